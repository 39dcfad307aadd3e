"""Spelling variants, Merkle manifest and URL filter against brute force, and on odd rows."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from stationflow.llm import queries as Q
from stationflow.llm.merkle import merkle_manifest
from stationflow.llm.spelling import long_neighbours, spelling_variants, trie_neighbours
from stationflow.llm.url_filter import filter_urls, host_reputation, registered_domain, suffix_of, url_parts

DATA = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# spelling

def brute_spelling(docs, least=5):
    seen = Counter()
    for i, text in docs:
        for w in re.findall("[a-z\u00c0-\u00ff]+", (text or "").translate(UP)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                seen[w] += 1
    n = {w: c for w, c in seen.items() if c >= least}
    near = {w: set() for w in n}
    for a in n:
        for b in n:
            if abs(len(a) - len(b)) > 1 or a == b:
                continue
            k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            if a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]:
                near[a].add(b)
    form = {w: min(near[w], key=lambda b: (-n[b], b)) for w in n if near[w]}
    form = {w: b for w, b in form.items() if n[b] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_spelling_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert as_rows(Q.op11_spelling_variants(spark, DATA)) == brute_spelling(docs)


@pytest.mark.parametrize("longest", [8, 60])
def test_spelling_edits_anywhere(spark, longest):
    base = ["kitten", "sittings", "aaaaaaa", "aaaaaa", "élève\u00ffs", "elève\u00ffs", "abcdefghi", "a" * 59, "a" * 60, "a" * 61, "b" + "a" * 60, "a" * 30 + "b" + "a" * 29, "\u00d7\u00f7\u00d7\u00f7\u00d7\u00f7"]
    words = {w for b in base for k in range(len(b)) for w in (b, b[:k] + b[k + 1 :], b[:k] + "z" + b[k:], b[:k] + "q" + b[k + 1 :]) if len(b) < 20 or k in (0, 29, len(b) - 1)}
    text = " ".join(w + " " + w for w in sorted(words)) + " Kitten kitteN" * 40
    docs = [(i, text) for i in range(4)] + [(None, text.upper()), (9, None), (10, ""), (11, "1 2, 3! 日本語 x"), (11, text)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    assert as_rows(spelling_variants(df, longest=longest)) == brute_spelling(docs)
    assert spelling_variants(df.limit(0)).count() == 0


def test_long_words_like_short_ones(spark):
    words = sorted({"abcdefgh"[:k] + c + "abcdefgh"[k + 1 :] for k in range(8) for c in "xyz"} | {"abcdefgh", "abcdefg", "bcdefgh", "aabcdefgh", "abcddefgh"})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    both = lambda x: {(a, b) for p in x.collect() for a, b in (tuple(p), tuple(p)[::-1])}
    assert both(trie_neighbours(df)) == both(long_neighbours(df, 1))


# manifest

def H(*x):
    return sha256("".join(x).encode()).hexdigest()


def brute_manifest(docs):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(enc, (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def tree(nodes):
        ways, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            above, under = [], []
            for i in range(0, len(nodes), 3):
                run = nodes[i : i + 3]
                for j in range(len(run)):
                    for k in below[i + j]:
                        ways[k].append((run[:j], run[j + 1 :]))
                above.append(H(*run))
                under.append([k for x in below[i : i + 3] for k in x])
            nodes, below = above, under
        return nodes[0], ways

    by = {}
    for r in docs:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        rows = sorted(by[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees.append((rows, *tree([leaf(r, r.text) for r in rows])))
    root, over = tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (rows, sub, ways), up in zip(trees, over):
        for r, way in zip(rows, ways):
            own = now = leaf(r, r.text)
            if r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                now = leaf(r, r.text.replace("\n", ""))
            for a, b in way + up:
                now = H(*a, now, *b)
            out.append((r.doc_id, own, sub, root, H(*[x for a, b in way + up for x in a + b]), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, height):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 7 < 4, "hot").when(F.col("doc_id") % 11 == 0, F.concat(F.lit("one"), "doc_id")).otherwise(F.col("source")))
    got = merkle_manifest(docs, height=height).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(docs.collect())


def test_manifest_odd_rows(spark):
    rows = [(1, "a\nb", "en", "s", 3), (1, "a\nb", "en", "s", 3), (None, None, None, None, None), (None, "x\n", None, None, 2), (2, "", "en", "s", 0), (7, "\n" * 9, "en", "\u00e9", 9), (3, "wort \n" * 50000, "de", "s", 0), (1, "other\n", "en", "s", 3), (4, "t\n", "en", "", 1)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, part int")
    assert sorted(map(tuple, merkle_manifest(df, height=1).collect()), key=repr) == brute_manifest(df.collect())
    assert merkle_manifest(df.limit(0)).count() == 0
    assert merkle_manifest(df.limit(1)).filter("subroot = leaf and root = leaf").count() == 1


# URLs

def test_url_parts(spark):
    urls = ["http://A.Example.COM/En/x?q=/y#z", "https://h", "//h/p", None, "", "x://y://z/w", "http://u@h:8?x", "ftp://h#/a", "http:///p", "http://\u00c9.de/\n/q"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    want = [("a.example.com", "/En/x"), ("h", ""), ("", ""), ("", ""), ("", ""), ("y:", "//z/w"), ("u@h:8", ""), ("h", ""), ("", "/p"), ("\u00c9.de", "/\n/q")]
    assert [tuple(r) for r in df.select(*url_parts(F.col("url"))).collect()] == want
    hosts = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.co.uk", "co.uk", "x.y.com", "y.com", "com", "")], "h string")
    assert [tuple(r) for r in hosts.select(suffix_of(F.col("h")), registered_domain(F.col("h"))).collect()] == [("co.uk", "b.co.uk"), ("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("com", "y.com"), ("com", "y.com"), ("com", "com"), ("", "")]


def test_rules(spark):
    urls = {"http://com/": "com/", "http://x.com": None, "http://telecom/": None, "http://a.example.com/en/1": "example.com/en/", "http://m.www.example.com/en/": "www.example.com/en/", "http://www.example.com/en": "com/", "http://b.net/es/": "net/es/", "http://b.net/de/": None, "http://example.com/EN/": "com/"}
    df = spark.createDataFrame([(u, None, "x") for u in urls], "url string, bad boolean, verdict string")
    got = {r.url: (r.rule, r.verdict) for r in filter_urls(df, Q.URL_RULES).collect()}
    block = {"example.com/en/", "net/es/"}
    assert got == {u: (r, "block" if r in block else "allow") for u, r in urls.items()}


def test_reputation_is_shrunk(spark):
    rows = [("bad.one.com", True)] * 60 + [("new.one.com", None)] * 3 + [("good.two.com", False)] * 200 + [("good.two.com", True)] * 2 + [("once.three.com", True)] + [(f"h{k}.two.com", k % 9 == 0) for k in range(90)]
    df = spark.createDataFrame([(f"http://{h}/p", b, 1) for h, b in rows], "url string, bad boolean, host int")
    got = {r.host: r for r in filter_urls(df).collect()}
    assert {h for h, r in got.items() if r.verdict == "block"} == {"bad.one.com", "new.one.com"}  # the second by its domain alone
    assert got["new.one.com"].n_labelled == 0 and got["bad.one.com"].n_labelled == 60
    seen = {r.host: r for r in host_reputation(df.select(url_parts(F.col("url"))[0].alias("host"), "bad")).collect()}
    assert seen["good.two.com"].rate < 0.05 < seen["once.three.com"].rate < 1
    assert seen["once.three.com"].bound < 0.5 < seen["bad.one.com"].bound  # one outcome is no evidence
    assert seen["new.one.com"].rate > seen["h1.two.com"].rate  # its domain's


def test_reputation_odd_rows(spark):
    df = spark.createDataFrame([(None, True), ("", None), ("nohost", False), ("http://a.b/" + "x" * 300000, None)], "url string, bad boolean")
    assert {(r.host, r.verdict) for r in filter_urls(df).collect()} == {("", "allow"), ("a.b", "allow")}
    clash = df
    for name in ("h_", "k", "n", "m_", "domain", "suffix", "prior", "Host", "rule"):
        clash = clash.withColumn(name, F.lit("x"))
    assert {(r.host, r.verdict, r.h_) for r in filter_urls(clash).collect()} == {("", "allow", "x"), ("a.b", "allow", "x")}
    assert filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in filter_urls(df.withColumn("bad", F.lit(None).cast("boolean"))).collect()} == {"allow"}
