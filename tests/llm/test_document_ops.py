import hashlib
import math
import re
import struct
import sys
import textwrap
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stationflow.llm import queries as Q
from stationflow.llm import topk
from stationflow.llm.components import connected_components
from stationflow.llm.decontaminate import contamination
from stationflow.llm.language import codewords, identify_language
from stationflow.llm.licenses import CUES, RULES, SENTENCES, scan_licenses
from stationflow.llm.neardup import SetSketch, near_duplicates, plausible, shingle_sets
from stationflow.llm.quality import resample_quality
from stationflow.llm.topk import exact_topk, kth_largest

DATA = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], "doc_id long, text string, lang string, component_id string, n_hit int")


ODD = [(1, None), (None, "one two three four five six"), (2, ""), (3, "  \n "), (4, "a"), (5, "a"), (5, "a"), (6, "12 34 !!"), (7, "wort " * 20000)]


# search

def brute_topk(rows, k=5, every=50):
    ok = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        vec = min(tuple(v) for i, v in ok if i == q)
        best = sorted((-int(np.dot(vec, v)), i) for i, v in ok if i != q and len(v) == len(vec))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_topk(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in Q.op1_exact_topk(spark, DATA).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_topk(rows)


@pytest.mark.parametrize("k,bins,block", [(1, 4, 2), (5, 16, 3), (50, 1024, 1024)])
def test_topk_odd_rows(spark, k, bins, block):
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.5, None]), (150, [float("nan"), 1.0]), (200, [0.0, -2.0]), (None, [9.0, 9.0]), (250, [1.0]), (300, [3e9, 3e9]), (350, []), (351, []), (400, [0.5] * 900), (401, [0.25] * 900)]
    rows += [(i, [0.25 * (i % 3), 0.5]) for i in range(1, 30)] + [(7, [0.25, 0.5]), (0, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], "id long, vector array<double>, score string")
    got = sorted(tuple(r) for r in exact_topk(df, F.col("id") % 50 == 0, k, bins=bins, block=block, query_block=2, at_once=2).collect())
    assert got == sorted(brute_topk(rows, k))
    assert exact_topk(df.limit(0), F.col("id") % 50 == 0, k).count() == 0


def test_topk_blocks(monkeypatch):
    """Blocks are bounded in vectors and in bytes, and hold every vector once, whatever the lengths."""
    monkeypatch.setattr(topk, "BLOCK_BYTES", 4000)
    rows = [(i, [float(i)] * (1, 0, 700, 3)[i % 4]) for i in range(200)]
    kind = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64()))])
    batches = [pa.RecordBatch.from_pylist([{"id": i, "vector": v} for i, v in rows[k : k + 30]], kind) for k in range(0, 200, 30)]
    found = []
    for b in topk._integers(iter(batches), 5):
        ids, v = np.frombuffer(b["ids"][0].as_py(), "<i8"), topk._vectors(b, 0)
        assert len(ids) == len(v) <= 5 and (v.nbytes <= 4000 or len(v) == 1)
        found += zip(ids.tolist(), v.tolist(), strict=True)
    assert sorted(found) == [(i, [256 * x for x in v]) for i, v in rows]


def test_kth_largest(spark):
    keys = [(int(k), i) for i, k in enumerate(np.random.default_rng(0).integers(-5, 5, 200))]
    df = spark.createDataFrame(keys, "key long, id long")
    order = sorted(keys, key=lambda x: (-x[0], x[1]))
    for k in (1, 7, 100, 200):
        assert kth_largest(df, k) == order[k - 1]
    assert kth_largest(df, 201) is None and kth_largest(df, 0) is None


# licences

def licences_by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    return sorted(con.execute(Q.oracle_sql()["op2_license_scan"]).fetchall())


def scanned(spark, rows):
    return {r.doc_id: (r.n_license_sentences, r.licenses) for r in scan_licenses(frame(spark, rows)).collect()}


def test_licenses_equal_sql(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in Q.op2_license_scan(spark, DATA).select("doc_id", "n_license_sentences", "licenses").collect()) == licences_by_sql(docs)


WRAPS = {
    "as written": lambda s: s,
    "wrapped": lambda s: textwrap.fill(s, 72),
    "narrow": lambda s: textwrap.fill(s, 30, break_long_words=False).replace("\n", "\r\n"),
    "# comment": lambda s: textwrap.indent(textwrap.fill(s, 72), "# "),
    "// comment": lambda s: textwrap.indent(textwrap.fill(s, 72), "   // "),
    "/* comment": lambda s: "/*\n" + textwrap.indent(textwrap.fill(s, 72), " * ") + "\n */",
    "list item": lambda s: "1. " + textwrap.fill(s, 60),
}


@pytest.mark.parametrize("wrap", WRAPS)
def test_every_sentence_and_rule_matches_itself(spark, wrap):
    w = WRAPS[wrap]
    assert all(re.search(CUES, s, re.I) for s in SENTENCES.values())
    rows = [(k, f"Some words before.\n\n{w(s)}\n\nAnd some behind it.") for k, s in enumerate(SENTENCES.values())]
    rows += [(1000 + k, "\n\n".join(w(SENTENCES[n]) + ("\n\nCopyright (c) 2020 Some One\n" if j == 0 else "") for j, n in enumerate(names))) for k, (_, names) in enumerate(RULES)]
    got = scanned(spark, rows)
    assert [k for k in range(len(SENTENCES)) if got[k][0] != 1] == []
    for k, (lic, names) in enumerate(RULES):
        assert got[1000 + k] == (len(names), f"{lic}:1"), (lic, names)
    assert sorted((i, *x) for i, x in got.items()) == licences_by_sql(rows)


def test_license_rules(spark):
    mit = "\n".join(SENTENCES[k] for k in ("mit-title-2", "mit-grant", "mit-condition", "as-is"))
    far = "\n".join("abcdefg")
    rows = [(10, mit), (11, "x\nMIT License\n" + SENTENCES["bsd-intro"]), (12, SENTENCES["mit-grant"] + f"\n{far}\n" + SENTENCES["mit-condition"]), (13, "Text. LICENSED UNDER the apache license, version 2.0!  More."), (14, "It is not released under the MIT License."), (15, mit + "\n" + mit + "\nReleased under the MIT License.\nAll rights reserved."), (16, "MIT\n\n\nLicense"), *ODD]
    got = scanned(spark, rows)
    assert [got[k][1] for k in (10, 11, 12, 13, 14, 15, 1, 2)] == ["MIT:1", "", "", "Apache-2.0:1", "", "MIT:3", "", ""]
    assert scan_licenses(frame(spark, rows)).count() == len(rows)
    assert scan_licenses(frame(spark, ODD).limit(0)).count() == 0
    clash = frame(spark, rows)
    for name in ("n", "d", "h", "found", "spans", "row_", "s_", "i_", "q_", "hash_", "licenses"):
        clash = clash.withColumn(name, F.lit("x"))
    out = scan_licenses(clash).collect()
    assert {r.doc_id: r.licenses for r in out} == {i: x[1] for i, x in got.items()} and all(r.d == r.row_ == "x" for r in out)


def test_licenses_as_published(spark):
    bsd = lambda holder, by, shall: "\n".join(["Copyright (c) 2008, Google Inc.", "All rights reserved.", SENTENCES["bsd-intro"], " * " + SENTENCES["bsd-source"], " * " + SENTENCES["bsd-binary"], " * " + SENTENCES["bsd-names"].replace("<name>", holder), SENTENCES["bsd-as-is"].replace("<name>", by), SENTENCES["bsd-no-event"].replace("<name>", shall)])
    mit = "\n".join(["The MIT License (MIT)", "Copyright (c) 2014 Some One", "All rights reserved.", SENTENCES["mit-grant"], SENTENCES["mit-condition"], SENTENCES["as-is"], SENTENCES["no-event"]])
    rows = {
        "BSD-3-Clause:1": [bsd("Google Inc.", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT OWNER OR CONTRIBUTORS"), bsd("the University", "THE REGENTS AND CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS"), bsd("the copyright holder", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS"), bsd("One Two, Three Four and Five Six of Seven Eight", "ITS AUTHOR", "ITS AUTHOR")],
        "MIT:1": [mit, "SPDX-License-Identifier: MIT"],
        "Apache-2.0:1,MIT:1": ["// SPDX-License-Identifier: (MIT OR Apache-2.0)", "# SPDX-License-Identifier: Apache-2.0 AND MIT\ncode here"],
        "BSD-3-Clause:1,GPL-2.0-only:1,MIT:1": ["/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT OR BSD-3-Clause */"],
        "GPL-2.0-or-later:1": ["SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0"],
        "Apache-2.0:1": ["\n".join(SENTENCES[k] for k in ("apache-notice-2", "apache-copy", "apache-basis", "apache-limits")) + "\nAll rights reserved."],
        "MPL-2.0:1": [SENTENCES["mpl-notice"] + " " + SENTENCES["mpl-copy"]],
        "GPL-3.0-or-later:1": ["\n".join(SENTENCES[k] for k in ("GPL-3.0-program", "gnu-warranty", "details-General"))],
        "proprietary:1": ["Copyright 2020 A Company. All rights reserved."],
        "": ["SPDX-License-Identifier: Foo OR MIT", "SPDX-License-Identifier: MIT OR", SENTENCES["bsd-names"].replace("<name>", " ".join("abcdefghijklm"))],
    }
    listed = [(want, text) for want, texts in rows.items() for text in texts]
    for wrap in (str, (lambda s: "\n".join(textwrap.fill(x, 60) for x in s.split("\n")))):
        docs = [(k, wrap(text)) for k, (_, text) in enumerate(listed)]
        got = scanned(spark, docs)
        assert {k: x[1] for k, x in got.items()} == {k: want for k, (want, _) in enumerate(listed)}
        assert sorted((i, *x) for i, x in got.items()) == licences_by_sql(docs)


# decontamination

def test_ascii_lower_changes_no_other_letter(spark):
    from stationflow.llm.common import ascii_lower

    letters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [("".join(letters[k : k + 997]),) for k in range(0, len(letters), 997)] + [(c,) for c in letters if c != c.lower() or c in "\u0130\u03a3"]
    for r in spark.createDataFrame(rows, "t string").withColumn("l", ascii_lower(F.col("t"))).collect():
        assert r.l == r.t.translate(UP)


def brute_contamination(docs, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for i, x in items:
        w = find((x or "").translate(UP))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, x in docs:
        w, found = find((x or "").translate(UP)), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if m := windows.get(tuple(w[k : k + n])):
                    found |= m
                    hit[k : k + n] = [True] * n
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(w), sum(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), 0 < sum(hit) and 20 * sum(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted((tuple(r) for r in Q.op6_benchmark_decontamination(spark, DATA).select(*cols).collect()), key=repr)
    assert got == brute_contamination(docs, items)


def test_decontamination_odd_rows(spark):
    say = " ".join(f"w{k}" for k in range(30))
    items = [(1, say), (2, "A a, a"), (3, None), (4, ""), (10, "wort"), (None, "five six"), (5, "x " * 20), (5, say)]
    docs = [*ODD, (20, say.upper() + " end"), (21, "b a A a a c"), (22, "x " * 40), (23, " ".join(say.split()[:12])), (24, say + " gap " + say)]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(frame(spark, docs), table).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated) for r in rows), key=repr)
    assert got == brute_contamination(docs, items)
    assert {r.n_hit for r in contamination(frame(spark, ODD), table.limit(0)).collect()} == {0}
    clash = frame(spark, docs)
    for name in ("d", "t", "h", "d_", "t_", "hash_", "row_", "k_", "n_", "i_", "start", "words", "item_id", "window"):
        clash = clash.withColumn(name, F.lit("x"))
    rows = contamination(clash, table.withColumn("doc_id", F.lit("y")).withColumn("len", F.lit("y"))).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in rows), key=repr) == sorted((x[:4] for x in got), key=repr) and all(r.hash_ == r.d_ == r.start == "x" for r in rows)
    assert contamination(frame(spark, docs), table.limit(1).filter("text is null")).count() == len(docs)
    assert contamination(frame(spark, ODD).limit(0), table).count() == 0


# quality and language

def test_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r.doc_id: r.selected for r in Q.op7_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    good, bad = [got[i] for i, q in labels.items() if q], [got[i] for i, q in labels.items() if not q]
    assert all(good) and sum(bad) < 0.1 * len(bad)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_quality_rejects_labelled_bad(spark, size):
    d = f"/root/testdata/{size}"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    texts = {r.doc_id: r.text.split() for r in spark.read.parquet(f"{d}/documents.parquet").filter("text is not null").collect()}
    rows = [r for r in Q.op7_quality_classifier(spark, d).collect() if r.doc_id in texts]
    good, bad = ([r for r in rows if labels.get(r.doc_id) == q] for q in (1, 0))
    repeated = [r for r in bad if len(set(texts[r.doc_id])) < 0.2 * len(texts[r.doc_id])]
    assert len(repeated) > 5 and len(bad) > 50
    for some, most in ((bad, 0.04), (repeated, 0.1)):
        assert sum(r.selected for r in some) <= most * len(some)
    assert sum(r.selected for r in good) >= 0.99 * len(good)


def test_quality_odd_rows(spark):
    rows = [*ODD, *[(i, f"clean plain words number {i % 5} here") for i in range(30, 60)], *[(i, "$$$ ### $$$ %%%") for i in range(60, 80)]]
    labels = spark.createDataFrame([(i, int(i < 60), None) for i in range(30, 80)] + [(None, 1, 0), (31, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows).withColumn("selected", F.lit("x"))
    out = resample_quality(docs, labels).collect()
    assert len(out) == len(rows)
    assert all(r.selected for r in out if r.doc_id and 30 <= r.doc_id < 60) and not any(r.selected for r in out if r.doc_id and r.doc_id >= 60)
    assert not any(r.selected for r in out if not (r.text or "").strip())
    assert sum(r.selected for r in resample_quality(docs, labels, keep=7).collect()) == 7
    assert all(r.selected for r in resample_quality(docs, labels.limit(0)).collect() if (r.text or "").strip())
    assert resample_quality(docs.limit(0), labels).count() == 0


def brute_quality(rows, labels, most=20_000, bits=16, temperature=0.002, seed=11):
    """log weight, key and choice of every (doc_id, text), number by number."""
    size = 1 << bits

    def grams(text):
        h = [zlib.crc32(t.encode()) for c in text.split() for t in re.findall(r"\w+|[^\w\s]+", c)]
        two = [(a * 2246822519 + b * 3266489917) % 2**32 for a, b in zip(h, h[1:], strict=False)]
        return [x >> (32 - bits) for x in [a * 2654435761 % 2**32 for a in h] + [t ^ (t >> 15) for t in two]]

    def hashed(i, *then):
        h = xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()
        for x in then:
            h = xxhash.xxh64(struct.pack("<i", x), seed=h).intdigest()
        return h - 2**64 if h >= 2**63 else h

    label = {}
    for i, q in labels:
        if i is not None and q is not None:
            label[i] = min(q, label.get(i, q))
    label = dict(sorted(label.items(), key=lambda x: (hashed(x[0]), x[0]))[:most])
    raw, target = [0.5] * size, [0.5] * size
    texts = {i: grams(t) for i, t in rows if t is not None}
    for i, g in texts.items():
        for x in g:
            raw[x] += 1
            target[x] += label.get(i, 0) > 0
    all_raw, all_target = sum(raw), sum(target)
    weight = {i: sum(math.log(target[x] / all_target) - math.log(raw[x] / all_raw) for x in g) / (len(g) + 4) if g else None for i, g in texts.items()}

    def apart(i):  # a labelled text's score without its own n-grams
        g, own = texts[i], Counter(texts[i]) if label[i] > 0 else Counter()
        return sum(math.log((target[x] - own[x]) / (all_target - own.total())) - math.log(raw[x] / all_raw) for x in g) / (len(g) + 4)

    seen = sorted((apart(i), label[i] > 0) for i in label if texts.get(i))
    good, bad = sum(g for _, g in seen), sum(not g for _, g in seen)
    error, k = min((sum(g for _, g in seen[: k + 1]) / good + sum(not g for _, g in seen[k + 1 :]) / bad, k) for k in range(len(seen) - 1) if seen[k][0] != seen[k + 1][0])
    threshold = (seen[k][0] + seen[k + 1][0]) / 2
    key = {i: math.floor((w / temperature - math.log(-math.log((hashed(i, seed) % 2**52 + 0.5) / 2**52))) * 1e6) for i, w in weight.items() if w is not None}
    keep = sum(w is not None and w >= threshold for w in weight.values())
    chosen = set(sorted(key, key=lambda i: (-key[i], i))[:keep])
    return {i: (weight.get(i), key.get(i), i in chosen) for i, _ in rows}


def test_quality_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    want = brute_quality(docs, labels)
    got = Q.op7_quality_classifier(spark, DATA).collect()
    assert len(got) == len(docs) and any(r.selected for r in got) and not all(r.selected for r in got)
    for r in got:
        weight, key, chosen = want[r.doc_id]
        assert (r.log_weight is None) == (weight is None) and r.selected == chosen
        if weight is not None:
            assert abs(r.log_weight - weight) < 1e-4 and abs(r.sample_key - key) < 1e5  # single precision weights over the temperature


def test_language_equals_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    bits = 14

    def grams(text):
        b = bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in f" {text.lower()} ".encode())
        return [((x << 16 | y << 8 | z) * 2654435761 % 2**32) >> (32 - bits) for x, y, z in zip(b, b[1:], b[2:], strict=False)]

    count = {}
    for i, text, lang in docs:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            count.setdefault(lang, Counter()).update(grams(text))
    langs = sorted(count)
    p = [[(count[x][k] + 0.5) / (count[x].total() + 0.5 * 2**bits) for k in range(2**bits)] for x in langs]
    code = codewords(len(langs))
    for r in Q.op8_language_id(spark, DATA).collect():
        text = next(t for i, t, _ in docs if i == r.doc_id)
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            assert r.lang_pred == "und"
            continue
        g, losses = grams(text), []
        side = lambda b, s: [k for k in range(len(langs)) if code[k][b] == s]
        ratio = lambda b, x: sum(p[k][x] for k in side(b, 1)) / len(side(b, 1)) * len(side(b, -1)) / sum(p[k][x] for k in side(b, -1))
        margin = [6 * sum(math.log(ratio(b, x)) * n for x, n in Counter(g).items()) / len(g) * min(1, math.sqrt(len(g) / 100)) for b in range(code.shape[1])]
        losses = [sum(math.log1p(math.exp(-c * m)) for c, m in zip(word, margin, strict=True)) for word in code]
        best = min(losses)
        assert langs[losses.index(best)] == r.lang_pred and abs(1 / sum(math.exp(best - x) for x in losses) - r.score) < 1e-4
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_letters_are_of_category_l(spark):
    rows = [(1, "½ ② ²"), (2, "1 2 3 ①"), (3, "٣ ๓"), (4, "a"), (5, "漢"), (6, "ʰ")] + [(k, "alpha beta gamma") for k in range(10, 30)]
    got = {r.doc_id: r.lang_pred for r in identify_language(frame(spark, rows)).collect()}
    assert [got[k] for k in range(1, 7)] == ["und", "und", "und", "en", "en", "en"]


def test_many_languages(spark):
    rows = [(k, f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 26 % 26)} " * 30, f"l{k % 600}") for k in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify_language(docs).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.25 * len(got) and len({r.lang_pred for r in got}) > 200
    assert len(codewords(3000)) == 3000


def test_language(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = Q.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and len(held) > 150
    assert np.mean([docs[r.doc_id] == r.lang_pred for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in got)
    code = codewords(4)
    assert min((code[i] != code[j]).sum() for i in range(4) for j in range(i)) == 4
    assert codewords(40).shape[0] == 40


def test_language_odd_rows(spark):
    rows = frame(spark, [*ODD, (50, "alpha beta")]).withColumn("score", F.lit("x"))
    out = {(r.doc_id, r.text): r for r in identify_language(rows).collect()}
    assert out[(1, None)].lang_pred == out[(2, "")].lang_pred == out[(6, "12 34 !!")].lang_pred == "und"
    assert out[(50, "alpha beta")].lang_pred == "en" and out[(None, ODD[1][1])].held_out is None
    assert {r.lang_pred for r in identify_language(rows.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify_language(rows.limit(0)).count() == 0


# near-duplicates

def brute_components(rows):
    sets = []
    for _, x in rows:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            c = len(s & sets[j])
            if c and 100 * c >= 85 * (len(s) + len(sets[j]) - c):
                part[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)], d == low[root(i)]) for i, (d, _) in enumerate(rows))


def near_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words, 120).tolist() for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(base[i % 4])
        for _ in range(rng.integers(0, 6)):
            w[rng.integers(0, len(w))] = str(rng.choice(words))
        rows.append((i * 3 % n, " ".join(w) if i % 7 else " ".join(base[0])))
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows(301)
    for block in (512, 32):
        got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect())
        assert got == brute_components(rows)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in Q.op9_minhash_neardup(spark, DATA).collect()) == brute_components(docs)


def test_near_duplicates_odd_rows(spark):
    out = near_duplicates(frame(spark, ODD)).collect()
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in out}
    assert len(out) == len(ODD)
    assert got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True) and got[(4, 1)] == (4, True) and got[(5, 1)] == (4, False)
    assert got[(None, 2)] == (None, True) and got[(7, 1)] == (7, True)
    assert near_duplicates(frame(spark, ODD).limit(0)).count() == 0


def test_shingle_sets():
    import pyarrow as pa

    texts = ["a b c d e f", None, "", " \t", "A  b\nC d É", "a b c d e f a b c d e f", " x ", "a b c d e", "\x0b\x1ca b"]
    sets, n = shingle_sets(pa.array(texts, pa.string()))
    assert n.tolist() == [2, 0, 0, 0, 1, 6, 1, 1, 1]
    ends = np.cumsum(n)
    one = [set(sets[e - m : e].tolist()) for e, m in zip(ends, n, strict=True)]
    assert one[0] < one[5] and one[7] < one[0] and not one[4] & one[7]
    for t, s in zip(texts, one, strict=True):  # alone or among others: the same fingerprints
        assert set(shingle_sets(pa.array([t], pa.string()))[0].tolist()) == s
    assert shingle_sets(pa.array([], pa.string()))[1].tolist() == []


def test_sketches():
    sk, rng = SetSketch(), np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[60:], rng.integers(0, 1 << 63, 60).astype(np.uint64)])
    sets = [a, b, np.union1d(a, b), a[:1], a[:40], a[:0], rng.integers(0, 1 << 63, 30000).astype(np.uint64)]
    regs = sk.registers(np.concatenate(sets), np.array([*map(len, sets)]))
    for s, r in zip(sets, regs, strict=True):  # alone or among others: the same registers
        if len(s):
            assert (sk.registers(s, np.array([len(s)]))[0] == r).all()
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()  # mergeable
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    ok, est = plausible(regs[0][None], np.array([float(len(a))]), regs[1][None], np.array([float(len(b))]), 0.85)
    assert ok[0] and abs(est[0] - j) < 0.1
    # every register is the least of exponential hashes: its mean tells the size
    for s, r in zip(sets, regs, strict=True):
        if len(s):
            size = len(sk.registers(s, np.array([len(s)]))[0]) / np.sum(1.001 ** -(r.astype(float) - (1 << 14) - 0.5))
            assert 0.8 < size / len(s) < 1.25


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (220, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    low = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(100):
        for a, b in pairs:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low


@pytest.mark.parametrize("name", ["op1_exact_topk", "op6_benchmark_decontamination", "op9_minhash_neardup"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in want.fetchall()) == sorted(tuple(r) for r in Q.queries()[name](spark, DATA).select(*names).collect())


# pipeline and guard

def test_pipeline(spark):
    import corpus_pipeline as P

    pieces = P.run(spark, DATA).collect()
    kept = {r.doc_id for r in pieces}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    lang = {r.doc_id for r in Q.op8_language_id(spark, DATA).filter("not ambiguous").collect()}
    rows = spark.createDataFrame([(i, docs[i]) for i in sorted(lang)], "doc_id long, text string")
    good = {r.doc_id for r in resample_quality(rows, spark.read.parquet(f"{DATA}/labels.parquet")).filter("selected").collect()}
    first = {c[0] for c in brute_components([(i, docs[i]) for i in sorted(good)]) if c[3]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {c[0] for c in brute_contamination([(i, docs[i]) for i in first], items) if not c[5]}
    assert kept == clean and len(kept) > 100
    assert [n for n, _ in P.STAGES] == ["language", "quality", "neardup", "decontaminate", "packing"]


def test_neardup_stage_odd_rows(spark):
    import corpus_pipeline as P

    a, b, c = ("one two three four five six seven", "a quite different text of its own words", "third text that nothing else in here is like")
    rows = [(None, a), (None, b), (None, None), (1, a), (1, a), (1, b), (2, c), (2, c), (3, a), (4, b), (4, "some more words that are only found in this row"), (5, None), (5, None)]
    got = P.neardup(spark, frame(spark, rows), DATA)
    assert got.columns == frame(spark, rows).columns
    want = [(None, a), (None, b), (None, None), (1, a), (1, b), (2, c), (4, "some more words that are only found in this row"), (5, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_stages_odd_rows(spark):
    import corpus_pipeline as P

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if labels.get(r.doc_id, 0)][:40]
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("length(text) > 200").first().text
    rows = [*ODD, *docs, docs[0], (None, docs[1][1]), (1_000_001, item), (None, item)]
    table = frame(spark, rows)
    for name in ("row_", "p_", "score", "ambiguous", "selected", "log_weight", "hash_", "n_words", "contaminated", "kept", "start", "length"):
        table = table.withColumn(name, F.lit("x"))
    gone = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, table, DATA)
        assert out.columns == table.columns and stage(spark, table.limit(0), DATA).count() == 0
        kept = out.collect()
        assert {r[c] for r in kept for c in ("row_", "p_", "score", "selected", "hash_")} == {"x"}
        gone[name] = Counter(rows) - Counter((r.doc_id, r.text) for r in kept)
    blank = [(1, None), (2, ""), (3, "  \n "), (6, "12 34 !!")]
    assert all(gone["language"][x] for x in blank) and not any(gone["language"][x] for x in docs)
    assert all(gone["quality"][x] for x in blank[:3]) and not any(gone["quality"][x] for x in docs)
    assert not any(gone["neardup"][x] for x in blank) and gone["neardup"][docs[0]] == 1 and gone["neardup"][(5, "a")] > 0
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {rows[c[0]] for c in brute_contamination([(k, t) for k, (_, t) in enumerate(rows)], items) if c[5]}
    assert set(gone["decontaminate"]) == bad and {(1_000_001, item), (None, item)} <= bad
    pieces = P.packing(spark, table, DATA).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0) and sum(r.start == 0 for r in pieces) == len(rows)


def test_entry_without_subpackage(monkeypatch):
    import importlib

    import __spark_entry__ as e

    with monkeypatch.context() as m:
        m.setitem(sys.modules, "stationflow.llm.queries", None)
        m.setitem(sys.modules, "stationflow.llm", None)
        m.setitem(sys.modules, "corpus_pipeline", None)
        e = importlib.reload(e)
        assert "g3_sample_index" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
    e = importlib.reload(e)
    assert "pipeline" in e.queries() and "op1_exact_topk" in e.queries()


# joins beyond the bound of broadcasts

@pytest.fixture
def no_broadcast(monkeypatch):
    from stationflow.llm import common

    monkeypatch.setattr(common, "BROADCAST_MB", 0)
    monkeypatch.setattr(common, "WORDS", 64)  # so that many rows are flagged in vain


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left"])
@pytest.mark.parametrize("n", [0, 5, 3000])
def test_join_few(spark, no_broadcast, how, n):
    from stationflow.llm.common import join_few

    left = spark.range(20_000).selectExpr("if(id % 7 = 0, null, id) as a", "id as b", "1 as maybe_")
    right = spark.range(n).selectExpr("id * 11 as k", "id as v")
    on = F.col("a") == F.col("k")
    assert rows_of(join_few(left, right, on, F.xxhash64("a"), F.xxhash64("k"), how)) == rows_of(left.join(right, on, how))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_small_salted(spark, no_broadcast, how):
    """A key with most of the rows comes from many parts, each row once."""
    from stationflow.llm.common import SALTS, join_small

    left = spark.range(6_000).selectExpr("if(id % 9 = 0, id, 1) as a", "id as b", "'x' as salt_")
    right = spark.range(1, 900).selectExpr("id as a", "id * 2 as v")
    got = join_small(left, right, "a", how, salt="b")
    assert rows_of(got.select("a", "b", "salt_", "v")) == rows_of(left.join(right, "a", how).select("a", "b", "salt_", "v"))
    assert f"sequence(0, {SALTS - 1}" in got._jdf.queryExecution().toString()


def test_large_families_beyond_broadcasts(spark, no_broadcast):
    """Families of many blocks, exact and near copies in them."""
    words = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join([*words[:40], f"x{i}", *words[41:]])) for i in range(40)] + [(100 + i, " ".join(f"y{i}-{k}" for k in range(30))) for i in range(6)] + [(200 + i, " ".join(words)) for i in range(9)]
    found = near_duplicates(frame(spark, rows).select("doc_id", "text"), block=4)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    lead = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    lead[b] = min(lead[a], lead[b])
    assert {(r.doc_id, r.component_id) for r in found.collect()} == set(lead.items()) and len(set(lead.values())) == 7


def test_same_rows_beyond_broadcasts(spark, no_broadcast):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name in ("op6_benchmark_decontamination", "op9_minhash_neardup"):
        got, sql = Q.queries()[name](spark, DATA), Q.oracle_sql()[name]
        assert rows_of(got) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall(), key=repr)


def test_neardup_stage_beyond_broadcasts(spark, no_broadcast):
    import corpus_pipeline

    rows = [(i, " ".join(f"w{(i % 9) * 50 + k}" for k in range(40))) for i in range(30)] + [(None, None), (3, None), (None, "a b c d e f"), (None, "a b c d e f"), (4, "x y z"), (4, "x y z"), (4, "other words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id int, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.neardup(spark, docs, DATA)
    assert kept.columns == docs.columns
    want = [(i, t) for i, t in rows[:9]] + [(None, None), (3, None), (None, "a b c d e f"), (None, "a b c d e f"), (4, "x y z"), (4, "other words")]
    assert sorted((tuple(r) for r in kept.select("doc_id", "text").collect()), key=repr) == sorted(want, key=repr)


def test_threshold_when_a_label_repeats(spark):
    from stationflow.llm.quality import NgramHasher, best_threshold, fit_quality

    docs = spark.createDataFrame([(1, "good words here")] * 300 + [(2, "bad things there")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    m = fit_quality(docs, labels)
    assert np.isfinite(m.threshold)
    one = lambda s, g: (np.array(s, float), np.array(s, float), np.array(g), 1 - np.array(g))
    assert best_threshold(*one([3, 1, 2, 4], [1, 0, 0, 1])) == 2.5 and best_threshold(*one([1, 2], [1, 1])) == float("-inf")
    few, many = NgramHasher(16, 2000), NgramHasher(16)
    import pyarrow as pa

    for k in range(5):
        texts = pa.array([" ".join(f"w{j}-{k}" for j in range(400)), None, "a" * 9000])
        assert all((x == y).all() for x, y in zip(few(texts), many(texts), strict=True))
    assert len(few.known) < 20
