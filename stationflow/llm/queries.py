"""Queries of the training-data operators with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm.common import join_small
from stationflow.llm.decontaminate import contamination
from stationflow.llm.html_text import extract_text
from stationflow.llm.language import identify_language
from stationflow.llm.licenses import oracle as licenses_oracle
from stationflow.llm.licenses import scan_licenses
from stationflow.llm.merkle import merkle_manifest
from stationflow.llm.neardup import near_duplicates
from stationflow.llm.packing import pack_documents
from stationflow.llm.quality import resample_quality
from stationflow.llm.spelling import spelling_variants
from stationflow.llm.token_counts import count_tokens
from stationflow.llm.token_files import token_digests, write_token_files
from stationflow.llm.topk import exact_topk
from stationflow.llm.url_filter import DOUBLE_SUFFIXES, filter_urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    best = exact_topk(vectors, F.col("id") % 50 == 0, k=5)
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_license_sentences", "licenses")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_words", "n_tokens")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resample_quality(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.round("log_weight", 9).alias("log_weight"), "sample_key", "selected")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_language(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_digests(spark, path)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(_read(spark, sf_dir, "documents"))


#: (host, path, verdict).
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no labels of pages: those of ``labels`` are taken by the page's id; of low quality or toxic is a bad outcome."""
    labels = _read(spark, sf_dir, "labels").filter("quality is not null or toxic is not null")
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    pages = join_small(_read(spark, sf_dir, "pages").select("page_id", "url"), bad, ["page_id"], "left")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "n_labelled", "bad_bound")


def queries() -> dict:
    return {
        "op1_exact_topk": op1_exact_topk,
        "op2_license_scan": op2_license_scan,
        "op3_html_extraction": op3_html_extraction,
        "op4_token_counts": op4_token_counts,
        "op5_packing": op5_packing,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_language_id": op8_language_id,
        "op9_minhash_neardup": op9_minhash_neardup,
        "op10_token_files": op10_token_files,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_url_filters": op13_url_filters,
    }


TOPK_SQL = """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every window of every document beside every window of every item.
CONTAMINATION_SQL = f"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
cuts AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS i FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS win FROM cuts),
sizes AS (SELECT DISTINCT n FROM wanted),
places AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS win FROM places) p JOIN wanted x USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

#: All pairs that share a shingle, and all that can be reached from each document.
NEARDUP_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
cuts AS (SELECT doc_id, w, least(len(w), 5) AS n, unnest(range(0, len(w) - least(len(w), 5) + 1)) AS i FROM docs WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + n], ' ') AS s FROM cuts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS low FROM docs UNION SELECT b, low FROM reach JOIN ways ON a = node WHERE low < b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT node, min(low) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id
"""


#: The checksum's table from its rule, and the checksum of a text's UTF-8 bytes.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"


def _crc32(text: str) -> str:
    units = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {units}), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295)"


#: Words by what is left of them without each of their letters.
SPELLING_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT id, w, count(*) AS c FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
hashed AS (SELECT w, c, {_crc32("(id || ':' || w)")} AS h FROM runs, crc),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cuts AS (SELECT word, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
found AS (SELECT x.word, y.word AS other FROM cuts x JOIN cuts y ON x.a = y.a AND x.b = y.b AND x.word <> y.word UNION SELECT x.word, y.word FROM cuts x JOIN words y ON y.word = x.a || x.b),
near AS (SELECT word, other FROM found UNION SELECT other, word FROM found),
ranked AS (SELECT x.word, other, y.n AS m, count(*) OVER (PARTITION BY x.word) AS n_near, row_number() OVER (PARTITION BY x.word ORDER BY y.n DESC, other) AS r FROM near x JOIN words y ON y.word = other),
known AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (word)),
up AS (SELECT word, word AS seen, form AS further FROM known UNION ALL SELECT u.word, k.word, k.form FROM up u JOIN known k ON k.word = u.further)
SELECT word, form, seen AS root, n, n_near, form_n FROM known JOIN (SELECT word, seen FROM up WHERE further IS NULL) USING (word)
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Every level of every tree, and each row's siblings on its way up.
MERKLE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
rows AS (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS tampered FROM documents, crc),
leaves AS (SELECT *, coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM rows),
nodes AS (SELECT g, 0 AS lvl, i, leaf AS h, c FROM leaves
          UNION ALL SELECT g, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (c + 2) // 3 FROM nodes WHERE c > 1 GROUP BY g, lvl, c, i // 3),
subs AS (SELECT g, h, lvl AS height, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS c FROM nodes WHERE c = 1),
tops AS (SELECT 0 AS lvl, i, h, c FROM subs UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (c + 2) // 3 FROM tops WHERE c > 1 GROUP BY lvl, c, i // 3),
own AS (SELECT doc_id, leaf, tampered, l.g, l.i, s.h AS subroot, s.i AS k, s.height, row_number() OVER () AS id FROM leaves l JOIN subs s USING (g)),
steps AS (SELECT id, 0 AS tree, n.lvl, n.i < o.i // CAST(pow(3, n.lvl) AS BIGINT) AS before, n.i, n.h FROM own o JOIN nodes n ON n.g = o.g AND n.c > 1 AND n.i // 3 = o.i // CAST(pow(3, n.lvl + 1) AS BIGINT) AND n.i <> o.i // CAST(pow(3, n.lvl) AS BIGINT)
          UNION ALL SELECT id, 1, n.lvl, n.i < o.k // CAST(pow(3, n.lvl) AS BIGINT), n.i, n.h FROM own o JOIN tops n ON n.c > 1 AND n.i // 3 = o.k // CAST(pow(3, n.lvl + 1) AS BIGINT) AND n.i <> o.k // CAST(pow(3, n.lvl) AS BIGINT)),
levels AS (SELECT id, 0 AS tree, unnest(range(0, height)) AS lvl FROM own UNION ALL SELECT id, 1, unnest(range(0, (SELECT max(lvl) FROM tops))) FROM own),
sides AS (SELECT id, tree, lvl, coalesce(string_agg(h, '' ORDER BY i) FILTER (before), '') AS a, coalesce(string_agg(h, '' ORDER BY i) FILTER (NOT before), '') AS b FROM levels LEFT JOIN steps USING (id, tree, lvl) GROUP BY ALL),
ways AS (SELECT id, string_agg(a || b, '' ORDER BY tree, lvl) AS proof, list(a || '|' || b ORDER BY tree, lvl) AS way FROM sides GROUP BY id),
folded AS (SELECT o.*, coalesce(proof, '') AS proof, list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(way, [])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS f FROM own o LEFT JOIN ways USING (id))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM folded, (SELECT h AS root FROM tops WHERE c = 1)
"""

_DOUBLE = ", ".join(f"'{x}'" for x in DOUBLE_SUFFIXES)


def _rate(of: str, by: str) -> str:
    """Rates of the groups ``of`` (by, k, n, prior) under the prior of their level."""
    r = "greatest(0.001, least(0.9, coalesce((SELECT CASE WHEN sum(n * (n - 1) * prior * (1 - prior)) > 0 THEN sum(pow(k - n * prior, 2) - n * prior * (1 - prior)) / sum(n * (n - 1) * prior * (1 - prior)) END FROM {0}), CAST(1 AS DOUBLE) / 3)))".format(of)
    return f"SELECT {by}, k, n, k + m * prior AS a, n - k + m * (1 - prior) AS b, (k + m * prior) / (n + m) AS rate FROM {of}, (SELECT 1 / {r} - 1 AS m)"


URL_SQL = f"""
WITH labelled AS (SELECT doc_id AS page_id, max(CAST(coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS INT)) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules (h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
ruled AS (SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict FROM split LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
labels_of AS (SELECT host, CAST(coalesce(sum(bad), 0) AS BIGINT) AS k, count(bad) AS n, string_split(host, '.') AS l FROM split LEFT JOIN labelled USING (page_id) GROUP BY host),
ends AS (SELECT host, k, n, l, array_to_string(l[-2:], '.') AS two FROM labels_of),
hosts AS (SELECT host, k, n, CASE WHEN two IN ({_DOUBLE}) THEN array_to_string(l[-3:], '.') ELSE two END AS domain, CASE WHEN two IN ({_DOUBLE}) THEN two ELSE l[-1] END AS suffix FROM ends),
base AS (SELECT (coalesce(sum(k), 0) + 0.5) / CAST(coalesce(sum(n), 0) + 1 AS DOUBLE) AS prior FROM hosts),
s AS (SELECT suffix, sum(k) AS k, sum(n) AS n, any_value(prior) AS prior FROM hosts, base GROUP BY suffix),
s_rate AS ({_rate("s", "suffix")}),
d AS (SELECT domain, sum(h.k) AS k, sum(h.n) AS n, any_value(rate) AS prior FROM hosts h JOIN s_rate USING (suffix) GROUP BY domain),
d_rate AS ({_rate("d", "domain")}),
h AS (SELECT host, h.k, h.n, rate AS prior FROM hosts h JOIN d_rate USING (domain)),
h_rate AS ({_rate("h", "host")}),
bounds AS (SELECT host, n AS n_labelled, round(rate - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))), 9) AS bad_bound FROM h_rate)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad_bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, n_labelled, bad_bound FROM ruled JOIN bounds USING (host)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_topk": TOPK_SQL,
        "op2_license_scan": licenses_oracle(),
        "op6_benchmark_decontamination": CONTAMINATION_SQL,
        "op9_minhash_neardup": NEARDUP_SQL,
        "op11_spelling_variants": SPELLING_SQL,
        "op12_merkle_manifest": MERKLE_SQL,
        "op13_url_filters": URL_SQL,
    }
