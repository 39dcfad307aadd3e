"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.common import ascii_lower, join_few, join_small, write_stage

#: What parts words once A-Z is lower-cased: ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same where the case is left as it is.
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def count_words(text: Column) -> Column:
    """Number of words of a text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS_ANY_CASE), "")).cast("long")


def _windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (window: its words, by single spaces; len), and which items have them (window, item_id)."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    n = F.size("words")
    length = F.least(n, F.lit(window))
    cut = words.select("item_id", length.alias("len"), F.explode(F.transform(F.sequence(F.lit(1), n - length + 1), lambda i: F.array_join(F.slice("words", i, length), " "))).alias("window"))
    return cut.select("window", "len").distinct(), cut.select("window", "item_id").distinct()


def _shingles(windows: DataFrame, width: int) -> DataFrame:
    """(window, len, at, width, hash): the shingles of each window. A window of fewer than ``width`` words is one shingle."""
    w = F.least("len", F.lit(width))
    words = F.split("window", " ")
    at = windows.select("window", "len", w.alias("width"), F.explode(F.sequence(F.lit(0), F.col("len") - w)).alias("at"))
    return at.select("window", "len", "at", "width", F.xxhash64("width", F.array_join(F.slice(words, F.col("at") + 1, F.col("width")), " ")).alias("hash"))


def _occurrences(docs: DataFrame, width: int, widths: list[int]) -> DataFrame:
    """(doc_id, text_hash, n_words, pos, hash): the shingles of every document, of each of ``widths`` up to ``width``."""
    words = F.col("words")
    zipped = F.arrays_zip(words.alias("w0"), *[F.slice(words, F.lit(k + 1), F.greatest(F.size(words), F.lit(1))).alias(f"w{k}") for k in range(1, width)])
    text = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    rows = text.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.posexplode(zipped).alias("pos", "s"))

    def shingle(w: int) -> Column:  # null where the text ends before
        return F.when(F.col(f"s.w{w - 1}").isNotNull(), F.xxhash64(F.lit(w), F.concat_ws(" ", *[f"s.w{k}" for k in range(w)])))

    keep = ["doc_id", "text_hash", "n_words", "pos"]
    if len(widths) == 1:
        return rows.select(*keep, shingle(widths[0]).alias("hash")).filter(F.col("hash").isNotNull())
    return rows.select(*keep, F.explode(F.array(*[shingle(w) for w in widths])).alias("hash")).filter(F.col("hash").isNotNull())


def find_benchmark(docs: DataFrame, items: DataFrame, window: int = 13, width: int = 5) -> DataFrame:
    """Where windows of benchmark items occur in documents: doc_id, text_hash, start (from 0), len, window.

    The sets are the word shingles of a window and of a document, and containment asks for all of a window's
    shingles, so any one of them is a sufficient prefix. Shingles are ordered by rarity: one pass over the documents
    counts those that windows have, and a window with one that never occurs is out. Only the rarest
    shingle of each window is then joined with the documents. Its offset, the window's length and
    the document's bound where the window can lie; there the words themselves are compared.
    """
    windows, _ = _windows(items, window)
    shingles = write_stage(_shingles(windows, width), "decontam-shingles")
    widths = sorted(r.width for r in shingles.select("width").distinct().limit(width).collect())
    if not widths:  # no item has a word
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, start int, len int, window string")
    occurrences = _occurrences(docs, width, widths)

    # Order by rarity; counts alone leave the tasks, no occurrence is written.
    count = join_small(occurrences.select("hash"), shingles.select("hash").distinct(), "hash").groupBy("hash").agg(F.count("*").alias("n"))
    ranked = shingles.join(count, "hash", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "hash")).alias("p")
    prefix = ranked.groupBy("window", "len").agg(rarest).filter("p.n > 0").select("window", "len", "p.at", "p.hash")
    prefix = write_stage(prefix, "decontam-prefix")

    # Join the prefixes, within the bounds.
    start = F.col("pos") - F.col("at")
    near = join_small(occurrences, prefix, "hash").filter((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    candidates = near.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(start.alias("start"), "len", "window")).alias("c"))
    candidates = write_stage(candidates, "decontam-candidates")

    # Verify on the words, one row a document.
    keys = candidates.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = join_few(texts, keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), F.col("text_hash"), F.col("h"), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    named = candidates.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "c")
    both = texts.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("doc_id", "text_hash", words_of(F.col("text")).alias("words"), "c")
    same = F.filter("c", lambda x: F.array_join(F.slice("words", x["start"] + 1, x["len"]), " ") == x["window"])
    return both.select("doc_id", "text_hash", F.explode(same).alias("x")).select("doc_id", "text_hash", "x.*")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, width: int = 5) -> DataFrame:
    """How much of each document is covered by windows of benchmark items.

    A window is ``window`` consecutive words of an item; an item of fewer words, but
    not none, is one window. Adds n_words, n_hit (words inside any occurrence),
    item_ids (sorted as strings), n_items and contaminated (n_hit > 0 and 20 n_hit >= n_words) to the
    columns of ``docs``.

    Null or empty text: no words, not contaminated. Null doc_id: judged like any other. Null item
    text: no window; null item_id: its windows hit, but it isn't listed. Repeated
    rows: each gets the same answer. Empty table on either side: no row or no hit.
    Columns of ``docs`` with an added name are replaced; any others may have any name.
    """
    added = ["n_words", "n_hit", "item_ids", "n_items", "contaminated"]
    docs = docs.select(*[c for c in docs.columns if c not in added])
    items = items.select("item_id", "text")
    hits = write_stage(find_benchmark(docs.select("doc_id", "text"), items, window, width), "decontam-hits")

    # Words covered by any occurrence: what each interval adds beyond those that start before it.
    spans = hits.groupBy("doc_id", "text_hash", "start").agg((F.col("start") + F.max("len")).alias("end"))
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(order), F.lit(0))
    new = F.greatest(F.col("end") - F.greatest("start", reached), F.lit(0)).alias("new")
    covered = spans.select("doc_id", "text_hash", new).groupBy("doc_id", "text_hash").agg(F.sum("new").alias("n_hit"), F.lit(None).cast("array<string>").alias("ids"))
    _, item_windows = _windows(items, window)
    named = join_small(hits, item_windows, "window").groupBy("doc_id", "text_hash").agg(F.lit(None).cast("long").alias("n_hit"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    found = covered.unionByName(named).groupBy("doc_id", "text_hash").agg(F.max("n_hit").alias("n_hit"), F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))
    found = write_stage(found.select(F.col("doc_id").alias("d_"), F.col("text_hash").alias("t_"), F.col("n_hit").alias("n_"), F.col("ids").alias("i_")), "decontam-found")

    rows = docs.select(F.struct(*docs.columns).alias("row_"), F.col("doc_id").alias("k_"), F.xxhash64("text").alias("h_"), count_words(F.col("text")).alias("w_"))
    out = join_few(rows, found, F.col("k_").eqNullSafe(F.col("d_")) & (F.col("h_") == F.col("t_")), F.col("h_"), F.col("t_"), "left")
    n_hit = F.coalesce("n_", F.lit(0)).cast("long")
    ids = F.coalesce("i_", F.array().cast("array<string>"))
    return out.select("row_.*", F.col("w_").alias("n_words"), n_hit.alias("n_hit"), ids.alias("item_ids"), F.size(ids).cast("long").alias("n_items"), ((n_hit > 0) & (20 * n_hit >= F.col("w_"))).alias("contaminated"))
