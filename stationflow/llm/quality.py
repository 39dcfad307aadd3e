"""Quality selection by importance resampling of hashed n-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import slices, write_stage
from stationflow.llm.topk import kth_largest

_TOKENS = re.compile(r"\w+|[^\w\s]+").findall


class NgramHasher:
    """Buckets of the 1- and 2-grams of texts' words and punctuation runs.

    Tokens are hashed once per distinct chunk between white space of a slice of texts; what is remembered
    is bounded and doesn't change results.
    """

    def __init__(self, bits: int, most: int = 48 << 20):
        """``most``: bytes that may be remembered."""
        self.shift, self.most, self.known, self.held = np.uint32(32 - bits), most, {}, 0

    def _chunk(self, chunk: str) -> bytes:
        return np.array([zlib.crc32(t.encode("utf-8", "replace")) for t in _TOKENS(chunk)], np.uint32).tobytes()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, the place of the text of each, their number by text) of all texts; null counts as empty."""
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        coded = split.values.dictionary_encode()
        at, begin = coded.indices.to_numpy(), split.offsets.to_numpy()
        chunks, known = coded.dictionary.to_pylist(), self.known
        parts = [known.get(c) for c in chunks]
        for k, part in enumerate(parts):
            if part is None:
                parts[k] = part = self._chunk(chunks[k])
                self.held += 220 + 4 * len(chunks[k]) + len(part)  # a slice's own chunks are bounded by the slice
                if self.held > self.most:
                    known.clear()
                    self.held = 0
                if len(part) < 4096:
                    known[chunks[k]] = part
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), np.uint32)))
        h = lists.take(pa.array(at)).flatten().to_numpy()
        tokens = np.diff(np.concatenate([[0], np.cumsum(size[at])])[begin])
        row = np.repeat(np.arange(len(tokens)), tokens)
        two = h[:-1] * np.uint32(2246822519) + h[1:] * np.uint32(3266489917)
        inside = row[1:] == row[:-1]
        grams = np.concatenate([h * np.uint32(2654435761), (two ^ (two >> np.uint32(15)))[inside]]) >> self.shift
        return grams, np.concatenate([row, row[1:][inside]]), tokens + np.maximum(tokens - 1, 0)


def _slices(texts: pd.Series) -> Iterator[pa.Array]:
    for part in slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["text"])]):
        yield part["text"]


def bounded_labels(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled documents, chosen by a hash of doc_id; conflicting
    labels of one document count as the lower one."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


class RatioModel:
    """log p_target / p_raw by bucket, and the threshold that parts the labelled documents."""

    prior = 4  # n-grams without evidence that each text counts besides its own

    def __init__(self, ratio: np.ndarray, threshold: float, bits: int):
        self.ratio, self.threshold, self.bits = ratio.astype(np.float32), threshold, bits


def fit_quality(docs: DataFrame, labels: DataFrame, bits: int = 16, most_labels: int = 20_000) -> RatioModel:
    """Fit both generative models and the threshold.

    The raw model counts the n-grams of every document. The target model counts those
    of the good documents among at most ``most_labels`` labelled ones (chosen by hash).
    The threshold is where the two labelled classes are told apart best; good documents are
    scored for it without their own n-grams in the target model, like the good ones that have no
    label. Without rejected examples it is minus infinity.
    """
    buckets = 1 << bits
    # most_labels rows at most, by the limit above
    marked = docs.select("doc_id", "text").join(F.broadcast(bounded_labels(labels, most_labels)), "doc_id", "left").filter(F.col("text").isNotNull()).select("text", F.col("quality").cast("int").alias("quality"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, raw, target = NgramHasher(bits), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in slices(batches):
            x, row, _ = grams(b["text"])
            raw += np.bincount(x, minlength=buckets)
            good = pc.fill_null(pc.greater(b["quality"], 0), False).to_numpy(zero_copy_only=False)
            if good.any():
                target += np.bincount(x[good[row]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    sums = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(buckets, 0.5), np.full(buckets, 0.5)
    got = sums.toArrow()  # 2**bits rows at most
    at = got["bucket"].to_numpy()
    raw[at] += got["raw"].to_numpy()
    target[at] += got["target"].to_numpy()
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    model = RatioModel(ratio, float("-inf"), bits)
    held_out = held_out_udf(docs.sparkSession, raw, target, bits)("text", F.col("quality") > 0)
    seen = marked.filter(F.col("quality").isNotNull()).select((F.col("quality") > 0).alias("good"), held_out.alias("s"))
    step = F.floor(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("s"))) * 2000)  # 200,001 bins at most, however often labelled ids repeat
    bins = seen.groupBy(F.when(F.col("s") > float("-inf"), step).alias("bin")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"), F.min("s").alias("low"), F.max("s").alias("high")).toArrow()
    model.threshold = best_threshold(*[bins[c].to_numpy() for c in ("low", "high", "good", "bad")])
    return model


def best_threshold(low: np.ndarray, high: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """Midpoint between two bins of scores (lowest, highest, good and bad ones) with the least balanced error; minus infinity without both classes."""
    if not good.sum() or not bad.sum():
        return float("-inf")
    order = np.argsort(low, kind="stable")
    low, high, good, bad = low[order], high[order], good[order], bad[order]
    error = np.cumsum(good) / good.sum() + 1 - np.cumsum(bad) / bad.sum()  # rejecting the first k + 1 bins
    k = int(np.argmin(error[:-1])) if len(error) > 1 else 0
    if error[k] >= 1 or len(error) == 1:
        return float("-inf")
    return float((high[k] + low[k + 1]) / 2) if high[k] > float("-inf") else float(low[k + 1])


def held_out_udf(spark, raw: np.ndarray, target: np.ndarray, bits: int):
    """The score of a text; a good one's own n-grams are taken out of the target model first."""
    shared = spark.sparkContext.broadcast((raw, target))  # 2**bits numbers each

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        raw, target = shared.value
        grams, all_raw, all_target = NgramHasher(bits), raw.sum(), target.sum()
        for texts, good in batches:
            out, marks = [], iter(good)
            for part in _slices(texts):
                x, row, n = grams(part)
                x = x[np.argsort(row, kind="stable")]
                for own, g in zip([next(marks) for _ in range(len(n))], np.split(x, np.cumsum(n)[:-1]), strict=True):
                    if not len(g):
                        out.append(float("-inf"))
                        continue
                    at, k = np.unique(g, return_counts=True)
                    took = k if own else np.zeros_like(k)
                    ratio = np.log((target[at] - took) / (all_target - took.sum())) - np.log(raw[at] / all_raw)
                    out.append(float((ratio * k).sum()) / (k.sum() + RatioModel.prior))
            yield pd.Series(out, dtype=float)

    return score


def score_udf(spark, model: RatioModel):
    shared = spark.sparkContext.broadcast(model)  # 2**bits numbers

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        grams, ratio = NgramHasher(m.bits), m.ratio.astype(np.float64)
        for s in texts:
            out = [np.zeros(0)]
            for part in _slices(s):
                x, row, n = grams(part)
                total = np.bincount(row, ratio[x], len(n))  # text by text in order: the same in any slice
                out.append(np.where(n > 0, total / (n + m.prior), -np.inf))
            yield pd.Series(np.concatenate(out))

    return score


def gumbel(seed: int) -> Column:
    """A Gumbel draw by doc_id: the same at every run and partitioning."""
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def resample_quality(docs: DataFrame, labels: DataFrame, keep: int | None = None, temperature: float = 0.002, bits: int = 16, most_labels: int = 20_000, seed: int = 11) -> DataFrame:
    """Importance resampling towards the labelled good documents.

    Adds log_weight (mean log ratio of the target and raw models over a text's
    n-grams, drawn a little to 0 for short texts), sample_key (log_weight / temperature plus a Gumbel draw) and selected to
    the columns of ``docs``. The ``keep`` largest keys are selected, which is sampling
    without replacement with probability in proportion to the tempered weight. ``keep``
    None: as many as lie at or above the threshold that parts the labelled classes.

    Null, empty or blank text: log_weight null, never selected. Null doc_id: scored like any
    other. Ties of the key go to the smaller doc_id; rows that share a doc_id and
    a text share their fate. No labels: all documents with text are selected. Empty table: no
    rows. A column of ``docs`` with one of the added names is replaced.
    """
    spark = docs.sparkSession
    rows = docs.select(*[c for c in docs.columns if c not in ("log_weight", "sample_key", "selected")])
    model = fit_quality(rows, labels, bits, most_labels)
    s = score_udf(spark, model)("text")
    scored = rows.withColumn("log_weight", s).withColumn("log_weight", F.when(F.col("log_weight") > float("-inf"), F.col("log_weight")))
    # In steps of 1e-6, so that the histogram's bins are whole numbers.
    scored = scored.withColumn("sample_key", F.floor((F.col("log_weight") / temperature + gumbel(seed)) * 1e6).cast("long"))
    scored = write_stage(scored, "quality")  # scored once for the count, the histograms and the result
    keys = scored.filter(F.col("sample_key").isNotNull()).select(F.col("sample_key").alias("key"), F.coalesce("doc_id", F.lit(-(1 << 62))).alias("id"))
    if keep is None:
        keep = scored.filter(F.col("log_weight") >= model.threshold).count()
    last = kth_largest(keys, keep)
    if last is None:
        chosen = F.col("sample_key").isNotNull() if keep > 0 else F.lit(False)
    else:
        key, doc = last
        chosen = (F.col("sample_key") > key) | ((F.col("sample_key") == key) & (F.coalesce("doc_id", F.lit(-(1 << 62))) <= doc))
    return scored.withColumn("selected", F.coalesce(chosen, F.lit(False)))
