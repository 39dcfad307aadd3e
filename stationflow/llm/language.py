"""Language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import slices, unused, write_stage

_LETTER = regex.compile(r"\p{L}").search
#: ASCII other than a-z counts as a space; bytes of other letters stay.
_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigrams(text: str, bits: int) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, spaces around it."""
    a = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_TABLE) + b" ", np.uint8).astype(np.uint32)
    x = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    return (x * np.uint32(2654435761)) >> np.uint32(32 - bits)


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """(n, length) of +-1: every split of up to five classes, else random splits.

    A column and its complement are the same question, so the first class is +1.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1.0 if i == 0 or not (c >> (i - 1)) & 1 else -1.0 for c in range(1, 1 << (n - 1))] for i in range(n)])
    rng = np.random.default_rng(seed)
    length = 8 * int(np.ceil(np.log2(n))) + 7
    best = None
    for _ in range(max(1, min(200, 20_000_000 // (n * n)))):  # the widest gap between any two codewords; with very many classes the first try
        code = rng.choice([-1.0, 1.0], (n, length))
        alike = max(np.max(np.where(np.arange(k, min(k + 256, n))[:, None] == np.arange(n), -length, code[k : k + 256] @ code.T)) for k in range(0, n, 256))
        if best is None or alike < best[0]:
            best = alike, code
    return best[1]


class CodeModel:
    """One linear n-gram classifier per code bit, and loss-weighted decoding.

    The classifier of a bit compares the mean n-gram distribution of the languages
    on either side. A text's margin for a bit is the mean log ratio over its n-grams,
    scaled by its length up to ``full`` n-grams (few n-grams say little).
    """

    def __init__(self, langs: list[str], counts: Iterable[np.ndarray], bits: int, full: int = 100, scale: float = 6.0, gap: float = 0.02):
        """``counts``: the n-gram counts of each language, one after the other."""
        self.langs, self.bits, self.full, self.scale, self.gap = langs, bits, full, scale, gap
        self.code = codewords(len(langs))
        if not langs:  # nothing to learn from: every text is und
            return
        sums = np.zeros((2, self.code.shape[1], 1 << bits))
        for word, x in zip(self.code, counts, strict=True):
            p = (x + 0.5) / (x + 0.5).sum()
            sums[0, word > 0] += p
            sums[1, word < 0] += p
        mean = sums / np.maximum(np.stack([(self.code > 0).sum(0), (self.code < 0).sum(0)]), 1)[:, :, None]
        mean[1] = np.where((self.code < 0).any(0)[:, None], mean[1], mean[0])
        self.weights = np.log(mean[0] / mean[1]).T.astype(np.float32).copy()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if text is None or not self.langs or not _LETTER(text):
            return "und", 0.0, True
        idx = trigrams(text, self.bits)
        n = len(idx)
        hist = np.bincount(idx, minlength=1 << self.bits).astype(np.float32)
        margin = self.scale * (hist @ self.weights) / n * min(1.0, np.sqrt(n / self.full))
        loss = np.log1p(np.exp(-self.code * margin)).sum(1)  # the loss of each codeword, weighted by margins
        odds = np.exp(loss.min() - loss)
        order = np.argsort(loss, kind="stable")
        near = len(order) > 1 and loss[order[1]] - loss[order[0]] < self.gap
        return self.langs[order[0]], float(odds[order[0]] / odds.sum()), bool(near)


def held_out() -> Column:
    """Rows that are kept from learning: crc32 of the doc_id as text, mod 4, is 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit_language_model(docs: DataFrame, train: Column, bits: int = 14, at_once: int = 64) -> CodeModel:
    """Count hashed n-grams by language over all rows where ``train`` holds.

    Only n-gram totals by language reach the driver, one language after the other: 2**bits
    numbers each. A task hands on its counts when it holds ``at_once`` languages.
    """
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def out():
            for lang, x in total.items():
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(x[at])], ["lang", "bucket", "n"])
            total.clear()

        for b in slices(batches):
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                if lang not in total:
                    if len(total) == at_once:
                        yield from out()
                    total[lang] = np.zeros(1 << bits, np.int64)
                total[lang] += np.bincount(trigrams(text, bits), minlength=1 << bits)
        yield from out()

    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = write_stage(sums, "language-counts")
    langs = [r.lang for r in sums.select("lang").distinct().orderBy("lang").toLocalIterator()]

    def counts() -> Iterator[np.ndarray]:
        for r in sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).orderBy("lang").toLocalIterator():
            x = np.zeros(1 << bits)
            x[[y.bucket for y in r.x]] = [y.n for y in r.x]
            yield x

    return CodeModel(langs, counts(), bits)


def identify_language(docs: DataFrame, bits: int = 14) -> DataFrame:
    """Predict the language of every text.

    Adds held_out, lang_pred, score (0 to 1) and ambiguous to the columns of ``docs``
    (doc_id, text, lang and any others). Learns from rows with non-null text and lang
    that aren't held out; predictions use the text alone.

    Null text, or one without a letter: und, score 0, ambiguous. Null doc_id: never
    learned from, held_out null. Empty text: und. Ties between languages: the
    first by name, flagged ambiguous. Repeated rows: each gets the same answer. Empty
    table or nothing to learn from: every text is und. A column of ``docs`` with
    one of the added names is replaced.
    """
    added = ["held_out", "lang_pred", "score", "ambiguous"]
    rows = docs.select(*[c for c in docs.columns if c not in added])
    model = fit_language_model(rows, ~held_out(), bits)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size for a number of languages

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in texts:
            yield pd.DataFrame([m.predict(t) for t in s], columns=["lang_pred", "score", "ambiguous"])

    got = unused(rows, "p_")
    return rows.withColumn(got, predict("text")).select(*rows.columns, held_out().alias("held_out"), *[f"{got}.{x}" for x in added[1:]])
