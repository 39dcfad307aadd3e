"""Packing documents into fixed-length sequences along a space-filling curve."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import partitions, slices, write_stage
from stationflow.llm.tokens import encoder


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer ``points`` (n, dims) below 2**bits.

    The usual two passes over the coordinates: undo the rotations from the top
    bit down, take the Gray code, then interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] & (1 << b)) != 0, flip ^ ((1 << b) - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class CurveOrder:
    """Hilbert key of a document: signed hashed counts of its ids, normalised,
    projected to a few dimensions by a fixed random matrix and put on a grid."""

    def __init__(self, vocab: int, buckets: int = 256, dims: int = 4, bits: int = 10, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bucket = rng.integers(0, buckets, vocab)
        self.sign = rng.choice([-1.0, 1.0], vocab)
        self.matrix = np.round(rng.normal(size=(buckets, dims)) * 4096)  # whole numbers: sums are exact in any order
        self.buckets, self.bits = buckets, bits

    def keys(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A key for each document of ``n`` ids."""
        row = np.repeat(np.arange(len(n)) * self.buckets, n)
        v = np.bincount(row + self.bucket[ids], self.sign[ids], len(n) * self.buckets).reshape(len(n), self.buckets)
        at = v @ self.matrix / (4096 * np.maximum(np.sqrt((v * v).sum(1)), 1e-9))[:, None]
        grid = (0.5 + 0.5 * np.tanh(0.8 * at)) * (1 << self.bits)
        return hilbert_key(np.clip(grid, 0, (1 << self.bits) - 1), self.bits)


def powers(n: int) -> list[int]:
    """``n`` as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, vocab: int = 1 << 16, segment: int = 8192) -> DataFrame:
    """Pack every document into sequences of ``length`` tokens, neighbours on the curve together.

    ``docs`` needs doc_id and text. Returns one row per piece: doc_id, start, length,
    ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Ids are sorted in segments of at most ``segment``, so rows have a bounded size and ranges
    of the curve hold about as many ids each, however long its documents are.
    The ids of a range fill sequences one after the other; a document is
    cut where a sequence is full. What is left at the end of a range is cut into
    sequences whose lengths are powers of two, so nothing needs padding.

    The vocabulary may have up to 65,536 ids.

    Null or empty text: the document is its end token alone. Null doc_id: packed, and
    returned with null. Repeated rows: each packed for itself. Ties on the curve go by
    doc_id, then by a checksum of the ids. Empty table: no rows. Other columns are ignored. A text of
    any length is cut over as many sequences as it needs.
    """
    spark = docs.sparkSession
    # "length" and "start" may also be names of the input: only two columns are read.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    columns = ["doc_id", "key", "crc", "start", "total", "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, order = encoder(tokenizer, "<u2"), CurveOrder(vocab)
        for part in slices(batches):
            ids, n = enc.encode(part["text"], end_id)
            keys, flat = order.keys(ids, n), ids.tobytes()
            ends = 2 * np.cumsum(n)
            out = []
            for d, k, total, end in zip(part["doc_id"].to_pylist(), keys.tolist(), n.tolist(), ends.tolist(), strict=True):
                whole = flat[end - 2 * total : end]
                out += [(d, k, crc32(whole), at // 2, total, whole[at : at + 2 * segment]) for at in range(0, 2 * total, 2 * segment)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=True)], columns)

    # Written once: the range sort samples its input, which must not encode twice.
    encoded = write_stage(rows.mapInArrow(encode, "doc_id long, key long, crc long, start long, total long, ids binary"), "packing")
    by = ["key", "doc_id", "crc", "start"]
    ordered = encoded.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        held: list[tuple] = []  # pieces of the sequence being filled: at most one per token
        fill = 0

        def rows_of(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        size = 0
        for b in batches:
            for doc, start, total, ids in zip(*[b[c].to_pylist() for c in ("doc_id", "start", "total", "ids")], strict=True):
                ids = np.frombuffer(ids, "<u2").astype("<u4")
                at, here = 0, len(ids)
                while at < here:
                    n = min(length - fill, here - at)
                    last = held[-1] if held else None
                    if last and last[0] == doc and last[4] == total and last[1] + last[2] == start + at:  # the segment before ends here
                        held[-1] = (doc, last[1], last[2] + n, last[3] + ids[at : at + n].tobytes(), total, sequence, last[6])
                    else:
                        held.append((doc, start + at, n, ids[at : at + n].tobytes(), total, sequence, fill))
                    at, fill = at + n, fill + n
                    if fill == length:
                        out += held
                        held, fill, sequence = [], 0, sequence + 1
                        size += length
                if size >= 1 << 20:
                    yield rows_of(out)
                    out, size = [], 0
        rest = [[0, n, sequence + k] for k, n in enumerate(powers(fill))]
        for doc, start, n, ids, total, _, _ in held:
            at = 0
            while at < n:
                r = rest[0]
                m = min(r[1] - r[0], n - at)
                out.append((doc, start + at, m, ids[4 * at : 4 * (at + m)], total, r[2], r[0]))
                at, r[0] = at + m, r[0] + m
                if r[0] == r[1]:
                    rest.pop(0)
        if out:
            yield rows_of(out)

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return ordered.select("doc_id", "start", "total", "ids").mapInArrow(pack, schema)
