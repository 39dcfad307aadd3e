"""Exact selection of the largest values by histograms, without a global sort."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.common import drop_stage, write_stage


def _locate(values: DataFrame, k: int, bins: int = 4096) -> tuple[int, int] | None:
    """The k-th largest of the long column v and how many are larger; None if fewer than k."""
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if k <= 0 or n < k:
        return None
    above = 0
    while low < high:
        width = (high - low) // bins + 1
        part = values.filter(F.col("v").between(low, high)).groupBy(F.floor((F.col("v") - F.lit(low)) / F.lit(width)).alias("bin"))
        for b, c in sorted(part.count().collect(), reverse=True):  # as many rows as bins
            if above + c >= k:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            above += c
    return low, above


def kth_largest(rows: DataFrame, k: int) -> tuple[int, int] | None:
    """(key, id) of the k-th row by key descending, id ascending; None if fewer than k.

    ``rows`` has the long columns key and id. Each round counts one histogram of at most
    4096 bins and narrows the range to the bin that holds the k-th value; ties are
    parted by a second search over their ids.
    """
    if (found := _locate(rows.select(F.col("key").alias("v")), k)) is None:
        return None
    key, above = found
    ties = rows.filter(F.col("key") == key).select((-F.col("id")).alias("v"))
    value, _ = _locate(ties, k - above)
    return key, -value


#: Bytes of a block of candidates, and of the queries that are broadcast at once.
BLOCK_BYTES, BROADCAST_BYTES = 16 << 20, 32 << 20


def _floors(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vector: it, the places of those vectors, and floor(256 x) with one row a vector."""
    length = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(256.0 * vectors.flatten().to_numpy(zero_copy_only=False))
    start = np.cumsum(length) - length
    for dim in np.unique(length).tolist():
        at = np.flatnonzero(length == dim)
        yield dim, at, flat[start[at][:, None] + np.arange(dim)]


def _integers(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``block`` vectors of one length: ids and floor(256 x) as bytes; fewer where vectors are long."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out(dim: int) -> Iterator[pa.RecordBatch]:
        parts = held.pop(dim)
        ids, vectors = np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])
        step = max(1, min(block, BLOCK_BYTES // (8 * max(dim, 1))))
        for k in range(0, len(ids), step):
            part = [pa.array([x[k : k + step].tobytes()], pa.binary()) for x in (ids.astype("<i8"), vectors.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *part], ["dim", "ids", "vectors"])

    for b in batches:
        ids = b["id"].to_numpy(zero_copy_only=False)
        for dim, at, vectors in _floors(b["vector"]):
            held.setdefault(dim, []).append((ids[at], vectors))
            size += vectors.nbytes + 8 * len(at)
        if size >= BLOCK_BYTES:
            for dim in list(held):
                yield from out(dim)
            size = 0
    for dim in list(held):
        yield from out(dim)


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a query: its id, and floor(256 x) as bytes."""
    for b in batches:
        for dim, at, vectors in _floors(b["vector"]):
            whole = [pa.array(np.full(len(at), dim, np.int32)), pa.array([v.tobytes() for v in vectors.astype("<f8")], pa.binary())]
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at)), *whole], ["query_id", "dim", "vector"])


_BLOCK = "dim int, ids binary, vectors binary"


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if q.size and c.size and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] >= 2.0**53:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return (q @ c.T).astype(np.int64)


def _vectors(b: pa.RecordBatch, i: int) -> np.ndarray:
    dim = b["dim"][i].as_py()
    flat = np.frombuffer(b["vectors"][i].as_buffer(), "<f8")
    return flat.reshape(-1, dim) if dim else np.zeros((b["ids"][i].as_buffer().size // 8, 0))


def _parts(b: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(b.num_rows):
        ids = np.frombuffer(b["ids"][i].as_buffer(), "<i8")
        c = _vectors(b, i)
        asked = b["queries"][i].values
        qid, low, width = (asked.field(x).to_numpy(zero_copy_only=False) for x in ("query_id", "low", "width"))
        q = np.frombuffer(b"".join(asked.field("vector").to_pylist()), "<f8").reshape(len(qid), c.shape[1])
        s = _scores(q, c)
        yield qid, low, width, ids, s, qid[:, None] != ids[None, :]


def exact_topk(vectors: DataFrame, is_query, k: int = 5, bins: int = 1024, block: int = 1024, query_block: int = 256, at_once: int = 16) -> DataFrame:
    """The ``k`` candidates with the highest scores for each query, exactly.

    ``vectors`` has id (long) and vector (array of double); rows where ``is_query``
    holds are queries, every row is a candidate of every query but its own id. The
    score is the inner product of floor(256 x). Returns query_id, rank, id, score; fewer than k
    rows only where there are fewer candidates.

    Every round scores all pairs in blocks and counts, for each query, a histogram over its
    current score range; a block reports only the bins down to its own k-th value. The bin
    with the k-th value becomes the next range, until it is one score wide. The last pass
    keeps what lies above that score, and of the ties the k smallest ids of a block.
    Queries go ``at_once`` blocks of about ``query_block`` at a time, fewer where their vectors are long, so what is
    broadcast is bounded by those parameters and by ``BROADCAST_BYTES``.

    Null ids, null vectors and vectors with null or non-finite components take no part.
    Vectors are compared only with those of the same length. Repeated rows are separate
    candidates; a query id that occurs more than once is asked once, with its least vector.
    Ties go to the smaller id. Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), is_query.alias("asks")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite)
    cands = write_stage(usable.select("id", "vector").mapInArrow(lambda it: _integers(it, block), _BLOCK), "topk-candidates")
    asked = usable.filter("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    asked = write_stage(asked.select("id", "vector").mapInArrow(_queries, "query_id long, dim int, vector binary"), "topk-queries")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("vector") + 40), F.lit(0))).first()
    groups = max(1, math.ceil(n / (query_block * at_once)), math.ceil(size / BROADCAST_BYTES))
    part = F.pmod(F.xxhash64("query_id"), F.lit(groups * at_once)).cast("int")
    asked = asked.withColumn("part", part)

    # The widest possible range of scores, from the largest length of any vector.
    def norms(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((_vectors(b, i) ** 2).sum(1).max(initial=0.0))) for i in range(b.num_rows)], pa.float64())], ["norm"])

    top = cands.mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0] or 0.0
    reach = int(min(top * top, 2.0**61)) + 1
    schema = "query_id long, rank int, id long, score long"
    if n == 0:
        return spark.createDataFrame([], schema)

    def pairs(state: DataFrame) -> list[DataFrame]:
        blocks = state.groupBy("part", "dim").agg(F.collect_list(F.struct("query_id", "vector", "low", "width")).alias("queries"))
        # at_once blocks of queries in each broadcast
        return [cands.join(F.broadcast(blocks.filter(F.col("part").between(g * at_once, (g + 1) * at_once - 1))), "dim") for g in range(groups)]

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qid, low, width, _, s, other in _parts(b):
                at = np.clip((s - low[:, None]) // width[:, None], -1, bins)  # bins: above the range
                at = np.where(other, at, -1) + 1 + (bins + 2) * np.arange(len(qid))[:, None]
                x = np.bincount(at.ravel(), minlength=(bins + 2) * len(qid)).reshape(-1, bins + 2)[:, 1:]
                down = np.cumsum(x[:, ::-1], 1)[:, ::-1]
                q, bin_ = np.nonzero((x > 0) & (down - x < k))
                yield pa.RecordBatch.from_arrays([pa.array(qid[q]), pa.array(bin_), pa.array(x[q, bin_])], ["query_id", "bin", "n"])

    width = (2 * reach) // bins + 1
    state = asked.withColumn("low", F.lit(-reach).cast("long")).withColumn("width", F.lit(width).cast("long"))
    down, before = Window.partitionBy("query_id").orderBy(F.desc("bin")), asked
    while True:
        counts = union([p.mapInArrow(histogram, "query_id long, bin long, n long") for p in pairs(state)]).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        run = counts.withColumn("run", F.sum("n").over(down))
        # The bin of the k-th value; with fewer than k candidates the lowest bin that has any.
        at = run.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("run") >= k, F.col("bin"))), F.lit(-1)).alias("bin"), F.max("run").alias("all"))
        state = state.join(at, "query_id", "left")
        # Fewer than k candidates: everything counts, so the threshold is the bottom of the range.
        bottom = F.col("low") + F.greatest(F.col("bin"), F.lit(0)) * F.col("width")
        few = F.coalesce(F.col("bin") < 0, F.lit(True))
        narrow = F.greatest(F.floor((F.col("width") - 1) / bins) + 1, F.lit(1)).cast("long")
        state = state.select("query_id", "dim", "vector", "part", F.when(few, F.col("low")).otherwise(bottom).cast("long").alias("low"), F.lit(narrow if width > 1 else F.lit(1)).cast("long").alias("width"))
        state = write_stage(state, "topk-state")
        drop_stage(before)
        before = state
        if width == 1:
            break
        width = (width - 1) // bins + 1

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qid, low, _, ids, s, other in _parts(b):
                q, c = np.nonzero((s >= low[:, None]) & other)
                order = np.lexsort((ids[c], -s[q, c], q))
                q, c = q[order], c[order]
                first = np.arange(len(q)) - np.searchsorted(q, q) < k  # the k best of each query
                q, c = q[first], c[first]
                yield pa.RecordBatch.from_arrays([pa.array(qid[q]), pa.array(ids[c]), pa.array(s[q, c])], ["query_id", "id", "score"])

    best = union([p.mapInArrow(final, "query_id long, id long, score long") for p in pairs(state)])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
