"""Token-id files: Parquet list columns that can be read selectively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from stationflow.llm.common import new_path, partitions, slices
from stationflow.llm.tokens import encoder


_LAYOUT = "spark.sql.parquet.writeLegacyFormat"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, encoding: str = "dictionary", compression: str = "lz4_raw", row_group_mb: int = 16, page_rows: int = 256) -> str:
    """Encode every document and write its ids in ascending doc_id order; returns the folder.

    The files hold doc_id, n_tokens, shard, before (ids of the shard's documents before
    this one) and ids (list of int). ``encoding`` is "dictionary" (small, for skewed
    ids) or "delta" (version 2 pages, DELTA_BINARY_PACKED). Row groups are bounded by
    ``row_group_mb``, pages by ``page_rows``; the writer adds page indexes, so a reader
    that filters on doc_id (sorted) or leaves out ids reads only those pages and columns.

    Null text counts as empty. Null doc_id comes first. Rows that share a doc_id stay
    apart, ordered by the length of their text, then by the text. An empty table gives files without rows.
    Further columns aren't written.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = F.octet_length("text")  # parts the rows of an id that many share, without a look at the texts
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", size).sortWithinPartitions("doc_id", size, "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for part in slices(batches):
            ids, n = enc.encode(part["text"], end_id)
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n), pa.array(np.full(len(n), shard)), pa.array(before + ends - n), lists], ["doc_id", "n_tokens", "shard", "before", "ids"])
            before += int(ends[-1])

    path = path or new_path(spark, "token-ids")
    schema = StructType([*[StructField(c, LongType()) for c in ("doc_id", "n_tokens", "shard", "before")], StructField("ids", ArrayType(IntegerType(), containsNull=False))])
    writer = ordered.mapInArrow(encode, schema).write
    options = {"parquet.block.size": row_group_mb << 20, "parquet.page.row.count.limit": page_rows, "compression": compression}
    if encoding == "delta":
        options |= {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"}
    # Lists without nulls as plain repeated numbers (the two-level layout): two fifths less time than with a group for each.
    before = spark.conf.get(_LAYOUT)
    spark.conf.set(_LAYOUT, "true")
    try:
        writer.options(**options).parquet(path)
    finally:
        spark.conf.set(_LAYOUT, before)
    return path


def read_token_files(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of the files in a doc_id range; only the columns that are used are read."""
    out = spark.read.schema("doc_id long, n_tokens long, shard long, before long, ids array<int>").parquet(path)
    if first is not None:
        out = out.filter(F.col("doc_id") >= first)
    return out if last is None else out.filter(F.col("doc_id") <= last)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, first): ids before each shard. One row per written partition."""
    totals = read_token_files(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) computed from the files alone."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["ids"]
            at, values = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy(zero_copy_only=False).view("<u4")).cast("B")
            crc = [zlib.crc32(values[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n = np.diff(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["shard"], b["before"], pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "shard", "before", "n_tokens", "ids_crc32"])

    rows = read_token_files(spark, path).select("doc_id", "shard", "before", "ids").mapInArrow(digest, "doc_id long, shard long, before long, n_tokens long, ids_crc32 long")
    # One row per partition of the write: its size is that number, whatever the input.
    starts = F.broadcast(shard_starts(spark, path))
    return rows.join(starts, "shard").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
