"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Capitals beyond A-Z, and blocks that have some of late: what else lower() could change.
OTHER_CAPITALS = r"[\x{80}-\x{FFFF}&&[\p{javaUpperCase}\p{javaTitleCase}]]|[\x{2C00}-\x{2C5F}\x{A720}-\x{A7FF}\x{10000}-\x{10FFFF}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none and runs on one machine (tests), a temporary folder is
    set; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a cut in the lineage
    that survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Remove the folder of a written stage that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes in ``column``, so that what is made of one is bounded."""
    for b in batches:
        if b.num_rows:
            part = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
            cut = (np.flatnonzero(np.diff(part)) + 1).tolist()
            for i, j in zip([0, *cut], [*cut, b.num_rows], strict=True):
                yield b.slice(i, j - i)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay. Texts without any other capital take the faster way."""
    return F.when(col.rlike(OTHER_CAPITALS), F.translate(col, UPPER, LOWER)).otherwise(F.lower(col))


def fits(df: DataFrame, mb: int) -> bool:
    """Whether the rows of ``df`` take at most about ``mb`` MB: numbers as 16 bytes each, others by their length.

    Reads no more rows than could fit by their number.
    """
    most = (mb << 20) // (16 * len(df.columns))
    size = F.lit(16 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        if kind == "string":
            size = size + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
        elif kind == "array<string>":
            size = size + F.coalesce(F.octet_length(F.array_join(F.col(name), "", "")) + 16 * F.size(F.col(name)), F.lit(0))
        elif kind.startswith(("array", "struct", "map", "binary")):
            return False
    rows, total = df.select(size.alias("size")).limit(most + 1).agg(F.count("*"), F.sum("size")).first()
    return rows <= most and (total or 0) <= mb << 20


#: MB up to which the right side of a join is broadcast.
BROADCAST_MB = 16
#: Parts over which a salted join deals the rows of a key.
SALTS = 64
#: Numbers of 64 bits that ``flag_possible`` broadcasts at most.
WORDS = 1 << 20


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", mb: int | None = None, salt: str | None = None) -> DataFrame:
    """Join that broadcasts ``right`` only if it is proven to take at most ``mb`` MB,
    and is otherwise an ordinary shuffled join.

    With ``salt``, a column of ``left``, the shuffled join deals the rows of each key (one column, ``on``) over ``SALTS`` parts and
    copies ``right`` to all of them, so that a key with many rows of ``left`` isn't one task. ``how``: inner or left.
    """
    if fits(right, BROADCAST_MB if mb is None else mb):
        return left.join(F.broadcast(right), on, how)
    if salt is None:
        return left.join(right, on, how)
    name = unused(left, "salt_")
    dealt = left.withColumn(name, F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return dealt.join(right.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [on, name], how).drop(name)


def flag_possible(left: DataFrame, key: Column, hashes: DataFrame, name: str) -> DataFrame:
    """``left`` with ``name``: false where the hash ``key`` is certainly none of ``hashes`` (h); never false for one that is.

    The hashes are put in a set of bits, of which at most ``WORDS`` numbers are broadcast, however many hashes there are: with n of
    them about n / (64 * WORDS) of the others are flagged too.
    """
    word = lambda h: F.pmod(F.shiftright(h, 6), F.lit(WORDS))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    at, held = unused(left, "word_of_bits_"), unused(left, "bits_")
    bits = hashes.groupBy(word(F.col("h")).alias(at)).agg(F.bit_or(bit(F.col("h"))).alias(held))
    return left.join(F.broadcast(bits), word(key) == F.col(at), "left").withColumn(name, F.coalesce(F.col(held).bitwiseAND(bit(key)) != 0, F.lit(False))).drop(at, held)


def join_few(left: DataFrame, right: DataFrame, on: Column, key: Column, hash_: Column, how: str = "inner") -> DataFrame:
    """Join with a ``right`` that concerns few of the rows of ``left``, which may be wide: broadcast if it is proven small; beyond that
    only rows of ``left`` whose hash ``key`` may be among the hashes ``hash_`` of ``right`` are shuffled, the others keep their place.

    ``how``: inner, left_semi or left.
    """
    if fits(right, BROADCAST_MB):
        return left.join(F.broadcast(right), on, how)
    flag = unused(left, "maybe_")
    flagged = flag_possible(left, key, right.select(hash_.alias("h")), flag)
    out = flagged.filter(flag).drop(flag).join(right, on, how)
    return out.unionByName(flagged.filter(~F.col(flag)).drop(flag), allowMissingColumns=True) if how == "left" else out
