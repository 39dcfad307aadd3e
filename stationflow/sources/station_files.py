"""Readers of station archives, report files and series tables; writers."""

from __future__ import annotations

import gzip
import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stationflow.functions.expr import dms_to_deg, nan_to_null
from stationflow.operators.timegrid import parse_epoch

_SCHEMA = "archive string, site string, epoch string, total double, wet double"


def _text(data: bytes) -> Iterator[str]:
    """Lines of every member of a zip of gzips; members that can't be read are skipped."""
    try:
        box = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    for name in box.namelist():
        try:
            raw = box.read(name)
            yield from (gzip.decompress(raw) if name.endswith(".gz") else raw).decode("utf-8", "replace").splitlines()
        except (OSError, EOFError, zipfile.BadZipFile):
            continue


def section(lines: Iterator[str], name: str) -> Iterator[list[str]]:
    """Tokens of the lines of a section, without its comments."""
    inside = False
    for line in lines:
        s = line.strip()
        if s.startswith("+"):
            inside = s[1:].startswith(name)
        elif s.startswith("-"):
            inside = False
        elif inside and s and not s.startswith("*"):
            yield s.split()


def ingest_station_archives(spark: SparkSession, path: str, step_s: int, start: str, end: str, closed: bool = True, glob: str = "*.zip") -> DataFrame:
    """(station_id, ts, total, wet) from zips of gzipped text, on whole steps, between start and end.

    One archive a row; files that don't match ``glob`` aren't opened. The later record of a slot wins.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return exact_slots(archive_records(files), step_s, start, end, closed)


def archive_records(files: DataFrame) -> DataFrame:
    """(archive, site, epoch, total, wet) of the archives (path, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                rows = [(p.rsplit("/", 1)[-1], t[0], t[1], t[2], t[4]) for t in section(_text(content), "TROP/SOLUTION") if len(t) >= 5]
                out = pd.DataFrame(rows, columns=["archive", "site", "epoch", "total", "wet"])
                out["total"], out["wet"] = pd.to_numeric(out["total"], errors="coerce"), pd.to_numeric(out["wet"], errors="coerce")
                yield out

    return files.select("path", "content").mapInPandas(parse, _SCHEMA)


def timed_records(rows: DataFrame, step_s: int) -> DataFrame:
    """Records with a time (ts) on whole steps, and their station_id."""
    ok = rows.filter(F.col("epoch").rlike(r"^\d\d:\d{1,3}:\d{1,5}$")).withColumn("ts", parse_epoch(F.col("epoch")))
    return ok.filter(F.unix_seconds("ts") % step_s == 0).withColumn("station_id", F.upper("site"))


def latest_records(rows: DataFrame) -> DataFrame:
    """(station_id, ts, archive, total, wet): of the records of a slot the one of the last archive."""
    return rows.groupBy("station_id", "ts").agg(F.max(F.struct("archive", "total", "wet")).alias("r")).select("station_id", "ts", "r.*")


def exact_slots(rows: DataFrame, step_s: int, start: str, end: str, closed: bool) -> DataFrame:
    ok = timed_records(rows, step_s).filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    ok = ok.filter(F.col("ts") <= F.lit(end).cast("timestamp") if closed else F.col("ts") < F.lit(end).cast("timestamp"))
    return latest_records(ok).select("station_id", "ts", nan_to_null("total").alias("total"), nan_to_null("wet").alias("wet"))


def ingest_station_catalog(spark: SparkSession, path: str, ids: DataFrame, glob: str = "*.zip") -> DataFrame:
    """(station_id, lat, lon, height_m) of each id: from the newest archive whose SITE/ID line can be read, else NULL."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                for t in section(_text(content), "SITE/ID"):
                    try:
                        rows.append((p.rsplit("/", 1)[-1], t[0].upper(), *[float(x) for x in t[-7:]]))
                        break
                    except ValueError:
                        continue
            yield pd.DataFrame(rows, columns=["archive", "station_id", "lod", "lom", "los", "lad", "lam", "las", "height_m"])

    got = files.mapInPandas(parse, "archive string, station_id string, lod double, lom double, los double, lad double, lam double, las double, height_m double")
    newest = got.groupBy("station_id").agg(F.max_by(F.struct("lod", "lom", "los", "lad", "lam", "las", "height_m"), "archive").alias("s"))
    newest = newest.select("station_id", dms_to_deg("s.lad", "s.lam", "s.las").alias("lat"), dms_to_deg("s.lod", "s.lom", "s.los").alias("lon"), F.col("s.height_m").alias("height_m"))
    return ids.join(newest, "station_id", "left")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN marks a missing value in the files; NULL does in the engine. Every scan of this module goes through here."""
    return df.select(*[nan_to_null(F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes])


def file_hour(path: Column) -> Column:
    """Hour in a name such as surf_2024010106, of a file or of a folder of part files."""
    return F.try_to_timestamp(F.regexp_extract(path, r"(\d{10})(?:\.\w+)?(?:/part-[^/]+)?$", 1), F.lit("yyyyMMddHH"))


def scan_report_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reports with the hour of their file."""
    df = spark.read.schema(schema).parquet(path)
    return without_nan(df.select("*", file_hour(F.col("_metadata.file_path")).alias("ts")))


def missing_hours(reports: DataFrame) -> DataFrame:
    """Hours between the first and the last that have no file."""
    have = reports.select("ts").distinct()
    axis = have.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("ts"))
    return axis.join(have, "ts", "left_anti")


def scan_checked(spark: SparkSession, path: str, required: list[str], key: list[str]) -> DataFrame:
    """A table with the required columns and no duplicate key; rows without a key go."""
    df = spark.read.parquet(path)
    if lost := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {lost}")
    df = without_nan(df).na.drop(subset=key)
    if df.groupBy(*key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"duplicate keys: {key}")
    return df


def scan_wide_csv(spark: SparkSession, path: str, schema: str, target: str, features: str = "M") -> DataFrame:
    """date, features, target; S keeps the target only."""
    df = without_nan(spark.read.csv(path, header=True, schema=schema))
    if features == "S":
        return df.select("date", target)
    return df.select("date", *[c for c in df.columns if c not in ("date", target)], target)


def scan_labelled_csv(spark: SparkSession, path: str, schema: str, label_last: bool = False) -> DataFrame:
    """Without its first column, missing values 0; the last column is the label if ``label_last``."""
    df = without_nan(spark.read.csv(path, header=True, schema=schema))
    df = df.drop(df.columns[0]).na.fill(0)
    return df.withColumnRenamed(df.columns[-1], "label") if label_last else df


def melt_variables(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    return df.unpivot(keys, variables, "variable", "value")


def spread_variables(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot("variable", variables).agg(F.first("value"))


def explode_nested(df: DataFrame, key: list[str], values: str) -> DataFrame:
    return without_nan(df.select(*key, F.posexplode(values).alias("step", "value")))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, max_rows: int = 5_000_000) -> None:
    """zstd Parquet with bounded files."""
    w = df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", max_rows)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, order: str, buckets: int) -> DataFrame:
    """The rows as a table bucketed by ``key`` and sorted within it, one file a bucket; returned as a scan of the table.

    Windows and aggregations by the key, and joins with tables of as many buckets, need no exchange of such a scan. For joins on the key
    and further columns set ``spark.sql.requireAllClusterKeysForCoPartition`` to false.
    """
    spread = df.repartition(buckets, key)  # deals rows out as buckets are
    spread.write.mode("overwrite").option("compression", "zstd").bucketBy(buckets, key).sortBy(key, order).saveAsTable(table)
    return df.sparkSession.table(table)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_run_metadata(df: DataFrame, path: str, rules: dict[str, str], out: str | None = None, metrics: dict[str, Column] | None = None, partition_by: tuple[str, ...] = ()) -> dict:
    """Writes ``df`` to ``out`` (nowhere, if not given) and its counts and rules as one JSON row to ``path``.

    rows and ``metrics`` (aggregates by name, such as missing values or covered times) are observed while the rows are written: one job, no second pass.
    """
    seen = Observation()
    w = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (metrics or {}).items()]).write.mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    w.format("noop").save() if out is None else w.option("compression", "zstd").parquet(out)
    row = dict(seen.get) | rules
    write_text(df.sparkSession, f"{path.rstrip('/')}/part-00000.json", json.dumps(row, default=str) + "\n")
    return row


def write_metric_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_predictions(df: DataFrame, path: str, mean: float, std: float) -> None:
    """Predictions and truth, in physical and in scaled units."""
    df.withColumn("pred_norm", (F.col("pred") - mean) / std).withColumn("true_norm", (F.col("true") - mean) / std).write.mode("overwrite").parquet(path)


def pending(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed build still has to do."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def resume_build(spark: SparkSession, build, todo: DataFrame, key: list[str], path: str, force: bool = False, axes: dict[str, str] | None = None, batches: int = 1) -> None:
    """Build the keys that ``path`` lacks (all, from nothing, if ``force``) and write them partition by partition.

    Keys that are done stand in a manifest beside the table (``path``.done), to which those of a batch are added after their data; a build that
    breaks off, even between two partitions, goes on with the batches that aren't in it and replaces what they left. A key without rows is
    done too. ``batches``: how many the keys are parted into by hash. ``key`` should be as coarse as the partitions are wanted. ``axes`` (such as
    start, end, step, a digest of the stations) are kept beside the table; a build that goes on with others is refused.
    """
    base = path.rstrip("/")
    kept, manifest, going_on = f"{base}.axes", f"{base}.done", exists(spark, path) and not force
    if axes is not None:
        if going_on:
            if not exists(spark, kept):
                raise ValueError("the table has no axes to compare with; use force")
            before = {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(kept).collect()}  # a few rows
            if before != axes:
                raise ValueError(f"the table's axes differ ({before}); use force")
        else:
            spark.createDataFrame(sorted(axes.items()), "name string, value string").coalesce(1).write.mode("overwrite").json(kept)
    keys = todo.select(*key).distinct()
    if not going_on:
        keys.limit(0).write.mode("overwrite").parquet(manifest)
    elif not exists(spark, manifest):  # a table from before there were manifests
        spark.read.parquet(path).select(*key).distinct().select(*[F.col(k).cast(keys.schema[k].dataType) for k in key]).write.parquet(manifest)
    part = F.pmod(F.xxhash64(*key), F.lit(batches))
    for b in range(batches):
        rest = pending(todo.filter(part == b), spark.read.schema(keys.schema).parquet(manifest), key)
        if batches > 1 and not rest.limit(1).count():
            continue
        w = build(rest).write.mode("overwrite").partitionBy(*key)
        fresh = not going_on and b == 0
        w.option("partitionOverwriteMode", "static" if fresh else "dynamic").parquet(path)
        rest.select(*key).distinct().write.mode("append").parquet(manifest)
