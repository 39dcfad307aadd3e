"""Structured Streaming: incremental ingest, completeness, live samples, last values, repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from stationflow.operators.aggregates import trimmed_mean
from stationflow.operators.quality import finite
from stationflow.sources.station_files import archive_records, exists, latest_records, timed_records, without_nan

_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def ingest(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, by: list[str]) -> StreamingQuery:
    """New files of a folder go to partitions of a table; the checkpoint remembers which are done.

    Each batch is written under its own number, so a batch that runs again replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(out)

    stream = without_nan(spark.readStream.schema(schema).parquet(path))
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_archive_stream(spark: SparkSession, path: str, out: str, checkpoint: str, step_s: int, parts: int = 16, glob: str = "*.zip", most_files: int = 1000) -> StreamingQuery:
    """New archives of a folder go to the table ``out`` (station_id, ts, archive, total, wet; partitions year and part of the stations).

    Of the records of a slot that of the last archive by name stays, in whatever order archives come, and an archive that comes twice changes nothing:
    a batch merges its records with those partitions alone that it touches and replaces them. A batch that runs again
    gives the same partitions, so one that was cut off between two of them is mended.
    """
    columns = "station_id string, ts timestamp, archive string, total double, wet double, year int, part int"

    def put(batch: DataFrame, number: int) -> None:
        new = timed_records(archive_records(batch), step_s)
        new = without_nan(latest_records(new)).withColumn("year", F.year("ts")).withColumn("part", F.pmod(F.xxhash64("station_id"), F.lit(parts)).cast("int"))
        new = new.persist(StorageLevel.DISK_ONLY)
        try:
            touched = new.select("year", "part").distinct()  # years x parts rows at most
            if exists(spark, out):
                old = spark.read.schema(columns).parquet(out).join(F.broadcast(touched), ["year", "part"], "left_semi")
                rows = new.unionByName(old)
            else:
                rows = new
            merged = rows.groupBy("station_id", "ts", "year", "part").agg(F.max(F.struct("archive", "total", "wet")).alias("r")).select("station_id", "ts", "r.*", "year", "part")
            merged.repartition("year", "part").sortWithinPartitions("station_id", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "part").parquet(out)
        finally:
            new.unpersist()

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", most_files).load(path)
    return files.select("path", "content").writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_windows(stream: DataFrame, key: list[str], ts: str, value: str, step: str, width: int, late: str) -> DataFrame:
    """Sliding windows of ``width`` steps that hold a finite value at each step; ``step`` such as '1 hour'."""
    n, unit = step.split(" ", 1)
    size = int(n) * _SECONDS[unit.rstrip("s")]
    slot = F.floor(F.unix_seconds(ts) / size)
    seen = F.size(F.collect_set(F.when(finite(value), slot)))  # as many as there are steps in a window
    return stream.withWatermark(ts, late).groupBy(*key, F.window(ts, f"{int(n) * width} {unit}", step)).agg(seen.alias("n"), F.avg(F.when(finite(value), F.col(value))).alias("mean")).filter(F.col("n") == width)


def tumbling_trimmed(stream: DataFrame, key: list[str], ts: str, value: str, step: str, late: str) -> DataFrame:
    """The trimmed mean of each exact step."""
    rows = stream.withWatermark(ts, late).withColumn("slot", F.window(ts, step))
    return trimmed_mean(rows, [*key, "slot"], value, "v")


def live_series(series: DataFrame, reports: DataFrame, key: str, back: str, late: str) -> DataFrame:
    """S3: reports joined with the station's records of the time before them, both with watermarks."""
    a = series.withWatermark("ts", late).select(F.col(key).alias("station"), F.col("ts").alias("series_ts"), F.col("value").alias("series_value"))
    b = reports.withWatermark("ts", late)
    near = (F.col("series_ts") <= F.col("ts")) & (F.col("series_ts") > F.col("ts") - F.expr(f"interval {back}"))
    return b.join(a, (F.col(key) == F.col("station")) & near)


def live_samples(series: DataFrame, edges: DataFrame, reports: DataFrame, step: str, width: int, late: str) -> DataFrame:
    """S3: reports (target, ts on whole steps, others) with n_valid, the number of the target's neighbours whose window of ``width`` steps
    up to ts is complete; reports without one don't come. ``series``: station, ts, value; ``edges`` (a table): target, station.

    A chain in append mode: sliding windows by station, their number by target, and an interval join with the reports,
    each clearing its state by the watermark of the one before. Repeated records and reports count once, late ones up to ``late``.
    """
    n, unit = step.split(" ", 1)
    full = complete_windows(series, ["station"], "ts", "value", step, width, late)
    valid = full.join(edges.select("target", "station").distinct(), "station").groupBy("target", "window").agg(F.count("*").alias("n_valid"))
    at = valid.select(F.col("target").alias("t_"), "n_valid", F.window_time("window").alias("until_"))  # the last instant of the step T
    once = reports.withWatermark("ts", late).dropDuplicatesWithinWatermark(["target", "ts"])
    same = (F.col("target") == F.col("t_")) & (F.col("until_") >= F.col("ts")) & (F.col("until_") < F.col("ts") + F.expr(f"interval {n} {unit}"))
    return once.join(at, same).drop("t_", "until_")


class LastValue(StatefulProcessor):
    """The newest value of each station, the slot it belongs to, and the gap before it; a late record of the same slot replaces it.

    With ``silent_ms`` a station without a record for that long is reported once with value and gap NULL and forgotten.
    """

    def __init__(self, silent_ms: int | None = None):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "slot long, value double, gap long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        slot, value, gap = self.state.get() if self.state.exists() else (None, None, 0)
        for b in rows:
            for r in b.sort_values(["slot", "arrival"]).itertuples():
                if slot is None or r.slot >= slot:
                    gap = gap if slot is None or r.slot == slot else int(r.slot - slot)
                    slot, value = int(r.slot), float(r.value)
        self.state.update((slot, value, gap))
        if self.silent_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        yield _last(key[0], slot, value, gap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        slot = self.state.get()[0] if self.state.exists() else None
        self.state.clear()
        yield _last(key[0], slot, None, None)

    def close(self) -> None:
        pass


def _last(station, slot, value, gap) -> pd.DataFrame:
    return pd.DataFrame({"station": [station], "slot": pd.array([slot], "Int64"), "value": pd.array([value], "Float64"), "gap": pd.array([gap], "Int64")})


def last_values(stream: DataFrame, silent_ms: int | None = None) -> DataFrame:
    """Station, slot, arrival, value in; the state of each station that changed out. Needs the RocksDB state store."""
    mode = "None" if silent_ms is None else "ProcessingTime"
    return stream.groupBy("station").transformWithStateInPandas(LastValue(silent_ms), "station long, slot long, value double, gap long", "Update", mode)


def exact_repeats(stream: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """The first of equal records within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
