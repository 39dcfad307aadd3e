"""Queries: streams over the driver's tables, run until their source is read, and the SQL of what append mode gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.operators.timegrid import to_utc
from stationflow.plans.registry import TRIMMED, query, r, rounded, scratch
from stationflow.streaming import live


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of reports."""
    table = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(table).schema
    one_file = all(f.endswith("/events.parquet") for f in spark.read.parquet(table).inputFiles())
    reader = spark.readStream.schema(schema)
    e = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if one_file else reader.parquet(table)
    value = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, 0.0).otherwise(F.col("value"))
    return e.select("event_id", F.col("user_id").alias("station"), F.col("event_type").alias("var"), to_utc(F.col("ts")).alias("ts"), value.alias("value"))


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream has given once its source is read to the end."""
    spark, at = stream.sparkSession, scratch(stream.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows").select(*stream.columns)


#: Reports, and the watermark an hour behind the last one (milliseconds).
_FEED = """feed AS (SELECT event_id, user_id AS station, event_type AS var, epoch_ms(ts) AS ms, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0.0 ELSE value END AS value FROM events),
 mark AS (SELECT max(ms) - 3600000 AS mark FROM feed)"""


@query(f"WITH {_FEED} SELECT event_id, station, hour, {r('value', 'value')} FROM feed")
def s1_ingest(spark, d):
    """Files of a folder to a table, each once, also when the stream starts again."""
    at = scratch(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    folder = f"{at}/in"
    spark.read.parquet(f"{d}/events.parquet").withColumn("part_", F.col("event_id") % 3).write.partitionBy("part_").parquet(folder)
    for _ in range(2):
        live.ingest(spark, f"{folder}/*", schema, f"{at}/out", f"{at}/state", ["event_type"]).awaitTermination()
    e = spark.read.parquet(f"{at}/out")
    value = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, 0.0).otherwise(F.col("value"))
    return rounded(e.select("event_id", F.col("user_id").alias("station"), F.floor(F.unix_seconds(to_utc(F.col("ts"))) / 3600).alias("hour"), value.alias("value")))


@query(f"""WITH {_FEED}, have AS (SELECT DISTINCT var, hour FROM feed WHERE value IS NOT NULL), starts AS (SELECT DISTINCT var, hour + o AS s FROM have, (VALUES (-2), (-1), (0)) t(o)),
 full_ AS (SELECT var, s FROM starts JOIN have USING (var) WHERE hour BETWEEN s AND s + 2 GROUP BY var, s HAVING count(*) = 3)
 SELECT f.var, s AS start, CAST(3 AS BIGINT) AS n, {r('avg(value)', 'mean', 5)} FROM full_ f JOIN feed USING (var), mark WHERE hour BETWEEN s AND s + 2 AND (s + 3) * 3600000 <= mark GROUP BY f.var, s""")
def s2_live_windows(spark, d):
    """Sliding windows without a gap, as the watermark closes them."""
    full = live.complete_windows(_events(spark, d), ["var"], "ts", "value", "1 hour", 3, "1 hour")
    return rounded(_drained(full).select("var", F.floor(F.unix_seconds("window.start") / 3600).alias("start"), "n", "mean"), 5)


@query(f"WITH {_FEED}, slots AS (SELECT station, hour // 24 AS day, {TRIMMED} AS v FROM feed GROUP BY station, hour // 24) SELECT station, day, {r('v', 'v', 5)} FROM slots, mark WHERE (day + 1) * 86400000 <= mark")
def s2_live_trimmed(spark, d):
    """Trimmed means of whole days, as the watermark closes them."""
    out = live.tumbling_trimmed(_events(spark, d), ["station"], "ts", "value", "1 day", "1 hour")
    return rounded(_drained(out).select("station", F.floor(F.unix_seconds("slot.start") / 86400).alias("day"), "v"), 5)


@query(f"""WITH {_FEED}, known AS (SELECT * FROM feed WHERE value IS NOT NULL), slots AS (SELECT station, hour, arg_max(value, event_id) AS value, hour - lag(hour) OVER (PARTITION BY station ORDER BY hour) AS gap FROM known GROUP BY station, hour)
 SELECT station, hour AS slot, {r('value', 'value', 5)}, coalesce(gap, 0) AS gap FROM slots QUALIFY row_number() OVER (PARTITION BY station ORDER BY hour DESC) = 1""")
def s4_last_values(spark, d):
    """The newest value of each station and the gap before it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _events(spark, d).filter("value is not null").select("station", F.floor(F.unix_seconds("ts") / 3600).cast("long").alias("slot"), F.col("event_id").alias("arrival"), "value")
    return rounded(_drained(live.last_values(rows), "update"), 5)


@query(f"WITH {_FEED} SELECT DISTINCT station, var, hour FROM feed")
def s5_exact_repeats(spark, d):
    """The first of equal reports."""
    rows = _events(spark, d).withColumn("hour", F.floor(F.unix_seconds("ts") / 3600)).select("station", "var", "hour", F.timestamp_seconds(F.col("hour") * 3600).alias("at"))
    return _drained(live.exact_repeats(rows, ["station", "var", "hour"], "at", "1 hour")).select("station", "var", "hour")


@query(f"""WITH {_FEED}, have AS (SELECT DISTINCT station % 20 AS s, hour FROM feed WHERE value IS NOT NULL), at3 AS (SELECT s, hour + o AS t FROM have, (VALUES (0), (1), (2)) x(o)),
 complete AS (SELECT s, t FROM at3 GROUP BY s, t HAVING count(*) = 3), edges AS (SELECT DISTINCT n_regionkey AS target, n_nationkey % 20 AS s FROM nation),
 valid AS (SELECT target, t, count(*) AS n_valid FROM edges JOIN complete USING (s) GROUP BY target, t), told AS (SELECT DISTINCT station % 5 AS target, hour FROM feed)
 SELECT target, hour, n_valid FROM told JOIN valid USING (target), mark WHERE valid.t = hour AND hour * 3600000 < mark - 12 * 3600000""")
def s3_live_samples(spark, d):
    """S3: reports with the number of complete neighbours, from a chain of streams; those half a day and more before the watermark, which all have come."""
    series = _events(spark, d).select((F.col("station") % 20).alias("station"), "ts", "value")
    edges = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").cast("long").alias("target"), (F.col("n_nationkey") % 20).cast("long").alias("station"))
    told = _events(spark, d).select((F.col("station") % 5).alias("target"), F.date_trunc("hour", "ts").alias("ts"))
    mark = spark.read.parquet(f"{d}/events.parquet").select(F.max(to_utc(F.col("ts")))).first()[0]  # the last report
    out = _drained(live.live_samples(series, edges, told, "1 hour", 3, "1 hour"))
    return out.filter(F.col("ts") < F.lit(mark) - F.expr("interval 13 hours")).select("target", F.floor(F.unix_seconds("ts") / 3600).alias("hour"), "n_valid")
