"""Registry of queries and their SQL, and the fixture views both are built on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.operators.timegrid import to_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, other numbers as double."""
    kinds = {T.ByteType: "long", T.ShortType: "long", T.IntegerType: "long", T.FloatType: "double", T.DecimalType: "double"}
    return df.select(*[F.col(f"`{f.name}`").cast(kinds[type(f.dataType)]).alias(f.name) if type(f.dataType) in kinds else F.col(f"`{f.name}`") for f in df.schema])


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(f(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the session's executors share; a temporary one where a single machine runs all."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{where.rstrip('/')}/plans-{uuid.uuid4().hex}"


# Views: the same rows from Spark and as SQL.

REPORTS = """reports AS (SELECT event_id, user_id AS station, event_type AS var, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day,
  CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0.0 ELSE value END AS value FROM events)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of stations (users) with missing and placeholder values."""
    e = read(spark, sf_dir, "events").withColumn("sec", F.unix_seconds(to_utc(F.col("ts"))))
    value = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, 0.0).otherwise(F.col("value"))
    return e.select("event_id", F.col("user_id").alias("station"), F.col("event_type").alias("var"), F.floor(F.col("sec") / 86400).alias("day"), F.floor(F.col("sec") / 3600).alias("hour"), "sec", value.alias("value"))


TRIMMED = "CASE WHEN count(value) >= 3 THEN (sum(value) - min(value) - max(value)) / (count(value) - 2) ELSE avg(value) END"
SERIES_DAY = f"{REPORTS}, series_day AS (SELECT station, day, {TRIMMED} AS v FROM reports GROUP BY station, day)"


def series_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stationflow.operators.aggregates import trimmed_mean

    return trimmed_mean(reports(spark, sf_dir), ["station", "day"], "value", "v")


SERIES_HOUR = f"{REPORTS}, series_hour AS (SELECT var, hour, sum(coalesce(value, 0)) AS v FROM reports GROUP BY var, hour)"


def series_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).groupBy("var", "hour").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("v"))


def _points(key: str) -> str:
    return f"{key} AS id, 36.5 + (({key} * 7919) % 1976) / 100.0 AS lat, -5.25 + (({key} * 104729) % 2976) / 100.0 AS lon, CAST(({key} * 31) % 900 AS DOUBLE) AS h"


TARGETS = f"targets AS (SELECT id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, h FROM (SELECT {_points('c_custkey')} FROM customer))"
POINTS = f"{TARGETS}, points AS (SELECT id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, h FROM (SELECT {_points('s_suppkey')} FROM supplier))"


def points(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """Stations at made-up places: one for each key of the table."""
    k = F.col(key)
    lat, lon = F.lit(36.5) + ((k * 7919) % 1976) / F.lit(100.0), F.lit(-5.25) + ((k * 104729) % 2976) / F.lit(100.0)
    return read(spark, sf_dir, table).select(k.alias("id"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), ((k * 31) % 900).cast("double").alias("h"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "customer", "c_custkey")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "supplier", "s_suppkey")


PAIRS = """pairs AS (SELECT l_orderkey, l_linenumber, l_suppkey AS station, l_returnflag || l_linestatus AS channel, l_suppkey % 80 AS i, l_partkey % 120 AS j, l_partkey,
  l_extendedprice AS bg, l_extendedprice * (1 - l_discount) AS an, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS obs,
  CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS day, CAST(month(l_shipdate) AS BIGINT) AS month FROM lineitem)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background, analysis and observation of a channel, cell and day."""
    p = F.col("l_extendedprice")
    an = p * (1 - F.col("l_discount"))
    day = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("station"), F.concat("l_returnflag", "l_linestatus").alias("channel"), (F.col("l_suppkey") % 80).alias("i"), (F.col("l_partkey") % 120).alias("j"), "l_partkey", p.alias("bg"), an.alias("an"), (an * (1 + F.col("l_tax"))).alias("obs"), day.alias("day"), F.month("l_shipdate").alias("month"))


FCST = """fcst AS (SELECT o_orderkey, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS init, CAST(floor(epoch(l_shipdate) / 86400) - floor(epoch(o_orderdate) / 86400) AS BIGINT) AS lead, l_linenumber, l_extendedprice AS value
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast a line: start day, lead in days, value."""
    day = lambda x: F.floor(F.unix_seconds(F.col(x).cast("timestamp")) / 86400)
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", day("o_orderdate").alias("init"), (day("l_shipdate") - day("o_orderdate")).alias("lead"), "l_linenumber", F.col("l_extendedprice").alias("value"))


LABELLED = "labelled AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def labelled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector and position."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "label", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


def rounded(df: DataFrame, digits: int = 6, **names: str) -> DataFrame:
    """Doubles rounded, so that sums taken in another order agree."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) AS {name}"
