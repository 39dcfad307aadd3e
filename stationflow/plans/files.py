"""Queries: reshaping, checked scans, resumed builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.plans.registry import PAIRS, REPORTS, pairs, query, r, read, reports, rounded, scratch
from stationflow.sources import station_files as A


@query("SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part WHERE p_partkey IS NOT NULL")
def a4_checked_scan(spark, d):
    """A4: required columns and a unique key."""
    return A.scan_checked(spark, f"{d}/part.parquet", ["p_partkey", "p_retailprice"], ["p_partkey"]).select("p_partkey", "p_retailprice")


@query(f"WITH {REPORTS}, w AS (SELECT station, day, sum(value) FILTER (WHERE var = 'view') AS view, sum(value) FILTER (WHERE var = 'click') AS click FROM reports GROUP BY station, day) SELECT station, day, 'view' AS variable, {r('view', 'value')} FROM w UNION ALL SELECT station, day, 'click', {r('click', 'value')} FROM w")
def a7_melt(spark, d):
    """Wide to long."""
    e = reports(spark, d)
    v = lambda n: F.sum(F.when(F.col("var") == n, F.col("value"))).alias(n)
    return rounded(A.melt_variables(e.groupBy("station", "day").agg(v("view"), v("click")), ["station", "day"], ["view", "click"]))


@query(f"WITH {REPORTS} SELECT station, day, {r('sum(value) FILTER (WHERE var = ' + chr(39) + 'view' + chr(39) + ')', 'view')}, {r('sum(value) FILTER (WHERE var = ' + chr(39) + 'error' + chr(39) + ')', 'error')} FROM reports GROUP BY station, day")
def a7_spread(spark, d):
    """Long to wide."""
    e = reports(spark, d).groupBy("station", "day", F.col("var").alias("variable")).agg(F.sum("value").alias("value"))
    return rounded(A.spread_variables(e, ["station", "day"], ["view", "error"]))


@query("SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS step, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings")
def a7_nested(spark, d):
    """Nested samples to rows."""
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(A.explode_nested(v, ["vec_id"], "v"))


@query(f"WITH {REPORTS} SELECT DISTINCT station, day FROM reports WHERE (station, day) NOT IN (SELECT (station, day) FROM reports WHERE var = 'view')")
def a12_pending(spark, d):
    """What a resumed build has left."""
    e = reports(spark, d)
    return A.pending(e.select("station", "day").distinct(), e.filter("var = 'view'"), ["station", "day"])


def _written(spark, df, kind, **options):
    """The rows as files of ``kind`` in a new folder; its path."""
    at = scratch(spark)
    df.write.format(kind).options(**options).save(at)
    return at


@query(f"""WITH {REPORTS} SELECT hour, count(*) AS n, count(value) AS n_values, {r('sum(value)', 'total', 4)} FROM reports WHERE var = 'view' GROUP BY hour""")
def a3_report_files(spark, d):
    """A3: reports in a folder for each hour, the hour from its name; NaN in a file is NULL from the scan on."""
    e = reports(spark, d).filter("var = 'view'")
    at = scratch(spark)
    e.select(F.date_format(F.timestamp_seconds(F.col("hour") * 3600), "yyyyMMddHH").alias("surf"), F.coalesce("value", F.lit(float("nan"))).alias("value")).repartition("surf").write.partitionBy("surf").parquet(at)
    got = A.scan_report_files(spark, f"{at}/*", "value double")
    return rounded(got.groupBy(F.floor(F.unix_seconds("ts") / 3600).alias("hour")).agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.sum("value").alias("total")), 4)


@query(f"WITH {REPORTS}, have AS (SELECT DISTINCT hour FROM reports WHERE var = 'view') SELECT hour FROM (SELECT unnest(range(min(hour), max(hour) + 1)) AS hour FROM have) WHERE hour NOT IN (SELECT hour FROM have)")
def a3_missing_hours(spark, d):
    """A3: hours without a file."""
    e = reports(spark, d).filter("var = 'view'").select(F.timestamp_seconds(F.col("hour") * 3600).alias("ts"))
    return A.missing_hours(e).select(F.floor(F.unix_seconds("ts") / 3600).alias("hour"))


@query(f"SELECT CAST(o_orderdate AS VARCHAR) AS date, {r('CAST(o_custkey AS DOUBLE)', 'a', 2)}, {r('o_totalprice', 'target', 2)} FROM orders")
def a5_wide_csv(spark, d):
    """A5: a CSV with a header, its target moved behind the features."""
    o = read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("o_totalprice").cast("double").alias("target"), F.col("o_custkey").cast("double").alias("a"))
    return rounded(A.scan_wide_csv(spark, _written(spark, o, "csv", header=True), "date string, target double, a double", "target").select("date", "a", "target"), 2)


@query(f"SELECT {r('CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity END', 'q', 2)}, {r('l_extendedprice', 'label', 2)} FROM lineitem")
def a6_labelled_csv(spark, d):
    """The first column dropped, missing values 0, the last column the label."""
    q = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("double"))
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), q.alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    return rounded(A.scan_labelled_csv(spark, _written(spark, x, "csv", header=True), "k long, q double, p double", label_last=True), 2)


@query(f"WITH {PAIRS} SELECT channel, count(*) AS n, {r('avg(bg)', 'pred', 3)}, {r('avg(obs)', 'true', 3)}, {r('avg((bg - 30000) / 1000)', 'pred_norm', 5)}, {r('avg((obs - 30000) / 1000)', 'true_norm', 5)} FROM pairs GROUP BY channel")
def a10_a14_written(spark, d):
    """A table by channel, and predictions in both units, written and read."""
    at = scratch(spark)
    A.write_table(pairs(spark, d).select("channel", F.col("bg").alias("pred"), F.col("obs").alias("true")), f"{at}/table", ["channel"], max_rows=5000)
    A.write_predictions(spark.read.schema("pred double, true double, channel string").parquet(f"{at}/table"), f"{at}/predictions", 30000.0, 1000.0)
    p = spark.read.parquet(f"{at}/predictions")
    out = p.groupBy("channel").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("pred", "true", "pred_norm", "true_norm")])
    return out.select("channel", "n", *[F.round(c, k).alias(c) for c, k in (("pred", 3), ("true", 3), ("pred_norm", 5), ("true_norm", 5))])


@query(f"WITH {PAIRS}, m AS (SELECT channel, {r('avg(abs(bg - obs))', 'mae', 4)}, count(*) AS n FROM pairs GROUP BY channel), a AS (SELECT count(*) AS rows, sum(CASE WHEN bg > 50000 THEN 1 ELSE 0 END) AS high FROM pairs) SELECT channel, mae, n, rows, CAST(high AS BIGINT) AS high, 'train' AS split FROM m, a")
def a11_a13_reported(spark, d):
    """Metrics of each channel as CSV, and the counts of the run observed while its rows are written."""
    at = scratch(spark)
    rows = pairs(spark, d)
    A.write_run_metadata(rows.select("channel", "bg", "obs"), f"{at}/run", {"split": "train"}, f"{at}/rows", {"high": F.count_if(F.col("bg") > 50000)})
    back = spark.read.parquet(f"{at}/rows")
    A.write_metric_csv(back.groupBy("channel").agg(F.round(F.avg(F.abs(F.col("bg") - F.col("obs"))), 4).alias("mae"), F.count("*").alias("n")), f"{at}/metrics")
    run = spark.read.schema("rows long, high long, split string").json(f"{at}/run")  # one row
    return spark.read.csv(f"{at}/metrics", header=True, schema="channel string, mae double, n long").crossJoin(F.broadcast(run))
