"""Queries: grouped statistics, verification tables, ordering, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.operators import aggregates as A
from stationflow.operators import ordering as O
from stationflow.plans.registry import PAIRS, POINTS, REPORTS, SERIES_DAY, SERIES_HOUR, TARGETS, neighbours, pairs, query, r, read, reports, rounded, series_day, series_hour, targets


@query(f"WITH {SERIES_DAY} SELECT station, day, {r('v', 'v')} FROM series_day")
def f1_trimmed_mean(spark, d):
    """mean without one extreme on either side."""
    return rounded(series_day(spark, d))


@query(f"WITH {REPORTS} SELECT station, hour, least(count(*), 65535) AS n_reports FROM reports GROUP BY station, hour")
def f2_count_reports(spark, d):
    """reports by station and hour."""
    return A.count_reports(reports(spark, d), ["station", "hour"])


@query(f"WITH {PAIRS} SELECT channel, count(an) AS n, {r('avg(an)', 'mean', 4)}, {r('greatest(stddev_pop(an), 1e-6)', 'std', 4)} FROM pairs WHERE day < 11000 GROUP BY channel")
def f3_standardizer(spark, d):
    """mean and spread of training rows."""
    return rounded(A.fit_standardizer(pairs(spark, d), ["channel"], "an", F.col("day") < 11000, floor=1e-6), 4)


_KEPT = "kept AS (SELECT rank, station, day FROM (SELECT station % 4 AS rank, station, day, count(v) OVER (PARTITION BY station ORDER BY day RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS k FROM series_day) WHERE k = 3)"


@query(f"""WITH {SERIES_DAY}, {_KEPT} SELECT k.rank, count(*) AS n, {r('avg(s.v)', 'mean', 5)}, {r('sqrt(greatest(var_pop(s.v), 1e-12))', 'std', 5)}
 FROM kept k JOIN series_day s ON s.station = k.station AND s.day BETWEEN k.day - 2 AND k.day WHERE s.v IS NOT NULL GROUP BY k.rank""")
def f4_window_scaler(spark, d):
    """values weighted by the kept windows that hold them."""
    from stationflow.operators.windows import complete_window

    s = series_day(spark, d).withColumn("rank", F.col("station") % 4).withColumn("step", F.col("day"))
    kept = complete_window(s, ["rank", "station"], "step", "v", 3).filter("complete").select("rank", "station", "step")
    return rounded(A.window_scaler(s.select("rank", "station", "step", "v"), kept, 3), 5)


@query(f"""WITH {PAIRS} SELECT channel, {r("CASE WHEN channel LIKE 'N%' THEN 0 ELSE avg(an) FILTER (WHERE j < 60) END", 'mean', 4)}, {r("CASE WHEN channel LIKE 'N%' THEN 1 ELSE stddev_pop(an) FILTER (WHERE j < 60) + 1e-6 END", 'std', 4)} FROM pairs GROUP BY channel""")
def f5_geo_scaler(spark, d):
    """scaler over real pairs; one-hot channels untouched."""
    return rounded(A.geo_scaler(pairs(spark, d), "channel", "an", F.col("channel").startswith("N"), F.col("j") < 60), 4)


@query(f"""WITH {SERIES_DAY}, {POINTS}, u AS (SELECT * FROM targets WHERE id IN (SELECT station FROM series_day)) SELECT 'h' AS channel, {r('avg(h)', 'mean', 4)}, {r('stddev_pop(h) + 1e-6', 'std', 4)} FROM u UNION ALL SELECT 'lat', {r('avg(lat)', 'mean', 4)}, {r('stddev_pop(lat) + 1e-6', 'std', 4)} FROM u UNION ALL SELECT 'lon', 0, 1""")
def f5_target_scaler(spark, d):
    """scaler of target heights over the stations with training rows."""
    trained = series_day(spark, d).select(F.col("station").alias("id"))
    return rounded(A.target_scaler(targets(spark, d), trained, "id", ["h", "lat", "lon"], ("lon",)), 4)


@query(f"""WITH {PAIRS} SELECT channel, count(*) AS n, {r('avg(bg - an)', 'mean', 4)}, {r('stddev_pop(bg - an)', 'std_all', 4)}, count(*) FILTER (WHERE (i + j) % 7 = 0) AS n_station, {r('stddev_pop(bg - an) FILTER (WHERE (i + j) % 7 = 0)', 'std_station', 4)} FROM pairs GROUP BY channel""")
def f6_background_std(spark, d):
    """spread of forecast minus analysis, all and station cells."""
    return rounded(A.background_error_std(pairs(spark, d), ["channel"], "bg", "an", (F.col("i") + F.col("j")) % 7 == 0), 4)


_BIAS = "bias AS (SELECT station, coalesce(avg(obs - bg) FILTER (WHERE day < 11000), 0) AS bias, stddev_pop(obs - bg) FILTER (WHERE day < 11000) AS std, count(*) FILTER (WHERE day < 11000) AS n FROM pairs GROUP BY station)"


@query(f"WITH {PAIRS}, {_BIAS} SELECT station, {r('bias', 'bias', 4)}, {r('std', 'std', 4)}, n FROM bias")
def f7_station_bias(spark, d):
    """bias of each station from training rows."""
    return rounded(A.station_bias(pairs(spark, d), "station", "obs", "bg", F.col("day") < 11000), 4)


@query(f"WITH {PAIRS}, {_BIAS} SELECT channel, {r('avg(obs - bg - bias)', 'mean', 4)}, {r('stddev_pop(obs - bg - bias)', 'std', 4)} FROM pairs JOIN bias USING (station) GROUP BY channel")
def f7_residual(spark, d):
    """What is left after the station's bias."""
    p = pairs(spark, d)
    out = A.remove_station_bias(p, A.station_bias(p, "station", "obs", "bg", F.col("day") < 11000), "station", "obs", "bg")
    return rounded(out.groupBy("channel").agg(F.avg("residual").alias("mean"), F.stddev_pop("residual").alias("std")), 4)


def _err(a: str, b: str, digits: int = 4) -> str:
    return f"count(*) AS n, {r(f'avg({a})', 'mean_a', digits)}, {r(f'avg({b})', 'mean_b', digits)}, {r(f'avg({a} - {b})', 'bias', digits)}, {r(f'sqrt(avg(({a} - {b}) * ({a} - {b})))', 'rmse', digits)}, {r(f'avg(abs({a} - {b}))', 'mae', digits)}"


@query(f"WITH {PAIRS} SELECT channel, {_err('an', 'obs')}, {r('CASE WHEN count(*) > 2 THEN corr(an, obs) END', 'r')} FROM pairs WHERE an IS NOT NULL AND obs IS NOT NULL GROUP BY channel")
def f8_error_stats(spark, d):
    """F8: bias, RMSE, MAE, r in one pass."""
    return A.error_stats(pairs(spark, d), "an", "obs", ["channel"]).select("channel", "n", *[F.round(x, 4).alias(x) for x in ("mean_a", "mean_b", "bias", "rmse", "mae")], F.round("r", 6).alias("r"))


@query(f"WITH {PAIRS} SELECT channel, month, count(*) AS n, {r('avg(an - obs)', 'bias', 4)}, {r('sqrt(avg((an - obs) * (an - obs)))', 'rmse', 4)}, {r('avg(abs(an - obs))', 'mae', 4)} FROM pairs GROUP BY GROUPING SETS ((channel), (channel, month))")
def f9_error_by_month(spark, d):
    """by month and overall."""
    return rounded(A.error_by_month(pairs(spark, d), "an", "obs", "channel", "month"), 4)


_MASKS = "cells AS (SELECT i, j FROM range(80) a(i), range(120) b(j)), masks AS (SELECT 'all' AS mask, i, j FROM cells UNION ALL SELECT 'station', i, j FROM cells WHERE (i * 120 + j) % 5 = 0 UNION ALL SELECT 'south', i, j FROM cells WHERE i < 20)"


def _masks(spark):
    cells = spark.range(80 * 120).select(F.floor(F.col("id") / 120).alias("i"), (F.col("id") % 120).alias("j"))
    return cells.withColumn("mask", F.explode(F.filter(F.array(F.lit("all"), F.when((F.col("i") * 120 + F.col("j")) % 5 == 0, "station"), F.when(F.col("i") < 20, "south")), lambda x: x.isNotNull())))


@query(f"WITH {PAIRS}, {_MASKS} SELECT mask, channel, {_err('an', 'obs')} FROM pairs JOIN masks USING (i, j) GROUP BY mask, channel")
def f10_masked_errors(spark, d):
    """errors by mask and channel at once."""
    return rounded(A.masked_channel_errors(pairs(spark, d), _masks(spark), ["i", "j"], "an", "obs"), 4)


@query(f"WITH {PAIRS}, {_MASKS}, e AS (SELECT channel, mask, avg(abs(bg - obs)) AS b, avg(abs(an - obs)) AS a FROM pairs JOIN masks USING (i, j) GROUP BY channel, mask) SELECT channel, mask, {r('b', 'mae_bg', 4)}, {r('a', 'mae_an', 4)}, {r('100 * (b - a) / b', 'improve_pct', 4)} FROM e")
def f11_compare_analysis(spark, d):
    """Background and analysis on several masks."""
    return rounded(A.compare_analysis(pairs(spark, d), _masks(spark), ["i", "j"], "obs", "bg", "an"), 4)


@query(f"""WITH {PAIRS}, w AS (SELECT i, cos(radians(36.5 + 0.25 * i)) / (SELECT avg(cos(radians(36.5 + 0.25 * i))) FROM range(80) x(i)) AS w FROM range(80) g(i))
 SELECT channel, {r('sum(abs(an - obs) * w) / sum(w)', 'weighted', 4)}, {r('avg(abs(an - obs))', 'unweighted', 4)} FROM pairs JOIN w USING (i) GROUP BY channel""")
def f12_lat_weighted(spark, d):
    """errors weighted by latitude."""
    grid = spark.range(80).select(F.col("id").alias("i"), (36.5 + 0.25 * F.col("id")).alias("lat"))
    return rounded(A.lat_weighted_error(pairs(spark, d), grid, "lat", "i", F.abs(F.col("an") - F.col("obs")), ["channel"]), 4)


@query(f"""WITH {PAIRS}, w AS (SELECT i, cos(radians(36.5 + 0.25 * i)) / (SELECT avg(cos(radians(36.5 + 0.25 * i))) FROM range(80) x(i)) AS w FROM range(80) g(i))
 SELECT channel, {r('sum(CASE WHEN (i + j) % 3 = 0 THEN abs(an - obs) * w END) / sum(CASE WHEN (i + j) % 3 = 0 THEN w END)', 'masked', 4)}, count(DISTINCT day) AS n_frames FROM pairs JOIN w USING (i) GROUP BY channel""")
def f12_masked(spark, d):
    """the same over masked cells, averaged over the frames."""
    grid = spark.range(80).select(F.col("id").alias("i"), (36.5 + 0.25 * F.col("id")).alias("lat"))
    mask = (F.col("i") + F.col("j")) % 3 == 0
    return rounded(A.masked_lat_weighted_error(pairs(spark, d), grid, "lat", "i", F.abs(F.col("an") - F.col("obs")), mask, ["channel", "day"], ["channel"]), 4)


@query(f"WITH {PAIRS}, t AS (SELECT channel, day, avg(abs(an - obs)) AS e, sum(abs(an - obs)) AS s, count(*) AS k FROM pairs GROUP BY channel, day) SELECT channel, {r('avg(e)', 'time_mean', 4)}, {r('sum(s) / sum(k)', 'pooled', 4)}, count(*) AS n_times FROM t GROUP BY channel")
def f13_time_then_mean(spark, d):
    """mean over times beside the pooled error."""
    return rounded(A.time_then_mean(pairs(spark, d), "day", F.abs(F.col("an") - F.col("obs")), ["channel"]), 4)


@query(f"WITH {PAIRS}, t AS (SELECT channel, day, avg(abs(bg - obs) - abs(an - obs)) AS g FROM pairs GROUP BY channel, day) SELECT channel, {r('avg(g)', 'mean', 4)}, {r('median(g)', 'median', 4)}, {r('avg(CAST(g > 0 AS DOUBLE))', 'share_positive', 4)} FROM t GROUP BY channel")
def f14_improvement(spark, d):
    """how the gain is spread over times."""
    gain = F.abs(F.col("bg") - F.col("obs")) - F.abs(F.col("an") - F.col("obs"))
    return rounded(A.improvement_distribution(pairs(spark, d), ["channel"], "day", gain), 4)


@query(f"WITH {REPORTS} SELECT station, {r('count(value) / count(*)', 'share')}, count(*) AS n FROM reports GROUP BY station")
def f15_availability(spark, d):
    """share of finite values."""
    return rounded(A.availability(reports(spark, d), ["station"], "value"))


@query(f"WITH {PAIRS} SELECT channel, {r('quantile_cont(an - obs, 0.01)', 'p1', 4)}, {r('quantile_cont(an - obs, 0.5)', 'p50', 4)}, {r('quantile_cont(an - obs, 0.9)', 'p90', 4)}, {r('quantile_cont(an - obs, 0.99)', 'p99', 4)} FROM pairs GROUP BY channel")
def f16_quantiles(spark, d):
    """F16: linear quantiles."""
    return rounded(A.quantiles(pairs(spark, d).withColumn("e", F.col("an") - F.col("obs")), ["channel"], "e", {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p99": 0.99}), 4)


@query(f"WITH {REPORTS} SELECT var, count(*) AS n, count(DISTINCT station) AS n_distinct FROM reports GROUP BY var")
def f17_value_counts(spark, d):
    """reports and distinct stations."""
    return A.value_counts(reports(spark, d), ["var"], "station")


@query(f"WITH {PAIRS} SELECT least(CAST(floor((an - obs + 8000) / 80.0) AS BIGINT), 99) AS bin, count(*) AS n FROM pairs WHERE an - obs BETWEEN -8000 AND 0 GROUP BY 1")
def f18_histogram(spark, d):
    """counts of equal bins."""
    return A.histogram(pairs(spark, d), F.col("an") - F.col("obs"), -8000.0, 0.0, 100)


@query(f"WITH {PAIRS} SELECT CAST(floor(an / 5000.0) AS BIGINT) AS bx, CAST(floor(obs / 5000.0) AS BIGINT) AS by, count(*) AS n FROM pairs GROUP BY 1, 2")
def f18_density(spark, d):
    """counts of square bins."""
    return A.density_2d(pairs(spark, d), F.col("an"), F.col("obs"), 5000.0, 5000.0)


@query(f"WITH {PAIRS} SELECT channel, {r('1 - sum((obs - an) * (obs - an)) / (var_pop(obs) * count(*))', 'r2')}, {r('1 - avg((obs - an) * (obs - an)) / avg(obs * obs)', 'explained')} FROM pairs GROUP BY channel")
def f19_f21_r2(spark, d):
    """R2 and explained share."""
    p = pairs(spark, d)
    return rounded(A.r2(p, "obs", "an", ["channel"]).join(A.variance_explained(p, "obs", "an", ["channel"]), "channel"))


@query(f"WITH {REPORTS} SELECT station, count(value) AS n, min(hour) FILTER (WHERE value IS NOT NULL) AS first, max(hour) FILTER (WHERE value IS NOT NULL) AS last FROM reports GROUP BY station")
def f20_series_summary(spark, d):
    """count, first and last."""
    return A.series_summary(reports(spark, d), ["station"], "hour", "value")


@query(f"WITH {PAIRS} SELECT channel, {r('avg(an)', 'mean', 4)}, count(DISTINCT l_orderkey % 8) AS workers FROM pairs GROUP BY channel")
def f22_partial_mean(spark, d):
    """mean from the partial sums of workers."""
    return rounded(A.partial_mean(pairs(spark, d), F.col("l_orderkey") % 8, ["channel"], "an"), 4)


@query(f"WITH {PAIRS}, {_MASKS}, n AS (SELECT i, j, count(l_orderkey) AS n FROM cells LEFT JOIN pairs p USING (i, j) GROUP BY i, j) SELECT count(*) FILTER (WHERE n = 0) AS empty, count(*) FILTER (WHERE n = 1) AS one, count(*) FILTER (WHERE n > 1) AS many FROM n")
def f23_cell_summary(spark, d):
    """cells with none, one and many."""
    cells = _masks(spark).filter("mask = 'all'").select("i", "j")
    n = cells.join(pairs(spark, d), ["i", "j"], "left").groupBy("i", "j").agg(F.count("l_orderkey").alias("n"))
    return A.cell_summary(n, "n")


@query(f"WITH {REPORTS} SELECT var, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS missing FROM reports GROUP BY var")
def f24_usage(spark, d):
    """use of each source."""
    return A.usage_by_source(reports(spark, d), "var", "value")


@query(f"WITH {PAIRS}, m AS (SELECT station, avg(an) AS a, avg(obs) AS b FROM pairs GROUP BY station) SELECT {_err('an', 'obs', 3)}, {r('corr(an, obs)', 'r')}, 'record' AS level FROM pairs UNION ALL SELECT {_err('a', 'b', 3)}, {r('corr(a, b)', 'r')}, 'station' FROM m")
def f25_station_means(spark, d):
    """errors of records and of station means."""
    out = A.station_mean_errors(pairs(spark, d), "station", "an", "obs")
    return out.select("n", *[F.round(x, 3).alias(x) for x in ("mean_a", "mean_b", "bias", "rmse", "mae")], F.round("r", 6).alias("r"), "level")


@query(f"""WITH {SERIES_DAY}, m AS (SELECT station, day, avg(value) AS w FROM reports GROUP BY station, day), x AS (SELECT m.w - s.v AS d FROM series_day s JOIN m USING (station, day))
 SELECT count(d) AS n, {r('max(abs(d))', 'max_abs')}, {r('avg(abs(d))', 'mean_abs')}, {r('avg(d)', 'mean')}, {r('stddev_pop(d)', 'std')}, max(abs(d)) < 1 AS passed FROM x""")
def f26_compare_tables(spark, d):
    """old and new table of the same key."""
    new = reports(spark, d).groupBy("station", "day").agg(F.avg("value").alias("v"))
    return rounded(A.compare_tables(series_day(spark, d), new, ["station", "day"], "v", 1.0))


@query("SELECT s_suppkey, 'st_' || lpad(CAST(row_number() OVER (ORDER BY s_name, s_suppkey) AS VARCHAR), 5, '0') AS id FROM supplier")
def i1_stable_ids(spark, d):
    """Ids in key order."""
    return O.stable_ids(read(spark, d, "supplier"), ["s_name", "s_suppkey"], "id", "st_").select("s_suppkey", "id")


@query(f"WITH {PAIRS} SELECT station, {r('stddev_pop(an)', 'spread', 3)} FROM pairs GROUP BY station ORDER BY stddev_pop(an) DESC, station LIMIT 10")
def i2_top(spark, d):
    """The widest spread."""
    s = pairs(spark, d).groupBy("station").agg(F.stddev_pop("an").alias("spread"))
    return rounded(O.top_n(s, [F.desc("spread"), F.asc("station")], 10), 3)


@query("SELECT c_custkey FROM customer ORDER BY (c_custkey * 1103515245 + 42) % 2147483647, c_custkey LIMIT 25")
def i3_pick_random(spark, d):
    """A seeded choice without replacement."""
    return O.pick_random(read(spark, d, "customer"), "c_custkey", 25, 42).select("c_custkey")


@query(f"WITH {SERIES_DAY} SELECT station, day FROM (SELECT *, dense_rank() OVER (ORDER BY station) AS k FROM series_day) WHERE k <= 12")
def i4_limit_size(spark, d):
    """I4: a number of whole samples."""
    return O.limit_groups(series_day(spark, d), "station", 12).select("station", "day")


@query(f"""WITH {SERIES_DAY}, a AS (SELECT station, day, (day // 3) AS chunk, row_number() OVER (PARTITION BY day // 3 ORDER BY ((station * 10007 + day) * 1103515245 + 7) % 2147483647, station, day) - 1 AS i FROM series_day)
 SELECT station, day, chunk, CAST(i // 64 AS BIGINT) AS batch, pl - 1 AS chunk_at FROM a JOIN (SELECT chunk, row_number() OVER (ORDER BY (chunk * 1103515245 + 7) % 2147483647, chunk) AS pl FROM (SELECT DISTINCT chunk FROM a)) USING (chunk)""")
def i5_batches(spark, d):
    """Shuffled batches within time chunks."""
    s = series_day(spark, d).withColumn("k", F.col("station") * 10007 + F.col("day"))
    return O.grouped_batches(s, F.floor(F.col("day") / 3), "k", 64, 7, ["station", "day"]).select("station", "day", "chunk", "batch", "chunk_at")


@query(f"WITH {POINTS} SELECT id, lat, 't' AS src FROM targets UNION ALL SELECT id, lat, 'p' FROM points")
def j1_union(spark, d):
    """Frames put together by name."""
    return targets(spark, d).select("id", "lat", F.lit("t").alias("src")).unionByName(neighbours(spark, d).select(F.lit("p").alias("src"), "lat", "id"))


@query(f"WITH {REPORTS} SELECT station, min(event_id) AS event_id FROM reports GROUP BY station")
def j2_first_per_key(spark, d):
    """The first row of each key."""
    return O.first_per_key(reports(spark, d), ["station"], [F.asc("event_id")]).select("station", "event_id")


@query(f"WITH {POINTS} SELECT id FROM targets EXCEPT SELECT id FROM points WHERE id % 2 = 0")
def j3_difference(spark, d):
    """Ids of one table only."""
    return targets(spark, d).select("id").exceptAll(neighbours(spark, d).filter("id % 2 = 0").select("id"))


@query(f"WITH {SERIES_HOUR} SELECT hour FROM series_hour WHERE var = 'view' INTERSECT SELECT hour FROM series_hour WHERE var = 'signup'")
def j4_intersection(spark, d):
    """Times of both axes."""
    s = series_hour(spark, d)
    return s.filter("var = 'view'").select("hour").intersect(s.filter("var = 'signup'").select("hour"))
