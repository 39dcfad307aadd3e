"""Queries: joins by place, grids, fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.operators import spatial as E
from stationflow.plans.grid_time import HAV
from stationflow.plans.registry import PAIRS, POINTS, REPORTS, SERIES_DAY, neighbours, pairs, query, r, read, reports, rounded, series_day, targets

_NEAR = f"near AS (SELECT t.id AS target, p.id AS point, {HAV('t.lat', 'p.lat', 't.lon', 'p.lon')} AS km, t.lat AS tlat, t.lon AS tlon, p.lat AS plat, p.lon AS plon, p.h - t.h AS dh FROM targets t, points p), within AS (SELECT * FROM near WHERE km <= 100)"
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY km, point) AS rank, least(count(*) OVER (PARTITION BY target), 65535) AS n_radius FROM within)"
_BEARING = "(degrees(atan2(sin(radians(plon - tlon)) * cos(radians(plat)), cos(radians(tlat)) * sin(radians(plat)) - sin(radians(tlat)) * cos(radians(plat)) * cos(radians(plon - tlon)))) + 360) % 360"
GRID = "grid AS (SELECT i * 120 + j AS id, i, j, 36.5 + 0.25 * i AS lat, -5.25 + 0.25 * j AS lon, 0.0 AS h FROM range(80) a(i), range(120) b(j))"
FIELD = "field AS (SELECT i, j, CAST(p_retailprice AS DOUBLE) AS value FROM (SELECT i, j, i * 120 + j AS k FROM range(80) a(i), range(120) b(j)) c JOIN part ON p_partkey = k % (SELECT count(*) FROM part))"


def grid(spark):
    g = spark.range(80 * 120).select("id", F.floor(F.col("id") / 120).alias("i"), (F.col("id") % 120).alias("j"))
    return g.select("id", "i", "j", (36.5 + 0.25 * F.col("i")).alias("lat"), (-5.25 + 0.25 * F.col("j")).alias("lon"), F.lit(0.0).alias("h"))


def field(spark, d):
    part = read(spark, d, "part")
    n = part.agg(F.count("*").alias("n"))
    g = grid(spark).crossJoin(F.broadcast(n)).withColumn("p_partkey", F.col("id") % F.col("n"))
    return part.join(F.broadcast(g), "p_partkey").select("i", "j", F.col("p_retailprice").alias("value"))  # a grid of fixed size


@query(f"WITH {POINTS}, r AS (SELECT c_custkey, c_custkey % 100 AS k FROM customer) SELECT c_custkey, p.id AS station_id FROM r JOIN points q ON q.id = r.k JOIN points p ON p.lat = q.lat AND p.lon = q.lon AND p.h = q.h")
def e1_station_key(spark, d):
    """Reports matched on a canonical place."""
    p = neighbours(spark, d)
    r_ = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 100).alias("id")).join(p, "id").select("c_custkey", "lat", (F.col("lon") + 360).alias("lon"), "h")
    return E.match_station_key(r_, p).select("c_custkey", "station_id")


@query(f"WITH {POINTS}, {_NEAR}, {_RANKED} SELECT target, point, rank, {r('km', 'distance_km', 5)}, {r(_BEARING, 'bearing_deg', 4)}, dh AS height_difference_m, n_radius FROM ranked WHERE rank <= 5")
def e2_radius_knn(spark, d):
    """Nearest points within a radius."""
    t, p = targets(spark, d), neighbours(spark, d)
    out = E.radius_knn_join(t, p, 100.0, 5, E.crowding_salt(p, 100.0))
    return out.withColumn("distance_km", F.round("distance_km", 5)).withColumn("bearing_deg", F.round("bearing_deg", 4))


@query(f"WITH {POINTS}, {_NEAR}, {_RANKED} SELECT target, point, {r('km', 'distance_km', 5)} FROM ranked WHERE rank = 1")
def e3_nearest(spark, d):
    """The nearest point."""
    t, p = targets(spark, d), neighbours(spark, d)
    return rounded(E.nearest_within(t, p, 100.0), 5)


@query(f"""WITH {SERIES_DAY}, {POINTS}, d AS (SELECT DISTINCT station, day FROM series_day), t AS (SELECT d.day, g.* FROM targets g JOIN d ON d.station = g.id), p AS (SELECT d.day, q.* FROM points q JOIN d ON d.station = q.id),
 n AS (SELECT t.day, t.id AS target, p.id AS point, {HAV('t.lat', 'p.lat', 't.lon', 'p.lon')} AS km FROM t JOIN p ON p.day = t.day WHERE {HAV('t.lat', 'p.lat', 't.lon', 'p.lon')} <= 100)
 SELECT day, target, point, {r('km', 'distance_km', 5)} FROM n QUALIFY row_number() OVER (PARTITION BY day, target ORDER BY km, point) = 1""")
def e3_nearest_by_time(spark, d):
    """The nearest point that reports at the time; stations come and go."""
    days = series_day(spark, d).select(F.col("station").alias("id"), "day").distinct()
    return rounded(E.nearest_within(targets(spark, d).join(days, "id"), neighbours(spark, d).join(days, "id"), 100.0, time="day"), 5)


@query(f"WITH {POINTS}, {GRID}, n AS (SELECT g.id, least(count(*), 5) AS n FROM grid g, points p WHERE {HAV('g.lat', 'p.lat', 'g.lon', 'p.lon')} <= 50 GROUP BY g.id) SELECT count(*) AS cells, count(n) AS with_any, {r('avg(CAST(coalesce(n, 0) >= 3 AS DOUBLE))', 'share')} FROM grid LEFT JOIN n USING (id)")
def e4_grid_knn(spark, d):
    """How many cells have neighbours."""
    p = neighbours(spark, d)
    return rounded(E.coverage(grid(spark).select("id", "lat", "lon", "h"), p, 50.0, 5, 3))


@query(f"""WITH {POINTS} SELECT id, greatest(0, least(79, CAST(ceil((lat - 36.5) / 0.25 - 0.5) AS BIGINT))) AS i, greatest(0, least(119, CAST(ceil((lon + 5.25) / 0.25 - 0.5) AS BIGINT))) AS j,
 (SELECT arg_min(k, struct_pack(d := abs(v - lon), k := k)) FROM (SELECT k, CAST(-5.0 AS DOUBLE) + CAST(k * k AS DOUBLE) * CAST(0.7 AS DOUBLE) AS v FROM range(7) x(k))) AS irregular FROM targets""")
def e5_nearest_index(spark, d):
    """E5: index on uniform and irregular axes."""
    t = targets(spark, d)
    axis = spark.range(7).select(F.col("id").alias("k"), (-5.0 + F.col("id") * F.col("id") * 0.7).alias("v"))
    out = E.nearest_on_axis(t, axis, "lon", "v", "k")
    return out.select("id", E.nearest_index(F.col("lat"), 36.5, 0.25, 80).alias("i"), E.nearest_index(F.col("lon"), -5.25, 0.25, 120).alias("j"), F.col("at").alias("irregular"))


_CORNER = """c AS (SELECT id, least(CAST(floor(y) AS BIGINT), 78) AS i, least(CAST(floor(x) AS BIGINT), 118) AS j, y, x FROM (SELECT id, greatest(0.0, least(79.0, (lat - 36.5) / 0.25)) AS y, greatest(0.0, least(119.0, (lon + 5.25) / 0.25)) AS x FROM targets)),
 w AS (SELECT id, i + a AS i, j + b AS j, (CASE WHEN a = 1 THEN y - i ELSE 1 - (y - i) END) * (CASE WHEN b = 1 THEN x - j ELSE 1 - (x - j) END) AS w FROM c, range(2) p(a), range(2) q(b))"""


@query(f"WITH {POINTS}, {FIELD}, {_CORNER} SELECT id, {r('sum(w * value)', 'value', 5)} FROM w JOIN field USING (i, j) GROUP BY id")
def e6_bilinear(spark, d):
    """Bilinear sampling at stations."""
    w = E.corners(targets(spark, d).select("id", "lat", "lon"), 36.5, -5.25, 0.25, 80, 120).select("id", "i", "j", "w")
    return rounded(E.bilinear_sample(field(spark, d), w, ["id"]), 5)


@query(f"""WITH {POINTS}, {FIELD}, {_CORNER} SELECT id, 'z' AS channel, {r('sum(w * value)', 'value', 5)} FROM w JOIN field USING (i, j) GROUP BY id
 UNION ALL SELECT id, 'tvh_1', CAST((greatest(0, least(79, CAST(ceil((lat - 36.5) / 0.25 - 0.5) AS BIGINT))) + greatest(0, least(119, CAST(ceil((lon + 5.25) / 0.25 - 0.5) AS BIGINT)))) % 2 AS DOUBLE) FROM targets""")
def e7_static(spark, d):
    """Continuous channels bilinear, one-hot channels nearest."""
    f = field(spark, d).select("i", "j", "value", F.lit("z").alias("channel"), F.lit(False).alias("onehot"))
    hot = grid(spark).select("i", "j", ((F.col("i") + F.col("j")) % 2).cast("double").alias("value"), F.lit("tvh_1").alias("channel"), F.lit(True).alias("onehot"))
    return rounded(E.sample_static(f.unionByName(hot), targets(spark, d), 36.5, -5.25, 0.25, 80, 120), 5)


@query(f"WITH {FIELD}, t AS (SELECT ti, tj, 38.0 + 0.5 * ti AS lat, CASE WHEN tj % 2 = 0 THEN 2.0 + 0.5 * tj ELSE 362.0 + 0.5 * tj END AS lon FROM range(20) a(ti), range(30) b(tj)), u AS (SELECT *, CAST(ceil((lat - 36.5) / 0.25 - 0.5) AS BIGINT) AS i, CAST(ceil(((lon + 5.25) % 360) / 0.25 - 0.5) AS BIGINT) AS j FROM t) SELECT ti, tj, {r('value', 'value')} FROM u JOIN field USING (i, j)")
def e8_remap(spark, d):
    """Nearest source cell, longitudes wrapped."""
    t = spark.range(600).select(F.floor(F.col("id") / 30).alias("ti"), (F.col("id") % 30).alias("tj"))
    t = t.withColumn("lat", 38.0 + 0.5 * F.col("ti")).withColumn("lon", F.when(F.col("tj") % 2 == 0, 2.0 + 0.5 * F.col("tj")).otherwise(362.0 + 0.5 * F.col("tj")))
    return rounded(E.remap_region(field(spark, d), t, 36.5, -5.25, 0.25, 80, 120).select("ti", "tj", "value"))


@query(f"""WITH {FIELD}, t AS (SELECT ti, tj, greatest(0.0, least(79.0, (ti + 0.5) * 2 - 0.5)) AS y, greatest(0.0, least(119.0, (tj + 0.5) * 3 - 0.5)) AS x FROM range(40) a(ti), range(40) b(tj)),
 c AS (SELECT *, least(CAST(floor(y) AS BIGINT), 78) AS ci, least(CAST(floor(x) AS BIGINT), 118) AS cj FROM t),
 w AS (SELECT ti, tj, ci + a AS i, cj + b AS j, (CASE WHEN a = 1 THEN y - ci ELSE 1 - (y - ci) END) * (CASE WHEN b = 1 THEN x - cj ELSE 1 - (x - cj) END) AS w FROM c, range(2) p(a), range(2) q(b))
 SELECT ti, tj, {r('sum(w * value)', 'value', 5)} FROM w JOIN field USING (i, j) GROUP BY ti, tj""")
def e9_regrid(spark, d):
    """Another size by pixel centres."""
    return rounded(E.regrid_bilinear(field(spark, d), 80, 120, 40, 40), 5)


_MAP = "cells AS (SELECT CAST(floor((lat - 36.5) / 0.25 + 0.5) AS BIGINT) AS i, CAST(floor((lon + 5.25) / 0.25 + 0.5) AS BIGINT) AS j, id FROM targets), m AS (SELECT i, j, count(*) AS n, arg_min(id, struct_pack(h := (id * 1103515245 + 5) % 2147483647, id := id)) AS station_id FROM cells GROUP BY i, j)"


@query(f"WITH {POINTS}, {GRID}, {_MAP} SELECT g.i, g.j, coalesce(n, 0) AS n_stations, n IS NOT NULL AS mask, station_id FROM grid g LEFT JOIN m USING (i, j)")
def e10_map_stations(spark, d):
    """One station a cell."""
    return E.map_stations_to_grid(targets(spark, d), 36.5, -5.25, 0.25, 80, 120, 5)


@query(f"WITH {POINTS} SELECT l.id, l.lat, p.h AS ph FROM targets l LEFT JOIN (SELECT id, h FROM points) p USING (id)")
def e11_metadata(spark, d):
    """Station heights attached, unmatched rows kept."""
    return E.attach_metadata(targets(spark, d).select("id", "lat"), neighbours(spark, d).select("id", F.col("h").alias("ph")), "id")


_THREE = "a AS (SELECT station, day, avg(value) AS a FROM reports WHERE var = 'view' GROUP BY station, day), b AS (SELECT station, day, avg(value) AS b FROM reports WHERE var = 'click' GROUP BY station, day), c AS (SELECT station, day, avg(value) AS c FROM reports WHERE var = 'error' GROUP BY station, day)"


@query(f"WITH {REPORTS}, {_THREE} SELECT station, day, {r('a', 'a')}, {r('b', 'b')}, {r('c', 'c')} FROM a JOIN b USING (station, day) JOIN c USING (station, day)")
def e12_three_way(spark, d):
    """Three tables on time and station."""
    e = reports(spark, d)
    parts = [e.filter(F.col("var") == v).groupBy("station", "day").agg(F.avg("value").alias(n)) for v, n in (("view", "a"), ("click", "b"), ("error", "c"))]
    return rounded(E.join_on_time_station(["station", "day"], *parts))


@query(f"WITH {POINTS} SELECT id FROM targets WHERE id NOT IN (SELECT id FROM points)")
def e13_missing(spark, d):
    """Ids without coordinates."""
    return E.unmatched(targets(spark, d).select("id"), neighbours(spark, d).select("id"), "id")


@query(f"""WITH {SERIES_DAY}, s AS (SELECT station, day AS t FROM series_day), w AS (SELECT s.station, s.t, unnest(range(t - 2, t + 1)) AS day FROM s)
 SELECT station, t, count(v) AS n, {r('sum(v)', 'total')} FROM w LEFT JOIN series_day USING (station, day) GROUP BY station, t HAVING count(v) > 0""")
def e14_window_join(spark, d):
    """Frames of each sample's window."""
    s = series_day(spark, d)
    out = E.window_join(s, s.select("station", "day"), "station", "day", "v", 3)
    return rounded(out.select("station", "t", "n", F.aggregate("frames", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("total")))


@query(f"""WITH {POINTS}, {FIELD}, a AS (SELECT id, greatest(0, least(79, CAST(ceil((lat - 36.5) / 0.25 - 0.5) AS BIGINT))) AS ci, greatest(0, least(119, CAST(ceil((lon + 5.25) / 0.25 - 0.5) AS BIGINT))) AS cj FROM targets)
 SELECT id, {r('max(value) FILTER (WHERE i = ci AND j = cj)', 'nearest')}, {r('avg(value)', 'mean', 5)} FROM a JOIN field ON i BETWEEN ci - 1 AND ci + 1 AND j BETWEEN cj - 1 AND cj + 1 GROUP BY id""")
def e15_dem(spark, d):
    """Nearest height, and the mean of nine cells."""
    out = E.dem_mean_3x3(field(spark, d), targets(spark, d), 36.5, -5.25, 0.25, 80, 120)
    return rounded(out, 5)


@query(f"WITH {POINTS}, {GRID}, {_MAP} SELECT DISTINCT g.i, g.j FROM grid g JOIN m ON g.i BETWEEN m.i - 2 AND m.i + 2 AND g.j BETWEEN m.j - 2 AND m.j + 2")
def e16_halo(spark, d):
    """Cells around stations."""
    cells = E.map_stations_to_grid(targets(spark, d), 36.5, -5.25, 0.25, 80, 120, 5).filter("mask")
    return E.halo_mask(cells, 2, 80, 120)


@query(f"WITH {PAIRS}, s AS (SELECT channel, avg(an) AS mean, stddev_pop(an) AS std FROM pairs GROUP BY channel) SELECT channel, l_orderkey, l_linenumber, l_partkey, {r('(an - mean) / std', 'z', 5)} FROM pairs JOIN s USING (channel)")
def e17_stats(spark, d):
    """Scaled by the statistics of its channel."""
    from stationflow.functions.expr import zscore
    from stationflow.operators.aggregates import fit_standardizer

    p = pairs(spark, d)
    out = E.attach_stats(p, fit_standardizer(p, ["channel"], "an"), "channel")
    return rounded(out.select("channel", "l_orderkey", "l_linenumber", "l_partkey", zscore("an", "mean", "std").alias("z")), 5)


@query(f"WITH {POINTS}, {_NEAR}, {_RANKED} SELECT target, string_agg(CAST(point AS VARCHAR), ',' ORDER BY rank) AS points FROM ranked WHERE rank <= 5 GROUP BY target")
def e18_neighbour_list(spark, d):
    """Ids of neighbours by rank."""
    out = E.neighbour_list(E.radius_knn_join(targets(spark, d), neighbours(spark, d), 100.0, 5, counts=False), 5)
    return out.select("target", F.concat_ws(",", F.transform("points", lambda x: x.cast("string"))).alias("points"))


@query(f"WITH {POINTS}, {_NEAR}, {_RANKED}, t AS (SELECT DISTINCT target FROM ranked) SELECT target, k AS rank, coalesce(dh, 0) AS up_m, coalesce(p.h, 0) AS height_m FROM t CROSS JOIN (SELECT unnest(range(1, 6)) AS k) LEFT JOIN ranked USING (target) LEFT JOIN points p ON p.id = point WHERE rank = k OR rank IS NULL UNION ALL SELECT target, k, 0, 0 FROM (SELECT target, unnest(range(1, 6)) AS k FROM t) x WHERE NOT EXISTS (SELECT 1 FROM ranked y WHERE y.target = x.target AND y.rank = x.k)")
def e19_geometry(spark, d):
    """neighbours' frame by rank, zero padded."""
    t, p = targets(spark, d), neighbours(spark, d)
    return E.neighbour_geometry(E.radius_knn_join(t, p, 100.0, 5, counts=False), t, p, 5).select("target", "rank", "up_m", "height_m")


@query(f"WITH {POINTS}, {_NEAR}, {_RANKED}, t AS (SELECT DISTINCT target FROM ranked), k AS (SELECT target, unnest(range(1, 6)) AS rank FROM t) SELECT k.target, k.rank, coalesce(dh, 0) AS up_m, coalesce(p.h, 0) AS height_m, {r('CASE WHEN p.id IS NULL THEN 0 ELSE g.lat END', 'target_lat')}, {r('coalesce(p.lon, 0)', 'lon')}, {r('coalesce(p.h + 2 * p.lat, 0)', 'static')} FROM k LEFT JOIN ranked USING (target, rank) LEFT JOIN points p ON p.id = point LEFT JOIN targets g ON g.id = k.target")
def e19_geometry8(spark, d):
    """With both places and a static vector."""
    t, p = targets(spark, d), neighbours(spark, d)
    static = p.select("id", F.array("h", "lat").alias("static"))
    out = E.neighbour_geometry(E.radius_knn_join(t, p, 100.0, 5, counts=False), t, p, 5, 8, static)
    return rounded(out.select("target", "rank", "up_m", "height_m", "target_lat", "lon", (F.col("static")[0] + 2 * F.col("static")[1]).alias("static")))


@query(f"""WITH {POINTS}, {FIELD}, a AS (SELECT id, CASE WHEN lat <= 36.5 + 0.25 * 59 THEN least(CAST(floor((lat - 36.5) / 0.25) AS BIGINT), 58) END AS i0, least(CAST(floor((lon + 5.25) / 0.25) AS BIGINT), 118) AS j0, (lat - 36.5) / 0.25 AS y, (lon + 5.25) / 0.25 AS x FROM targets)
 SELECT a.id, {r('sum((1 - abs(y - i)) * (1 - abs(x - j)) * value)', 'value', 4)} FROM a LEFT JOIN field ON i BETWEEN i0 AND i0 + 1 AND j BETWEEN j0 AND j0 + 1 GROUP BY a.id""")
def e9_regrid_axes(spark, d):
    """Linear between given axes, NULL outside."""
    return rounded(E.regrid_axes(field(spark, d), [36.5 + 0.25 * k for k in range(60)], [-5.25 + 0.25 * k for k in range(120)], targets(spark, d)), 4)


@query(f"WITH {PAIRS}, f AS (SELECT channel, day, max(an) AS value FROM pairs GROUP BY channel, day), g AS (SELECT channel, day, max(obs) AS value FROM pairs WHERE day % 2 = 0 GROUP BY channel, day) SELECT day, channel, {r('value', 'value', 6)} FROM f WHERE channel <> 'NO' UNION ALL SELECT day, 'NO', {r('value', 'value', 6)} FROM (SELECT DISTINCT day FROM f) LEFT JOIN (SELECT * FROM g WHERE channel = 'NO') USING (day)")
def e20_fuse(spark, d):
    """One channel from another source."""
    p = pairs(spark, d)
    a = p.groupBy("channel", "day").agg(F.max("an").alias("value"))
    b = p.filter("day % 2 = 0").groupBy("channel", "day").agg(F.max("obs").alias("value"))
    return rounded(E.fuse_fields(a, b, "NO", ["day"]))


@query(f"WITH {SERIES_DAY}, x AS (SELECT station, day, max(value) AS m FROM reports WHERE var = 'purchase' GROUP BY station, day), j AS (SELECT s.day, x.m FROM series_day s LEFT JOIN x USING (station, day)) SELECT {r('avg(CAST(m IS NOT NULL AS DOUBLE))', 'share')}, count(DISTINCT day) FILTER (WHERE m IS NOT NULL) AS times FROM j")
def e21_optional(spark, d):
    """An optional source and its coverage."""
    x = reports(spark, d).filter("var = 'purchase'").groupBy("station", "day").agg(F.max("value").alias("m"))
    return rounded(E.covered_share(E.attach_optional_source(series_day(spark, d), x, ["station", "day"], "x_"), "x_m", "day"))


@query(f"WITH {REPORTS}, a AS (SELECT station, day, sum(value) AS value FROM reports WHERE var = 'view' GROUP BY station, day), b AS (SELECT station, day, sum(value) AS value FROM reports WHERE var <> 'view' GROUP BY station, day) SELECT station, day, {r('value', 'value')}, 0 AS priority FROM a UNION ALL SELECT station, day, {r('value', 'value')}, 1 FROM b WHERE (station, day) NOT IN (SELECT (station, day) FROM a)")
def a8_first_wins(spark, d):
    """Ordered sources, the first wins."""
    e = reports(spark, d)
    a, b = (e.filter(c).groupBy("station", "day").agg(F.sum("value").alias("value")) for c in ("var = 'view'", "var <> 'view'"))
    return rounded(E.union_sources_first_wins([a, b], ["station", "day"]))
