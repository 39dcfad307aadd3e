"""Queries: scalar functions, time axes, quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.functions import expr as X
from stationflow.operators import quality as Q
from stationflow.operators import timegrid as B
from stationflow.operators.ordering import row_blocks
from stationflow.plans.registry import FCST, PAIRS, POINTS, REPORTS, SERIES_DAY, SERIES_HOUR, TARGETS, forecasts, neighbours, pairs, query, r, read, reports, rounded, series_day, series_hour, targets

_HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2))))"
HAV = lambda a, b, c, d: _HAV.format(a, b, c, d)  # noqa: E731  lat1, lat2, lon1, lon2


@query(f"""WITH {TARGETS} SELECT id, {r('((lon * 3 + 180) % 360 + 360) % 360 - 180', 'lon180')}, {r('((lon * 3) % 360 + 360) % 360', 'lon360')},
 {r('-5.0 - (id % 60) / 60.0 - (id % 50) / 3600.0', 'dms')}, {r('degrees(0) + lat', 'lat')}, {r(HAV('lat', '40.0', 'lon', '0.0'), 'km')},
 {r("2 * sin(" + HAV('lat', '40.0', 'lon', '0.0') + " / 6371.0088 / 2)", 'chord')},
 {r("radians(lon - 0.0) * cos(radians(40.0)) * 6371000.0", 'x', 3)}, {r("radians(lat - 40.0) * 6371000.0", 'y', 3)},
 {r("((degrees(atan2(sin(radians(0.0 - lon)) * cos(radians(40.0)), cos(radians(lat)) * sin(radians(40.0)) - sin(radians(lat)) * cos(radians(40.0)) * cos(radians(0.0 - lon)))) + 360) % 360 + 360) % 360", 'bearing', 5)},
 {r("sin(radians(lat))", 'sin_lat')}, {r("cos(radians(lon))", 'cos_lon')}, CAST(round_even(lat * 1000000, 0) AS BIGINT) AS key_lat, CAST(round_even(h * 100, 0) AS BIGINT) AS key_h, {r('round_even(lat, 1)', 'lat1')} FROM targets""")
def d_geography(spark, d):
    """Longitudes, degrees, distances, bearings, side channels, station keys."""
    t, zero, forty = targets(spark, d), F.lit(0.0), F.lit(40.0)
    xy, side, key = X.equirect_xy("lat", "lon", forty, zero), X.latlon_side_channels("lat", "lon"), X.station_key("lat", "lon", "h")
    out = t.select("id", X.wrap_lon_180(F.col("lon") * 3).alias("lon180"), X.wrap_lon_360(F.col("lon") * 3).alias("lon360"), X.dms_to_deg(F.lit(-5.0), F.col("id") % 60, F.col("id") % 50).alias("dms"), "lat", X.haversine_km("lat", "lon", forty, zero).alias("km"), X.chord("lat", "lon", forty, zero).alias("chord"), F.round(xy["x"], 3).alias("x"), F.round(xy["y"], 3).alias("y"), F.round(X.initial_bearing("lat", "lon", forty, zero), 5).alias("bearing"), side["sin_lat"].alias("sin_lat"), side["cos_lon"].alias("cos_lon"), key["lat"].alias("key_lat"), key["h"].alias("key_h"), X.round_key("lat", 1).alias("lat1"))
    return rounded(out)


def _ecef(p: str) -> str:
    n = f"(6378137.0 / sqrt(1 - 6.69437999014e-3 * pow(sin(radians({p}.lat)), 2)))"
    return f"({n} + {p}.h) * cos(radians({p}.lat)) * cos(radians({p}.lon)) AS x, ({n} + {p}.h) * cos(radians({p}.lat)) * sin(radians({p}.lon)) AS y, ({n} * (1 - 6.69437999014e-3) + {p}.h) * sin(radians({p}.lat)) AS z"


@query(f"""WITH {POINTS}, a AS (SELECT *, {_ecef('targets')} FROM targets), b AS (SELECT *, {_ecef('points')} FROM points),
 j AS (SELECT a.id AS target, b.id AS point, radians(a.lat) AS p, radians(a.lon) AS q, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, b.h - a.h AS up_m FROM a JOIN b ON a.id % 10 = b.id % 10)
 SELECT target, point, {r('(-sin(q) * dx + cos(q) * dy) / 1000', 'east_km')}, {r('(-sin(p) * cos(q) * dx - sin(p) * sin(q) * dy + cos(p) * dz) / 1000', 'north_km')}, up_m FROM j""")
def d6_enu(spark, d):
    """Earth-centred coordinates and the local frame."""
    t, p = targets(spark, d), neighbours(spark, d)
    tasks = max(1, t.count() * p.count() // 10 // 2_000_000)  # the pairs are dealt evenly; trigonometry is a row's, not a pair's
    t = t.select((F.col("id") % 10).alias("unit"), "lon", "h", F.col("id").alias("target"), X.enu_frame("lat", "lon", "h").alias("frame"))
    p = p.select((F.col("id") % 10).alias("unit"), F.col("id").alias("point"), X.ecef("lat", "lon", "h").alias("place"), "h")
    # east is the same for all targets of a longitude, so a file of few longitudes and points holds few different values
    ts, ps = row_blocks(t, ["unit"], ["lon", "h", "target"], 256, "ts"), row_blocks(p, ["unit"], ["point"], 512, "ps")
    tiles = ts.join(ps, "unit").repartition(tasks, "unit", "ts_at", "ps_at")
    j = tiles.select("ps", F.inline("ts")).select("target", "frame", F.inline("ps"))
    e = X.enu_in("frame", "place", "h")
    return j.select("target", "point", *[X.round_half_up(e[k], 6).alias(k) for k in ("east_km", "north_km")], e["up_m"].alias("up_m"))


_T, _RH, _P = "(250.0 + (s_suppkey % 60))", "(20.0 + (s_suppkey % 80))", "(900.0 + (s_suppkey % 120))"
_ESW, _ESI = f"(6.1078 * exp(17.269 * ({_T} - 273.15) / ({_T} - 273.15 + 237.3)))", f"(6.1078 * exp(22.44294 * ({_T} - 273.15) / ({_T} - 273.15 + 272.4406)))"
_ALPHA = f"(CASE WHEN {_T} >= 273.16 THEN 1.0 WHEN {_T} <= 250.16 THEN 0.0 ELSE pow(({_T} - 250.16) / 23.0, 2) END)"
_Q = f"({_RH} / 100 * ({_ALPHA} * 611.21 * exp(17.502 * ({_T} - 273.16) / ({_T} - 32.19)) + (1 - {_ALPHA}) * 611.21 * exp(22.587 * ({_T} - 273.16) / ({_T} + 0.7))))"
_ZHD = f"(2.2768 * {_P} / (1 - 0.00266 * cos(2 * radians(45.0)) - 0.00000028 * 100.0))"


@query(f"""SELECT s_suppkey, {r(_ESW, 'es_water')}, {r(_ESI, 'es_ice')}, {r(f'6.112 * exp(17.67 * ({_T} - 273.15) / ({_T} - 273.15 + 243.5))', 'es_bolton')}, {r(f'{_ESW} * {_RH} / 100', 'e')},
 {r(f'0.622 * {_Q} / ({_P} * 100 - 0.378 * {_Q})', 'q', 8)}, {r(f'{_P} * exp(-9.80665 * 100.0 / (287.05 * {_T}))', 'p_station')}, {r(f'{_P} * exp(-9.80665 * 100.0 / (287.05 * ({_T} + 0.325)))', 'p_lapse')},
 {r(f'{_P} * exp(-9.80665 * (0.0 - 100.0) / (287.05 * {_T}))', 'p_sea')}, {r(_ZHD, 'zhd')}, {r(f'2.277 * (1255.0 / {_T} + 0.05) * {_ESW} * {_RH} / 100', 'zwd')}, {r(f'{_ZHD} + 2.277 * (1255.0 / {_T} + 0.05) * {_ESW} * {_RH} / 100', 'ztd')},
 {r('ln(1 + greatest(s_acctbal, 0.0) * 1000)', 'rain')}, {r('(s_acctbal - 10) / 4', 'z')}, {r('s_acctbal * 4 + 10', 'unz')}, {r('s_acctbal / 9.80665', 'gph')}, {r('s_acctbal / 100', 'hpa')},
 CASE WHEN s_nationkey <> 0 THEN {"round(100.0 * (s_nationkey - s_suppkey) / s_nationkey, 6)"} END AS improve, {r('CASE WHEN s_nationkey <> 0 THEN s_acctbal / s_nationkey ELSE 0 END', 'safe')}, {r('1e-6 * 77.6890 * 287.05 / 9.80665 * 50.0', 'top', 8)} FROM supplier""")
def d_physics(spark, d):
    """Humidity, pressure, delays, rain, scaling, units, safe division."""
    s, k = read(spark, d, "supplier"), F.col("s_suppkey")
    t, rh, p, h, lat = F.lit(250.0) + k % 60, F.lit(20.0) + k % 80, F.lit(900.0) + k % 120, F.lit(100.0), F.lit(45.0)
    z, bal, n = X.ztd_surface(t, p, rh, h, lat), F.col("s_acctbal"), F.col("s_nationkey").cast("double")
    out = s.select("s_suppkey", X.sat_vapor_pressure(t).alias("es_water"), X.sat_vapor_pressure(t, "ice").alias("es_ice"), X.sat_vapor_pressure(t, "bolton").alias("es_bolton"), X.vapor_pressure(t, rh).alias("e"), F.round(X.specific_humidity(t, rh, p * 100), 8).alias("q"), X.station_pressure(p, h, t).alias("p_station"), X.station_pressure(p, h, t, lapse=True).alias("p_lapse"), X.reduce_pressure(p, h, F.lit(0.0), t).alias("p_sea"), z["zhd"].alias("zhd"), z["zwd"].alias("zwd"), z["ztd"].alias("ztd"), X.precip_transform(bal, metres=True).alias("rain"), X.zscore(bal, F.lit(10.0), F.lit(4.0)).alias("z"), X.unzscore(bal, F.lit(10.0), F.lit(4.0)).alias("unz"), X.geopotential_height(bal).alias("gph"), X.pa_to_hpa(bal).alias("hpa"), X.improvement_pct(n, k.cast("double")).alias("improve"), X.divide_no_nan(bal, n).alias("safe"), F.round(X.top_dry_column(F.lit(50.0)), 8).alias("top"))
    digits = {"q": 8, "top": 8}
    return out.select(*[F.round(c, digits.get(c, 6)).alias(c) if c != "s_suppkey" else F.col(c) for c in out.columns])


@query(f"""WITH {SERIES_DAY}, span AS (SELECT min(day) AS a, max(day) AS b FROM series_day), grid AS (SELECT s.station, unnest(range(a, b + 1)) AS day FROM (SELECT DISTINCT station FROM series_day) s, span)
 SELECT grid.station, grid.day, {r('v', 'v')} FROM grid LEFT JOIN series_day USING (station, day)""")
def b1_b2_align(spark, d):
    """B1, B2: a dense axis for every station."""
    return rounded(B.align_to_axis(series_day(spark, d), ["station"], "day"))


@query(f"""WITH {REPORTS}, axis AS (SELECT CAST(epoch(t) AS BIGINT) AS sec FROM (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 6 HOUR)) AS t)),
 counts AS (SELECT CAST(floor(sec / 21600.0) AS BIGINT) * 21600 AS sec, count(*) AS n_reports, count(DISTINCT station) AS n_stations FROM reports GROUP BY ALL)
 SELECT axis.sec, coalesce(n_reports, 0) AS n_reports, coalesce(n_stations, 0) AS n_stations FROM axis LEFT JOIN counts USING (sec)""")
def b1_time_axis(spark, d):
    """B1: a half-open axis, with the reports and stations of each step; steps without any stay."""
    axis = B.time_axis(spark, "2024-01-01", "2024-01-31", "6 hours", closed=False).select(F.unix_seconds("ts").alias("sec"))
    step = (F.floor(F.col("sec") / 21600) * 21600).alias("sec")
    counts = reports(spark, d).select(step, "station").groupBy("sec").agg(F.count("*").alias("n_reports"), F.countDistinct("station").alias("n_stations"))
    zero = F.lit(0).cast("long")
    return axis.join(counts, "sec", "left").select("sec", F.coalesce("n_reports", zero).alias("n_reports"), F.coalesce("n_stations", zero).alias("n_stations"))


@query(f"WITH {REPORTS} SELECT event_id, sec % 300 = 0 AS exact, CAST(floor((sec - 1704067200) / 300) AS BIGINT) AS step, CAST(hour AS BIGINT) AS hour FROM reports WHERE sec % 4 = 0")
def b3_b5_b6_steps(spark, d):
    """Exact epochs, step numbers, UTC."""
    e = reports(spark, d).filter(B.exact_epoch(F.col("sec"), 4))
    return e.select("event_id", B.exact_epoch(F.col("sec"), 300).alias("exact"), B.step_index(F.col("sec"), F.lit(1704067200), 300).alias("step"), "hour")


@query("""SELECT event_id, CAST(epoch(make_date(CASE WHEN y < 80 THEN 2000 + y ELSE 1900 + y END, 1, 1) + CAST(doy - 1 AS INTEGER)) + s AS BIGINT) AS sec
 FROM (SELECT event_id, CAST(event_id % 100 AS INTEGER) AS y, event_id % 365 + 1 AS doy, event_id % 86400 AS s FROM events)""")
def b4_parse_epoch(spark, d):
    """Yy:doy:sod."""
    k = F.col("event_id")
    text = F.concat_ws(":", F.lpad((k % 100).cast("string"), 2, "0"), (k % 365 + 1).cast("string"), (k % 86400).cast("string"))
    return read(spark, d, "events").select("event_id", F.unix_seconds(B.parse_epoch(text)).alias("sec"))


@query(f"""WITH {REPORTS}, span AS (SELECT station, min(hour) AS first, max(hour) AS last, count(*) AS n FROM reports GROUP BY station)
 SELECT station, unnest(range(first, last + 1)) AS hour FROM span""")
def b7_b8_candidates(spark, d):
    """Active span and every hour in it."""
    return B.candidate_hours(B.active_span(reports(spark, d), "station", "hour"), "station")


@query(f"""WITH {SERIES_DAY} SELECT station, day, CASE WHEN day < 19740 THEN 'train' WHEN day < 19745 THEN 'val' ELSE 'test' END AS split FROM series_day""")
def b9_assign_split(spark, d):
    """Half-open ranges with open ends."""
    return series_day(spark, d).select("station", "day", B.assign_split(F.col("day"), [("train", None, 19740), ("val", 19740, 19745), ("test", 19745, None)]).alias("split"))


_ROWS = "rows AS (SELECT var, hour, row_number() OVER (PARTITION BY var ORDER BY hour) - 1 AS i, count(*) OVER (PARTITION BY var) AS n FROM series_hour)"


@query(f"""WITH {SERIES_HOUR}, {_ROWS} SELECT var, hour, i, split FROM rows JOIN (VALUES ('train'), ('val'), ('test')) s(split)
 ON (split = 'train' AND i < floor(n * CAST(0.7 AS DOUBLE))) OR (split = 'val' AND i >= floor(n * CAST(0.7 AS DOUBLE)) - 24 AND i < n - floor(n * CAST(0.2 AS DOUBLE))) OR (split = 'test' AND i >= n - floor(n * CAST(0.2 AS DOUBLE)) - 24)""")
def b10_split_by_ratio(spark, d):
    """0.7, 0.1, 0.2 with lookback."""
    return B.split_by_ratio(series_hour(spark, d), "var", "hour", 24).select("var", "hour", "i", "split")


@query(f"""WITH {SERIES_HOUR}, {_ROWS} SELECT var, hour, i, split FROM rows JOIN (VALUES ('train'), ('val'), ('test')) s(split)
 ON (split = 'train' AND i < 300) OR (split = 'val' AND i >= 276 AND i < 400) OR (split = 'test' AND i >= 376 AND i < 500)""")
def b11_split_by_borders(spark, d):
    """Fixed borders with lookback."""
    return B.split_by_borders(series_hour(spark, d), "var", "hour", 24, (300, 100, 100)).select("var", "hour", "i", "split")


@query(f"WITH {SERIES_HOUR}, {_ROWS} SELECT var, hour, i FROM rows WHERE i >= floor(n * CAST(0.8 AS DOUBLE))")
def b12_holdout_tail(spark, d):
    """The last fifth."""
    return B.holdout_tail(series_hour(spark, d), "var", "hour").select("var", "hour", "i")


@query(f"WITH {SERIES_DAY} SELECT station, day FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY day) - 1 AS i FROM series_day WHERE v IS NOT NULL) WHERE i % 3 = 0")
def b13_stride(spark, d):
    """Every third kept row."""
    return B.stride_sample(series_day(spark, d).filter("v is not null"), ["station"], "day", 3).select("station", "day")


_CAL = [("second", "second(ts) / 59.0"), ("minute", "minute(ts) / 59.0"), ("hour", "hour(ts) / 23.0"), ("dow", "(isodow(ts) - 1) / 6.0"), ("dom", "(day(ts) - 1) / 30.0"), ("doy", "(dayofyear(ts) - 1) / 365.0")]


@query(f"SELECT event_id, {', '.join(r(e + ' - 0.5', 'cal_' + n) for n, e in _CAL)}, {r('(month(ts) - 1) / 11.0 - 0.5', 'cal_month')}, {r('(week(ts) - 1) / 52.0 - 0.5', 'cal_week')} FROM events")
def b14_calendar_linear(spark, d):
    """Scaled calendar fields."""
    ts = F.col("ts")
    return rounded(read(spark, d, "events").select("event_id", *B.calendar_linear(ts, "S"), *B.calendar_linear(ts, "M"), B.calendar_linear(ts, "W")[1]))


_CYC = [("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("dom", "(day(ts) - 1)", 31), ("doy", "(dayofyear(ts) - 1)", 365)]


@query(f"""SELECT event_id, {', '.join(r(f'{f}(2 * pi() * {e} / {p})', f'{f}_{n}') for n, e, p in _CYC for f in ('sin', 'cos'))},
 month(ts) AS month, day(ts) AS day, isodow(ts) - 1 AS weekday, hour(ts) AS hour, CAST(floor(minute(ts) / 15) AS BIGINT) AS quarter FROM events""")
def b15_b16_calendar(spark, d):
    """Cyclic and whole calendar fields."""
    return rounded(read(spark, d, "events").select("event_id", *B.calendar_cyclic(F.col("ts")), *B.calendar_integer(F.col("ts"))))


@query(f"""WITH {FCST}, axis AS (SELECT DISTINCT CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS valid FROM orders WHERE o_orderkey % 3 = 0)
 SELECT lead, count(*) AS n, {r('sum(value)', 'total', 2)} FROM fcst JOIN axis ON init + lead = valid GROUP BY lead""")
def b17_lead_align(spark, d):
    """Forecasts valid at the axis' times."""
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    axis = read(spark, d, "orders").filter("o_orderkey % 3 = 0").select(day.alias("valid"))
    return B.lead_align(forecasts(spark, d), axis, "init", "lead", "valid").groupBy("lead").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""WITH {REPORTS}, a AS (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS pos FROM (SELECT DISTINCT hour FROM reports WHERE var = 'signup')), b AS (SELECT DISTINCT hour FROM reports WHERE var = 'view')
 SELECT hour, coalesce(pos, -1) AS "at" FROM b LEFT JOIN a USING (hour)""")
def b18_match_axes(spark, d):
    """Index of each time in another axis."""
    e = reports(spark, d)
    return B.match_axes(e.filter("var = 'signup'"), e.filter("var = 'view'"), "hour")


@query(f"WITH {REPORTS} SELECT hour FROM reports GROUP BY hour HAVING count(DISTINCT var) = 5")
def b19_common_times(spark, d):
    """Hours that all sources have."""
    e = reports(spark, d)
    return B.common_times("hour", *[e.filter(F.col("var") == v) for v in ("click", "error", "purchase", "signup", "view")])


@query(f"WITH {REPORTS} SELECT event_id, hour, CAST(hour % 24 AS BIGINT) AS hod FROM reports WHERE hour >= 473400 AND hour <= 473500 AND hour % 24 IN (0, 6, 12, 18)")
def b20_b21_window(spark, d):
    """Clipped window, chosen hours of the day."""
    e = B.clamp_window(reports(spark, d), "hour", 473400, 473500)
    return e.withColumn("hod", F.col("hour") % 24).filter(F.col("hod").isin(0, 6, 12, 18)).select("event_id", "hour", "hod")


@query(f"""WITH {SERIES_HOUR}, w AS (SELECT var, hour, list(hour) OVER (PARTITION BY var ORDER BY hour ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS x, max(hour) OVER (PARTITION BY var) AS e FROM series_hour)
 SELECT var, x[1] AS first, x[4] AS last, x[4] + 6 AS output FROM w WHERE len(x) = 4 AND x[4] + 6 < e""")
def b22_in_out_times(spark, d):
    """Input runs and output times."""
    t = B.in_out_times(series_hour(spark, d), "var", "hour", 4, 6)
    return t.select("var", F.element_at("inputs", 1).alias("first"), F.element_at("inputs", -1).alias("last"), "output")


@query("SELECT o_orderkey, CAST(epoch(TIMESTAMP '2000-01-01') AS BIGINT) + o_custkey * 3600 AS hours, CAST(epoch(TIMESTAMP '1990-06-01') AS BIGINT) + o_custkey * 86400 AS days FROM orders")
def a9_decode_cf_time(spark, d):
    """Times as a number of units."""
    k = F.col("o_custkey")
    return read(spark, d, "orders").select("o_orderkey", F.unix_seconds(B.decode_cf_time(k, "hours since 2000-01-01")).alias("hours"), F.unix_seconds(B.decode_cf_time(k, "days since 1990-06-01")).alias("days"))


@query(f"""WITH {REPORTS} SELECT event_id, value FROM reports WHERE value IS NOT NULL AND CASE WHEN var = 'view' THEN value > 1 AND value < 20 WHEN var = 'click' THEN value > 5 AND value < 40 ELSE TRUE END""")
def c1_c2_plausible(spark, d):
    """Finite and plausible values."""
    rules = {"view": (1.0, 20.0), "click": (5.0, 40.0)}
    return reports(spark, d).filter(Q.finite("value") & Q.plausible(F.col("var"), F.col("value"), rules)).select("event_id", "value")


_RINGS = [("a", [(-4.0, 38.0), (3.0, 37.5), (8.0, 44.0), (1.0, 51.0), (-4.5, 46.0)]), ("b", [(5.0, 40.0), (20.0, 41.0), (18.0, 50.0), (12.0, 43.0), (6.0, 52.0)])]
_EDGES = [(n, *p, *q) for n, ring in _RINGS for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]


@query(f"""WITH {TARGETS}, edges(ring, x1, y1, x2, y2) AS (VALUES {', '.join(str(e) for e in _EDGES)})
 SELECT id, ring FROM targets, edges GROUP BY id, ring HAVING count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND lon < CAST(x2 - x1 AS DOUBLE) * (lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1""")
def c3_polygons(spark, d):
    """Points in polygons."""
    edges = spark.createDataFrame(_EDGES, "ring string, x1 double, y1 double, x2 double, y2 double")
    return Q.points_in_polygons(targets(spark, d).select("id", "lat", "lon"), edges).select("id", "ring")


@query(f"WITH {TARGETS} SELECT id, lat, lon FROM targets WHERE lat BETWEEN 39.875 AND 45.125 AND lon BETWEEN -0.125 AND 12.125")
def c4_bbox(spark, d):
    """C4: closed box with half a cell around it."""
    return Q.bbox_crop(targets(spark, d).select("id", "lat", "lon"), (40.0, 45.0, 0.0, 12.0), half_cell=0.125)


@query(f"WITH {REPORTS} SELECT station, count(*) AS n_raw, count(*) FILTER (WHERE value IS NULL) AS n_missing FROM reports GROUP BY station")
def c5_missing(spark, d):
    """Missing values counted (dropped by ``drop_missing``)."""
    return Q.missing_counts(reports(spark, d), ["station"], "value")


@query(f"""WITH {REPORTS}, w AS (SELECT event_id, station, value AS u, CASE WHEN event_id % 26 = 0 THEN 0.0 ELSE value END AS v FROM reports),
 x AS (SELECT station, CASE WHEN NOT (u = 0 AND v = 0) THEN u END AS u, CASE WHEN NOT (u = 0 AND v = 0) THEN v END AS v FROM w)
 SELECT station, count(u) AS n, {r('avg(u)', 'u')}, {r('avg(v)', 'v')} FROM x GROUP BY station""")
def c6_calm(spark, d):
    """Calm placeholders left out before the mean."""
    w = reports(spark, d).select("station", F.col("value").alias("u"), F.when(F.col("event_id") % 26 == 0, 0.0).otherwise(F.col("value")).alias("v"))
    return rounded(w.select("station", *Q.no_calm("u", "v")).groupBy("station").agg(F.count("u").alias("n"), F.avg("u").alias("u"), F.avg("v").alias("v")))


@query(f"""WITH {SERIES_DAY}, n AS (SELECT station, day, count(v) OVER w AS k, v FROM series_day WINDOW w AS (PARTITION BY station ORDER BY day RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
 SELECT station, day, CASE WHEN v IS NULL AND k < 2 THEN 'no_target_and_few_neighbours' WHEN v IS NULL AND k < 3 THEN 'no_target_and_incomplete' WHEN v IS NULL THEN 'no_target' WHEN k < 2 THEN 'few_neighbours' WHEN k < 3 THEN 'incomplete' END AS reason, k >= 2 AND v IS NOT NULL AS kept FROM n""")
def c7_c8_reasons(spark, d):
    """Sample filter and exclusion reason."""
    from pyspark.sql import Window

    n = series_day(spark, d).withColumn("k", F.count("v").over(Window.partitionBy("station").orderBy("day").rangeBetween(-2, 0)))
    reason = Q.exclusion_reason(F.col("v").isNotNull(), F.col("k") >= 2, F.col("k") >= 3)
    return n.select("station", "day", reason.alias("reason"), Q.sample_filter(F.col("k"), 2, F.col("v")).alias("kept"))


@query(f"""WITH {REPORTS}, a AS (SELECT station, day, max(value) FILTER (WHERE var = 'view') AS p, max(value) FILTER (WHERE var = 'click') AS slp, count(value) AS n FROM reports GROUP BY station, day)
 SELECT station, day, {r('CASE WHEN n >= 2 THEN coalesce(p, slp * exp(-9.80665 * 100.0 / (287.05 * 288.0))) END', 'p')} FROM a""")
def c9_fallback(spark, d):
    """A value from another where it is missing, if enough observations."""
    v = lambda x: F.max(F.when(F.col("var") == x, F.col("value")))
    a = reports(spark, d).groupBy("station", "day").agg(v("view").alias("p"), v("click").alias("slp"), F.count("value").alias("n"))
    p = Q.first_known(F.col("p"), X.station_pressure("slp", F.lit(100.0), F.lit(288.0)))
    return rounded(a.select("station", "day", Q.at_least(p, F.col("n"), 2).alias("p")))


@query(f"""WITH {PAIRS}, e AS (SELECT DISTINCT station, j FROM pairs), k AS (SELECT station, count(*) AS k FROM e GROUP BY station HAVING count(*) >= 20)
 SELECT station, k FROM (SELECT *, row_number() OVER (ORDER BY station) - 1 AS i FROM k) WHERE i >= 2 AND i < 52""")
def c10_pool(spark, d):
    """Targets with enough neighbours, a slice of them."""
    return Q.min_neighbours_pool(pairs(spark, d).select("station", "j").distinct(), "station", 20, 2, 50)


@query("SELECT p_partkey, regexp_extract(ch, '^([a-z]+)([0-9]+)$', 1) AS var, TRY_CAST(nullif(regexp_extract(ch, '^([a-z]+)([0-9]+)$', 2), '') AS BIGINT) AS level FROM (SELECT p_partkey, lower(substr(p_name, 1, 1)) || 't' || CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size * 10 AS VARCHAR) END AS ch FROM part)")
def c11_channel(spark, d):
    """C11: variable and level of a channel name."""
    ch = F.concat(F.lower(F.substring("p_name", 1, 1)), F.lit("t"), F.when(F.col("p_size") % 3 == 0, "").otherwise((F.col("p_size") * 10).cast("string")))
    var, level = Q.channel_parts(ch)
    return read(spark, d, "part").select("p_partkey", var.alias("var"), level.alias("level"))
