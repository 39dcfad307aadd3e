"""Delays integrated over vertical profiles: one row per column and level in, one per column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.functions.expr import EPS_WET, G0, K1, K2, K2_PRESSURE, K3, K3_PRESSURE, R_DRY, station_pressure, top_dry_column, unzscore, vapor_pressure, zhd_saastamoinen
from stationflow.operators.spatial import nearest_index

# Saturation over water (hPa, 1, degrees Celsius) and the inverse compressibility of water vapour.
BOLTON = (6.112, 17.67, 243.5)
COMPRESSIBILITY = (1650.0, 0.01317, 1.75e-4, 1.44e-6)


def _trapezoid(rows: DataFrame, by: list[str], order: Column, x: Column, y: Column, clip: bool = False, lower: bool = False) -> DataFrame:
    """Integral of y over x along the order; negative steps count as 0 if ``clip``; ``lower``: the value below times the thickness."""
    w = Window.partitionBy(*by).orderBy(order)
    dx = x - F.lag(x).over(w)
    dx = F.greatest(dx, F.lit(0.0)) if clip else dx
    mean = F.lag(y).over(w) if lower else 0.5 * (y + F.lag(y).over(w))
    return rows.withColumn("area_", mean * dx).groupBy(*by).agg(F.sum("area_").alias("integral"))


def zwd_pressure(profile: DataFrame, by: list[str]) -> DataFrame:
    """Wet delay in mm over pressure: columns p, t, r (hPa, K, %)."""
    e = vapor_pressure("t", "r")
    y = (K2_PRESSURE * e + K3_PRESSURE * e / F.col("t")) / F.col("p")
    out = _trapezoid(profile, by, F.col("p"), F.col("p"), y)
    return out.select(*by, (1e-3 * R_DRY / G0 * F.col("integral")).alias("zwd"))


def surface_nodes(profile: DataFrame, surface: DataFrame, by: list[str]) -> DataFrame:
    """Levels with the surface as the lowest node.

    Levels at or below the surface pressure take the surface's state. The surface
    has 2 m temperature, and the humidity of the lowest level above ground.
    """
    rows = profile.join(surface.select(*by, "t2m", "p_s", "h", "lat"), by)
    above = F.when(F.col("p") < F.col("p_s"), F.struct("p", "r"))
    w = Window.partitionBy(*by)
    rh = F.coalesce(F.max(above).over(w)["r"], F.max(F.struct("p", "r")).over(w)["r"])
    rows = rows.withColumn("rh_s", rh)
    below = F.col("p") >= F.col("p_s")
    levels = rows.select(*by, "p_s", "h", "lat", F.when(below, F.col("p_s")).otherwise(F.col("p")).alias("p"), F.when(below, F.col("t2m")).otherwise(F.col("t")).alias("t"), F.when(below, vapor_pressure("t2m", "rh_s")).otherwise(vapor_pressure("t", "r")).alias("e"), F.when(below, F.col("h")).otherwise(F.col("z")).alias("z"), F.col("p").alias("order"))
    ground = rows.groupBy(*by).agg(*[F.first(x).alias(x) for x in ("p_s", "h", "lat", "t2m", "rh_s")])
    ground = ground.select(*by, "p_s", "h", "lat", F.col("p_s").alias("p"), F.col("t2m").alias("t"), vapor_pressure("t2m", "rh_s").alias("e"), F.col("h").alias("z"), F.lit(1e9).alias("order"))
    return levels.unionByName(ground)


def zwd_pressure_surface(profile: DataFrame, surface: DataFrame, by: list[str]) -> DataFrame:
    """Wet delay over pressure with the surface node, and the hydrostatic delay of the surface pressure (mm)."""
    nodes = surface_nodes(profile, surface, by)
    y = (K2_PRESSURE * F.col("e") + K3_PRESSURE * F.col("e") / F.col("t")) / F.col("p")
    wet = _trapezoid(nodes, by, F.col("order"), F.col("p"), y)
    zhd = surface.select(*by, zhd_saastamoinen("p_s", "lat", "h").alias("zhd"))
    return wet.join(zhd, by).select(*by, "zhd", (1e-3 * R_DRY / G0 * F.col("integral")).alias("zwd"))


def delay_geometric(profile: DataFrame, surface: DataFrame, by: list[str], top: bool = True, lower: bool = False) -> DataFrame:
    """zhd and zwd in mm by height: trapezoids of the refractivities from the surface up, plus the dry air above the top level."""
    nodes = surface_nodes(profile, surface, by)
    dry = K1 * (F.col("p") - F.col("e")) / F.col("t")
    wet = (K2 - EPS_WET * K1) * F.col("e") / F.col("t") + K3 * F.col("e") / (F.col("t") * F.col("t"))
    up = F.desc("order")
    w = Window.partitionBy(*by).orderBy(up)
    dz = F.greatest(F.col("z") - F.lag("z").over(w), F.lit(0.0))
    area = lambda y: (F.lag(y).over(w) if lower else 0.5 * (y + F.lag(y).over(w))) * dz
    rows = nodes.withColumn("d_", area(dry)).withColumn("w_", area(wet))
    above = 1e3 * top_dry_column(F.min("p")) if top else F.lit(0.0)
    return rows.groupBy(*by).agg((1e-3 * F.sum("d_") + above).alias("zhd"), (1e-3 * F.sum("w_")).alias("zwd"))


def delay_variants(profile: DataFrame, surface: DataFrame, by: list[str]) -> DataFrame:
    """The rectangle rule, the trapezoid, and the trapezoid with the column's top, side by side."""
    out = None
    for name, kw in (("rectangle", {"top": False, "lower": True}), ("trapezoid", {"top": False}), ("with_top", {})):
        d = delay_geometric(profile, surface, by, **kw).select(*by, (F.col("zhd") + F.col("zwd")).alias(name))
        out = d if out is None else out.join(d, by)
    return out


def delay_layers(profile: DataFrame, by: list[str], ground: str | None = None, compressibility: bool = False, trapezoid: bool = False) -> DataFrame:
    """zhd and zwd in mm by height alone: columns p (hPa), t (K), r (%), z (m) and, if named, ``ground`` (m).

    Each layer counts with the value at its lower side, or the mean of both sides. Where the ground lies between
    the lowest and the highest level, the column begins there, with a node interpolated by height.
    ``compressibility``: the inverse compressibility of water vapour on the wet part.
    """
    tc = F.col("t") - 273.15
    rows = profile.withColumn("e", F.col("r") / 100.0 * BOLTON[0] * F.exp(BOLTON[1] * tc / (tc + BOLTON[2])))
    w = Window.partitionBy(*by).orderBy("z")
    if ground:
        whole = Window.partitionBy(*by)
        g, low, high = F.col(ground), F.min("z").over(whole), F.max("z").over(whole)
        cut = (g > low) & (g < high)
        part = (g - F.lag("z").over(w)) / (F.col("z") - F.lag("z").over(w))
        at = lambda c: F.lag(c).over(w) + part * (F.col(c) - F.lag(c).over(w))
        first = F.when(cut & (F.col("z") > g) & (F.lag("z").over(w) <= g), F.struct(at("p").alias("p"), at("t").alias("t"), at("e").alias("e"), g.alias("z")))
        keep = F.when(~F.coalesce(cut, F.lit(False)) | (F.col("z") > g), F.struct("p", "t", "e", "z"))
        rows = rows.withColumn("n_", F.array_compact(F.array(first, keep))).select(*by, F.explode("n_").alias("n_")).select(*by, "n_.*")
    tc, e, t = F.col("t") - 273.15, F.col("e"), F.col("t")
    a, b, c, d = COMPRESSIBILITY
    inverse = 1.0 + a * (e / (t * t * t)) * (1.0 - b * tc + c * tc * tc + d * tc * tc * tc) if compressibility else F.lit(1.0)
    dry, wet = K1 * (F.col("p") - e) / t, ((K2 - EPS_WET * K1) * e / t + K3 * e / (t * t)) * inverse
    dz = F.lead("z").over(w) - F.col("z")
    layer = lambda x: (0.5 * (x + F.lead(x).over(w)) if trapezoid else x) * dz
    areas = rows.select(*by, layer(dry).alias("d"), layer(wet).alias("w"))
    return areas.groupBy(*by).agg((1e-3 * F.sum("d")).alias("zhd"), (1e-3 * F.sum("w")).alias("zwd"))


def orography_height(profile: DataFrame, surface: DataFrame, by: list[str]) -> DataFrame:
    """Height of the model's ground: from the lowest level above it down to the surface pressure. NULL without such a level."""
    rows = profile.join(surface.select(*by, "p_s"), by)
    m = F.max(F.when(F.col("p") < F.col("p_s"), F.struct("p", "z", "t")))
    got = rows.groupBy(*by, "p_s").agg(m.alias("m"))
    return got.select(*by, (F.col("m.z") + R_DRY * F.col("m.t") / G0 * F.log(F.col("m.p") / F.col("p_s"))).alias("h_oro"))


def destandardise(field: DataFrame, stats: DataFrame, levels: list[float]) -> DataFrame:
    """Physical values of the chosen levels; ``stats`` is one row a channel."""
    return field.join(stats, "channel").filter(F.col("level").isin(levels)).withColumn("value", unzscore("value", "mean", "std"))


def same_levels(a: DataFrame, b: DataFrame, level: str) -> DataFrame:
    """Whether two tables have the same set of levels, in whatever order. Levels are a short list."""
    got = lambda x, n: x.agg(F.array_sort(F.collect_set(level)).alias(n))
    return got(a, "a").crossJoin(got(b, "b")).select((F.col("a") == F.col("b")).alias("same"), F.size("a").alias("n"))


def delay_table(profile: DataFrame, surface: DataFrame, by: list[str], cells: DataFrame, cell: str) -> DataFrame:
    """Delays of every cell: NULL off the stations. ``surface`` has msl instead of p_s."""
    s = surface.withColumn("p_s", station_pressure("msl", "h", "t2m"))
    d = delay_geometric(profile, s, by)
    return cells.join(d, cell, "left").withColumn("ztd", F.col("zhd") + F.col("zwd"))


def column_delay(levels: Column, t2m: Column, p_s: Column, h: Column) -> Column:
    """Struct zhd, zwd in mm of one column, as ``delay_geometric``: ``levels`` is an array of (p, t, r, z), in any order."""
    down = F.reverse(F.array_sort(levels))  # from the ground up; p is the first field
    above = F.filter(down, lambda x: x["p"] < p_s)
    rh = F.coalesce(F.get(above, F.lit(0))["r"], F.get(down, F.lit(0))["r"])
    node = lambda p, t, e, z: F.struct(p.alias("p"), t.alias("t"), e.alias("e"), z.alias("z"))
    ground = node(p_s, t2m, vapor_pressure(t2m, rh), h)
    nodes = F.concat(F.array(ground), F.transform(down, lambda x: F.when(x["p"] >= p_s, ground).otherwise(node(x["p"], x["t"], vapor_pressure(x["t"], x["r"]), x["z"]))))
    dry = lambda x: K1 * (x["p"] - x["e"]) / x["t"]
    wet = lambda x: (K2 - EPS_WET * K1) * x["e"] / x["t"] + K3 * x["e"] / (x["t"] * x["t"])
    part = lambda first: F.slice(nodes, F.lit(first), F.size(nodes) - 1)
    area = lambda f: lambda a, b: 0.5 * (f(a) + f(b)) * F.greatest(b["z"] - a["z"], F.lit(0.0))
    total = lambda f: F.aggregate(F.zip_with(part(1), part(2), area(f)), F.lit(0.0), lambda s, x: s + x)
    top = 1e3 * top_dry_column(F.element_at(nodes, -1)["p"])
    return F.struct((1e-3 * total(dry) + top).alias("zhd"), (1e-3 * total(wet)).alias("zwd"))


def delay_from_forecast(fcst: DataFrame, stats: DataFrame, cells: DataFrame, times: DataFrame, lead: int, levels: list[float], lat0: float, lon0: float, step: float, n_lat: int, n_lon: int, time: str = "t") -> DataFrame:
    """(ti, tj, time, zhd, zwd, ztd) in mm for every cell and valid time; NULL off the stations and where the forecast lacks a channel.

    ``fcst``: init, lead, channel, i, j, value (standardised, long); ``stats``: channel, mean, std; ``cells``: ti, tj, lat,
    lon, h of the station there (NULL without one); ``times``: the wanted valid times, in the unit of init and lead.
    Rows are cut to the lead, the channels of the profile, the source cells nearest to a station (longitudes wrap) and the
    times, before the one shuffle, by (time, cell); there levels are pivoted and integrated within the row.
    """
    wanted = [f"{v}{int(x)}" for v in "trz" for x in levels] + ["t2m", "msl"]
    i, j = nearest_index(F.col("lat"), lat0, step, n_lat), nearest_index(F.pmod(F.col("lon") - lon0, F.lit(360.0)) + lon0, lon0, step, n_lon)
    stations = cells.filter("h is not null").select("ti", "tj", "h", i.alias("i"), j.alias("j"))
    starts = times.select((F.col(time) - lead).alias("init")).distinct()
    rows = fcst.filter((F.col("lead") == lead) & F.col("channel").isin(wanted)).join(starts, "init", "left_semi").join(stations, ["i", "j"]).join(stats, "channel")
    rows = rows.select("ti", "tj", "h", (F.col("init") + F.col("lead")).alias(time), "channel", unzscore("value", "mean", "std").alias("x"))
    column = rows.groupBy("ti", "tj", time).agg(F.first("h").alias("h"), *[F.max(F.when(F.col("channel") == c, F.col("x"))).alias(c) for c in wanted])
    profile = F.array(*[F.struct(F.lit(x).alias("p"), F.col(f"t{int(x)}").alias("t"), F.col(f"r{int(x)}").alias("r"), (F.col(f"z{int(x)}") / G0).alias("z")) for x in levels])
    got = column.select("ti", "tj", time, column_delay(profile, F.col("t2m"), station_pressure(F.col("msl") / 100.0, "h", "t2m"), F.col("h")).alias("d"))
    axis = times.agg(F.sort_array(F.collect_set(time)).alias("axis_"))  # one row: a time axis
    every = cells.select("ti", "tj").crossJoin(F.broadcast(axis)).select("ti", "tj", F.explode("axis_").alias(time))
    return every.join(got, ["ti", "tj", time], "left").select("ti", "tj", time, "d.zhd", "d.zwd").withColumn("ztd", F.col("zhd") + F.col("zwd"))


def delay_mixed(dry: DataFrame, wet: DataFrame, by: list[str]) -> DataFrame:
    """Hydrostatic part of one source and wet part of another."""
    return dry.select(*by, "zhd").join(wet.select(*by, "zwd"), by).withColumn("ztd", F.col("zhd") + F.col("zwd"))
