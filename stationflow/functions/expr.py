"""Scalar functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants.
EARTH_KM = 6371.0088
G0 = 9.80665
R_DRY = 287.05
EPS = 0.622
ZHD_MM = 2.2768
K2_PRESSURE, K3_PRESSURE = 16.52, 3.776e5
K1, K2, K3, EPS_WET = 77.6890, 71.2952, 375463.0, 0.62198


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def nan_to_null(x) -> Column:
    """NaN marks a missing value at the source; NULL does in the engine."""
    return F.nullif(c(x), F.lit(float("nan")))


def round_half_up(x, digits: int) -> Column:
    """Halves away from zero, as SQL's round does it in doubles: ``F.round`` makes a decimal number of every value, which takes far longer."""
    unit = 10.0**digits
    n = F.floor(F.abs(c(x)) * unit + 0.5)
    return F.when(F.abs(c(x)) < 2.0**52 / unit, F.when(c(x) < 0, -n).otherwise(n) / unit).otherwise(c(x))  # larger ones have no such digits


def wrap_lon_180(x) -> Column:
    """In [-180, 180); a longitude that lies there keeps its very bits."""
    return F.when((c(x) >= -180.0) & (c(x) < 180.0), c(x)).otherwise(F.pmod(c(x) + 180.0, F.lit(360.0)) - 180.0)


def wrap_lon_360(x) -> Column:
    return F.pmod(c(x), F.lit(360.0))


def dms_to_deg(d, m, s) -> Column:
    """Degrees, minutes and seconds; the sign of the degrees holds for all."""
    return F.when(c(d) < 0, c(d) - c(m) / 60.0 - c(s) / 3600.0).otherwise(c(d) + c(m) / 60.0 + c(s) / 3600.0)


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    p, q = F.radians(c(lat1)), F.radians(c(lat2))
    a = F.pow(F.sin((q - p) / 2), F.lit(2.0)) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(c(lon2) - c(lon1)) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def chord(lat1, lon1, lat2, lon2) -> Column:
    """Straight distance of two points on the unit sphere."""
    return 2 * F.sin(haversine_km(lat1, lon1, lat2, lon2, 1.0) / 2)


def equirect_xy(lat, lon, lat0, lon0, radius_m: float = 6_371_000.0) -> Column:
    x = F.radians(c(lon) - c(lon0)) * F.cos(F.radians(c(lat0))) * radius_m
    return F.struct(x.alias("x"), (F.radians(c(lat) - c(lat0)) * radius_m).alias("y"))


def initial_bearing(lat1, lon1, lat2, lon2) -> Column:
    p, q, d = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lon2) - c(lon1))
    y = F.sin(d) * F.cos(q)
    x = F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def ecef(lat, lon, h) -> Column:
    """Cartesian coordinates on the WGS84 ellipsoid in m."""
    a, e2 = 6378137.0, 6.69437999014e-3
    p, q = F.radians(c(lat)), F.radians(c(lon))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(p), F.lit(2.0)))
    return F.struct(((n + c(h)) * F.cos(p) * F.cos(q)).alias("x"), ((n + c(h)) * F.cos(p) * F.sin(q)).alias("y"), ((n * (1 - e2) + c(h)) * F.sin(p)).alias("z"))


def enu_frame(lat0, lon0, h0) -> Column:
    """The target's place and the directions of its frame: what ``enu_in`` needs of it, found once a target."""
    p, q, s = F.radians(c(lat0)), F.radians(c(lon0)), ecef(lat0, lon0, h0)
    parts = {"x": s["x"], "y": s["y"], "z": s["z"], "sp": F.sin(p), "cp": F.cos(p), "sq": F.sin(q), "cq": F.cos(q), "h": c(h0)}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def enu_in(frame, place, h) -> Column:
    """East and north in km in a frame of ``enu_frame`` of a place of ``ecef``; up is the height difference in m."""
    f, t = c(frame), c(place)
    dx, dy, dz = (t[k] - f[k] for k in "xyz")
    east = (-f["sq"] * dx + f["cq"] * dy) / 1000
    north = (-f["sp"] * f["cq"] * dx - f["sp"] * f["sq"] * dy + f["cp"] * dz) / 1000
    return F.struct(east.alias("east_km"), north.alias("north_km"), (c(h) - f["h"]).alias("up_m"))


def enu(lat0, lon0, h0, lat, lon, h) -> Column:
    """East and north in km in the target's frame; up is the height difference in m."""
    return enu_in(enu_frame(lat0, lon0, h0), ecef(lat, lon, h), h)


def sat_vapor_pressure(t, kind: str = "water") -> Column:
    """Saturation vapour pressure in hPa at ``t`` K: over water or ice (Tetens), or Bolton's form."""
    x = c(t) - 273.15
    if kind == "bolton":
        return 6.112 * F.exp(17.67 * x / (x + 243.5))
    a, b = (17.269, 237.3) if kind == "water" else (22.44294, 272.4406)
    return 6.1078 * F.exp(a * x / (x + b))


def vapor_pressure(t, rh, percent: bool = True, kind: str = "water") -> Column:
    return sat_vapor_pressure(t, kind) * c(rh) / (100.0 if percent else 1.0)


def specific_humidity(t, rh, p_pa) -> Column:
    """Mixed phase, kg/kg: water above 273.16 K, ice below 250.16 K, quadratic in between."""
    x = (c(t) - 250.16) / (273.16 - 250.16)
    share = F.when(c(t) >= 273.16, 1.0).when(c(t) <= 250.16, 0.0).otherwise(x * x)
    water = 611.21 * F.exp(17.502 * (c(t) - 273.16) / (c(t) - 32.19))
    ice = 611.21 * F.exp(22.587 * (c(t) - 273.16) / (c(t) + 0.7))
    e = (share * water + (1 - share) * ice) * c(rh) / 100.0
    return F.try_divide(EPS * e, c(p_pa) - 0.378 * e)


def station_pressure(msl, h, t, lapse: bool = False) -> Column:
    mean = c(t) + 0.0065 * c(h) / 2 if lapse else c(t)
    return c(msl) * F.exp(-G0 * c(h) / (R_DRY * mean))


def reduce_pressure(p, h_from, h_to, t) -> Column:
    return c(p) * F.exp(-G0 * (c(h_to) - c(h_from)) / (R_DRY * c(t)))


def zhd_saastamoinen(p, lat, h) -> Column:
    """Hydrostatic zenith delay in mm; ``p`` in hPa, ``h`` in m."""
    return ZHD_MM * c(p) / (1 - 0.00266 * F.cos(2 * F.radians(c(lat))) - 0.00000028 * c(h))


def ztd_surface(t, p, rh, h, lat) -> Column:
    """Delay parts in mm from a surface report alone."""
    e = vapor_pressure(t, rh)
    zhd = zhd_saastamoinen(p, lat, h)
    zwd = 2.277 * (1255.0 / c(t) + 0.05) * e
    return F.struct(zhd.alias("zhd"), zwd.alias("zwd"), (zhd + zwd).alias("ztd"), e.alias("e"))


def precip_transform(x, metres: bool = False) -> Column:
    """log(1 + mm) of rain that can't be negative."""
    return F.log1p(F.greatest(c(x), F.lit(0.0)) * (1000.0 if metres else 1.0))


def zscore(x, mean, std) -> Column:
    return F.try_divide(c(x) - c(mean), c(std))


def unzscore(z, mean, std) -> Column:
    return c(z) * c(std) + c(mean)


def geopotential_height(z) -> Column:
    return c(z) / G0


def pa_to_hpa(p) -> Column:
    return c(p) / 100.0


def improvement_pct(background, analysis) -> Column:
    return F.try_divide(100.0 * (c(background) - c(analysis)), c(background))


def latlon_side_channels(lat, lon) -> Column:
    return F.struct(F.sin(F.radians(c(lat))).alias("sin_lat"), F.cos(F.radians(c(lon))).alias("cos_lon"))


def divide_no_nan(a, b) -> Column:
    return F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0))


def top_dry_column(p_top) -> Column:
    """Delay in m of the dry air above pressure ``p_top`` (hPa)."""
    return 1e-6 * K1 * R_DRY / G0 * c(p_top)


def station_key(lat, lon, h) -> Column:
    """Whole micro-degrees and centimetres: a key that survives float noise."""
    return F.struct(F.rint(c(lat) * 1e6).cast("long").alias("lat"), F.rint(wrap_lon_180(lon) * 1e6).cast("long").alias("lon"), F.rint(c(h) * 100).cast("long").alias("h"))


def round_key(x, digits: int = 3) -> Column:
    return F.bround(c(x), digits)
