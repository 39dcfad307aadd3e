"""Time axes, alignment, calendars and splits. Times are whole steps or seconds unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def time_axis(spark: SparkSession, start: str, end: str, step: str, closed: bool = True) -> DataFrame:
    """Every ``step`` from start to end (UTC); half-open unless ``closed``."""
    if start > end:
        raise ValueError("the axis ends before it starts")
    axis = spark.range(1).select(F.explode(F.expr(f"sequence(timestamp'{start}', timestamp'{end}', interval {step})")).alias("ts"))
    return axis if closed else axis.filter(F.col("ts") < F.lit(end).cast("timestamp"))


def align_to_axis(series: DataFrame, keys: list[str], step: str) -> DataFrame:
    """One row for each key and step between the table's first and last step; missing ones hold NULL."""
    span = series.agg(F.min(step).alias("a"), F.max(step).alias("b"))  # one row
    grid = series.select(*keys).distinct().crossJoin(F.broadcast(span)).select(*keys, F.explode(F.sequence("a", "b")).alias(step))
    return grid.join(series, [*keys, step], "left")


def exact_epoch(sec: Column, step_s: int) -> Column:
    return sec % step_s == 0


def parse_epoch(col: Column) -> Column:
    """yy:doy:sod to a timestamp; years below 80 are in this century."""
    p = F.split(col, ":")
    y = F.element_at(p, 1).cast("int")
    day = F.date_add(F.make_date(F.when(y < 80, y + 2000).otherwise(y + 1900), F.lit(1), F.lit(1)), F.element_at(p, 2).cast("int") - 1)
    return F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + F.element_at(p, 3).cast("long"))


def step_index(sec: Column, t0: Column, step_s: int) -> Column:
    return F.floor((sec - t0) / step_s)


def to_utc(ts: Column) -> Column:
    """A naive time is UTC."""
    return ts.cast("timestamp")


def active_span(reports: DataFrame, key: str, hour: str) -> DataFrame:
    return reports.groupBy(key).agg(F.min(hour).alias("first"), F.max(hour).alias("last"), F.count("*").alias("n_reports"))


def candidate_hours(span: DataFrame, key: str) -> DataFrame:
    """Every hour from a station's first report to its last."""
    return span.select(key, F.explode(F.sequence("first", "last")).alias("hour"))


def assign_split(t: Column, bounds: list[tuple[str, int | None, int | None]]) -> Column:
    """Name of the half-open range that holds ``t``; an end of None is open."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(bounds):
        inside = (t >= low if low is not None else F.lit(True)) & (t < high if high is not None else F.lit(True))
        out = F.when(inside, name).otherwise(out)
    return out


def _ranges(series: DataFrame, key: str, step: str, bounds) -> DataFrame:
    w = Window.partitionBy(key)
    rows = series.withColumn("i", F.row_number().over(w.orderBy(step)) - 1).withColumn("n", F.count("*").over(w))
    at = F.array(*[F.struct(F.lit(name).alias("split"), low.cast("long").alias("low"), high.cast("long").alias("high")) for name, low, high in bounds(F.col("n"))])
    return rows.withColumn("s", F.explode(F.filter(at, lambda s: (F.col("i") >= s["low"]) & (F.col("i") < s["high"])))).select(*series.columns, "i", "s.split")


def split_by_ratio(series: DataFrame, key: str, step: str, lookback: int, train: float = 0.7, test: float = 0.2) -> DataFrame:
    """Train, val and test by row order; val and test start ``lookback`` rows earlier, so ranges overlap."""

    def bounds(n):
        a, b = F.floor(n * train), F.floor(n * test)
        return [("train", F.lit(0), a), ("val", a - lookback, n - b), ("test", n - b - lookback, n)]

    return _ranges(series, key, step, bounds)


def split_by_borders(series: DataFrame, key: str, step: str, lookback: int, sizes: tuple[int, int, int]) -> DataFrame:
    """The same with fixed sizes, such as 12, 4 and 4 months of 30 days."""
    a, b, c = sizes
    return _ranges(series, key, step, lambda n: [("train", F.lit(0), F.lit(a)), ("val", F.lit(a - lookback), F.lit(a + b)), ("test", F.lit(a + b - lookback), F.lit(a + b + c))])


def holdout_tail(series: DataFrame, key: str, step: str, share: float = 0.8) -> DataFrame:
    """The rows after ``share`` of a series, which stay in training too."""
    w = Window.partitionBy(key)
    rows = series.withColumn("i", F.row_number().over(w.orderBy(step)) - 1).withColumn("n", F.count("*").over(w))
    return rows.filter(F.col("i") >= F.floor(F.col("n") * share)).drop("n")


def stride_sample(rows: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """Every k-th kept row of each key, from the first."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("i", i).filter(F.col("i") % k == 0).drop("i")


_LINEAR = {
    "second": lambda t: F.second(t) / 59.0 - 0.5,
    "minute": lambda t: F.minute(t) / 59.0 - 0.5,
    "hour": lambda t: F.hour(t) / 23.0 - 0.5,
    "dow": lambda t: F.weekday(t) / 6.0 - 0.5,
    "dom": lambda t: (F.dayofmonth(t) - 1) / 30.0 - 0.5,
    "doy": lambda t: (F.dayofyear(t) - 1) / 365.0 - 0.5,
    "month": lambda t: (F.month(t) - 1) / 11.0 - 0.5,
    "week": lambda t: (F.weekofyear(t) - 1) / 52.0 - 0.5,
}
#: Features by frequency of the series.
FEATURES = {"Y": [], "Q": ["month"], "M": ["month"], "W": ["dom", "week"], "D": ["dow", "dom", "doy"], "B": ["dow", "dom", "doy"], "H": ["hour", "dow", "dom", "doy"], "T": ["minute", "hour", "dow", "dom", "doy"], "S": ["second", "minute", "hour", "dow", "dom", "doy"]}


def calendar_linear(t: Column, freq: str) -> list[Column]:
    """Calendar fields scaled to -0.5 .. 0.5."""
    return [_LINEAR[f](t).alias(f"cal_{f}") for f in FEATURES[freq]]


def calendar_cyclic(t: Column, hour_only: bool = False) -> list[Column]:
    parts = {"hour": (F.hour(t), 24), "dow": (F.weekday(t), 7), "dom": (F.dayofmonth(t) - 1, 31), "doy": (F.dayofyear(t) - 1, 365)}
    out = []
    for name, (x, period) in parts.items():
        if hour_only and name != "hour":
            continue
        angle = 2 * F.pi() * x / period
        out += [F.sin(angle).alias(f"sin_{name}"), F.cos(angle).alias(f"cos_{name}")]
    return out


def calendar_integer(t: Column) -> list[Column]:
    return [F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.weekday(t).alias("weekday"), F.hour(t).alias("hour"), F.floor(F.minute(t) / 15).alias("quarter")]


def lead_align(fcst: DataFrame, axis: DataFrame, init: str, lead: str, valid: str) -> DataFrame:
    """Forecasts that are valid exactly at times of the axis."""
    return fcst.withColumn(valid, F.col(init) + F.col(lead)).join(axis.select(valid).distinct(), valid)


def match_axes(a: DataFrame, b: DataFrame, step: str) -> DataFrame:
    """Index in ``a`` of each time of ``b``, -1 where ``a`` has none. The axes are small."""
    numbered = a.select(step).distinct().withColumn("at", F.row_number().over(Window.orderBy(step)) - 1)
    return b.select(step).distinct().join(numbered, step, "left").withColumn("at", F.coalesce("at", F.lit(-1)))


def common_times(step: str, *sources: DataFrame) -> DataFrame:
    """Times that every source has."""
    out = sources[0].select(step).distinct()
    for s in sources[1:]:
        out = out.join(s.select(step), step, "left_semi")
    return out


def clamp_window(df: DataFrame, step: str, low: int, high: int) -> DataFrame:
    """Rows of the requested range, clipped to what there is; an empty range is an error."""
    first, last = df.agg(F.min(step), F.max(step)).first()
    low, high = (low, high) if first is None else (max(low, first), min(high, last))
    if first is None or low > high:
        raise ValueError("no data in the window")
    return df.filter(F.col(step).between(low, high))


def in_out_times(axis: DataFrame, key: str, step: str, n_in: int, lead: int) -> DataFrame:
    """Runs of ``n_in`` steps and the output time ``lead`` steps after the last, if before the axis ends."""
    w = Window.partitionBy(key).orderBy(step)
    runs = axis.withColumn("inputs", F.collect_list(step).over(w.rowsBetween(0, n_in - 1))).withColumn("end", F.max(step).over(Window.partitionBy(key)))
    runs = runs.filter(F.size("inputs") == n_in).withColumn("output", F.element_at("inputs", -1) + lead)
    return runs.filter(F.col("output") < F.col("end")).select(key, "inputs", "output")


_UNITS = {"hours": 3600, "days": 86400, "minutes": 60, "seconds": 1}


def decode_cf_time(col: Column, units: str) -> Column:
    """'hours since 2000-01-01' and the like to timestamps."""
    m = re.fullmatch(r"(hours|days|minutes|seconds) since (.+)", units)
    if not m:
        raise ValueError(f"units not understood: {units}")
    return F.timestamp_seconds(F.unix_seconds(F.lit(m[2]).cast("timestamp")) + (col * _UNITS[m[1]]).cast("long"))
