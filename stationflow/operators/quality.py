"""Filters and quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.functions.expr import wrap_lon_180

#: Open bounds of plausible values.
PLAUSIBLE = {"t2m": (200.0, 340.0), "slp": (850.0, 1100.0), "u10": (-60.0, 60.0), "v10": (-60.0, 60.0)}


def finite(*cols: str) -> Column:
    out = F.lit(True)
    for x in cols:
        out = out & F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & (F.abs(F.col(x)) < float("inf"))
    return out


def plausible(var: Column, value: Column, rules: dict[str, tuple[float, float]] | None = None) -> Column:
    """Inside the open bounds of its variable; variables without a rule pass."""
    out = F.lit(True)
    for name, (low, high) in (rules or PLAUSIBLE).items():
        out = F.when(var == name, (value > low) & (value < high)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def points_in_polygons(points: DataFrame, edges: DataFrame, lat: str = "lat", lon: str = "lon", cell: float = 1.0) -> DataFrame:
    """(point columns, ring) for points inside a ring, by ray casting; a point that repeats is found as often.

    ``edges``: ring, x1, y1, x2, y2. Points are joined with the rings whose box holds them, by the cells of ``cell``
    degrees that a box covers (an equi join, whatever the number of rings),
    then with those edges of the rings that reach into their band of latitude; an odd number of crossings is inside.
    """
    boxes = edges.groupBy("ring").agg(F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"), F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("y1", "y2")).alias("n"))
    at = lambda x: F.floor(x / cell)
    covered = lambda low, high: F.sequence(at(low), at(high))
    boxes = boxes.withColumn("cx_", F.explode(covered(F.col("w"), F.col("e")))).withColumn("cy_", F.explode(covered(F.col("s"), F.col("n"))))
    once = points.groupBy(*points.columns).agg(F.count("*").alias("times_"))
    p = once.withColumn("px", wrap_lon_180(lon)).withColumn("py", F.col(lat)).withColumn("cx_", at(F.col("px"))).withColumn("cy_", at(F.col("py")))
    near = p.join(boxes, ["cx_", "cy_"]).filter(F.col("px").between(F.col("w"), F.col("e")) & F.col("py").between(F.col("s"), F.col("n")))
    banded = edges.withColumn("cy_", F.explode(covered(F.least("y1", "y2"), F.greatest("y1", "y2"))))
    hit = near.join(banded, ["ring", "cy_"])
    spans = (F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))
    cross = spans & (F.col("px") < F.try_divide((F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1"))
    inside = hit.groupBy(*points.columns, "ring").agg(F.count_if(cross).alias("n_"), F.max("times_").alias("times_")).filter("n_ % 2 = 1")
    return inside.withColumn("each_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times_")))).drop("n_", "times_", "each_")


def bbox_crop(df: DataFrame, box: tuple[float, float, float, float], lat: str = "lat", lon: str = "lon", half_cell: float = 0.0) -> DataFrame:
    south, north, west, east = box
    return df.filter(F.col(lat).between(south - half_cell, north + half_cell) & F.col(lon).between(west - half_cell, east + half_cell))


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


def missing_counts(df: DataFrame, by: list[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_raw"), F.count_if(F.col(col).isNull()).alias("n_missing"))


def no_calm(u: str, v: str) -> tuple[Column, Column]:
    """Wind parts, NULL where both are 0: a placeholder for calm."""
    calm = (F.col(u) == 0) & (F.col(v) == 0)
    return F.when(~calm, F.col(u)).alias(u), F.when(~calm, F.col(v)).alias(v)


def sample_filter(n_complete: Column, k: int, *present: Column) -> Column:
    out = n_complete >= k
    for x in present:
        out = out & x.isNotNull()
    return out


def exclusion_reason(exists: Column, static_ok: Column, valid_ok: Column) -> Column:
    """Why a sample is left out: which of the three conditions fail, NULL if none."""
    return (
        F.when(~exists & ~static_ok, "no_target_and_few_neighbours")
        .when(~exists & ~valid_ok, "no_target_and_incomplete")
        .when(~exists, "no_target")
        .when(~static_ok, "few_neighbours")
        .when(~valid_ok, "incomplete")
    )


def first_known(*choices: Column) -> Column:
    return F.coalesce(*choices)


def at_least(value: Column, n: Column, least: int) -> Column:
    """The value, where it rests on ``least`` observations or more."""
    return F.when(n >= least, value)


def min_neighbours_pool(edges: DataFrame, target: str, least: int, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Targets with ``least`` neighbours or more, in order, a slice of them. One row per target is ranked."""
    pool = edges.groupBy(target).agg(F.count("*").alias("k")).filter(F.col("k") >= least)
    pool = pool.withColumn("i", F.row_number().over(Window.orderBy(target)) - 1).filter(F.col("i") >= offset)
    return (pool if limit is None else pool.filter(F.col("i") < offset + limit)).drop("i")


def channel_parts(channel: Column) -> tuple[Column, Column]:
    """Variable and level of a channel such as t850."""
    pattern = "^([a-z]+)(\\d+)$"
    return F.regexp_extract(channel, pattern, 1), F.nullif(F.regexp_extract(channel, pattern, 2), F.lit("")).cast("int")
