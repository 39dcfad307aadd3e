"""Warping distances, unit-root tests, linear forecasts, scoring, bootstrap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dtw_paths(x: np.ndarray, y: np.ndarray, slope: str = "symmetric", band: int | None = None, cost: str = "euclidean") -> tuple[np.ndarray, list[np.ndarray]]:
    """Warping distances and paths of pairs of series (pairs, steps) or of step vectors (pairs, steps, width).

    symmetric: steps (1,1), (1,0), (0,1), the first of equal ones; asymmetric: (1,0), (1,1), (1,2). ``band``: largest distance from the
    diagonal. ``cost`` of two steps: euclidean or absolute. All pairs advance together, by anti-diagonals or by rows.
    """
    a, b = (np.moveaxis(v[:, :, None] if v.ndim == 2 else v, 0, -1) for v in (x, y))  # steps, width, pairs: pairs lie side by side
    n, m, pairs = len(a), len(b), a.shape[2]
    # Where a path within the band exists and no step is missing, cells outside of it are never looked at.
    narrow = slope == "symmetric" and band is not None and abs(n - m) <= band and bool(np.isfinite(a).all() and np.isfinite(b).all())
    reach = band if narrow else n + m
    i, j = np.indices((n, m))
    i, j = (v[np.abs(i - j) <= reach] for v in (i, j))
    gaps = np.zeros((len(i), pairs))
    for k in range(a.shape[1]):  # width by width: no array of pairs x steps x steps x width
        gap = a[i, k] - b[j, k]
        gaps += np.abs(gap) if cost == "absolute" else gap * gap
    if cost != "absolute":
        np.sqrt(gaps, out=gaps)
    d = np.full((n, m, pairs), np.inf)
    d[i, j] = gaps
    if band is not None:
        i, j = np.indices((n, m))
        d[np.abs(i - j) > band] = np.inf
    total = np.full((n + 1, m + 3, pairs), np.inf)  # one row and two columns of margin before the first cell, one behind
    total[0, 1] = 0
    back = np.zeros((n, m, pairs), np.int8)
    if slope == "symmetric":
        moves = [(1, 1), (1, 0), (0, 1)]
        for s in range(n + m - 1):
            i = np.arange(max(0, s - m + 1, (s - reach + 1) // 2), min(n, s + 1, (s + reach) // 2 + 1))
            j = s - i
            before = np.stack([total[i, j + 1], total[i, j + 2], total[i + 1, j + 1]])
            back[i, j] = before.argmin(0)
            total[i + 1, j + 2] = d[i, j] + before.min(0)
    else:
        moves = [(1, 0), (1, 1), (1, 2)]
        for i in range(n):
            before = np.stack([total[i, 2 : m + 2], total[i, 1 : m + 1], total[i, :m]])
            back[i] = before.argmin(0)
            total[i + 1, 2 : m + 2] = d[i] + before.min(0)
    step = np.array(moves)
    at, who = np.tile([n - 1, m - 1], (pairs, 1)), np.arange(pairs)
    seen, live = [], np.ones(pairs, bool)
    while live.any():
        seen.append((at.copy(), live.copy()))
        move = step[back[np.maximum(at[:, 0], 0), np.maximum(at[:, 1], 0), who]]
        at = np.where(live[:, None], at - move, at)
        live = live & (at >= 0).all(1)
    places, there = np.stack([p for p, _ in seen[::-1]], 1), np.stack([t for _, t in seen[::-1]], 1)
    return total[n, m + 1], [places[k, there[k]] for k in range(pairs)]


def dtw_path(x: np.ndarray, y: np.ndarray, slope: str = "symmetric", band: int | None = None) -> tuple[float, list[tuple[int, int]]]:
    """Distance and path of one pair."""
    total, paths = dtw_paths(x[None], y[None], slope, band)
    return float(total[0]), [tuple(p) for p in paths[0].tolist()]


def warping_error(x: np.ndarray, y: np.ndarray, warp: int = 1, w: float = np.inf, s: float = 1.0) -> float:
    """Warping error of two series with absolute gaps.

    A cell follows the diagonal one before it, or one of the ``warp`` cells behind it in the row before or in the column
    before, those times ``s``; cells further than ``w`` from the diagonal are closed. With ``warp`` above 1 a cell of the column
    before that isn't summed up yet counts with its own gap.
    """
    r, c = len(x), len(y)
    gap = np.full((r + 1, c + 1), np.inf)
    i, j = np.indices((r, c))
    gap[1:, 1:] = np.where(np.abs(i - j) <= w, np.abs(np.subtract.outer(x, y)), np.inf)
    gap[0, 0] = 0
    total = gap.copy()
    # Cells with one value of warp * row + column depend on earlier ones alone, so they advance together.
    for t in range(warp + 1, warp * r + c + 1):
        i = np.arange(max(1, -(-(t - c) // warp)), min(r, (t - 1) // warp) + 1)
        j = t - warp * i
        best = total[i - 1, j - 1]
        for k in range(warp):
            below = np.minimum(i + k, r)
            best = np.minimum(best, s * np.where(below == i, total[i, j - 1], gap[below, j - 1]))
            best = np.minimum(best, s * total[i - 1, np.minimum(j + k, c)])
        total[i, j] += best
    return float(total[r, c])


def descriptors(x: np.ndarray) -> np.ndarray:
    """A window around each step (5 % of the length, 5 to 100; the longer half before it), the edges repeated; of several channels
    one beside the other."""
    w = int(np.clip(round(0.05 * len(x)), 5, 100))
    at = np.clip(np.arange(len(x))[:, None] + np.arange(w) - (w + 1) // 2, 0, len(x) - 1)
    return x[at] if x.ndim == 1 else np.moveaxis(x[at], 1, 2).reshape(len(x), -1)


def _steps(x) -> np.ndarray:
    """A series as an array of steps, or of steps x channels."""
    return np.array([np.asarray(v, float) for v in x]) if len(x) and np.ndim(x[0]) else np.asarray(x, float)


def _together(x: list[np.ndarray], y: list[np.ndarray], slope: str, band: int | None, shape: bool, cost: str = "euclidean", cells: int = 1 << 21) -> list[tuple[float, np.ndarray]]:
    """Distance and path of each pair; pairs of the same lengths go together, ``cells`` cells at a time."""
    out: list = [None] * len(x)
    same: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(zip(x, y, strict=True)):
        same.setdefault((len(a), len(b)), []).append(k)
    for (n, m), at in same.items():
        if not n or not m:
            for k in at:
                out[k] = (0.0 if n == m else float("inf"), np.zeros((0, 2), int))
            continue
        size = max(1, cells // (n * m))
        for part in (at[k : k + size] for k in range(0, len(at), size)):
            a, b = np.stack([x[k] for k in part]), np.stack([y[k] for k in part])
            if shape:
                a, b = (np.stack([descriptors(v) for v in s]) for s in (a, b))
            for k, *got in zip(part, *dtw_paths(a, b, slope, band, cost), strict=True):
                out[k] = (float(got[0]), got[1])
    return out


def pairwise_dtw(pairs: DataFrame, key: list[str], slope: str = "symmetric", band: int | None = None, shape: bool = False, tasks: int = 64, cost: str = "euclidean") -> DataFrame:
    """(key, distance, path) for rows with arrays x and y, of numbers or of channels; pairs are dealt evenly over ``tasks``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in (b.iloc[k : k + 512] for k in range(0, len(b), 512)):
                got = _together([_steps(v) for v in part["x"]], [_steps(v) for v in part["y"]], slope, band, shape, cost)
                out = part[key].copy()
                out["distance"] = [d for d, _ in got]
                out["path"] = [[{"i": i, "j": j} for i, j in p.tolist()] for _, p in got]
                yield out

    schema = ", ".join(f"{k} long" for k in key) + ", distance double, path array<struct<i:long,j:long>>"
    return pairs.repartition(tasks, *key).select(*[F.col(k).cast("long").alias(k) for k in key], "x", "y").mapInPandas(run, schema)


def mean_dtw(pairs: DataFrame, key: str, by: list[str], warp: int = 1, w: float = float("inf"), s: float = 1.0, tasks: int = 64) -> DataFrame:
    """Mean warping error of forecast windows (x against y) by group, with absolute gaps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = [np.asarray(v, float) for v in b["x"]], [np.asarray(v, float) for v in b["y"]]
            if warp == 1 and s == 1 and w == float("inf"):
                error = [d for d, _ in _together(x, y, "symmetric", None, False, "absolute")]
            else:
                error = [warping_error(u, v, warp, w, s) for u, v in zip(x, y, strict=True)]
            yield b[by].assign(distance=error)

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", distance double"
    d = pairs.repartition(tasks, key).select(*by, "x", "y").mapInPandas(run, schema)
    return d.groupBy(*by).agg(F.avg("distance").alias("dtw"), F.count("*").alias("n"))


def adf_test(df: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    """Unit-root regression with a constant and no or one lagged difference, the better by AIC: lag, n, coefficient, t.

    Centred sums of products by series, then the normal equations in closed form: one shuffle, no
    Python. Both regressions are compared on the rows that have the lagged difference; without it
    the final one uses all rows.
    """
    w = Window.partitionBy(*by).orderBy(step)
    rows = df.withColumn("y1", F.lag(value).over(w)).withColumn("d", F.col(value) - F.col("y1"))
    rows = rows.withColumn("d1", F.lag("d").over(w)).filter(F.col("d").isNotNull())
    has = F.col("d1").isNotNull()
    y, z, d = F.col("y1"), F.col("d1"), F.col("d")
    common = lambda x: F.when(has, x)
    product = lambda a, b: F.covar_pop(a, b) * F.count(F.when(a.isNotNull() & b.isNotNull(), 1))
    sums = {"yy": (common(y), y), "yz": (common(y), z), "zz": (z, z), "yd": (common(y), d), "zd": (z, d), "dd": (common(d), d), "ya": (y, y), "da": (y, d), "aa": (d, d)}
    s = rows.groupBy(*by).agg(F.count(F.when(has, 1)).alias("n1"), F.count("*").alias("n0"), *[product(*ab).alias(k) for k, ab in sums.items()])
    c = F.col
    det = c("yy") * c("zz") - c("yz") * c("yz")
    b1 = F.try_divide(c("zz") * c("yd") - c("yz") * c("zd"), det)
    rss1 = c("dd") - b1 * c("yd") - F.try_divide(c("yy") * c("zd") - c("yz") * c("yd"), det) * c("zd")
    aic = lambda rss, k: c("n1") * F.log(F.try_divide(rss, c("n1"))) + 2 * k
    one = aic(rss1, 3) < aic(c("dd") - F.try_divide(c("yd") * c("yd"), c("yy")), 2)
    b0 = F.try_divide(c("da"), c("ya"))
    se0 = F.sqrt(F.try_divide(c("aa") - b0 * c("da"), (c("n0") - 2) * c("ya")))
    se1 = F.sqrt(F.try_divide(rss1, c("n1") - 3) * F.try_divide(c("zz"), det))
    pick = lambda x, y: F.when(one, x).otherwise(y)
    return s.select(*by, pick(F.lit(1), F.lit(0)).alias("lag"), pick(c("n1"), c("n0")).alias("n"), pick(b1, b0).alias("coefficient"), pick(F.try_divide(b1, se1), F.try_divide(b0, se0)).alias("t"))


def mean_adf(df: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    return adf_test(df, by, step, value).agg(F.avg("t").alias("mean_t"), F.count("*").alias("n"))


def decompose_window(x: Column, kernel: int) -> Column:
    """trend and seasonal of a window by itself: a centred average, the ends repeated, and what is left."""
    ends = lambda at, n: F.array_repeat(F.element_at(x, at), n)
    padded = F.concat(ends(1, (kernel - 1) // 2), x, ends(-1, kernel // 2))
    trend = F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.aggregate(F.slice(padded, i, kernel), F.lit(0.0), lambda a, v: a + v) / kernel)
    return F.struct(trend.alias("trend"), F.zip_with(x, trend, lambda v, t: v - t).alias("seasonal"))


def linear_forecaster(windows: DataFrame, train: Column, horizon: int, by: list[str] | None = None, kernel: int = 5, ridge: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(coefficients, windows with pred): trend and seasonal parts of each window x mapped linearly to the ``horizon`` values y after it.

    Each window is decomposed by itself, so nothing of y gets into its input. One map for all, or one for each group of
    ``by`` (a map per channel). Fitted on the rows where ``train`` holds, from sums of products that tasks add up: one
    pass, whatever the horizon; applied to all rows. A group without training rows gets null.
    """
    by = by or []
    parts = decompose_window(F.col("x"), kernel)
    table = windows.withColumn("p_", parts).withColumn("f_", F.concat("p_.trend", "p_.seasonal", F.array(F.lit(1.0)))).drop("p_")
    kinds = dict(windows.dtypes)
    head = "".join(f"{k} {kinds[k]}, " for k in by)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}

        def out():
            rows = [(*(k if isinstance(k, tuple) else (k,))[: len(by)], *v) for k, g in total.items() for v in enumerate(g.reshape(-1).tolist())]
            total.clear()
            return pd.DataFrame(rows, columns=[*by, "at", "v"])

        for b in batches:
            for k, g in b.groupby(by, dropna=False) if by else [((), b)]:
                f = np.stack([np.asarray(v, float) for v in g["f_"]])
                y = np.stack([np.asarray(v, float) for v in g["y"]])
                new = f.T @ np.hstack([f, y])
                total[k] = total[k] + new if k in total else new
            if len(total) > 200:
                yield out()
        if total:
            yield out()

    sums = table.filter(train).select(*by, "f_", "y").mapInPandas(products, f"{head}at long, v double").groupBy(*by, "at").agg(F.sum("v").alias("v"))

    def solve(g: pd.DataFrame) -> pd.DataFrame:  # (features) x (features + horizon) numbers
        v = g.sort_values("at")["v"].to_numpy()
        n = int((np.sqrt(horizon * horizon + 4 * len(v)) - horizon) / 2 + 0.5)
        m = v.reshape(n, n + horizon)
        coef = np.linalg.solve(m[:, :n] + ridge * np.eye(n), m[:, n:])
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in by}, "coef": [coef.T.tolist()]})

    coefs = sums.groupBy(*by).applyInPandas(solve, f"{head}coef array<array<double>>")
    dot = lambda c: F.aggregate(F.zip_with("f_", c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    joined = table.join(coefs, by, "left") if by else table.join(F.broadcast(coefs), F.lit(True), "left")  # without groups one row
    return coefs, joined.withColumn("pred", F.transform("coef", dot)).drop("f_", "coef")


def score_windows(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], key: list[str], x: str, batch: int = 256, mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """Apply a model to assembled samples in batches, undo the scaling, keep the keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                out = part[key].copy()
                pred = np.asarray(fn(np.stack([np.asarray(v, float) for v in part[x]]))) * std + mean
                out["pred"] = [p.tolist() for p in pred.reshape(len(part), -1)]
                yield out

    kinds = dict(df.dtypes)
    return df.select(*key, x).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", pred array<double>")


def bootstrap_ci(df: DataFrame, key: Column, value: str, rounds: int = 200, seed: int = 17) -> DataFrame:
    """95 % interval of the mean by Poisson weights: every row counts 0, 1, 2 ... times in each round."""
    u = (F.pmod(F.xxhash64(key, F.col("b"), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    edges = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1)) if k else 1) for k in range(8)])
    w = F.lit(0)
    for k, e in enumerate(edges):
        w = w + F.when(u > float(e), 1).otherwise(0) if k else F.when(u > float(e), 1).otherwise(0)
    means = df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", w).groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def paired_t(df: DataFrame, diff: Column) -> DataFrame:
    return df.agg(F.count(diff).alias("n"), F.avg(diff).alias("mean"), F.try_divide(F.avg(diff) * F.sqrt(F.count(diff).cast("double")), F.stddev_samp(diff)).alias("t"))
