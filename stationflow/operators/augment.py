"""Seeded augmentation of series: arrays or long rows in, the same shape out.

Random numbers are hashes of series, position and seed, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.operators.similarity import _steps, _together


_PRIME = 2147483647


def draw(seed: int, *key: Column) -> Column:
    """A whole number in [0, 2^31 - 1) by arithmetic on whole numbers alone, the same in any engine."""
    h = F.lit(seed % _PRIME).cast("long")
    for k in [*key, F.lit(seed)]:
        h = F.transform(F.array((h + F.pmod(k.cast("long"), F.lit(_PRIME))) * 1103515245 + 12345), lambda x: x % _PRIME)
        h = F.element_at(F.transform(h, lambda x: (x * x + x + 1) % _PRIME), 1)
    return h


def key_of(df: DataFrame, name: str) -> Column:
    """A column as a whole number to draw by: itself, or its hash where it isn't one."""
    return F.col(name) if dict(df.dtypes)[name] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(name)


def uniform(seed: int, *key: Column) -> Column:
    """In (0, 1)."""
    return (draw(seed, *key) + 0.5) / float(_PRIME)


def normal(seed: int, *key: Column) -> Column:
    """By Box and Muller's transform of two draws."""
    return F.sqrt(-2 * F.log(uniform(seed, *key))) * F.cos(2 * F.pi() * uniform(seed + 7919, *key))


def channel_order(n: int, seed: int) -> list[int]:
    """A seeded shuffle of the channels."""
    return sorted(range(n), key=lambda c: ((c + 1) * 1103515245 + seed * 12345) % _PRIME)


def jitter(df: DataFrame, key: str, pos: str, value: str, sigma: float = 0.03, seed: int = 1) -> DataFrame:
    return df.withColumn(value, F.col(value) + sigma * normal(seed, key_of(df, key), F.col(pos)))


def scaling(df: DataFrame, key: list[str], value: str, sigma: float = 0.1, seed: int = 2) -> DataFrame:
    return df.withColumn(value, F.col(value) * (1 + sigma * normal(seed, *[key_of(df, k) for k in key])))


def rotation(df: DataFrame, key: list[str], channel: str, value: str, n_channels: int, seed: int = 3) -> DataFrame:
    """A random sign for each series and channel, and one shuffle of the channels for all."""
    order = channel_order(n_channels, seed)
    moved = F.element_at(F.array(*[F.lit(order.index(c)) for c in range(n_channels)]), (F.col(channel) + 1).cast("int"))
    sign = F.when(uniform(seed, *[key_of(df, k) for k in key], F.col(channel)) < 0.5, -1.0).otherwise(1.0)
    return df.withColumn(value, F.col(value) * sign).withColumn(channel, moved)


def permutation(df: DataFrame, key: str, pos: str, value: str, segments: int = 5, seed: int = 4, equal: bool = True) -> DataFrame:
    """Segments of each series, equal or cut at random, in a random order."""
    w = Window.partitionBy(key)
    if equal:
        seg = F.ntile(segments).over(w.orderBy(pos))
    else:
        i, n = F.row_number().over(w.orderBy(pos)) - 1, F.count("*").over(w)
        seg = sum(((i >= F.floor(uniform(seed + k, key_of(df, key)) * n)).cast("int") for k in range(1, segments)), F.lit(0))
    rows = df.withColumn("seg_", seg).withColumn("u_", uniform(seed, key_of(df, key), F.col("seg_")))
    return rows.withColumn(pos, F.row_number().over(w.orderBy("u_", "seg_", pos)).cast("long") - 1).drop("seg_", "u_")


def window_slice(df: DataFrame, key: str, pos: str, value: str, n: int, share: float = 0.9, seed: int = 5) -> DataFrame:
    """A random window of ``share``, stretched back to ``n`` positions on lines between its values."""
    m = int(np.ceil(share * n))
    listed = df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(pos, value))), lambda s: s[value]).alias("v"))
    start = F.floor(uniform(seed, key_of(df, key)) * (n - m + 1)).cast("int")
    cut = listed.withColumn("c_", F.slice("v", start + 1, m))

    def at(i: Column) -> Column:
        x = i * (m - 1) / (n - 1)
        a = F.least(F.floor(x), F.lit(m - 2)).cast("int")
        return F.element_at("c_", a + 1) + (x - a) * (F.element_at("c_", a + 2) - F.element_at("c_", a + 1))

    return cut.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)).alias(pos, value))


def scale_shift_jitter(df: DataFrame, key: str, pos: str, value: str, sigma: float = 0.2, seed: int = 6) -> DataFrame:
    k = key_of(df, key)
    return df.withColumn(value, F.col(value) * (1 + sigma * normal(seed, k)) + sigma * normal(seed + 1, k) + sigma * normal(seed + 2, k, F.col(pos)))


def missing_mask(df: DataFrame, key: str, pos: str, value: str, rate: float, seed: int = 8) -> DataFrame:
    """Hides a share of values: mask 0 and value 0 where hidden."""
    hidden = F.pmod((F.col(key) * 10007 + F.col(pos)) * 1103515245 + seed, F.lit(2147483647)) < int(rate * 2147483647)
    return df.withColumn("mask", F.when(hidden, 0).otherwise(1)).withColumn("hidden", F.when(hidden, 0.0).otherwise(F.col(value)))


def _spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through (x, y)."""
    n = len(x)
    h, a = np.diff(x), np.zeros((n, n))
    b = np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u, v = x[k + 1] - at, at - x[k]
    return (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v


def _curve(rng, n: int, sigma: float, knots: int) -> np.ndarray:
    return _spline(np.linspace(0, n - 1, knots + 2), rng.normal(1.0, sigma, knots + 2), np.arange(n))


def _each(df: DataFrame, key: str, pos: str, value: str, f, seed: int) -> DataFrame:
    """Apply f(values, rng) to each series; the generator's seed is the key."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(pos)
        k = int(g[key].iloc[0])
        return pd.DataFrame({key: k, pos: g[pos].to_numpy(), value: f(g[value].to_numpy(float), np.random.default_rng([seed, k]))})

    return df.select(key, pos, value).groupBy(key).applyInPandas(one, f"{key} long, {pos} long, {value} double")


def magnitude_warp(df: DataFrame, key: str, pos: str, value: str, sigma: float = 0.2, knots: int = 4, seed: int = 10) -> DataFrame:
    """Values times a smooth random curve."""
    return _each(df, key, pos, value, lambda x, rng: x * _curve(rng, len(x), sigma, knots), seed)


def time_warp(df: DataFrame, key: str, pos: str, value: str, sigma: float = 0.2, knots: int = 4, seed: int = 11) -> DataFrame:
    """Positions moved by a smooth random curve that keeps the ends."""

    def f(x, rng):
        steps = np.cumsum(np.maximum(_curve(rng, len(x), sigma, knots), 0.05))
        at = (steps - steps[0]) / (steps[-1] - steps[0]) * (len(x) - 1)
        return np.interp(np.arange(len(x)), at, x)

    return _each(df, key, pos, value, f, seed)


def window_warp(df: DataFrame, key: str, pos: str, value: str, share: float = 0.1, seed: int = 12) -> DataFrame:
    """A random window sped up or slowed down by 2, the whole stretched back to its length."""

    def f(x, rng):
        n, m = len(x), max(2, int(np.ceil(share * len(x))))
        s, factor = rng.integers(1, max(2, n - m)), rng.choice([0.5, 2.0])
        part = np.interp(np.linspace(0, m - 1, max(1, int(m * factor))), np.arange(m), x[s : s + m])
        y = np.concatenate([x[:s], part, x[s + m :]])
        return np.interp(np.linspace(0, len(y) - 1, n), np.arange(len(y)), y)

    return _each(df, key, pos, value, f, seed)


def members(series: DataFrame, key: str, label: str, seed: int, buckets: int = 4096) -> DataFrame:
    """(key, label, i, n): the place of each series in the hashed order of its class of n.

    The hash is cut into ``buckets`` ranges that are numbered by themselves and raised by the rows of
    the ranges before, so no task holds a class.
    """
    rows = series.select(key, label).withColumn("u_", draw(seed, key_of(series, key))).withColumn("b_", F.floor(F.col("u_") / (_PRIME / buckets)))
    counts = rows.groupBy(label, "b_").agg(F.count("*").alias("n_"))  # up to ``buckets`` rows a class
    w = Window.partitionBy(label)
    counts = counts.select(F.col(label).alias("l_"), F.col("b_").alias("c_"), (F.sum("n_").over(w.orderBy("b_")) - F.col("n_")).alias("before_"), F.sum("n_").over(w).alias("n"))
    local = rows.withColumn("i_", F.row_number().over(Window.partitionBy(label, "b_").orderBy("u_", key)) - 1)
    return local.join(counts, F.col(label).eqNullSafe(F.col("l_")) & (F.col("b_") == F.col("c_"))).select(key, label, (F.col("i_") + F.col("before_")).alias("i"), "n")


def partners(series: DataFrame, key: str, label: str, seed: int, first: int = 1, last: int = 1) -> DataFrame:
    """(key, partner): the ``first``-th to ``last``-th next series of the same class in its hashed ring, each once, 0 being the series itself."""
    rows = members(series, key, label, seed)
    nxt = rows.select(F.col(label).alias("l_"), F.col("i").alias("j_"), F.col(key).alias("partner"))
    asked = rows.withColumn("k_", F.explode(F.sequence(F.lit(first), F.lit(last)))).filter(F.col("k_") < F.col("n"))
    return asked.join(nxt, F.col(label).eqNullSafe(F.col("l_")) & ((F.col("i") + F.col("k_")) % F.col("n") == F.col("j_"))).select(key, "partner")


def strangers(series: DataFrame, key: str, label: str, seed: int, n: int = 1) -> DataFrame:
    """(key, partner): up to ``n`` hashed choices among the series of other classes, each once."""
    rows = members(series, key, label, seed)
    order = Window.orderBy("c_")
    classes = rows.groupBy(F.col(label).alias("c_")).agg(F.max("n").alias("size_"))  # one row a class
    classes = classes.withColumn("at_", F.row_number().over(order) - 1)
    many = classes.agg(F.count("*").alias("many_"))
    own = rows.select(key, label).join(classes.select("c_", "at_"), F.col(label).eqNullSafe(F.col("c_"))).crossJoin(F.broadcast(many))  # one row
    draw = lambda j, top: F.pmod(F.xxhash64(F.col(key), F.col("k_"), F.lit(seed + j)), top)
    asked = own.filter("many_ > 1").withColumn("k_", F.explode(F.sequence(F.lit(1), F.lit(n))))
    asked = asked.withColumn("to_", (F.col("at_") + 1 + draw(1, F.col("many_") - 1)) % F.col("many_")).select(key, "k_", "to_")
    asked = asked.join(classes.select(F.col("at_").alias("to_"), F.col("c_").alias("l_"), "size_"), "to_").withColumn("j_", draw(2, F.col("size_")))
    other = rows.select(F.col(label).alias("m_"), F.col("i").alias("i_"), F.col(key).alias("partner"))
    return asked.join(other, F.col("l_").eqNullSafe(F.col("m_")) & (F.col("j_") == F.col("i_"))).select(key, "partner").distinct()


def _with_partners(series: DataFrame, key: str, values: str, picks: DataFrame) -> DataFrame:
    """(key, x, picks): each series with the arrays of its few partners, in partner order; none where it has none."""
    named = picks.withColumn("side_", F.lit(1)) if "side_" not in picks.columns else picks
    found = named.join(series.select(F.col(key).alias("partner"), F.col(values).alias("y_")), "partner")
    listed = found.groupBy(F.col(key).alias("k_")).agg(F.sort_array(F.collect_list(F.struct(F.col("side_").alias("side"), F.col("partner"), F.col("y_").alias("y")))).alias("picks"))
    return series.select(F.col(key).cast("long").alias(key), F.col(values).alias("x")).join(listed, F.col(key) == F.col("k_"), "left").select(key, "x", "picks")


def _map_picks(df: DataFrame, key: str, f, more: str = "") -> DataFrame:
    """f(key, x, [(side, y)]) for each row; a series without partners goes through f as well.

    A series is an array of numbers, or of one array of channels a step; one path then moves all its channels.
    f yields lists of (x, y, band, shape) and is sent the distance and path of each; those that the rows of a slice ask for are found together.
    """
    kind = dict(df.dtypes)["x"]
    kind = "array<array<double>>" if kind.startswith("array<array") else "array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (batch.iloc[k : k + 256] for batch in batches for k in range(0, len(batch), 256)):
            asked = [f(int(k), _steps(x), [(p["side"], _steps(p["y"])) for p in picks] if picks is not None else []) for k, x, picks in zip(b[key], b["x"], b["picks"], strict=True)]
            rows = [(k, *(v.tolist() if isinstance(v, np.ndarray) else v for v in (got if isinstance(got, tuple) else (got,)))) for k, got in zip(b[key], _answered(asked), strict=True)]
            yield pd.DataFrame(rows, columns=[key, "v", *[m.split()[0] for m in more.split(",") if m]])

    return df.mapInPandas(run, f"{key} long, v {kind}" + (f", {more}" if more else ""))


def _band(x: np.ndarray) -> int:
    """A tenth of the length."""
    return int(np.ceil(len(x) / 10))


def _answered(runs: list[Generator]) -> list:
    """What each run returns, all answered round by round: a round finds the paths that the runs ask for together."""
    out, said = [None] * len(runs), dict.fromkeys(range(len(runs)))
    while said:
        asked = {}
        for k, answer in said.items():
            try:
                asked[k] = runs[k].send(answer)
            except StopIteration as end:
                out[k] = end.value
        said = {k: [None] * len(questions) for k, questions in asked.items()}
        alike: dict[tuple[int, bool], list] = {}
        for k, questions in asked.items():
            for at, (x, y, band, shape) in enumerate(questions):
                alike.setdefault((band, shape), []).append((k, at, x, y))
        for (band, shape), each in alike.items():
            for (k, at, _, _), got in zip(each, _together([e[2] for e in each], [e[3] for e in each], "symmetric", band, shape), strict=True):
                said[k][at] = got
    return out


def _stretched(v: np.ndarray, n: int) -> np.ndarray:
    """``n`` steps on lines between those of ``v``, channel by channel."""
    if v.ndim == 2:
        return np.stack([_stretched(c, n) for c in v.T], 1)
    return np.interp(np.arange(n), np.linspace(0, n - 1, len(v)), v)


def spawner(series: DataFrame, key: str, label: str, values: str, sigma: float = 0.05, seed: int = 13) -> DataFrame:
    """Mean along two warping paths, before and after a random point, with a same-class partner; then jitter.

    Paths stay within a tenth of the length. Alone in its class, a series is only jittered.
    """

    def f(k, x, picks):
        rng, n = np.random.default_rng([seed, k]), len(x)
        out = x
        if picks and n > 2:
            y, s = picks[0][1], int(rng.integers(1, n - 1))
            (_, head), (_, tail) = yield [(x[:s], y[:s], _band(x), False), (x[s:], y[s:], _band(x), False)]
            path = np.concatenate([head, tail + s])
            out = _stretched((x[path[:, 0]] + y[path[:, 1]]) / 2, n)
        return out + rng.normal(0, sigma, out.shape)

    return _map_picks(_with_partners(series, key, values, partners(series, key, label, seed)), key, f)


def guided_warp(series: DataFrame, key: str, label: str, values: str, shape: bool = False, seed: int = 14) -> DataFrame:
    """A same-class partner's time order put on the series by the warping path (of descriptors if ``shape``), within a
    tenth of the length. Alone in its class, a series stays as it is."""

    def f(_, x, picks):
        if not picks:
            return x
        ((_, path),) = yield [(picks[0][1], x, _band(x), shape)]
        return _stretched(x[path[:, 1]], len(x))

    return _map_picks(_with_partners(series, key, values, partners(series, key, label, seed)), key, f)


def discriminative_warp(series: DataFrame, key: str, label: str, values: str, shape: bool = False, slices: bool = True, seed: int = 16) -> DataFrame:
    """The time order of the one of up to three same-class series that tells the classes apart best.

    That is where the mean warping distance to up to three series of other classes exceeds that to the other same-class ones
    most. With ``slices`` a window of 0.9 to 1 of the result, more for what was warped more (in share of the largest warp
    of all), is stretched back. Without series on both sides a series stays as it is.
    """
    picks = partners(series, key, label, seed, 1, 3).withColumn("side_", F.lit(1)).unionByName(strangers(series, key, label, seed, 3).withColumn("side_", F.lit(0)))

    def f(_, x, picks):
        same, other = ([y for side, y in picks if side == s] for s in (1, 0))
        if not same or not other:
            return x, 0.0
        n, m, band = len(same), len(other), _band(x)
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
        got = yield [(same[a], same[b], band, shape) for a, b in pairs] + [(a, b, band, shape) for a in same for b in other]
        near = np.zeros((n, n))
        for (a, b), (d, _) in zip(pairs, got[: len(pairs)], strict=True):
            near[a, b] = near[b, a] = d
        far = np.array([d for d, _ in got[len(pairs) :]]).reshape(n, m)
        teacher = same[int(np.argmax(far.mean(1) - near.sum(1) / max(n - 1, 1)))]
        ((_, path),) = yield [(teacher, x, band, shape)]
        order = path[:, 1]
        return _stretched(x[order], len(x)), float(np.abs(np.arange(len(x)) - _stretched(order.astype(float), len(x))).sum())

    warped = _map_picks(_with_partners(series, key, values, picks), key, f, "warp double")
    if not slices:
        return warped
    warped = warped.repartition(key)  # one exchange that the largest warp and the result both read: paths are found once
    channels = dict(warped.dtypes)["v"].startswith("array<array")
    most = warped.agg(F.max("warp").alias("most"))  # one row
    n = F.size("v")
    share = 0.9 + 0.1 * F.coalesce(F.try_divide("warp", F.col("most")), F.lit(0.0))
    m = F.least(F.ceil(F.round(share * n, 9)), n).cast("int")
    start = F.floor(uniform(seed, key_of(series, key)) * (n - m)).cast("int")

    def at(i: Column) -> Column:
        x = i * F.col("m_") / (n - 1)
        low = F.least(F.floor(x), F.col("m_") - 1).cast("int")
        high = F.least(low + 1, F.col("m_") - 1)
        part = F.least(x, F.col("m_") - 1.0) - low
        a, b = F.element_at("v", F.col("s_") + low + 1), F.element_at("v", F.col("s_") + high + 1)
        return F.zip_with(a, b, lambda u, v: u + part * (v - u)) if channels else a + part * (b - a)

    cut = warped.crossJoin(F.broadcast(most)).withColumn("m_", m).withColumn("s_", start)
    return cut.select(key, F.when(F.col("m_") >= n, F.col("v")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at)).alias("v"), "warp")


def weighted_dba(series: DataFrame, key: str, label: str, values: str, size: int = 6, seed: int = 15) -> DataFrame:
    """For each series the barycentre of up to ``size`` of its class: the medoid by warping distance, and the others brought
    on its time, weighted by a half to the power of their distance over that of the nearest."""

    def f(_, x, picks):
        group = [y for _, y in picks]
        n, band = len(group), _band(x)
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
        dist = np.zeros((n, n))
        for (a, b), (d, _) in zip(pairs, (yield [(group[a], group[b], band, False) for a, b in pairs]), strict=True):
            dist[a, b] = dist[b, a] = d
        medoid = int(dist.sum(1).argmin())
        nearest = np.sort(dist[medoid])[1] if n > 1 else 0.0
        total, weights = np.zeros(group[medoid].shape), np.zeros(len(group[medoid]))
        moved = [k for k in range(n) if k != medoid and nearest != 0]
        paths = dict(zip(moved, [p for _, p in (yield [(group[medoid], group[k], band, False) for k in moved])], strict=True))
        for k, y in enumerate(group):
            if k == medoid or nearest == 0:
                total += group[medoid]
                weights += 1
                continue
            path, w = paths[k], float(np.exp(np.log(0.5) * dist[medoid, k] / nearest))
            # of several steps that meet one step of the medoid, the last counts
            last = np.append(path[1:, 0] != path[:-1, 0], True)
            total[path[last, 0]] += w * y[path[last, 1]]
            weights[path[last, 0]] += w
        return total / (weights[:, None] if total.ndim == 2 else weights)

    return _map_picks(_with_partners(series, key, values, partners(series, key, label, seed, 0, size - 1)), key, f)


def as_arrays(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """One row a series, its values as the array v."""
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(pos, value))), lambda s: s[value]).alias("v"))


#: Operations of the chain, in the order they are applied.
CHAIN = ["jitter", "scaling", "rotation", "permutation", "randompermutation", "magwarp", "timewarp", "windowslice", "windowwarp", "spawner", "dtwwarp", "shapedtwwarp", "wdba", "discdtw", "discsdtw"]


def augment(df: DataFrame, key: str, label: str, pos: str, value: str, ops: list[str], n: int, seed: int = 9) -> DataFrame:
    """The enabled operations of ``CHAIN`` one after the other on series of ``n`` steps: key, label, pos, value."""
    if unknown := set(ops) - set(CHAIN):
        raise ValueError(f"unknown operations: {sorted(unknown)}")
    labels = df.select(key, label).distinct()
    out = df.select(key, pos, value)
    by_array = {"spawner": spawner, "dtwwarp": guided_warp, "shapedtwwarp": lambda *a, **k: guided_warp(*a, shape=True, **k), "wdba": weighted_dba, "discdtw": discriminative_warp, "discsdtw": lambda *a, **k: discriminative_warp(*a, shape=True, **k)}
    for k, op in enumerate(o for o in CHAIN if o in ops):
        s = seed * 1000 + k
        if op in by_array:
            arrays = as_arrays(out.join(labels, key), [key, label], pos, value)
            out = by_array[op](arrays, key, label, "v", seed=s).select(key, F.posexplode("v").alias(pos, value)).withColumn(pos, F.col(pos).cast("long"))
        elif op == "scaling":
            out = scaling(out, [key], value, seed=s)
        elif op == "rotation":  # one channel: a sign for each series
            out = rotation(out.withColumn("channel_", F.lit(0)), [key], "channel_", value, 1, seed=s).drop("channel_")
        elif op == "windowslice":
            out = window_slice(out, key, pos, value, n, seed=s).withColumn(pos, F.col(pos).cast("long"))
        else:
            f = {"jitter": jitter, "permutation": permutation, "randompermutation": lambda *a, **b: permutation(*a, equal=False, **b), "magwarp": magnitude_warp, "timewarp": time_warp, "windowwarp": window_warp}[op]
            out = f(out, key, pos, value, seed=s)
    return out.join(labels, key).select(key, label, pos, value)


def run_augmentation(df: DataFrame, key: str, label: str, pos: str, value: str, rounds: int, ops: list[str], n: int, seed: int = 9) -> DataFrame:
    """The original (round 0) and ``rounds`` copies, each through the enabled operations with its own draws; labels repeated."""
    out = df.select(F.lit(0).alias("round"), key, label, pos, value)
    for r in range(1, rounds + 1):
        out = out.unionByName(augment(df, key, label, pos, value, ops, n, seed + r).select(F.lit(r).alias("round"), key, label, pos, value))
    return out
