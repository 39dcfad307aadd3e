"""Series transforms: interpolation, decomposition, smoothing, spectra, wavelets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.operators.ordering import seeded


def interpolate_linear(df: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """Missing values on the line between the known ones around them; the nearest known one at the ends."""
    w = Window.partitionBy(*by).orderBy(pos)
    at = F.when(F.col(value).isNotNull(), F.col(pos))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v0, p0 = F.last(value, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(back)
    v1, p1 = F.first(value, ignorenulls=True).over(ahead), F.first(at, ignorenulls=True).over(ahead)
    line = v0 + (v1 - v0) * F.try_divide(F.col(pos) - p0, p1 - p0)
    return df.withColumn("filled", F.coalesce(F.col(value), line, v0, v1))


def trend_seasonal(df: DataFrame, by: list[str], pos: str, value: str, kernels: list[int]) -> DataFrame:
    """Centred moving average, the ends continued by their edge value; the mean over several kernels. seasonal = x - trend."""
    part = Window.partitionBy(*by).orderBy(pos)
    every = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(every), F.last(value).over(every)
    i, n = F.row_number().over(part), F.count("*").over(Window.partitionBy(*by))
    trend = F.lit(0.0)
    for k in kernels:
        left, right = (k - 1) // 2, k - 1 - (k - 1) // 2
        inside = F.sum(value).over(part.rowsBetween(-left, right))
        before = F.greatest(F.lit(0), F.lit(left) - (i - 1))
        after = F.greatest(F.lit(0), F.lit(right) - (n - i))
        trend = trend + (inside + before * first + after * last) / k
    return df.withColumn("trend", trend / len(kernels)).withColumn("seasonal", F.col(value) - F.col("trend"))


def exp_smooth(values: Column, alpha: float, v0: float) -> Column:
    """s_t = alpha s_(t-1) + (1 - alpha) x_t from s = v0, for each step."""
    step = lambda s, x: F.concat(s, F.array(F.element_at(s, -1) * alpha + x * (1 - alpha)))
    return F.slice(F.aggregate(values, F.array(F.lit(v0)), step), 2, F.size(values))


def seasonal_diff(df: DataFrame, by: list[str], pos: str, value: str, lag: int) -> DataFrame:
    return df.withColumn("diff", F.col(value) - F.lag(value, lag).over(Window.partitionBy(*by).orderBy(pos)))


def _long(frame: pd.DataFrame, by: str, pos: str, value: str) -> tuple:
    g = frame.sort_values(pos)
    return g[by].iloc[0], g[pos].to_numpy(), g[value].to_numpy(float)


def spectrum(df: DataFrame, by: str, pos: str, value: str) -> DataFrame:
    """(series, freq, amp, re, im) of the real transform of each series."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        key, _, x = _long(g, by, pos, value)
        f = np.fft.rfft(x)
        return pd.DataFrame({by: key, "freq": np.arange(len(f)), "n": len(x), "amp": np.abs(f), "re": f.real, "im": f.imag})

    return df.select(by, pos, value).groupBy(by).applyInPandas(one, f"{by} long, freq long, n long, amp double, re double, im double")


def dominant_periods(spec: DataFrame, by: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` frequencies of the largest mean amplitude but 0, their periods, and each series' amplitude there."""
    mean = spec.filter("freq > 0").groupBy("freq").agg(F.avg("amp").alias("mean_amp"), F.max("n").alias("n"))
    top = mean.orderBy(F.desc("mean_amp"), "freq").limit(k).select("freq", "mean_amp", F.floor(F.col("n") / F.col("freq")).alias("period"))
    return top, spec.join(F.broadcast(top.select("freq")), "freq").select(by, "freq", "amp")  # k rows


def rebuild(spec: DataFrame, by: str, keep: Column, last: int | None = None) -> DataFrame:
    """(series, pos, v): sum of the kept frequencies at each position, up to ``last`` positions (also past the end)."""
    w = F.when((F.col("freq") == 0) | (F.col("freq") * 2 == F.col("n")), 1.0).otherwise(2.0)
    rows = spec.filter(keep).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.lit(last).cast("long"), F.col("n")) - 1)))
    angle = 2 * F.pi() * F.col("freq") * F.col("pos") / F.col("n")
    return rows.groupBy(by, "pos").agg(F.sum(w * (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)) / F.col("n")).alias("v"))


def strongest(spec: DataFrame, by: str, k: int) -> DataFrame:
    """Frequencies but 0 of each series with at least its k-th largest amplitude."""
    rank = F.rank().over(Window.partitionBy(by).orderBy(F.desc("amp")))
    return spec.filter("freq > 0").withColumn("r_", rank).filter(F.col("r_") <= k).drop("r_")


def dft_decompose(df: DataFrame, by: str, pos: str, value: str, k: int) -> DataFrame:
    """season: the ``k`` strongest frequencies; trend: the rest."""
    season = rebuild(strongest(spectrum(df, by, pos, value), by, k), by, F.lit(True)).withColumnRenamed("v", "season").withColumnRenamed("pos", pos)
    return df.join(season, [by, pos]).withColumn("trend", F.col(value) - F.col("season"))


def spectrum_mask(spec: DataFrame, share: float) -> DataFrame:
    """The top ``share`` of frequencies by mean amplitude over the whole table. One row a frequency is ranked."""
    mean = spec.groupBy("freq").agg(F.avg("amp").alias("a"))
    ranked = mean.select("freq", F.row_number().over(Window.orderBy(F.desc("a"), "freq")).alias("i_"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n_"))
    return ranked.filter(F.col("i_") <= F.floor(F.col("n_") * share)).select("freq")


def choose_modes(spec: DataFrame, k: int, kind: str = "low", seed: int = 0) -> DataFrame:
    """``k`` frequencies: the lowest, or a seeded choice. One row a frequency is ordered."""
    freq = spec.select("freq").distinct()
    return freq.orderBy("freq" if kind == "low" else seeded(F.col("freq") * 7919, seed), "freq").limit(k)


def variant_invariant(df: DataFrame, by: str, pos: str, value: str, share: float) -> DataFrame:
    """invariant: the corpus' dominant frequencies; variant: the rest of each series."""
    spec = spectrum(df, by, pos, value).repartition(by)  # one exchange that both uses read: spectra are made once
    kept = spec.join(F.broadcast(spectrum_mask(spec, share)), "freq")
    inv = rebuild(kept, by, F.lit(True)).withColumnRenamed("v", "invariant").withColumnRenamed("pos", pos)
    return df.join(inv, [by, pos]).withColumn("variant", F.col(value) - F.col("invariant"))


def fourier_extrapolate(df: DataFrame, by: str, pos: str, value: str, k: int, length: int, horizon: int) -> DataFrame:
    """The ``k`` strongest frequencies but 0 and the highest, continued ``horizon`` positions."""
    spec = spectrum(df, by, pos, value).filter(F.col("freq") * 2 < F.col("n"))
    return rebuild(strongest(spec, by, k), by, F.lit(True), length + horizon)


def autocorrelation(df: DataFrame, by: str, pos: str, value: str, length: int, short: int = 256) -> DataFrame:
    """(series, lag, r): circular correlation of each series with itself.

    Sums of products for series of up to ``short`` steps, where they are native and cheap; by the spectrum, in length times its
    logarithm, for longer ones.
    """
    a = df.select(by, F.col(pos).alias("p"), F.col(value).alias("x"))
    listed = a.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("v"))
    if length > short:

        def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[[by]].assign(r=[np.fft.irfft(np.abs(np.fft.rfft(np.asarray(v, float))) ** 2, length).tolist() for v in b["v"]])

        kind = dict(df.dtypes)[by]
        return listed.mapInPandas(spectra, f"{by} {kind}, r array<double>").select(by, F.posexplode("r").alias("lag", "r"))
    r = lambda lag: F.aggregate(F.zip_with(F.col("v"), F.concat(F.slice("v", lag + 1, F.lit(length) - lag), F.slice("v", 1, lag)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return listed.select(by, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), r)).alias("lag", "r"))


def delay_weights(corr: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` lags of the largest correlation of each series, with softmax weights."""
    w = Window.partitionBy(by)
    top = corr.withColumn("i_", F.row_number().over(w.orderBy(F.desc("r"), "lag"))).filter(F.col("i_") <= k).drop("i_")
    e = F.exp(F.col("r") - F.max("r").over(w))
    return top.withColumn("weight", e / F.sum(e).over(w))


def delay_aggregate(df: DataFrame, weights: DataFrame, by: str, pos: str, value: str, length: int) -> DataFrame:
    """Weighted sum of the series rolled by its lags."""
    rolled = df.join(weights.select(by, "lag", "weight"), by).withColumn("to", F.pmod(F.col(pos) - F.col("lag"), F.lit(length)))
    return rolled.groupBy(by, F.col("to").alias("pos")).agg(F.sum(F.col("weight") * F.col(value)).alias("v"))


def wavelet_decompose(df: DataFrame, by: str, pos: str, value: str, level: int, low: tuple[float, ...] = (0.5**0.5, 0.5**0.5)) -> DataFrame:
    """(series, level, band, pos, v): a low and high filter bank, every other value kept, ``level`` times.

    The high filter is the low one backwards with alternating signs. The last level
    holds the remaining low band too.
    """
    m = len(low)
    high = tuple((-1) ** k * low[m - 1 - k] for k in range(m))
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi) in enumerate(zip(low, high, strict=True))])
    cur, out = df.select(by, F.col(pos).alias("pos"), F.col(value).alias("v")), None
    for lev in range(1, level + 1):
        to = F.col("pos") - F.col("t.k")
        bank = cur.withColumn("t", F.explode(taps)).filter((to >= 0) & (to % 2 == 0)).groupBy(by, (to / 2).cast("long").alias("pos")).agg(F.sum(F.col("v") * F.col("t.lo")).alias("lo"), F.sum(F.col("v") * F.col("t.hi")).alias("hi"), F.count("*").alias("n_")).filter(F.col("n_") == m)
        part = bank.select(by, F.lit(lev).alias("level"), F.lit("high").alias("band"), "pos", F.col("hi").alias("v"))
        out = part if out is None else out.unionByName(part)
        cur = bank.select(by, "pos", F.col("lo").alias("v"))
    return out.unionByName(cur.select(by, F.lit(level).alias("level"), F.lit("low").alias("band"), "pos", "v"))


def wavelet_reconstruct(bands: DataFrame, by: str, level: int, low: tuple[float, ...] = (0.5**0.5, 0.5**0.5)) -> DataFrame:
    """(series, pos, v): the inverse of ``wavelet_decompose``, level by level. With filters of more than two taps the
    positions near an end whose taps were cut off don't come back whole."""
    m = len(low)
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(low[k]).alias("lo"), F.lit((-1) ** k * low[m - 1 - k]).alias("hi")) for k in range(m)])
    cur = bands.filter("band = 'low'").select(by, "pos", "v")
    for lev in range(level, 0, -1):
        high = bands.filter((F.col("band") == "high") & (F.col("level") == lev)).select(by, "pos", F.col("v").alias("h_"))
        both = cur.join(high, [by, "pos"], "full").withColumn("t", F.explode(taps))
        part = F.coalesce(F.col("v"), F.lit(0.0)) * F.col("t.lo") + F.coalesce(F.col("h_"), F.lit(0.0)) * F.col("t.hi")
        cur = both.groupBy(by, (2 * F.col("pos") + F.col("t.k")).alias("pos")).agg(F.sum(part).alias("v"))
    return cur


def wavelet_periodic(df: DataFrame, by: str, pos: str, value: str, level: int, low: tuple[float, ...]) -> DataFrame:
    """(series, level, band, pos, v, size): a two-band filter bank on series taken as periodic, for an orthogonal filter of any even length.

    Positions are 0 to n - 1 without gaps. A series of odd length is continued by its last value; size is its length at that
    level before. However long the filter, no position is lost, and ``wavelet_inverse`` gives the series back.
    """
    m = len(low)
    if m % 2:
        raise ValueError("a filter of even length")
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(low[k]).alias("lo"), F.lit((-1) ** k * low[m - 1 - k]).alias("hi")) for k in range(m)])
    cur = df.select(by, F.col(pos).cast("long").alias("pos"), F.col(value).alias("v")).withColumn("size", F.count("*").over(Window.partitionBy(by)))
    out = None
    for lev in range(1, level + 1):
        even = F.col("size") + F.col("size") % 2
        tail = (F.col("size") % 2 == 1) & (F.col("pos") == F.col("size") - 1)
        whole = cur.withColumn("pos", F.explode(F.when(tail, F.array(F.col("pos"), F.col("pos") + 1)).otherwise(F.array("pos"))))
        to = F.pmod(F.col("pos") - F.col("t.k"), even)
        bank = whole.withColumn("t", F.explode(taps)).filter(to % 2 == 0).groupBy(by, "size", (to / 2).cast("long").alias("pos")).agg(F.sum(F.col("v") * F.col("t.lo")).alias("lo"), F.sum(F.col("v") * F.col("t.hi")).alias("hi"))
        part = bank.select(by, F.lit(lev).alias("level"), F.lit("high").alias("band"), "pos", F.col("hi").alias("v"), "size")
        out = part if out is None else out.unionByName(part)
        last = bank.select(by, F.lit(lev).alias("level"), F.lit("low").alias("band"), "pos", F.col("lo").alias("v"), "size")
        cur = bank.select(by, "pos", F.col("lo").alias("v"), ((F.col("size") + 1) / 2).cast("long").alias("size"))
    return out.unionByName(last)


def wavelet_inverse(bands: DataFrame, by: str, level: int, low: tuple[float, ...]) -> DataFrame:
    """(series, pos, v): the series of ``wavelet_periodic`` again, each level synthesised from its two bands."""
    m = len(low)
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(low[k]).alias("lo"), F.lit((-1) ** k * low[m - 1 - k]).alias("hi")) for k in range(m)])
    cur = bands.filter("band = 'low'").select(by, "pos", "v")
    for lev in range(level, 0, -1):
        high = bands.filter((F.col("band") == "high") & (F.col("level") == lev)).select(by, "pos", F.col("v").alias("h_"), "size")
        both = cur.join(high, [by, "pos"]).withColumn("t", F.explode(taps))
        to = F.pmod(2 * F.col("pos") + F.col("t.k"), F.col("size") + F.col("size") % 2)
        cur = both.groupBy(by, "size", to.alias("pos")).agg(F.sum(F.col("v") * F.col("t.lo") + F.col("h_") * F.col("t.hi")).alias("v")).filter(F.col("pos") < F.col("size")).select(by, "pos", "v")
    return cur


def damped_trend(growth: Column, phi: float, h: Column) -> Column:
    """The last growth times phi + phi^2 + ... + phi^h."""
    return growth * (phi * (1 - F.pow(F.lit(phi), h)) / (1 - phi))
