"""Queries: windows, samples, transforms of series, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.operators import profile as H
from stationflow.operators import spatial as E
from stationflow.operators import timegrid as B
from stationflow.operators import transforms as X
from stationflow.operators import windows as G
from stationflow.operators.quality import exclusion_reason
from stationflow.plans.places import _NEAR, _RANKED
from stationflow.plans.registry import LABELLED, PAIRS, POINTS, REPORTS, SERIES_DAY, SERIES_HOUR, labelled_series, neighbours, pairs, query, r, read, reports, rounded, series_day, series_hour, targets

_COMPLETE = "complete AS (SELECT station, day, v, count(v) OVER (PARTITION BY station ORDER BY day RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS complete FROM series_day)"
_VEC = "vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _vecs(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _edges(spark, d):
    e = E.radius_knn_join(targets(spark, d), neighbours(spark, d), 100.0, 3, counts=False)
    return e.select("target", F.col("point").alias("station"), "rank")


_EDGES = f"{_NEAR}, {_RANKED}, edges AS (SELECT target, point AS station, rank FROM ranked WHERE rank <= 3)"


@query(f"WITH {SERIES_DAY}, {_COMPLETE} SELECT station, day, complete FROM complete")
def g1_complete_window(spark, d):
    """G1: windows without a gap."""
    return G.complete_window(series_day(spark, d), ["station"], "day", "v", 3).select("station", "day", "complete")


_GAPPY = f"{REPORTS}, gappy AS (SELECT event_id % 2 AS half, hour, CASE WHEN (hour * 7919) % 397 <> 0 THEN sum(coalesce(value, 0)) END AS v FROM reports GROUP BY event_id % 2, hour)"
_LONG = 288


def _gappy(spark, d):
    s = reports(spark, d).groupBy((F.col("event_id") % 2).alias("half"), "hour").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("v"))
    return s.withColumn("v", F.when((F.col("hour") * 7919) % 397 != 0, F.col("v")))


@query(f"WITH {_GAPPY} SELECT half, hour, count(v) OVER (PARTITION BY half ORDER BY hour RANGE BETWEEN {_LONG - 1} PRECEDING AND CURRENT ROW) = {_LONG} AS complete FROM gappy")
def g1_long_windows(spark, d):
    """G1: windows of 288 steps without a gap."""
    return G.complete_window(_gappy(spark, d), ["half"], "hour", "v", _LONG).select("half", "hour", "complete")


@query(f"""WITH {_GAPPY} SELECT half, hour AS t, count(v) OVER w AS n, {r('sum(v) OVER w', 'total', 4)}, {r('sum(v * (hour % 24)) OVER w', 'by_hour', 4)} FROM gappy
 WINDOW w AS (PARTITION BY half ORDER BY hour RANGE BETWEEN {_LONG - 1} PRECEDING AND CURRENT ROW) QUALIFY count(v) OVER w > 0""")
def e14_long_frames(spark, d):
    """Frames of 288 steps."""
    s = _gappy(spark, d)
    out = E.window_join(s, s.select("half", "hour"), "half", "hour", "v", _LONG)
    add = lambda f: F.aggregate(F.transform("frames", f), F.lit(0.0), lambda a, x: a + x)
    at = lambda v, i: F.coalesce(v, F.lit(0.0)) * ((F.col("t") - (_LONG - 1) + i) % 24)
    return rounded(out.select("half", "t", "n", add(lambda v: F.coalesce(v, F.lit(0.0))).alias("total"), add(at).alias("by_hour")), 4)


@query(f"WITH {SERIES_DAY}, {_COMPLETE}, {POINTS}, {_EDGES} SELECT target, day, count(*) AS n_valid FROM edges JOIN complete USING (station) WHERE complete GROUP BY target, day")
def g2_valid_neighbours(spark, d):
    """Complete neighbours at each step."""
    c = G.complete_window(series_day(spark, d), ["station"], "day", "v", 3)
    return G.valid_neighbours(_edges(spark, d), c, "target", "station", "day")


@query(f"""WITH {SERIES_DAY}, {_COMPLETE}, {POINTS}, {_EDGES}, cnt AS (SELECT station AS target, day, count(value) AS n FROM reports GROUP BY station, day),
 span AS (SELECT target, min(day) AS a, max(day) AS b FROM cnt GROUP BY target), cand AS (SELECT target, unnest(range(a, b + 1)) AS day FROM span),
 st AS (SELECT target, count(*) AS n FROM edges GROUP BY target), va AS (SELECT target, day, count(*) AS n FROM edges JOIN complete USING (station) WHERE complete GROUP BY target, day),
 j AS (SELECT c.target, c.day, coalesce(cnt.n, 0) AS r, coalesce(st.n, 0) AS s, coalesce(va.n, 0) AS v FROM cand c LEFT JOIN cnt USING (target, day) LEFT JOIN st USING (target) LEFT JOIN va USING (target, day))
 SELECT row_number() OVER (ORDER BY target, day) - 1 AS sample_id, target, day, r AS n_reports, s AS n_static, v AS n_valid,
 CASE WHEN r = 0 AND s < 1 THEN 'no_target_and_few_neighbours' WHEN r = 0 AND v < 1 THEN 'no_target_and_incomplete' WHEN r = 0 THEN 'no_target' WHEN s < 1 THEN 'few_neighbours' WHEN v < 1 THEN 'incomplete' END AS reason FROM j""")
def g3_sample_index(spark, d):
    """The index of samples with reasons and running ids."""
    e = reports(spark, d).select(F.col("station").alias("target"), "day", "value")
    counts = e.groupBy("target", "day").agg(F.count("value").alias("n_reports"))
    span = B.active_span(counts, "target", "day")
    cand = span.select("target", F.explode(F.sequence("first", "last")).alias("day"))
    edges = _edges(spark, d)
    static = edges.groupBy("target").agg(F.count("*").alias("n_static"))
    valid = G.valid_neighbours(edges, G.complete_window(series_day(spark, d), ["station"], "day", "v", 3), "target", "station", "day")
    return G.sample_index(cand, counts, static, valid, "target", "day", 1, exclusion_reason).select("sample_id", "target", "day", "n_reports", "n_static", "n_valid", "reason")


@query(f"""WITH {SERIES_HOUR}, w AS (SELECT var, row_number() OVER p - 1 AS start, count(*) OVER (PARTITION BY var) AS n, list(v) OVER (PARTITION BY var ORDER BY hour ROWS BETWEEN CURRENT ROW AND 17 FOLLOWING) AS x FROM series_hour WINDOW p AS (PARTITION BY var ORDER BY hour))
 SELECT var, start, {r('list_sum(x[1:12])', 'sum_x', 4)}, {r('list_sum(x[9:18])', 'sum_y', 4)}, {r('x[9]', 'first_y', 4)}, len(x[9:18]) AS len_y FROM w WHERE start + 18 <= n""")
def g4_make_windows(spark, d):
    """Input, label and horizon of each start."""
    w = G.make_windows(series_hour(spark, d), "var", "hour", "v", 12, 4, 6)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rounded(w.select("var", "start", total("x").alias("sum_x"), total("y").alias("sum_y"), F.element_at("y", 1).alias("first_y"), F.size("y").alias("len_y")), 4)


@query(f"""WITH {SERIES_HOUR}, w AS (SELECT var, row_number() OVER p - 1 AS start, count(*) OVER (PARTITION BY var) AS n, list(v) OVER (PARTITION BY var ORDER BY hour ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS x FROM series_hour WINDOW p AS (PARTITION BY var ORDER BY hour))
 SELECT var, start, {r('list_sum(x)', 'total', 4)} FROM w WHERE start + 24 <= n AND start % 24 = 0""")
def g5_segments(spark, d):
    """Disjoint segments (overlapping with a smaller stride)."""
    w = G.segment_windows(series_hour(spark, d), "var", "hour", "v", 24, 24)
    return rounded(w.select("var", "start", F.aggregate("x", F.lit(0.0), lambda a, x: a + x).alias("total")), 4)


@query(f"WITH {_VEC} SELECT vec_id, {r('list_sum(v[-20:])', 'last20')}, CAST(64 AS BIGINT) AS seen80, {r('list_sum(v[1:10])', 'first10')}, {r('v[1] + v[3] + v[5]', 'even3')}, {r('v[64] + v[63]', 'tail2')} FROM vecs")
def g6_g8_g9_cuts(spark, d):
    """Last window, padding, subsampling."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    v = F.col("v")
    out = _vecs(spark, d).select("vec_id", total(G.last_window(v, 20)["x"]).alias("last20"), total(G.last_window(v, 80)["mask"]).cast("long").alias("seen80"), total(G.pad_truncate(v, 10)["x"]).alias("first10"), total(F.slice(G.subsample_long(v, 32, 2), 1, 3)).alias("even3"), total(F.slice(G.last_window(v, 80)["x"], -2, 2)).alias("tail2"))
    return rounded(out)


@query(f"WITH {_VEC}, c AS (SELECT vec_id, v, 40 + (vec_id * 1103515245 + 9) % 2147483647 % 24 AS cut FROM vecs) SELECT vec_id, cut, {r('list_sum(v[cut - 11:cut])', 'insample')}, {r('list_sum(v[cut + 1:cut + 8])', 'outsample')}, least(64 - cut, 8) AS n_out FROM c")
def g7_random_cut(spark, d):
    """A seeded cut with masks."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    c = _vecs(spark, d).withColumn("c", G.random_cut(F.col("v"), F.col("vec_id"), 12, 8, 3, 9))
    return rounded(c.select("vec_id", "c.cut", total("c.insample").alias("insample"), total("c.outsample").alias("outsample"), total("c.out_mask").cast("long").alias("n_out")))


@query(f"""WITH {SERIES_DAY}, g AS (SELECT station, day, CASE WHEN day % 3 <> 0 THEN v END AS v FROM series_day),
 k AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER b AS p0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER a AS p1 FROM g
 WINDOW b AS (PARTITION BY station ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY station ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT station, day, {r('coalesce(v, v0 + (v1 - v0) * (day - p0) / nullif(p1 - p0, 0), v0, v1)', 'filled')} FROM k""")
def g10_interpolate(spark, d):
    """Gaps on the line between their neighbours."""
    g = series_day(spark, d).withColumn("v", F.when(F.col("day") % 3 != 0, F.col("v")))
    return rounded(X.interpolate_linear(g, ["station"], "day", "v").select("station", "day", "filled"))


@query(f"WITH {LABELLED}, t AS (SELECT avg(x) AS m, stddev_samp(x) AS s, min(x) AS lo, max(x) AS hi FROM labelled) SELECT vec_id, pos, {r('(x - m) / (s + 1e-8)', 'g_std', 5)}, {r('(x - lo) / (hi - lo + 1e-8)', 'g_mm', 5)}, {r('(x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-8)', 'v_std', 5)}, {r('(x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w + 1e-8)', 'v_mm', 5)} FROM labelled, t WINDOW w AS (PARTITION BY vec_id)")
def g11_normalize(spark, d):
    """Four ways to scale a frame."""
    out = labelled_series(spark, d)
    for name, by, kind in (("g_std", None, "standard"), ("g_mm", None, "minmax"), ("v_std", ["vec_id"], "standard"), ("v_mm", ["vec_id"], "minmax")):
        out = G.normalize_frame(out, "x", by, kind).withColumnRenamed("normed", name)
    return rounded(out.select("vec_id", "pos", "g_std", "g_mm", "v_std", "v_mm"), 5)


@query(f"WITH {SERIES_DAY} SELECT station, day, {r('v - avg(v) OVER (PARTITION BY station)', 'anomaly')} FROM series_day")
def g12_anomaly(spark, d):
    """Distance from the station's mean."""
    return rounded(G.anomaly(series_day(spark, d), ["station"], "v").select("station", "day", "anomaly"))


@query(f"WITH {LABELLED} SELECT vec_id, pos, {r('(x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5)', 'normed', 5)}, {r('x - last_value(x) OVER o', 'centred')}, {r('CASE WHEN pos % 3 <> 0 THEN (x - avg(x) FILTER (WHERE pos % 3 <> 0) OVER w) / sqrt(avg(x * x) FILTER (WHERE pos % 3 <> 0) OVER w - pow(avg(x) FILTER (WHERE pos % 3 <> 0) OVER w, 2) + 1e-5) ELSE 0 END', 'masked', 5)} FROM labelled WINDOW w AS (PARTITION BY vec_id), o AS (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def g13_g14_instance_norm(spark, d):
    """Window-wise scaling, all or observed points."""
    s = G.instance_norm(labelled_series(spark, d), ["vec_id"], "x")
    s = G.subtract_last(s, ["vec_id"], "pos", "x").withColumnRenamed("normed", "n1")
    s = G.masked_instance_norm(s, ["vec_id"], "x", F.col("pos") % 3 != 0)
    return s.select("vec_id", "pos", F.round("n1", 5).alias("normed"), F.round("centred", 6).alias("centred"), F.round("normed", 5).alias("masked"))


def _ma(k: int) -> str:
    return f"(SELECT avg(c.v[greatest(1, least(64, i))]) FROM range(CAST(a.pos AS BIGINT) + 1 - {(k - 1) // 2}, CAST(a.pos AS BIGINT) + 2 + {k - 1 - (k - 1) // 2}) t(i))"


@query(f"WITH {LABELLED}, {_VEC}, a AS (SELECT * FROM labelled WHERE vec_id < 100) SELECT a.vec_id, pos, {r(f'({_ma(5)} + {_ma(8)}) / 2', 'trend', 5)}, {r(f'x - ({_ma(5)} + {_ma(8)}) / 2', 'seasonal', 5)} FROM a JOIN vecs c USING (vec_id)".replace("vec_id < 100", "TRUE"))
def g15_trend_seasonal(spark, d):
    """Moving average with repeated edges."""
    return rounded(X.trend_seasonal(labelled_series(spark, d), ["vec_id"], "pos", "x", [5, 8]).select("vec_id", "pos", "trend", "seasonal"), 5)


@query(f"WITH {LABELLED} SELECT vec_id, CAST(pos // 10 AS BIGINT) AS bin, {r('avg(x)', 'v')}, {r('max(x)', 'top')} FROM labelled GROUP BY vec_id, pos // 10 HAVING count(*) = 10")
def g16_downsample(spark, d):
    """Mean and maximum of whole runs."""
    s = labelled_series(spark, d)
    return rounded(G.downsample(s, ["vec_id"], "pos", "x", 10).join(G.downsample(s, ["vec_id"], "pos", "x", 10, "max").withColumnRenamed("v", "top"), ["vec_id", "bin"]))


@query(f"WITH {LABELLED} SELECT vec_id, pos, CASE WHEN pos % 2 = 0 THEN 'even' ELSE 'odd' END AS half, pos // 2 AS \"at\", CAST(pos // 10 AS BIGINT) AS contiguous, pos % 7 AS interval FROM labelled")
def g17_g31_chunks(spark, d):
    """Even and odd halves, contiguous and interval chunks."""
    s = G.even_odd(labelled_series(spark, d), "pos").withColumn("c", G.chunk_ids(F.col("pos"), 64, 10))
    return s.select("vec_id", "pos", "half", "at", "c.contiguous", "c.interval")


@query(f"WITH {_VEC}, p AS (SELECT vec_id, v || list_value(v[64], v[64], v[64], v[64]) AS u FROM vecs), s AS (SELECT vec_id, u, unnest(range(0, 14)) AS k FROM p) SELECT vec_id, k, {r('list_sum(u[k * 4 + 1:k * 4 + 16])', 'total')} FROM s")
def g18_patches(spark, d):
    """Overlapping patches."""
    p = _vecs(spark, d).select("vec_id", F.posexplode(G.patches(F.col("v"), 16, 4, 4)).alias("k", "patch"))
    return rounded(p.select("vec_id", "k", F.aggregate("patch", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query(f"""WITH {LABELLED} SELECT b.vec_id, b.pos, {r('sum(0.3 * pow(0.7, b.pos - a.pos) * a.x) + pow(0.7, b.pos + 1) * 0.5', 'smooth')} FROM labelled a JOIN labelled b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY b.vec_id, b.pos""")
def g19_exp_smooth(spark, d):
    """Exponential smoothing."""
    s = _vecs(spark, d).select("vec_id", F.posexplode(X.exp_smooth(F.col("v"), 0.7, 0.5)).alias("pos", "smooth"))
    return rounded(s)


_DFT = "spec AS (SELECT vec_id, f AS freq, sum(x * cos(2 * pi() * f * pos / 64)) AS re, -sum(x * sin(2 * pi() * f * pos / 64)) AS im FROM labelled, range(33) t(f) GROUP BY vec_id, f), amps AS (SELECT *, sqrt(re * re + im * im) AS amp FROM spec)"


@query(f"WITH {LABELLED}, {_DFT} SELECT freq, {r('avg(amp)', 'mean_amp')}, 64 // freq AS period FROM amps WHERE freq > 0 GROUP BY freq ORDER BY avg(amp) DESC LIMIT 5")
def g20_dominant_periods(spark, d):
    """Periods of the strongest frequencies."""
    top, _ = X.dominant_periods(X.spectrum(labelled_series(spark, d), "vec_id", "pos", "x"), "vec_id", 5)
    return rounded(top)


_TOP4 = "top AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY amp DESC) AS k FROM amps WHERE freq > 0) WHERE k <= 4)"
_PARTS = "(CASE WHEN freq = 32 OR freq = 0 THEN 1 ELSE 2 END) * (re * cos(2 * pi() * freq * p / 64) - im * sin(2 * pi() * freq * p / 64)) / 64"


@query(f"WITH {LABELLED}, {_DFT}, {_TOP4}, s AS (SELECT vec_id, p AS pos, sum({_PARTS}) AS season FROM top, range(64) t(p) GROUP BY vec_id, p) SELECT vec_id, pos, {r('season', 'season', 5)}, {r('x - season', 'trend', 5)} FROM s JOIN labelled USING (vec_id, pos)")
def g21_dft_decompose(spark, d):
    """Season of the strongest frequencies."""
    return rounded(X.dft_decompose(labelled_series(spark, d), "vec_id", "pos", "x", 4).select("vec_id", "pos", "season", "trend"), 5)


@query(f"WITH {LABELLED}, {_DFT}, m AS (SELECT freq FROM amps GROUP BY freq ORDER BY avg(amp) DESC, freq LIMIT 6), s AS (SELECT vec_id, p AS pos, sum({_PARTS}) AS inv FROM (SELECT * FROM amps WHERE freq IN (SELECT freq FROM m)), range(64) t(p) GROUP BY vec_id, p) SELECT vec_id, pos, {r('inv', 'invariant', 5)}, {r('x - inv', 'variant', 5)} FROM s JOIN labelled USING (vec_id, pos)")
def g22_spectrum_mask(spark, d):
    """The corpus' dominant frequencies and the rest."""
    return rounded(X.variant_invariant(labelled_series(spark, d), "vec_id", "pos", "x", 0.2).select("vec_id", "pos", "invariant", "variant"), 5)


@query(f"WITH {LABELLED}, {_DFT}, top AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY amp DESC) AS k FROM amps WHERE freq > 0 AND freq < 32) WHERE k <= 4) SELECT vec_id, p AS pos, {r(f'sum({_PARTS})', 'v', 5)} FROM top, range(80) t(p) GROUP BY vec_id, p")
def g23_extrapolate(spark, d):
    """Strongest frequencies past the end."""
    return rounded(X.fourier_extrapolate(labelled_series(spark, d), "vec_id", "pos", "x", 4, 64, 16), 5)


_AC = "ac AS (SELECT vec_id, lag, sum(v[i + 1] * v[(i + lag) % 64 + 1]) AS r FROM vecs, range(64) a(lag), range(64) b(i) GROUP BY vec_id, lag), tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, lag) AS k FROM ac WHERE lag < 33) WHERE k <= 4), wt AS (SELECT vec_id, lag, exp(r) / sum(exp(r)) OVER (PARTITION BY vec_id) AS w FROM tk)"


@query(f"WITH {_VEC}, {_AC} SELECT vec_id, p AS pos, {r('sum(w * v[(p + lag) % 64 + 1])', 'v')} FROM wt JOIN vecs USING (vec_id), range(64) t(p) GROUP BY vec_id, p")
def g24_autocorrelation(spark, d):
    """Lags of the largest correlation, and the series rolled by them."""
    s = labelled_series(spark, d)
    c = X.autocorrelation(s, "vec_id", "pos", "x", 64).filter("lag < 33")
    return rounded(X.delay_aggregate(s, X.delay_weights(c, "vec_id", 4), "vec_id", "pos", "x", 64))


@query(f"""WITH {LABELLED}, l1 AS (SELECT vec_id, pos // 2 AS p, sum(x) / sqrt(2) AS lo, sum(CASE WHEN pos % 2 = 0 THEN x ELSE -x END) / sqrt(2) AS hi FROM labelled GROUP BY vec_id, pos // 2),
 l2 AS (SELECT vec_id, p // 2 AS p, sum(lo) / sqrt(2) AS lo, sum(CASE WHEN p % 2 = 0 THEN lo ELSE -lo END) / sqrt(2) AS hi FROM l1 GROUP BY vec_id, p // 2)
 SELECT vec_id, 1 AS level, 'high' AS band, p AS pos, {r('hi', 'v')} FROM l1 UNION ALL SELECT vec_id, 2, 'high', p, {r('hi', 'v')} FROM l2 UNION ALL SELECT vec_id, 2, 'low', p, {r('lo', 'v')} FROM l2""")
def g25_wavelet(spark, d):
    """A filter bank with every other value kept."""
    return rounded(X.wavelet_decompose(labelled_series(spark, d), "vec_id", "pos", "x", 2))


@query(f"WITH {LABELLED} SELECT vec_id, pos, {r('x', 'v')} FROM labelled")
def g25_inverse(spark, d):
    """The series back from its bands."""
    bands = X.wavelet_decompose(labelled_series(spark, d), "vec_id", "pos", "x", 3)
    return rounded(X.wavelet_reconstruct(bands, "vec_id", 3).select("vec_id", F.col("pos").cast("long").alias("pos"), "v"))


#: Orthogonal filters of four and of six taps, by their closed forms.
_FOUR = tuple((1 + a * 3**0.5 + b) / (4 * 2**0.5) for a, b in ((1, 0), (1, 2), (-1, 2), (-1, 0)))
_Q, _W = 10**0.5, (5 + 2 * 10**0.5) ** 0.5
_SIX = tuple(x / (16 * 2**0.5) for x in (1 + _Q + _W, 5 + _Q + 3 * _W, 10 - 2 * _Q + 2 * _W, 10 - 2 * _Q - 2 * _W, 5 + _Q - 3 * _W, 1 + _Q - _W))


def _bank(source: str, n: int, taps: tuple[float, ...], high: bool = False) -> str:
    """List of a band of the periodic series ``source`` of ``n`` values."""
    h = [(-1) ** k * x for k, x in enumerate(reversed(taps))] if high else taps
    return f"list_transform(range({n // 2}), lambda k: " + " + ".join(f"CAST({x!r} AS DOUBLE) * {source}[CAST((2 * k + {j}) % {n} + 1 AS BIGINT)]" for j, x in enumerate(h)) + ")"


@query(f"""WITH {_VEC}, a AS (SELECT vec_id, {_bank('v', 64, _SIX)} AS lo, {_bank('v', 64, _SIX, True)} AS hi FROM vecs), b AS (SELECT vec_id, hi, {_bank('lo', 32, _SIX)} AS lo2, {_bank('lo', 32, _SIX, True)} AS hi2 FROM a)
 SELECT vec_id, CAST(1 AS BIGINT) AS level, 'high' AS band, p AS pos, {r('hi[p + 1]', 'v')}, CAST(64 AS BIGINT) AS size FROM b, range(32) t(p) UNION ALL SELECT vec_id, 2, 'high', p, {r('hi2[p + 1]', 'v')}, 32 FROM b, range(16) t(p) UNION ALL SELECT vec_id, 2, 'low', p, {r('lo2[p + 1]', 'v')}, 32 FROM b, range(16) t(p)""")
def g25_periodic(spark, d):
    """A long filter on periodic series."""
    return rounded(X.wavelet_periodic(labelled_series(spark, d), "vec_id", "pos", "x", 2, _SIX))


@query(f"WITH {LABELLED} SELECT vec_id, pos, {r('x', 'v')} FROM labelled WHERE pos < 40 + vec_id % 25")
def g25_long_inverse(spark, d):
    """Series of all lengths back from four levels of a long filter."""
    s = labelled_series(spark, d).filter(F.col("pos") < 40 + F.col("vec_id") % 25)
    return rounded(X.wavelet_inverse(X.wavelet_periodic(s, "vec_id", "pos", "x", 4, _FOUR), "vec_id", 4, _FOUR).select("vec_id", "pos", "v"))


@query(f"""WITH {LABELLED}, l1 AS (SELECT vec_id, pos // 3 AS bin, avg(x) AS v, min(pos) % 7 AS mark, count(*) AS n FROM labelled GROUP BY vec_id, pos // 3 HAVING count(*) = 3), l2 AS (SELECT vec_id, bin // 3 AS bin, avg(v) AS v, arg_min(mark, bin) AS mark FROM l1 GROUP BY vec_id, bin // 3 HAVING count(*) = 3)
 SELECT vec_id, 0 AS level, pos AS bin, {r('x', 'v')}, pos % 7 AS mark FROM labelled UNION ALL SELECT vec_id, 1, bin, {r('v', 'v')}, mark FROM l1 UNION ALL SELECT vec_id, 2, bin, {r('v', 'v')}, mark FROM l2""")
def g16_levels(spark, d):
    """Several levels, marks by the stride."""
    s = labelled_series(spark, d).withColumn("mark", F.col("pos") % 7)
    return rounded(G.downsample_levels(s, ["vec_id"], "pos", "x", "mark", 3, 2))


@query(f"WITH {LABELLED} SELECT vec_id, pos, {r('x - lag(x, 12) OVER (PARTITION BY vec_id ORDER BY pos)', 'diff')} FROM labelled")
def g26_seasonal_diff(spark, d):
    """Difference to a season before."""
    return rounded(X.seasonal_diff(labelled_series(spark, d), ["vec_id"], "pos", "x", 12).select("vec_id", "pos", "diff"))


@query(f"WITH {SERIES_DAY}, {_COMPLETE}, {POINTS}, {_EDGES}, g AS (SELECT target, day, rank, CASE WHEN complete THEN v ELSE 0 END AS v FROM edges JOIN complete USING (station)) SELECT target, day, {r('coalesce(sum(v) FILTER (WHERE rank = 1), 0)', 'x1')}, {r('coalesce(sum(v) FILTER (WHERE rank = 2), 0)', 'x2')}, {r('coalesce(sum(v) FILTER (WHERE rank = 3), 0)', 'x3')} FROM g GROUP BY target, day")
def g27_gate(spark, d):
    """Incomplete and missing neighbours as 0."""
    c = G.complete_window(series_day(spark, d), ["station"], "day", "v", 3)
    e = _edges(spark, d).join(c, "station").withColumn("rank", F.col("rank").cast("long"))
    out = G.gate_by_validity(e, ["target", "day"], "rank", F.col("complete"), "v", 3)
    return rounded(out.select("target", "day", *[F.element_at("x", k).alias(f"x{k}") for k in (1, 2, 3)]))


@query(f"""WITH {SERIES_DAY}, {_COMPLETE}, {POINTS}, {_EDGES}, s AS (SELECT DISTINCT e.target, d.day AS t FROM edges e JOIN series_day d ON d.station = e.station),
 ok AS (SELECT s.target, s.t, e.rank, e.station, p.h - g.h AS up FROM s JOIN edges e ON e.target = s.target JOIN complete c ON c.station = e.station AND c.day = s.t AND c.complete JOIN points p ON p.id = e.station JOIN targets g ON g.id = s.target),
 x AS (SELECT ok.target, ok.t, sum(d.v / 2) AS total, sum(d.v / 2 * ok.rank * (d.day - ok.t + 3)) AS weighted FROM ok JOIN series_day d ON d.station = ok.station AND d.day BETWEEN ok.t - 2 AND ok.t GROUP BY ok.target, ok.t),
 n AS (SELECT ok.target, ok.t, sum(ok.up * ok.rank) AS up, sum(b.n * ok.rank) AS bg FROM ok LEFT JOIN (SELECT station, day, count(*) AS n FROM reports GROUP BY station, day) b ON b.station = ok.station AND b.day = ok.t GROUP BY ok.target, ok.t)
 SELECT s.target, s.t, {r('coalesce(x.total, 0)', 'total', 7)}, {r('coalesce(weighted, 0)', 'weighted', 7)}, {r('coalesce(up, 0)', 'up', 4)}, CAST(coalesce(n.bg, 0) AS DOUBLE) AS bg, {r('CASE WHEN y.station IS NOT NULL THEN coalesce(y.v, 0) END', 'y', 7)}, CAST((s.t - 2) % 7 + 10 * ((s.t - 1) % 7) + 100 * (s.t % 7) AS DOUBLE) AS marks, CAST(s.t % 7 AS DOUBLE) AS mark_t, {r('g.h', 'height')}, CAST(q.n AS DOUBLE) AS bg_target
 FROM s JOIN targets g ON g.id = s.target LEFT JOIN x ON x.target = s.target AND x.t = s.t LEFT JOIN n ON n.target = s.target AND n.t = s.t LEFT JOIN series_day y ON y.station = s.target AND y.day = s.t
 LEFT JOIN (SELECT station, day, count(*) AS n FROM reports GROUP BY station, day) q ON q.station = s.target AND q.day = s.t""")
def g28_assemble(spark, d):
    """Samples with inputs, target, marks, geometry, features and background."""
    s, t, p = series_day(spark, d), targets(spark, d), neighbours(spark, d)
    up = t.select(F.col("id").alias("target"), F.col("h").alias("th"))
    e = _edges(spark, d).join(up, "target").join(p.select(F.col("id").alias("station"), "h"), "station").withColumn("up", F.col("h") - F.col("th"))
    idx = e.select("target", "station").join(s, "station").select("target", "day").distinct()
    bg = reports(spark, d).groupBy("station", "day").agg(F.array(F.count("*").cast("double")).alias("bg"))
    x = G.assemble_samples(
        idx, e, s, "target", "station", "day", "v", 3, 3, ("up",), 0.0, 2.0,
        y=s.select(F.col("station").alias("target"), "day", F.array("v").alias("y")),
        marks=lambda step: F.array((step % 7).cast("double")),
        features=t.select(F.col("id").alias("target"), F.array("h").alias("features")),
        background=bg, target_background=bg.withColumnRenamed("station", "target"),
    )
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda u, v: u + v)
    by_rank = lambda a: add(F.transform(a, lambda v, k: F.element_at(v, 1) * (k + 1)))
    total = add(F.flatten("x"))
    weighted = add(F.transform("x", lambda row, i: add(F.transform(row, lambda v, k: v * (k + 1))) * (i + 1)))
    marks = F.element_at(F.col("marks")[0], 1) + 10 * F.element_at(F.col("marks")[1], 1) + 100 * F.element_at(F.col("marks")[2], 1)
    one = {"y": F.element_at("y", 1), "marks": marks, "mark_t": F.element_at("mark_t", 1), "height": F.element_at("features", 1), "bg_target": F.element_at("bg_target", 1), "up": by_rank(F.col("geometry")), "bg": by_rank(F.col("bg"))}
    out = x.select("target", "t", total.alias("total"), weighted.alias("weighted"), *[v.alias(k) for k, v in one.items()])
    return out.select("target", "t", *[F.round(c, n).alias(c) for c, n in (("total", 7), ("weighted", 7), ("up", 4), ("y", 7), ("bg", 6), ("marks", 6), ("mark_t", 6), ("height", 6), ("bg_target", 6))])


@query(f"WITH {REPORTS} SELECT event_id, CAST(max(CASE WHEN value IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY station, day) AS BIGINT) AS mask, {r('coalesce(value, 0)', 'filled')} FROM reports")
def g30_frame_mask(spark, d):
    """Frames with any observed channel."""
    return rounded(G.frame_mask(reports(spark, d), ["station", "day"], "value").select("event_id", "mask", "filled"))


@query(f"WITH {_VEC} SELECT vec_id, h, {r('(v[64] - v[63]) * (SELECT sum(pow(0.9, i)) FROM range(1, h + 1) t(i))', 'v')} FROM (SELECT *, unnest(range(1, 9)) AS h FROM vecs)")
def g32_damped_trend(spark, d):
    """The last growth, damped."""
    v = _vecs(spark, d).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(8))))
    return rounded(v.select("vec_id", "h", X.damped_trend(F.element_at("v", -1) - F.element_at("v", -2), 0.9, F.col("h")).alias("v")))


_LEV = [50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 850, 925, 1000]
_E = "6.1078 * exp(17.269 * ({t} - 273.15) / ({t} - 273.15 + 237.3)) * {r} / 100"
PROFILE = f"""lev AS (SELECT CAST(p AS DOUBLE) AS p, CAST(k AS BIGINT) AS k FROM (VALUES {', '.join(f'({p}, {k + 1})' for k, p in enumerate(_LEV))}) t(p, k)),
 profile AS (SELECT vec_id, p, 250 + 30 * v[k] AS t, 50 + 40 * v[k + 13] AS r, 44330.0 * (1 - pow(p / 1013.25, 0.19)) + 5 * v[k] AS z FROM vecs, lev),
 surface AS (SELECT vec_id, 288 + 20 * v[27] AS t2m, 960 + 100 * v[28] AS p_s, 300 + 500 * v[29] AS h, 45 + 20 * v[30] AS lat FROM vecs),
 rows_ AS (SELECT *, coalesce(max(CASE WHEN p < p_s THEN {{'p': p, 'r': r}} END) OVER w, max({{'p': p, 'r': r}}) OVER w).r AS rh FROM profile JOIN surface USING (vec_id) WINDOW w AS (PARTITION BY vec_id)),
 nodes AS (SELECT vec_id, p AS o, CASE WHEN p >= p_s THEN p_s ELSE p END AS p, CASE WHEN p >= p_s THEN t2m ELSE t END AS t, CASE WHEN p >= p_s THEN {_E.format(t='t2m', r='rh')} ELSE {_E.format(t='t', r='r')} END AS e, CASE WHEN p >= p_s THEN h ELSE z END AS z FROM rows_
  UNION ALL SELECT DISTINCT vec_id, 1e9, p_s, t2m, {_E.format(t='t2m', r='rh')}, h FROM rows_)"""
_WET = "(16.52 * e + 3.776e5 * e / t) / p"
_NH, _NW = "77.6890 * (p - e) / t", "(71.2952 - 0.62198 * 77.6890) * e / t + 375463.0 * e / (t * t)"
_GEO = f"""seg AS (SELECT vec_id, p, 0.5 * ({_NH} + lag({_NH}) OVER w) * greatest(z - lag(z) OVER w, 0) AS d, 0.5 * ({_NW} + lag({_NW}) OVER w) * greatest(z - lag(z) OVER w, 0) AS w,
 (lag({_NH}) OVER w + lag({_NW}) OVER w) * greatest(z - lag(z) OVER w, 0) AS rect FROM nodes WINDOW w AS (PARTITION BY vec_id ORDER BY o DESC)),
 geo AS (SELECT vec_id, 1e-3 * sum(d) AS d, 1e-3 * sum(w) AS w, 1e-3 * sum(rect) AS rect, 1e-3 * 77.6890 * 287.05 / 9.80665 * min(p) AS top FROM seg GROUP BY vec_id)"""


def _profile(spark, d):
    lev = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(k + 1).alias("k")) for k, p in enumerate(_LEV)])
    v = lambda k: F.element_at("v", k)
    x = _vecs(spark, d).withColumn("l", F.explode(lev))
    p = F.col("l.p")
    return x.select("vec_id", p.alias("p"), (250 + 30 * v(F.col("l.k"))).alias("t"), (50 + 40 * v(F.col("l.k") + 13)).alias("r"), (44330.0 * (1 - F.pow(p / 1013.25, F.lit(0.19))) + 5 * v(F.col("l.k"))).alias("z"))


def _surface(spark, d):
    v = lambda k: F.element_at("v", k)
    return _vecs(spark, d).select("vec_id", (288 + 20 * v(27)).alias("t2m"), (960 + 100 * v(28)).alias("p_s"), (300 + 500 * v(29)).alias("h"), (45 + 20 * v(30)).alias("lat"))


@query(f"WITH {_VEC}, {PROFILE}, y AS (SELECT *, (16.52 * {_E.format(t='t', r='r')} + 3.776e5 * {_E.format(t='t', r='r')} / t) / p AS y FROM profile), s AS (SELECT vec_id, 0.5 * (y + lag(y) OVER w) * (p - lag(p) OVER w) AS a FROM y WINDOW w AS (PARTITION BY vec_id ORDER BY p)) SELECT vec_id, {r('1e-3 * 287.05 / 9.80665 * sum(a)', 'zwd')} FROM s GROUP BY vec_id")
def h1_zwd_pressure(spark, d):
    """H1: wet delay over pressure."""
    return rounded(H.zwd_pressure(_profile(spark, d), ["vec_id"]))


@query(f"WITH {_VEC}, {PROFILE}, s AS (SELECT vec_id, 0.5 * ({_WET} + lag({_WET}) OVER w) * (p - lag(p) OVER w) AS a FROM nodes WINDOW w AS (PARTITION BY vec_id ORDER BY o)) SELECT vec_id, {r('2.2768 * p_s / (1 - 0.00266 * cos(2 * radians(lat)) - 0.00000028 * h)', 'zhd')}, {r('1e-3 * 287.05 / 9.80665 * x', 'zwd')} FROM (SELECT vec_id, sum(a) AS x FROM s GROUP BY vec_id) JOIN surface USING (vec_id)")
def h2_zwd_surface(spark, d):
    """H2: with the surface as the lowest node."""
    return rounded(H.zwd_pressure_surface(_profile(spark, d), _surface(spark, d), ["vec_id"]))


@query(f"WITH {_VEC}, {PROFILE}, {_GEO} SELECT vec_id, {r('d + top', 'zhd', 5)}, {r('w', 'zwd', 5)} FROM geo")
def h3_delay_geometric(spark, d):
    """H3: by height, with the dry air above."""
    return rounded(H.delay_geometric(_profile(spark, d), _surface(spark, d), ["vec_id"]), 5)


@query(f"WITH {_VEC}, {PROFILE}, {_GEO} SELECT vec_id, {r('rect', 'rectangle', 5)}, {r('d + w', 'trapezoid', 5)}, {r('d + w + top', 'with_top', 5)} FROM geo")
def h4_variants(spark, d):
    """H4: integration rules side by side."""
    return rounded(H.delay_variants(_profile(spark, d), _surface(spark, d), ["vec_id"]), 5)


_LAYERS = """x AS (SELECT vec_id, p, t, z, r / 100 * 6.112 * exp(17.67 * (t - 273.15) / (t - 273.15 + 243.5)) AS e FROM profile),
 b AS (SELECT vec_id, h, (SELECT max(z) FROM x WHERE x.vec_id = s.vec_id AND z <= h) AS z0, (SELECT min(z) FROM x WHERE x.vec_id = s.vec_id AND z > h) AS z1, (SELECT min(z) FROM x WHERE x.vec_id = s.vec_id) AS lowest FROM surface s),
 y AS (SELECT x.vec_id, p, t, e, z FROM x JOIN b USING (vec_id) WHERE NOT (lowest < h AND z1 IS NOT NULL) OR z > h
  UNION ALL SELECT b.vec_id, u.p + (h - z0) / (z1 - z0) * (v.p - u.p), u.t + (h - z0) / (z1 - z0) * (v.t - u.t), u.e + (h - z0) / (z1 - z0) * (v.e - u.e), h FROM b JOIN x u ON u.vec_id = b.vec_id AND u.z = z0 JOIN x v ON v.vec_id = b.vec_id AND v.z = z1 WHERE lowest < h),
 l AS (SELECT vec_id, 77.6890 * (p - e) / t AS nh, (71.2952 - 0.62198 * 77.6890) * e / t + 375463.0 * e / (t * t) AS nw, 1 + 1650 * (e / (t * t * t)) * (1 - 0.01317 * (t - 273.15) + 1.75e-4 * pow(t - 273.15, 2) + 1.44e-6 * pow(t - 273.15, 3)) AS c, lead(z) OVER (PARTITION BY vec_id ORDER BY z) - z AS dz FROM y)"""


@query(f"WITH {_VEC}, {PROFILE}, {_LAYERS} SELECT vec_id, {r('1e-3 * sum(nh * dz)', 'zhd', 4)}, {r('1e-3 * sum(nw * dz)', 'zwd', 4)}, {r('1e-3 * sum(nw * c * dz)', 'exact', 4)} FROM l GROUP BY vec_id")
def h4_layers(spark, d):
    """H4: by layers from an interpolated ground up, plain and with compressibility."""
    p = _profile(spark, d).join(_surface(spark, d).select("vec_id", "h"), "vec_id")
    exact = H.delay_layers(p, ["vec_id"], "h", compressibility=True).select("vec_id", F.col("zwd").alias("exact"))
    return rounded(H.delay_layers(p, ["vec_id"], "h").join(exact, "vec_id"), 4)


@query(f"WITH {_VEC}, {PROFILE}, m AS (SELECT vec_id, p_s, max(CASE WHEN p < p_s THEN {{'p': p, 'z': z, 't': t}} END) AS m FROM profile JOIN surface USING (vec_id) GROUP BY vec_id, p_s) SELECT vec_id, {r('m.z + 287.05 * m.t / 9.80665 * ln(m.p / p_s)', 'h_oro')} FROM m")
def h5_orography(spark, d):
    """H5: height of the model's ground."""
    return rounded(H.orography_height(_profile(spark, d), _surface(spark, d), ["vec_id"]))


@query(f"WITH {_VEC}, {PROFILE}, s AS (SELECT avg(t) AS m, stddev_pop(t) AS sd FROM profile) SELECT vec_id, p AS level, {r('(t - m) / sd * sd + m', 'value', 5)} FROM profile, s WHERE p IN (500, 700, 850)")
def h6_destandardise(spark, d):
    """H6: chosen levels in physical units."""
    p = _profile(spark, d).select("vec_id", F.col("p").alias("level"), F.lit("t").alias("channel"), "t")
    stats = p.groupBy("channel").agg(F.avg("t").alias("mean"), F.stddev_pop("t").alias("std"))
    z = p.join(stats, "channel").withColumn("value", (F.col("t") - F.col("mean")) / F.col("std")).select("vec_id", "level", "channel", "value")
    return rounded(H.destandardise(z, stats, [500.0, 700.0, 850.0]).select("vec_id", "level", "value"), 5)


@query(f"WITH {_VEC}, {PROFILE.replace('960 + 100 * v[28] AS p_s', '(960 + 100 * v[28]) * exp(-9.80665 * (300 + 500 * v[29]) / (287.05 * (288 + 20 * v[27]))) AS p_s')}, {_GEO} SELECT vec_id, {r('d + top', 'zhd', 4)}, {r('w', 'zwd', 4)}, {r('d + top + w', 'ztd', 4)} FROM embeddings LEFT JOIN (SELECT * FROM geo WHERE vec_id % 3 = 0) USING (vec_id)")
def h7_delay_table(spark, d):
    """H7: delays of station cells, NULL elsewhere."""
    s = _surface(spark, d).filter("vec_id % 3 = 0").withColumnRenamed("p_s", "msl")
    cells = read(spark, d, "embeddings").select("vec_id")
    return rounded(H.delay_table(_profile(spark, d), s, ["vec_id"], cells, "vec_id"), 4)


#: Vectors as columns of a forecast: start vec_id % 12 (in steps of 6 hours), cell vec_id // 12 of a grid of 30 columns; every third cell has a station.
_CELL = "CAST(vec_id // 12 AS BIGINT)"


@query(f"""WITH {_VEC}, {PROFILE.replace('960 + 100 * v[28] AS p_s', '(960 + 100 * v[28]) * exp(-9.80665 * (vec_id // 12 % 7 * 100) / (287.05 * (288 + 20 * v[27]))) AS p_s').replace('300 + 500 * v[29] AS h', 'CAST(vec_id // 12 % 7 * 100 AS DOUBLE) AS h')}, {_GEO},
 cells AS (SELECT DISTINCT {_CELL} AS cell FROM embeddings), times AS (SELECT CAST(t AS BIGINT) AS t FROM range(1, 14) x(t)),
 got AS (SELECT {_CELL} AS cell, vec_id % 12 + 4 AS t, d + top AS zhd, w AS zwd FROM geo WHERE {_CELL} % 3 = 0)
 SELECT cell // 30 AS ti, cell % 30 AS tj, t, {r('zhd', 'zhd', 4)}, {r('zwd', 'zwd', 4)}, {r('zhd + zwd', 'ztd', 4)} FROM (SELECT * FROM cells, times) LEFT JOIN got USING (cell, t)""")
def h7_from_forecast(spark, d):
    """H7: delays from long rows of a forecast: lead, grid map, standardised channels, levels, integral."""
    p, s = _profile(spark, d), _surface(spark, d)
    level = F.col("p").cast("int").cast("string")
    of = lambda df, name, v: df.select("vec_id", name.alias("channel"), v.alias("x"))
    rows = of(p, F.concat(F.lit("t"), level), F.col("t")).unionByName(of(p, F.concat(F.lit("r"), level), F.col("r"))).unionByName(of(p, F.concat(F.lit("z"), level), F.col("z") * 9.80665)).unionByName(of(s, F.lit("t2m"), F.col("t2m"))).unionByName(of(s, F.lit("msl"), F.col("p_s") * 100.0))
    cell = F.floor(F.col("vec_id") / 12)
    stats = spark.createDataFrame([(f"{c}{int(x)}", m, sd) for c, m, sd in (("t", 250.0, 30.0), ("r", 50.0, 20.0), ("z", 1e5, 5e4)) for x in _LEV] + [("t2m", 280.0, 15.0), ("msl", 1e5, 1e3)], "channel string, mean double, std double")
    fcst = rows.join(stats, "channel").select((F.col("vec_id") % 12).alias("init"), F.explode(F.array(F.lit(4), F.lit(8))).alias("lead"), "channel", (F.floor(cell / 30)).alias("i"), (cell % 30).alias("j"), ((F.col("x") - F.col("mean")) / F.col("std")).alias("value"))
    fcst = fcst.withColumn("value", F.when(F.col("lead") == 4, F.col("value")).otherwise(F.col("value") + 1.0))
    grid = read(spark, d, "embeddings").select(cell.alias("c")).distinct().select(F.floor(F.col("c") / 30).alias("ti"), (F.col("c") % 30).alias("tj"), (F.col("c") % 3 == 0).alias("there"), (F.col("c") % 7 * 100).cast("double").alias("h"))
    cells = grid.select("ti", "tj", (40.0 + F.col("ti")).alias("lat"), (370.0 + F.col("tj")).alias("lon"), F.when(F.col("there"), F.col("h")).alias("h"))
    times = spark.range(1, 14).select(F.col("id").alias("t"))
    out = H.delay_from_forecast(fcst, stats, cells, times, 4, [float(x) for x in _LEV], 40.0, 10.0, 1.0, 100_000, 30)
    return rounded(out.select("ti", "tj", "t", "zhd", "zwd", "ztd"), 4)


@query(f"WITH {_VEC}, {PROFILE} SELECT (SELECT list_sort(list(DISTINCT p)) FROM profile) = (SELECT list_sort(list(DISTINCT p)) FROM profile WHERE vec_id % 2 = 0) AS same, (SELECT count(DISTINCT p) FROM profile) AS n")
def h8_levels(spark, d):
    """H8: same levels whatever the order."""
    p = _profile(spark, d)
    return H.same_levels(p, p.filter("vec_id % 2 = 0").orderBy(F.desc("p")), "p")


@query(f"WITH {_VEC}, {PROFILE}, {_GEO} SELECT vec_id, {r('d + top', 'zhd', 5)}, {r('x', 'zwd', 5)}, {r('d + top + x', 'ztd', 5)} FROM geo JOIN (SELECT vec_id, 1e-3 * 287.05 / 9.80665 * sum(a) AS x FROM (SELECT vec_id, 0.5 * ({_WET} + lag({_WET}) OVER w) * (p - lag(p) OVER w) AS a FROM nodes WINDOW w AS (PARTITION BY vec_id ORDER BY o)) GROUP BY vec_id) USING (vec_id)")
def h9_mixed(spark, d):
    """H9: dry part of one source, wet part of another."""
    p, s = _profile(spark, d), _surface(spark, d)
    return rounded(H.delay_mixed(H.delay_geometric(p, s, ["vec_id"]), H.zwd_pressure_surface(p, s, ["vec_id"]), ["vec_id"]), 5)
