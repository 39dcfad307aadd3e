"""Queries: task metrics, augmentation, similarity, scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from stationflow.operators import augment as K
from stationflow.operators import metrics as M
from stationflow.operators import similarity as L
from stationflow.operators import transforms as X
from stationflow.operators.windows import make_windows
from stationflow.plans.registry import LABELLED, PAIRS, SERIES_HOUR, labelled_series, pairs, query, r, read, rounded, series_hour


def _vecs(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


_D = "(an - obs)"


@query(f"WITH {PAIRS} SELECT channel, {r(f'avg(abs{_D})', 'mae', 4)}, {r(f'avg({_D} * {_D})', 'mse', 2)}, {r(f'sqrt(avg({_D} * {_D}))', 'rmse', 4)}, {r(f'avg(abs({_D} / obs))', 'mape')}, {r(f'avg(pow({_D} / obs, 2))', 'mspe')} FROM pairs GROUP BY channel")
def m1_errors(spark, d):
    """M1: MAE, MSE, RMSE, MAPE, MSPE."""
    out = M.forecast_errors(pairs(spark, d), "obs", "an", ["channel"])
    digits = {"mae": 4, "mse": 2, "rmse": 4}
    return out.select("channel", *[F.round(c, digits.get(c, 6)).alias(c) for c in out.columns[1:]])


@query(f"WITH {PAIRS}, c AS (SELECT channel, station, obs, an, (obs - avg(obs) OVER w) * (an - avg(an) OVER w) AS uv FROM pairs WINDOW w AS (PARTITION BY channel, station)), s AS (SELECT channel, station, CASE WHEN sum(uv * uv) > 0 THEN sum(uv) / sqrt(sum(uv * uv)) END AS c FROM c GROUP BY channel, station), e AS (SELECT channel, sqrt(sum((obs - an) * (obs - an)) / (var_pop(obs) * count(obs))) AS rse FROM pairs GROUP BY channel) SELECT channel, {r('any_value(rse)', 'rse')}, {r('avg(c)', 'corr', 5)} FROM s JOIN e USING (channel) GROUP BY channel")
def m2_rse_corr(spark, d):
    """M2: relative squared error, and the mean normalised product over series."""
    p = pairs(spark, d)
    out = M.rse(p, "obs", "an", ["channel"]).join(M.corr_last_axis(p, "obs", "an", "day", "station", ["channel"]), "channel")
    return out.select("channel", F.round("rse", 6).alias("rse"), F.round("corr", 5).alias("corr"))


@query(f"WITH {PAIRS} SELECT channel, count(*) AS n, {r(f'avg(abs{_D})', 'mae', 4)}, {r(f'sqrt(avg({_D} * {_D}))', 'rmse', 4)} FROM pairs GROUP BY GROUPING SETS ((channel), ())")
def m3_with_total(spark, d):
    """M3: by variable and overall."""
    return rounded(M.errors_with_total(pairs(spark, d), "obs", "an", "channel"), 4)


@query(f"WITH {PAIRS} SELECT channel, {r(f'avg(abs{_D})', 'mae', 4)} FROM pairs WHERE (l_partkey * 10007 + l_orderkey) % 8 = 0 GROUP BY channel")
def m4_masked(spark, d):
    """M4: errors of hidden points."""
    p = pairs(spark, d)
    return rounded(M.masked_errors(p, "obs", "an", (F.col("l_partkey") * 10007 + F.col("l_orderkey")) % 8 == 0, ["channel"]).select("channel", "mae"), 4)


_M4 = """monthly AS (SELECT l_suppkey AS s, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS m, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2), last AS (SELECT max(m) - 6 AS cut FROM monthly),
 tr AS (SELECT * FROM monthly, last WHERE m <= cut), te AS (SELECT te.*, avg_ AS p, last_ AS b FROM (SELECT * FROM monthly, last WHERE m > cut) te JOIN (SELECT s, avg(y) AS avg_, arg_max(y, m) AS last_ FROM tr GROUP BY s) x USING (s)),
 sc AS (SELECT s, avg(abs(d)) AS scale FROM (SELECT s, y - lag(y, 12) OVER (PARTITION BY s ORDER BY m) AS d FROM tr) GROUP BY s),
 er AS (SELECT s, {cols} FROM te GROUP BY s)"""


def _m4_sql(p: str) -> str:
    return f"avg(200 * abs(y - {p}) / (abs(y) + abs({p}))) AS smape_{p}, avg(100 * abs(y - {p}) / abs(y)) AS mape_{p}, avg(abs(y - {p})) AS mae_{p}"


def _m4(spark, d):
    li = read(spark, d, "lineitem").withColumn("m", F.year("l_shipdate") * 12 + F.month("l_shipdate"))
    m = li.groupBy(F.col("l_suppkey").alias("s"), F.col("m").cast("long").alias("m")).agg(F.sum("l_extendedprice").alias("y"))
    last = m.agg((F.max("m") - 6).alias("cut"))
    m = m.crossJoin(F.broadcast(last))  # one row
    train = m.filter("m <= cut").select("s", "m", "y")
    model = train.groupBy("s").agg(F.avg("y").alias("p"), F.max_by("y", "m").alias("b"))
    return train, m.filter("m > cut").join(model, "s").select("s", "m", "y", "p", "b")


@query(f"WITH {_M4.format(cols=_m4_sql('p'))} SELECT s, {r('smape_p', 'smape', 5)}, {r('mape_p', 'mape', 4)}, {r('mae_p / scale', 'mase', 5)} FROM er LEFT JOIN sc USING (s)")
def m5_competition(spark, d):
    """M5: sMAPE, MAPE, MASE by series."""
    train, test = _m4(spark, d)
    out = M.competition_errors(test, ["s"], "m", "y", "p", train, 12)
    return out.select("s", F.round("smape", 5).alias("smape"), F.round("mape", 4).alias("mape"), F.round("mase", 5).alias("mase"))


@query(f"""WITH {_M4.format(cols=_m4_sql('p') + ', ' + _m4_sql('b'))}, g AS (SELECT s % 6 AS grp, avg(smape_p) AS sm, avg(mae_p / scale) AS ma, avg(smape_b) AS sb, avg(mae_b / scale) AS mb, count(*) AS n FROM er LEFT JOIN sc USING (s) GROUP BY s % 6),
 t AS (SELECT sum(sm * n) / sum(n) AS sm, sum(ma * n) / sum(n) AS ma, sum(sb * n) / sum(n) AS sb, sum(mb * n) / sum(n) AS mb, CAST(sum(n) AS BIGINT) AS n FROM g)
 SELECT CAST(grp AS VARCHAR) AS grp, {r('sm', 'smape', 4)}, {r('ma', 'mase', 4)}, {r('(sm / sb + ma / mb) / 2', 'owa', 4)}, n FROM g UNION ALL SELECT 'Average', {r('sm', 'smape', 4)}, {r('ma', 'mase', 4)}, {r('(sm / sb + ma / mb) / 2', 'owa', 4)}, n FROM t""")
def m6_owa(spark, d):
    """M6: against a baseline, by group and overall."""
    train, test = _m4(spark, d)
    e = lambda p: M.competition_errors(test, ["s"], "m", "y", p, train, 12).withColumn("grp", F.col("s") % 6)
    return rounded(M.owa(e("p"), e("b"), "grp"), 4)


_NAMES = "CASE s % 6 WHEN 0 THEN 'Yearly' WHEN 1 THEN 'Quarterly' WHEN 2 THEN 'Monthly' WHEN 3 THEN 'Weekly' WHEN 4 THEN 'Daily' ELSE 'Hourly' END"


@query(f"""WITH {_M4.format(cols=_m4_sql('p') + ', ' + _m4_sql('b'))}, g AS (SELECT CASE WHEN s % 6 < 3 THEN {_NAMES} ELSE 'Others' END AS grp, avg(smape_p) AS sm, avg(mae_p / scale) AS ma, avg(smape_b) AS sb, avg(mae_b / scale) AS mb, count(*) AS n FROM er LEFT JOIN sc USING (s) GROUP BY 1),
 t AS (SELECT * FROM g UNION ALL SELECT 'Average', sum(sm * n) / sum(n), sum(ma * n) / sum(n), sum(sb * n) / sum(n), sum(mb * n) / sum(n), CAST(sum(n) AS BIGINT) FROM g)
 SELECT grp, {r('sm', 'smape', 3)}, {r('ma', 'mase', 3)}, {r('(sm / sb + ma / mb) / 2', 'owa', 3)}, n FROM t""")
def m6_summary(spark, d):
    """M6: by named group, the rest together, and overall."""
    train, test = _m4(spark, d)
    name = F.element_at(F.array(*[F.lit(x) for x in ("Yearly", "Quarterly", "Monthly", "Weekly", "Daily", "Hourly")]), (F.col("s") % 6 + 1).cast("int"))
    e = lambda p: M.competition_errors(test, ["s"], "m", "y", p, train, 12).withColumn("grp", name)
    return M.competition_summary(e("p"), e("b"), "grp")


_RUNS = "runs AS (SELECT doc_id, CAST(toxic AS BIGINT) AS truth, CAST(n_chars AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id)), th AS (SELECT quantile_cont(score, 0.75) AS t FROM (SELECT score FROM runs WHERE doc_id % 2 = 0 UNION ALL SELECT score FROM runs WHERE doc_id % 2 = 1)), fl AS (SELECT doc_id, truth, CAST(score > t AS BIGINT) AS pred FROM runs, th WHERE doc_id % 2 = 1)"
_ADJ = "ad AS (SELECT *, sum(s) OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS run FROM (SELECT *, CASE WHEN truth <> lag(truth) OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) THEN 1 ELSE 0 END AS s FROM fl)), aj AS (SELECT doc_id, truth, pred, CASE WHEN truth = 1 THEN max(pred) OVER (PARTITION BY doc_id // 1000, run) ELSE pred END AS adjusted FROM ad)"


def _runs(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(read(spark, d, "labels"), "doc_id").select("doc_id", F.col("toxic").cast("long").alias("truth"), "score")
    return M.anomaly_flags(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"), "score", 25.0).withColumn("part", F.floor(F.col("doc_id") / 1000))


@query(f"WITH {_RUNS}, {_ADJ} SELECT doc_id, truth, pred, adjusted FROM aj")
def m7_m8_anomaly(spark, d):
    """M7, M8: threshold flags, and runs adjusted."""
    return M.point_adjust(_runs(spark, d), ["part"], "doc_id", "truth", "pred").select("doc_id", "truth", "pred", "adjusted")


@query(f"WITH {_RUNS}, {_ADJ}, c AS (SELECT count(*) FILTER (WHERE truth = 1 AND adjusted = 1) AS tp, count(*) FILTER (WHERE truth = 0 AND adjusted = 1) AS fp, count(*) FILTER (WHERE truth = 1 AND adjusted = 0) AS fn, avg(CAST(truth = adjusted AS DOUBLE)) AS acc FROM aj) SELECT {r('acc', 'accuracy')}, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')}, {r('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')}, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')} FROM c")
def m9_detection(spark, d):
    """M9: accuracy, precision, recall, F1."""
    return rounded(M.detection_scores(M.point_adjust(_runs(spark, d), ["part"], "doc_id", "truth", "pred"), "truth", "adjusted"))


@query(f"WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[])[1:10] AS x FROM embeddings), c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM v)) SELECT vec_id, list_position(x, list_max(x)) - 1 AS pred, code, {r('exp(list_max(x)) / (SELECT sum(exp(u)) FROM unnest(x) t(u))', 'top')} FROM v JOIN c USING (label)")
def m10_classification(spark, d):
    """Softmax, argmax, label codes."""
    x = _vecs(spark, d).select("vec_id", "label", F.slice("v", 1, 10).alias("x"))
    out = M.label_codes(x, "label").select("vec_id", M.argmax(F.col("x")).alias("pred"), "code", F.array_max(M.softmax(F.col("x"))).alias("top"))
    return rounded(out)


@query(f"WITH {LABELLED} SELECT vec_id, CAST(pos // 8 AS BIGINT) AS step, {r('avg(pow(x - x * 0.9, 2))', 'score', 8)} FROM labelled GROUP BY 1, 2")
def m11_reconstruction(spark, d):
    """Mean squared error over channels."""
    s = labelled_series(spark, d).withColumn("step", F.floor(F.col("pos") / 8)).withColumn("y", F.col("x") * 0.9)
    return rounded(M.reconstruction_score(s, ["vec_id", "step"], "x", "y"), 8)


def _draw(seed: int, *key: str) -> str:
    h = f"CAST({seed} AS BIGINT)"
    for k in [*key, str(seed)]:
        h = f"list_transform([(({h}) + CAST({k} AS BIGINT)) * 1103515245 + 12345], lambda h: ((h % 2147483647) * (h % 2147483647) + h % 2147483647 + 1) % 2147483647)[1]"
    return h


def _uniform(seed: int, *key: str) -> str:
    return f"(({_draw(seed, *key)}) + 0.5) / CAST(2147483647 AS DOUBLE)"


def _normal(seed: int, *key: str) -> str:
    return f"sqrt(-2 * ln({_uniform(seed, *key)})) * cos(2 * pi() * ({_uniform(seed + 7919, *key)}))"


_MOVED = K.channel_order(4, 3)


@query(f"""WITH {LABELLED}, a AS (SELECT *, pos % 4 AS ch, x + 0.03 * {_normal(1, 'vec_id', 'pos')} AS j FROM labelled),
 b AS (SELECT *, j * (1 + 0.1 * {_normal(2, 'vec_id', 'pos % 4')}) * CASE WHEN {_uniform(3, 'vec_id', 'pos % 4')} < 0.5 THEN -1 ELSE 1 END AS y FROM a)
 SELECT vec_id, CAST(label AS BIGINT) AS label, pos, {r(f"y * (1 + 0.2 * {_normal(6, 'vec_id')}) + 0.2 * {_normal(7, 'vec_id')} + 0.2 * {_normal(8, 'vec_id', 'pos')}", 'x')}, CAST([{', '.join(str(_MOVED.index(k)) for k in range(4))}][ch + 1] AS BIGINT) AS ch FROM b""")
def k1_k3_k13_noise(spark, d):
    """Jitter, scaling, rotation, and all three."""
    s = labelled_series(spark, d).withColumn("ch", F.col("pos") % 4)
    a = K.rotation(K.scaling(K.jitter(s, "vec_id", "pos", "x"), ["vec_id", "ch"], "x"), ["vec_id"], "ch", "x", 4)
    return rounded(K.scale_shift_jitter(a, "vec_id", "pos", "x"))


@query(f"""WITH {LABELLED}, s AS (SELECT *, ntile(5) OVER (PARTITION BY vec_id ORDER BY pos) AS seg FROM labelled), u AS (SELECT *, {_draw(4, 'vec_id', 'seg')} AS u FROM s)
 SELECT vec_id, CAST(label AS BIGINT) AS label, row_number() OVER (PARTITION BY vec_id ORDER BY u, seg, pos) - 1 AS pos, {r('x', 'x')} FROM u""")
def k4_permutation(spark, d):
    """K4: segments in a random order."""
    return rounded(K.permutation(labelled_series(spark, d), "vec_id", "pos", "x"))


@query()
def k5_magnitude_warp(spark, d):
    """K5: a smooth random factor."""
    return K.magnitude_warp(labelled_series(spark, d), "vec_id", "pos", "x")


@query()
def k6_time_warp(spark, d):
    """K6: smoothly moved positions."""
    return K.time_warp(labelled_series(spark, d), "vec_id", "pos", "x")


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(floor(({_uniform(5, 'vec_id')}) * 7) AS BIGINT) AS s FROM embeddings),
 cut AS (SELECT vec_id, v[s + 1 : s + 58] AS c, unnest(range(64)) AS pos FROM v), a AS (SELECT *, pos * 57 / CAST(63 AS DOUBLE) AS t, CAST(least(floor(pos * 57 / CAST(63 AS DOUBLE)), 56) AS BIGINT) AS k FROM cut)
 SELECT vec_id, pos, {r('c[k + 1] + (t - k) * (c[k + 2] - c[k + 1])', 'x')} FROM a""")
def k7_window_slice(spark, d):
    """K7: a window stretched back."""
    return rounded(K.window_slice(labelled_series(spark, d), "vec_id", "pos", "x", 64))


@query()
def k8_window_warp(spark, d):
    """K8: a window sped up or slowed down."""
    return K.window_warp(labelled_series(spark, d), "vec_id", "pos", "x")


@query()
def k9_spawner(spark, d):
    """K9: mean of two series of a class along their path."""
    return K.spawner(_vecs(spark, d), "vec_id", "label", "v")


@query()
def k10_weighted_dba(spark, d):
    """Weighted barycentres."""
    return K.weighted_dba(_vecs(spark, d), "vec_id", "label", "v")


@query()
def k11_guided_warp(spark, d):
    """A partner's time order."""
    return K.guided_warp(_vecs(spark, d), "vec_id", "label", "v")


@query()
def k12_discriminative_warp(spark, d):
    """The order of the partner that tells the classes apart, and a slice by warp."""
    return K.discriminative_warp(_vecs(spark, d), "vec_id", "label", "v", shape=True).select("vec_id", "v")


@query()
def k14_run_augmentation(spark, d):
    """The original and two copies through a chain of operations."""
    return K.run_augmentation(labelled_series(spark, d), "vec_id", "label", "pos", "x", 2, ["jitter", "scaling", "permutation", "windowslice", "dtwwarp"], 64)


@query(f"WITH {LABELLED}, h AS (SELECT *, ((vec_id * 10007 + pos) * 1103515245 + 8) % 2147483647 < CAST(floor(0.25 * 2147483647) AS BIGINT) AS hid FROM labelled) SELECT vec_id, pos, CASE WHEN hid THEN 0 ELSE 1 END AS mask, {r('CASE WHEN hid THEN 0 ELSE x END', 'hidden')} FROM h")
def k15_missing_mask(spark, d):
    """A share of the values hidden."""
    return rounded(K.missing_mask(labelled_series(spark, d), "vec_id", "pos", "x", 0.25).select("vec_id", "pos", "mask", "hidden"))


def _dtw_pairs(spark, d):
    """Each vector with the next of its class in a hashed ring: one pair a vector."""
    v = _vecs(spark, d)
    other = v.select(F.col("vec_id").alias("other"), F.col("v").alias("y"))
    pairs = K.partners(v, "vec_id", "label", 1).withColumnRenamed("partner", "other")
    return pairs.join(v.select("vec_id", "label", F.col("v").alias("x")), "vec_id").join(other, "other")


_RING = f"""ring AS (SELECT vec_id, label, v, row_number() OVER (PARTITION BY label ORDER BY u, vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, {_draw(1, 'vec_id')} AS u FROM embeddings)),
 pairs AS (SELECT a.vec_id, b.vec_id AS other, a.label, a.v AS x, b.v AS y FROM ring a JOIN ring b ON a.label IS NOT DISTINCT FROM b.label AND b.k = (a.k + 1) % a.n WHERE a.n > 1)"""


def _dtw(cost: str) -> str:
    """CTE dtw (vec_id, other, label, distance, steps) of pairs of 64 steps, row by row; ``cost`` of the steps i + 1 and j (1 to 64)."""
    inf = "CAST('inf' AS DOUBLE)"
    cell = "least(e[2], e[4], acc[-2])"
    steps = f"1 + CASE WHEN e[2] = {cell} THEN e[3] WHEN e[4] = {cell} THEN e[5] ELSE acc[-1] END"
    row = f"list_transform(range(1, 65), lambda j: [{cost}, d[2 * j - 1], d[2 * j], d[2 * j + 1], d[2 * j + 2]])"
    return f"""dp AS (SELECT vec_id, other, label, x, y, CAST(0 AS BIGINT) AS i, list_concat([CAST(0 AS DOUBLE), 0], list_transform(range(128), lambda k: CASE WHEN k % 2 = 0 THEN {inf} ELSE 0 END)) AS d FROM pairs
 UNION ALL SELECT vec_id, other, label, x, y, i + 1, list_reduce(list_prepend([{inf}, CAST(0 AS DOUBLE)], {row}), lambda acc, e: list_concat(acc, [e[1] + {cell}, {steps}])) FROM dp WHERE i < 64),
 dtw AS (SELECT vec_id, other, label, d[129] AS distance, CAST(d[130] AS BIGINT) AS steps FROM dp WHERE i = 64)"""


_SHAPE = "sqrt(" + " + ".join(f"pow(x[greatest(1, least(64, i + 1 + ({o})))] - y[greatest(1, least(64, j + ({o})))], 2)" for o in range(-3, 2)) + ")"


@query(f"WITH RECURSIVE {_RING}, {_dtw('CASE WHEN abs(i + 1 - j) <= 8 THEN abs(x[i + 1] - y[j]) ELSE ' + chr(39) + 'inf' + chr(39) + ' END')} SELECT vec_id, other, {r('distance', 'distance')}, steps FROM dtw")
def l1_pairwise_dtw(spark, d):
    """L1: warping distance in a band, with paths."""
    out = L.pairwise_dtw(_dtw_pairs(spark, d), ["vec_id", "other"], band=8)
    return out.select("vec_id", "other", F.round("distance", 6).alias("distance"), F.size("path").alias("steps"))


@query(f"WITH RECURSIVE {_RING}, {_dtw(_SHAPE)} SELECT vec_id, other, {r('distance', 'distance')} FROM dtw")
def l2_shape_dtw(spark, d):
    """L2: distance of shape descriptors."""
    return L.pairwise_dtw(_dtw_pairs(spark, d), ["vec_id", "other"], shape=True).select("vec_id", "other", F.round("distance", 6).alias("distance"))


@query(f"WITH RECURSIVE {_RING}, {_dtw('abs(x[i + 1] - y[j])')} SELECT CAST(label AS BIGINT) AS label, {r('avg(distance)', 'dtw')}, count(*) AS n FROM dtw GROUP BY label")
def l3_forecast_dtw(spark, d):
    """L3: mean warping error by class."""
    return rounded(L.mean_dtw(_dtw_pairs(spark, d), "vec_id", ["label"]))


_ADF = """a AS (SELECT var, hour, v - y1 AS d, y1 FROM (SELECT var, hour, v, lag(v) OVER (PARTITION BY var ORDER BY hour) AS y1 FROM series_hour) WHERE y1 IS NOT NULL),
 b AS (SELECT *, lag(d) OVER (PARTITION BY var ORDER BY hour) AS z FROM a),
 f AS (SELECT var, count(*) AS n0, covar_pop(y1, y1) * count(*) AS ya, covar_pop(y1, d) * count(*) AS da, covar_pop(d, d) * count(*) AS aa FROM b GROUP BY var),
 s AS (SELECT var, count(*) AS n, covar_pop(y1, y1) * count(*) AS yy, covar_pop(y1, z) * count(*) AS yz, covar_pop(z, z) * count(*) AS zz, covar_pop(y1, d) * count(*) AS yd, covar_pop(z, d) * count(*) AS zd, covar_pop(d, d) * count(*) AS dd FROM b WHERE z IS NOT NULL GROUP BY var),
 c AS (SELECT *, yy * zz - yz * yz AS det FROM s JOIN f USING (var)), e AS (SELECT *, (zz * yd - yz * zd) / det AS b1, (yy * zd - yz * yd) / det AS g, da / ya AS b0 FROM c),
 h AS (SELECT *, dd - b1 * yd - g * zd AS rss FROM e), k AS (SELECT *, n * ln(rss / n) + 6 < n * ln((dd - yd * yd / yy) / n) + 4 AS one FROM h)"""


@query(f"WITH {SERIES_HOUR}, {_ADF} SELECT var, CAST(one AS BIGINT) AS lag, CASE WHEN one THEN n ELSE n0 END AS n, {r('CASE WHEN one THEN b1 ELSE b0 END', 'coefficient')}, {r('CASE WHEN one THEN b1 / sqrt(rss / (n - 3) * zz / det) ELSE b0 / sqrt((aa - b0 * da) / ((n0 - 2) * ya)) END', 't', 5)} FROM k")
def l4_adf(spark, d):
    """L4: unit-root statistic by series."""
    out = L.adf_test(series_hour(spark, d), ["var"], "hour", "v")
    return out.select("var", "lag", "n", F.round("coefficient", 6).alias("coefficient"), F.round("t", 5).alias("t"))


@query(f"WITH {SERIES_HOUR}, {_ADF}, t AS (SELECT CASE WHEN one THEN b1 / sqrt(rss / (n - 3) * zz / det) ELSE b0 / sqrt((aa - b0 * da) / ((n0 - 2) * ya)) END AS t FROM k) SELECT {r('avg(t)', 'mean_t', 5)}, count(*) AS n FROM t")
def l4_mean_adf(spark, d):
    """L4: the mean statistic of all series."""
    return rounded(L.mean_adf(series_hour(spark, d), ["var"], "hour", "v"), 5)


@query()
def l5_linear_forecast(spark, d):
    """Trend and seasonal parts of each window mapped to the two steps after it, a map per channel."""
    w = make_windows(series_hour(spark, d), "var", "hour", "v", 12, 0, 2)
    # fitted on windows whose last value lies before the first that is to be forecast in the held-out ones
    cut = F.floor(0.8 * F.max("start").over(Window.partitionBy("var")))
    w = w.withColumn("held_out", F.col("start") > cut).withColumn("train_", F.col("start") + 2 <= cut + 1)
    _, out = L.linear_forecaster(w, F.col("train_"), 2, ["var"])
    return out.select("var", "start", "held_out", *[F.round(F.element_at("pred", k + 1), 4).alias(f"y{k}") for k in (0, 1)], *[F.round(F.element_at("y", k + 1), 4).alias(f"true{k}") for k in (0, 1)])


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) SELECT vec_id, round(list_avg(x) * 2 + 1, 6) AS pred FROM v")
def l6_score_windows(spark, d):
    """A user's model over assembled samples, scaled back."""
    out = L.score_windows(_vecs(spark, d), lambda x: np.mean(x, axis=1, keepdims=True), ["vec_id"], "v", mean=1.0, std=2.0)
    return rounded(out.select("vec_id", F.element_at("pred", 1).alias("pred")))


@query(f"WITH {PAIRS} SELECT count(*) AS n, {r('avg(abs(bg - obs) - abs(an - obs))', 'mean', 3)}, {r('avg(abs(bg - obs) - abs(an - obs)) * sqrt(count(*)) / stddev_samp(abs(bg - obs) - abs(an - obs))', 't', 4)} FROM pairs")
def l7_paired_t(spark, d):
    """Paired t of the gain."""
    gain = F.abs(F.col("bg") - F.col("obs")) - F.abs(F.col("an") - F.col("obs"))
    out = L.paired_t(pairs(spark, d), gain)
    return out.select("n", F.round("mean", 3).alias("mean"), F.round("t", 4).alias("t"))


@query()
def l7_bootstrap(spark, d):
    """Bootstrap interval of the daily mean gain."""
    gain = F.abs(F.col("bg") - F.col("obs")) - F.abs(F.col("an") - F.col("obs"))
    days = pairs(spark, d).groupBy("day").agg(F.avg(gain).alias("g"))
    return L.bootstrap_ci(days, F.col("day"), "g")
