import numpy as np
import pytest
from pyspark.sql import functions as F

from stationflow.operators import augment as K
from stationflow.operators import metrics as M
from stationflow.operators import ordering as O
from stationflow.operators import similarity as L
from stationflow.operators import spatial as E
from stationflow.operators import transforms as X
from stationflow.operators import windows as G


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(k, k % 2, p, float(v)) for k in range(6) for p, v in enumerate(rng.normal(size=32))], "vec_id long, label long, pos long, x double").repartition(3)


def arrays(series):
    return series.groupBy("vec_id", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


def test_bilinear_of_a_plane_is_the_plane(spark):
    field = spark.range(100).selectExpr("id div 10 as i", "id % 10 as j", "cast(2 * (id div 10) - 3 * (id % 10) as double) as value")
    pts = spark.createDataFrame([(1, 2.25, 3.75), (2, 0.0, 0.0), (3, 9.0, 9.0)], "id long, lat double, lon double")
    got = {r.id: r.value for r in E.bilinear_sample(field, E.corners(pts, 0.0, 0.0, 1.0, 10, 10).select("id", "i", "j", "w"), ["id"]).collect()}
    assert got == {1: 2 * 2.25 - 3 * 3.75, 2: 0.0, 3: -9.0}


def test_radius_join_across_the_date_line_and_poles(spark):
    rng = np.random.default_rng(1)
    place = [(i, float(a), float(b), 0.0) for i, (a, b) in enumerate(zip(rng.uniform(-89, 89, 150), rng.choice([179.5, -179.5, 0.0, 120.0], 150) + rng.uniform(-1, 1, 150), strict=True))]
    t = spark.createDataFrame(place, "id long, lat double, lon double, h double")
    got = {(r.target, r.point) for r in E.radius_join(t, t, 400.0, salt=3).collect()}

    def km(a, b):
        p, q = np.radians(a[1]), np.radians(b[1])
        s = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0088 * np.arcsin(min(1.0, np.sqrt(s)))

    rows = E.radius_join(t, t, 400.0).count()
    want = {(a[0], b[0]) for a in place for b in place if km(a, b) <= 400.0}
    assert got == want and rows == len(want)


def test_parts_add_up(series):
    t = X.trend_seasonal(series, ["vec_id"], "pos", "x", [5]).withColumn("d", F.abs(F.col("trend") + F.col("seasonal") - F.col("x")))
    d = X.dft_decompose(series, "vec_id", "pos", "x", 20).withColumn("d", F.abs(F.col("trend") + F.col("season") - F.col("x")))
    n = G.instance_norm(series, ["vec_id"], "x").withColumn("d", F.abs(F.col("normed") * F.col("std") + F.col("mean") - F.col("x")))
    for df in (t, d, n):
        assert df.agg(F.max("d")).first()[0] < 1e-9
    w = X.wavelet_decompose(series, "vec_id", "pos", "x", 3)
    energy = lambda df, c: df.agg(F.sum(F.col(c) * F.col(c))).first()[0]
    assert abs(energy(w, "v") - energy(series, "x")) < 1e-9


def test_adjustment_never_lowers_recall(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(0, i, int(a), int(b)) for i, (a, b) in enumerate(zip(rng.random(200) < 0.3, rng.random(200) < 0.2, strict=True))], "k long, i long, t long, p long")
    a = M.point_adjust(df, ["k"], "i", "t", "p")
    assert M.detection_scores(a, "t", "adjusted").first().recall >= M.detection_scores(a, "t", "p").first().recall


def test_warping(spark):
    x = np.array([0.0, 1.0, 2.0, 1.0])
    assert L.dtw_path(x, x)[0] == 0 and L.dtw_path(x, x)[1] == [(i, i) for i in range(4)]
    assert L.dtw_path(np.array([0.0, 0.0, 1.0]), np.array([0.0, 1.0]))[0] == 0
    assert L.dtw_path(np.array([0.0, 3.0]), np.array([1.0, 1.0]))[0] == 3.0
    assert L.dtw_path(x, x[::-1], band=0)[0] == np.abs(x - x[::-1]).sum()
    assert L.descriptors(x).tolist()[0] == [0, 0, 0, 0, 1] and L.descriptors(x).shape == (4, 5)


def slow_warp(x, y, slope, band, cost):
    """Distance and path by the definition, cell by cell."""
    moves = [(1, 1), (1, 0), (0, 1)] if slope == "symmetric" else [(1, 0), (1, 1), (1, 2)]
    total = {(-1, -1): (0.0, None)}
    for i in range(len(x)):
        for j in range(len(y)):
            if band is None or abs(i - j) <= band:
                at, best = None, np.inf
                for a, b in moves:
                    if total.get((i - a, j - b), (np.inf,))[0] < best:
                        at, best = (i - a, j - b), total[i - a, j - b][0]
                total[i, j] = (best + cost(x[i], y[j]), at)
    path, at = [], (len(x) - 1, len(y) - 1)
    while at in total and at != (-1, -1) and at is not None:
        path.append(at)
        at = total[at][1]
    return total[len(x) - 1, len(y) - 1][0], path[::-1]


@pytest.mark.parametrize("slope,band,shape", [("symmetric", None, False), ("symmetric", 3, False), ("asymmetric", None, False), ("symmetric", None, True)])
def test_warping_equals_the_definition(slope, band, shape):
    rng = np.random.default_rng(5)
    x, y = [rng.integers(0, 4, 12).astype(float) for _ in range(7)], [rng.integers(0, 4, 12).astype(float) for _ in range(7)]
    for a, b, (d, path) in zip(x, y, L._together(x, y, slope, band, shape), strict=True):
        u, v = (L.descriptors(a), L.descriptors(b)) if shape else (a[:, None], b[:, None])
        want, way = slow_warp(u, v, slope, band, lambda p, q: float(np.sqrt(((p - q) ** 2).sum())))
        assert abs(d - want) < 1e-9 and [tuple(p) for p in path.tolist()] == way
    assert L.warping_error(x[0], y[0]) == pytest.approx(slow_warp(x[0], y[0], "symmetric", None, lambda p, q: abs(p - q))[0])
    assert L.warping_error(x[0], y[0], w=2) == pytest.approx(slow_warp(x[0], y[0], "symmetric", 2, lambda p, q: abs(p - q))[0])
    assert L.warping_error(x[0], x[0], warp=2, s=1.5) == 0

    def by_cells(x, y, warp, w, s):
        r, c = len(x), len(y)
        d = np.full((r + 1, c + 1), np.inf)
        i, j = np.indices((r, c))
        d[1:, 1:] = np.where(np.abs(i - j) <= w, np.abs(np.subtract.outer(x, y)), np.inf)
        d[0, 0] = 0
        for i in range(r):
            for j in range(c):
                d[i + 1, j + 1] += min(d[i, j], *(s * d[min(i + k, r), j] for k in range(1, warp + 1)), *(s * d[i, min(j + k, c)] for k in range(1, warp + 1)))
        return d[r, c]

    for warp, w, factor in ((1, np.inf, 1.3), (2, np.inf, 1.0), (3, 5, 1.1), (4, 2, 0.5)):
        for a, b in ((x[0], y[0]), (x[0][:9], y[0]), (x[0], y[0][:1])):
            assert L.warping_error(a, b, warp, w, factor) == pytest.approx(by_cells(a, b, warp, w, factor))
    assert L._together([np.zeros(0), np.zeros(2)], [np.zeros(0), np.zeros(0)], slope, band, shape)[1][0] == np.inf


def test_linear_forecast_per_channel(spark):
    rng = np.random.default_rng(6)
    rows = [(c, k, [float(v) for v in x], [float(x[-1] * (c + 1)), float(x.mean() - c)], k < 60) for c in range(2) for k, x in enumerate(rng.normal(size=(80, 8)))]
    df = spark.createDataFrame(rows, "c long, k long, x array<double>, y array<double>, train boolean")
    for by in (["c"], None):
        coefs, out = L.linear_forecaster(df, F.col("train"), 2, by, kernel=3, ridge=1e-6)
        assert coefs.count() == (2 if by else 1)
        got = {(r.c, r.k): r.pred for r in out.collect()}
        for c in range(2):
            part = [r for r in rows if r[4] and (not by or r[0] == c)]
            a = np.array([[*r[2], 1.0] for r in part])  # trend and seasonal parts span the same maps as x
            fit = np.linalg.lstsq(a, np.array([r[3] for r in part]), rcond=None)[0]
            for r in rows:
                if r[0] == c:
                    assert np.allclose(got[c, r[1]], np.array([*r[2], 1.0]) @ fit, atol=1e-3)
        if by:  # held out: the map is exact per channel
            assert max(abs(got[r[0], r[1]][0] - r[3][0]) for r in rows if not r[4]) < 1e-3
    t = np.array(df.select(L.decompose_window(F.col("x"), 4)["trend"].alias("t")).first().t)
    x = np.array(rows[0][2])
    assert np.allclose(t, [np.pad(x, (1, 2), mode="edge")[k : k + 4].mean() for k in range(8)])
    changed = df.withColumn("y", F.array(F.lit(9.0), F.lit(9.0)))  # nothing of y gets into the input
    assert df.select(L.decompose_window(F.col("x"), 3)).collect() == changed.select(L.decompose_window(F.col("x"), 3)).collect()


def test_augmentation_keeps_shape_and_is_reproducible(series):
    for f in (K.jitter, K.permutation, K.magnitude_warp, K.time_warp, K.window_warp, K.scale_shift_jitter):
        one = {(r.vec_id, r.pos): r.x for r in f(series, "vec_id", "pos", "x").collect()}
        two = {(r.vec_id, r.pos): r.x for r in f(series.repartition(5), "vec_id", "pos", "x").collect()}
        assert one == two and len(one) == 6 * 32
    kept = {(r.vec_id, round(r.x, 9)) for r in K.permutation(series, "vec_id", "pos", "x").collect()}
    assert kept == {(r.vec_id, round(r.x, 9)) for r in series.collect()}
    v = arrays(series)
    for p in K.partners(v, "vec_id", "label", 1).collect():
        assert p.partner != p.vec_id and p.partner % 2 == p.vec_id % 2
    for p in K.strangers(v, "vec_id", "label", 1, 3).collect():
        assert p.partner % 2 != p.vec_id % 2
    alone = v.withColumn("label", F.col("vec_id"))
    for f in (K.spawner, K.guided_warp, K.discriminative_warp, K.weighted_dba):
        one = {r.vec_id: r.v for r in f(v, "vec_id", "label", "v").collect()}
        assert len(one) == 6 and all(len(x) == 32 for x in one.values())
        assert one == {r.vec_id: r.v for r in f(v.repartition(5), "vec_id", "label", "v").collect()}
        assert f(alone, "vec_id", "label", "v").count() == 6


def test_members_are_numbered_without_gaps(spark):
    df = spark.range(3000).withColumn("label", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 2990, "b"))
    got = K.members(df, "id", "label", 1, buckets=16)
    for r in got.groupBy("label").agg(F.collect_set("i").alias("i"), F.max("n").alias("n")).collect():
        assert sorted(r.i) == list(range(r.n))
    assert got.count() == 3000
    picks = K.partners(df, "id", "label", 1, 0, 5)
    assert picks.groupBy("id").count().filter("count <> 6").count() == 0 and picks.filter("id = partner").count() == 3000


def test_barycentre_and_teacher_equal_the_definition(spark, series):
    v = arrays(series)
    x = {r.vec_id: np.array(r.v) for r in v.collect()}
    cost = lambda p, q: float(abs(p - q))
    warp = lambda a, b: slow_warp(a, b, "symmetric", 4, cost)
    groups, same, other = {}, {}, {}
    for found, picks in ((groups, K.partners(v, "vec_id", "label", 15, 0, 5)), (same, K.partners(v, "vec_id", "label", 16, 1, 3)), (other, K.strangers(v, "vec_id", "label", 16, 3))):
        for r in picks.collect():
            found.setdefault(r.vec_id, []).append(r.partner)
    for r in K.weighted_dba(v, "vec_id", "label", "v").collect():
        ids = sorted(groups[r.vec_id])
        dist = [[warp(x[a], x[b])[0] if a != b else 0.0 for b in ids] for a in ids]
        medoid = min(range(len(ids)), key=lambda k: sum(dist[k]))
        near = sorted(dist[medoid])[1]
        total, weight = [0.0] * 32, [0.0] * 32
        for k, i in enumerate(ids):
            step = dict(warp(x[ids[medoid]], x[i])[1])  # of several steps the last
            for p, q in step.items():
                u = 1.0 if k == medoid else 0.5 ** (dist[medoid][k] / near)
                total[p] += u * x[i][q]
                weight[p] += u
        assert np.allclose(r.v, np.array(total) / weight)
    for r in K.discriminative_warp(v, "vec_id", "label", "v", slices=False).collect():
        a, b = sorted(same[r.vec_id]), sorted(other[r.vec_id])
        gain = [np.mean([warp(x[p], x[q])[0] for q in b]) - sum(warp(x[p], x[q])[0] for q in a if q != p) / max(len(a) - 1, 1) for p in a]
        teacher = x[a[int(np.argmax(gain))]]
        order = np.array([j for _, j in warp(teacher, x[r.vec_id])[1]])
        at = np.linspace(0, 31, len(order))
        assert np.allclose(r.v, np.interp(range(32), at, x[r.vec_id][order]))
        assert r.warp == pytest.approx(np.abs(np.arange(32) - np.interp(range(32), at, order)).sum())


def test_chain_of_augmentation(series):
    out = K.run_augmentation(series, "vec_id", "label", "pos", "x", 2, ["dtwwarp", "jitter", "windowslice", "wdba"], 32)
    assert out.groupBy("round", "vec_id").count().filter("count <> 32").count() == 0 and out.select("round").distinct().count() == 3
    assert out.filter("round = 0").select("vec_id", "label", "pos", "x").exceptAll(series.select("vec_id", "label", "pos", "x")).count() == 0
    by_hand = K.weighted_dba(K.as_arrays(series, ["vec_id", "label"], "pos", "x"), "vec_id", "label", "v", seed=10000)
    one = K.augment(series, "vec_id", "label", "pos", "x", ["wdba"], 32, seed=10)
    assert {(r.vec_id, r.pos): r.x for r in one.collect()} == {(r.vec_id, k): y for r in by_hand.collect() for k, y in enumerate(r.v)}
    with pytest.raises(ValueError):
        K.augment(series, "vec_id", "label", "pos", "x", ["none"], 32)


def test_unit_root(spark):
    rng = np.random.default_rng(3)
    walk, noise = np.cumsum(rng.normal(size=400)), rng.normal(size=400)
    df = spark.createDataFrame([(n, i, float(v)) for n, x in (("walk", walk), ("noise", noise)) for i, v in enumerate(x)], "s string, i long, v double")
    t = {r.s: r.t for r in L.adf_test(df, ["s"], "i", "v").collect()}
    assert t["noise"] < -10 < t["walk"]
    lag = {r.s: r.lag for r in L.adf_test(df, ["s"], "i", "v").collect()}
    for name, x in (("walk", walk), ("noise", noise)):
        d = np.diff(x)
        if lag[name]:
            a, e = np.stack([np.ones(398), x[1:-1], d[:-1]], 1), d[1:]
        else:
            a, e = np.stack([np.ones(399), x[:-1]], 1), d
        b, res, *_ = np.linalg.lstsq(a, e, rcond=None)
        se = np.sqrt(res[0] / (len(e) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
        assert abs(t[name] - b[1] / se) < 1e-6


def test_random_segments_and_modes(spark, series):
    got = K.permutation(series, "vec_id", "pos", "x", equal=False)
    assert {(r.vec_id, round(r.x, 9)) for r in got.collect()} == {(r.vec_id, round(r.x, 9)) for r in series.collect()}
    spec = X.spectrum(series, "vec_id", "pos", "x")
    assert [r.freq for r in X.choose_modes(spec, 3).collect()] == [0, 1, 2]
    assert X.choose_modes(spec, 5, "random", 3).count() == 5


def test_stable_ids_past_five_digits(spark):
    got = O.stable_ids(spark.range(1, 100_021), ["id"], "name", "st_")
    assert got.select("name").distinct().count() == 100_020
    assert {r.id: r.name for r in got.filter("id in (1, 99999, 100000, 100019)").collect()} == {1: "st_00001", 99999: "st_99999", 100000: "st_100000", 100019: "st_100019"}


def test_long_lags_by_the_spectrum(series):
    native = {(r.vec_id, r.lag): r.r for r in X.autocorrelation(series, "vec_id", "pos", "x", 32).collect()}
    fast = {(r.vec_id, r.lag): r.r for r in X.autocorrelation(series, "vec_id", "pos", "x", 32, short=0).collect()}
    assert native.keys() == fast.keys() and all(abs(native[k] - fast[k]) < 1e-9 for k in native)


def test_metadata_without_a_station_is_an_error(spark):
    rows, stations = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, 5.0)], "id long, h double")
    assert E.attach_metadata(rows, stations, "id").count() == 2
    assert E.attach_metadata(rows.filter("id = 1"), stations, "id", strict=True).first().h == 5.0
    with pytest.raises(Exception, match="no station for id 2"):
        E.attach_metadata(rows, stations, "id", strict=True).collect()


def test_crowded_cells_are_salted(spark):
    p = spark.range(300).select("id", F.lit(40.0).alias("lat"), (F.col("id") / 1e6).alias("lon"), F.lit(0.0).alias("h"))
    assert E.crowding_salt(p, 50.0, rows=100) == 3 and E.crowding_salt(p.limit(0), 50.0) == 1
    one, two = (sorted((r.target, r.point, r["rank"]) for r in E.radius_knn_join(p.limit(20), p, 50.0, 4, salt).collect()) for salt in (1, 3))
    assert one == two


def test_channels_move_along_one_path(spark, series):
    arrays = K.as_arrays(series, ["vec_id", "label"], "pos", "x")
    twice = arrays.select("vec_id", "label", F.transform("v", lambda x: F.array(x, x)).alias("v"))
    other = arrays.select("vec_id", "label", F.transform("v", lambda x, i: F.array(x, F.sin(i.cast("double")))).alias("v"))
    for warp in (lambda a: K.guided_warp(a, "vec_id", "label", "v"), lambda a: K.guided_warp(a, "vec_id", "label", "v", shape=True), lambda a: K.discriminative_warp(a, "vec_id", "label", "v"), lambda a: K.weighted_dba(a, "vec_id", "label", "v"), lambda a: K.spawner(a, "vec_id", "label", "v", sigma=0.0)):
        one = {r.vec_id: np.array(r.v) for r in warp(arrays).collect()}
        two = {r.vec_id: np.array(r.v) for r in warp(twice).collect()}
        assert one.keys() == two.keys() and all(np.allclose(two[k], np.stack([one[k], one[k]], 1)) for k in one)  # equal channels have the path of one
        assert all(np.shape(r.v) == (32, 2) for r in warp(other).collect())
    x = spark.createDataFrame([(1, [[0.0, 0.0], [3.0, 4.0]], [[0.0, 0.0], [0.0, 0.0]])], "k long, x array<array<double>>, y array<array<double>>")
    assert L.pairwise_dtw(x, ["k"]).first().distance == 5.0
