"""Steps whose cost must not grow faster than the tables."""

import glob

import duckdb
import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from stationflow.functions import expr as X
from stationflow.operators import aggregates as A
from stationflow.operators import augment as K
from stationflow.operators import ordering as O
from stationflow.operators import quality as Q
from stationflow.operators import similarity as L
from stationflow.operators import spatial as E
from stationflow.plans import QUERIES, SQL


def test_heights_are_averaged_by_cell_not_by_point(spark):
    dem = spark.createDataFrame([(i, j, float(i * 10 + j * j)) for i in range(4) for j in range(5) if (i, j) != (2, 2)], "i long, j long, value double")
    pts = spark.createDataFrame([(1, 0.1, 0.1), (2, 2.0, 2.2), (3, 9.0, 9.0)], "id long, lat double, lon double")
    out = E.dem_mean_3x3(dem, pts, 0.0, 0.0, 1.0, 4, 5)
    z = {(r.i, r.j): r.value for r in dem.collect()}
    mean = lambda i, j: np.mean([z[p, q] for p in range(i - 1, i + 2) for q in range(j - 1, j + 2) if (p, q) in z])
    assert {r.id: (r.nearest, round(r["mean"], 9)) for r in out.collect()} == {1: (0.0, round(mean(0, 0), 9)), 2: (None, round(mean(2, 2), 9)), 3: (z[3, 4], round(mean(3, 4), 9))}
    assert "Hint=(strategy=broadcast)" in out._jdf.queryExecution().optimizedPlan().toString()  # the cells, never the points


def test_points_on_an_edge_keep_their_longitude(spark):
    ring = [(5.1, 0.0), (6.0, 0.0), (6.0, 1.0), (5.1, 1.0)]
    edges = spark.createDataFrame([("a", *p, *q) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)], "ring string, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 0.5, 5.1), (2, 0.5, 6.0), (3, 0.5, 365.5), (4, 0.5, 180.0)], "id long, lat double, lon double")
    assert (5.1 + 180) % 360 - 180 < 5.1  # wrapping it would put it out of the ring
    assert sorted(r.id for r in Q.points_in_polygons(pts, edges).collect()) == [1, 3]


def test_paths_of_a_slice_are_found_together(monkeypatch):
    calls = []
    monkeypatch.setattr(K, "_together", lambda *a: calls.append(len(a[0])) or L._together(*a))

    def f(x, y):
        (got,) = yield [(x, y, 2, False)]
        (_, path), (far, _) = yield [(x, y, 2, False), (y, x + 1, 2, True)]
        return got[0], len(path), far

    rng = np.random.default_rng(3)
    rows = [(rng.normal(size=12), rng.normal(size=12)) for _ in range(40)]
    out = K._answered([f(x, y) for x, y in rows])
    assert calls == [40, 40, 40]  # not one call a row
    for (x, y), (d, steps, far) in zip(rows, out, strict=True):
        want, path = L.dtw_path(x, y, band=2)
        assert abs(d - want) < 1e-12 and steps == len(path) and max(abs(i - j) for i, j in path) <= 2
        assert abs(far - L.dtw_paths(L.descriptors(y)[None], L.descriptors(x + 1)[None], band=2)[0][0]) < 1e-12


def test_nearest_of_crowds_and_copies_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    lon = np.concatenate([rng.normal(180.0, 0.02, 60), rng.uniform(-180, 180, 60), np.full(30, 12.5), rng.normal(179.0, 0.5, 50)])
    lat = np.concatenate([rng.normal(50.0, 0.02, 60), rng.choice([89.7, -89.8, 88.0], 60), np.full(30, 45.25), rng.normal(50.0, 0.5, 50)])
    place = [(i, float(a), float((b + 180) % 360 - 180), float(i % 7)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))]
    p = spark.createDataFrame(place, "id long, lat double, lon double, h double")
    a, b = np.radians(np.array([r[1] for r in place])), np.radians(np.array([r[2] for r in place]))
    km = 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(1, np.sin((a[None] - a[:, None]) / 2) ** 2 + np.cos(a[None]) * np.cos(a[:, None]) * np.sin((b[None] - b[:, None]) / 2) ** 2)))
    rows = E.radius_knn_join(p, p, 100.0, 4).collect()
    got = {(r.target, r["rank"]): r for r in rows}
    want = {t: sorted((round(km[t, q], 6), q) for q in range(len(place)) if km[t, q] <= 100.0) for t in range(len(place))}
    assert len(rows) == len(got) == sum(min(4, len(w)) for w in want.values())
    for (t, k), r in got.items():
        assert abs(r.distance_km - want[t][k - 1][0]) < 1e-5 and r.n_radius == len(want[t]) and r.height_difference_m == r.point % 7 - t % 7
    assert {(r.target, r.point) for r in rows if 120 <= r.target < 150} == {(t, q) for t in range(120, 150) for q in range(120, 124)}
    at = p.withColumn("day", F.explode(F.array(F.lit(1), F.lit(2)))).filter("day = 1 or id % 3 = 0")
    one = {(r.day, r.target): r.distance_km for r in E.nearest_within(at, at.filter("id % 2 = 0"), 100.0, time="day").collect()}
    near = lambda d, t: min((km[t, q] for q in range(0, len(place), 2) if (d == 1 or q % 3 == 0) and km[t, q] <= 100.0), default=None)
    expected = {(d, t): near(d, t) for d in (1, 2) for t in range(len(place)) if d == 1 or t % 3 == 0}
    assert one.keys() == {k for k, v in expected.items() if v is not None} and all(abs(v - expected[k]) < 1e-5 for k, v in one.items())
    shown = E.nearest_within(p, p, 100.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "far_" in shown  # candidates are bounded by the k-th distance, not by the radius alone


def test_frames_are_found_once_a_row_not_once_a_pair(spark):
    t = spark.createDataFrame([(40.0, 3.0, 10.0, 41.0, 4.0, 30.0)], "la double, lo double, h0 double, lat double, lon double, h double")
    both = t.select(X.enu("la", "lo", "h0", "lat", "lon", "h").alias("a"), X.enu_frame("la", "lo", "h0").alias("f"), X.ecef("lat", "lon", "h").alias("p"), "h")
    r = both.select("a", X.enu_in("f", "p", "h").alias("b")).first()
    assert r.a == r.b and r.a.up_m == 20.0
    plan = QUERIES["d6_enu"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "SIN" in plan.split("Join")[1] and "SIN" not in plan.split("Join")[0]


def test_pairs_of_frames_are_written_in_few_bytes(spark, tmp_path):
    keys = [(j + 14880 * i,) for i in range(20) for j in range(2000)]  # 20 targets of each longitude, far from each other in the table
    spark.createDataFrame([*keys, keys[7], (None,)], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([*[(k,) for k in range(600) if k % 3 == 0], (30,), (None,)], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    QUERIES["d6_enu"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    duck = duckdb.connect()
    for t in ("customer", "supplier"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    by = ["target", "point"]
    got, want = duck.execute(f"SELECT * FROM '{tmp_path}/out/*.parquet'").df().sort_values(by), duck.execute(SQL["d6_enu"]).df().sort_values(by)
    assert len(got) == len(want) > 800_000
    for name in want.columns:
        assert np.abs(got[name].to_numpy() - want[name].to_numpy()).max() < 2e-6
    size = dict.fromkeys(want.columns, 0)
    for f in glob.glob(f"{tmp_path}/out/*.parquet"):
        m = pq.ParquetFile(f).metadata
        for g in range(m.num_row_groups):
            for k in range(m.num_columns):
                column = m.row_group(g).column(k)
                size[column.path_in_schema] += column.total_compressed_size
    assert sum(size.values()) < 11 * len(got) and size["east_km"] < 2 * len(got)  # north has a value of its own for each pair, 8 bytes


def test_blocks_hold_each_row_once_and_no_other_group(spark):
    rows = [(g, float(i % 5), i) for g, n in ((1, 2500), (2, 3), (None, 2)) for i in range(n)] + [(2, 0.0, 0)]
    df = spark.createDataFrame(rows, "g long, v double, i long")
    out = O.row_blocks(df, ["g"], ["v"], 100, "rows").collect()
    assert sorted(((r.g, x.v, x.i) for r in out for x in r.rows), key=repr) == sorted(rows, key=repr)
    assert max(len(r.rows) for r in out) <= 100 and len({(r.g, r.rows_at) for r in out}) == len(out) < 40
    assert all([x.v for x in r.rows] == sorted(x.v for x in r.rows) for r in out)
    one = sorted((r for r in out if r.g == 1), key=lambda r: r.rows_at)
    assert all(a.rows[-1].v <= b.rows[0].v for a, b in zip(one, one[1:], strict=False))


def test_rounding_is_that_of_sql(spark):
    tie = [(k + 0.5) / 1e6 for k in range(10**9, 10**9 + 4000)]
    tie = [y for x in tie for y in (x, float(np.nextafter(x, 0)), float(np.nextafter(x, 1e9)))]
    x = [*tie, *[-y for y in tie], 0.0, -0.0, 1e-9, -1e-9, 5e-7, -5e-7, 0.1234565, 1e15, 1e300, -1e300, 7.25, None]
    df = spark.createDataFrame(list(enumerate(x)), "i long, x double")
    got = [r[0] for r in df.orderBy("i").select(X.round_half_up("x", 6)).collect()]
    want = [r[0] for r in duckdb.execute("SELECT round(v, 6) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [x]).fetchall()]
    assert got == want
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),)], "x double").select(X.round_half_up("x", 6)).collect()
    assert [str(r[0]) for r in odd] == ["nan", "inf", "-inf"]
    assert [r[0] for r in df.orderBy("i").select(F.round("x", 6)).collect()] != want  # decimal digits of a double next to a tie say otherwise


def test_quantiles_are_exact_without_a_task_that_holds_a_group(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(x)) for g, n in ((0, 4000), (1, 7), (2, 1)) for x in np.round(rng.normal(size=n), 2)] + [(None, 1.0), (None, 2.0), (3, None), (4, float("nan")), (4, 1.0), (4, 2.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    at = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.99, "e": 1.0}
    want = {r.g: tuple(map(str, r[1:])) for r in df.groupBy("g").agg(*[F.percentile("v", q).alias(n) for n, q in at.items()]).collect()}
    for whole in (1000, 100_000):
        out = A.quantiles(df, ["g"], "v", at, whole=whole)
        assert {r.g: tuple(map(str, r[1:])) for r in out.collect()} == want
        assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
