import gzip
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationflow.sources import station_files as A

TROPO = """+SITE/ID
*CODE LON LAT H
 {site} A 10 30 36.0 -45 15 0.0 321.5
-SITE/ID
+TROP/SOLUTION
*SITE EPOCH TROTOT SIG TRWET
 {site} 24:001:00000 2400.5 1.0 100.5
 {site} 24:001:00300 2401.5 1.0 101.5
 {site} 24:001:03600 {late} 1.0 102.5
 bad line
-TROP/SOLUTION
"""


def archive(path, site, late):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr(f"{site}.tro.gz", gzip.compress(TROPO.format(site=site, late=late).encode()))
        z.writestr("broken.gz", b"not gzip")
    path.write_bytes(box.getvalue())


def test_archives(spark, tmp_path):
    archive(tmp_path / "a1.zip", "abcd", 2402.5)
    archive(tmp_path / "a2.zip", "abcd", 2409.5)
    (tmp_path / "junk.zip").write_bytes(b"nothing")
    get = lambda closed: {(r.station_id, str(r.ts)): (r.total, r.wet) for r in A.ingest_station_archives(spark, str(tmp_path), 3600, "2024-01-01", "2024-01-01 01:00:00", closed).collect()}
    assert get(True) == {("ABCD", "2024-01-01 00:00:00"): (2400.5, 100.5), ("ABCD", "2024-01-01 01:00:00"): (2409.5, 102.5)}
    assert len(get(False)) == 1


def test_catalog(spark, tmp_path):
    archive(tmp_path / "a1.zip", "abcd", 1.0)
    ids = spark.createDataFrame([("ABCD",), ("NONE",)], "station_id string")
    got = {r.station_id: r for r in A.ingest_station_catalog(spark, str(tmp_path), ids).collect()}
    assert abs(got["ABCD"].lon - 10.51) < 1e-9 and abs(got["ABCD"].lat + 45.25) < 1e-9 and got["ABCD"].height_m == 321.5
    assert got["NONE"].lat is None


def test_report_files(spark, tmp_path):
    for hour in ("2024010100", "2024010101", "2024010103"):
        spark.range(2).selectExpr("cast(id as double) as p").write.parquet(str(tmp_path / f"surf_{hour}"))
    hours = A.file_hour(F.col("x"))
    got = spark.createDataFrame([("f/surf_2024010103",), ("f/other",)], "x string").select(hours.alias("ts"))
    assert [str(r.ts) for r in got.collect()] == ["2024-01-01 03:00:00", "None"]
    reports = spark.createDataFrame([("a/surf_2024010100",), ("a/surf_2024010103",)], "x string").select(hours.alias("ts"))
    assert A.missing_hours(reports).count() == 2
    spark.sql("select double('NaN') as p").write.parquet(str(tmp_path / "surf_2024010105"))
    read = A.scan_report_files(spark, str(tmp_path / "surf_*"), "p double")
    assert read.count() == 7 and read.filter("p is null").select(F.date_format("ts", "HH").alias("h")).first().h == "05" and read.filter("isnan(p)").count() == 0
    assert [F"{r.ts:%H}" for r in A.missing_hours(read).orderBy("ts").collect()] == ["02", "04"]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1.0, 2.0, 3.0), ("2024-01-02", 4.0, None, 6.0)], "date string, b double, target double, a double")
    df.write.csv(str(tmp_path / "w"), header=True)
    wide = A.scan_wide_csv(spark, str(tmp_path / "w"), "date string, b double, target double, a double", "target")
    assert wide.columns == ["date", "b", "a", "target"]
    assert A.scan_wide_csv(spark, str(tmp_path / "w"), "date string, b double, target double, a double", "target", "S").columns == ["date", "target"]
    lab = A.scan_labelled_csv(spark, str(tmp_path / "w"), "date string, b double, target double, a double", label_last=True)
    assert lab.columns == ["b", "target", "label"] and lab.filter("target = 0").count() == 1
    A.write_table(df, str(tmp_path / "t"), ["date"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    A.write_metric_csv(df, str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("part-*.csv"))) == 1
    A.write_run_metadata(df, str(tmp_path / "j"), {"rule": "x"})
    assert spark.read.json(str(tmp_path / "j")).first().rows == 2
    A.write_predictions(df.selectExpr("b as pred", "a as true"), str(tmp_path / "p"), 1.0, 2.0)
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["pred", "true", "pred_norm", "true_norm"]


def test_checked_scan(spark, tmp_path):
    spark.createDataFrame([(1, 2.0), (1, 3.0)], "k long, v double").write.parquet(str(tmp_path / "d"))
    with pytest.raises(ValueError, match="missing"):
        A.scan_checked(spark, str(tmp_path / "d"), ["z"], ["k"])
    with pytest.raises(ValueError, match="duplicate"):
        A.scan_checked(spark, str(tmp_path / "d"), ["v"], ["k"])


def test_resume(spark, tmp_path):
    built = []

    def build(rest):
        built.append(rest.count())
        return rest.withColumn("v", F.col("k") * 2)

    todo, out = spark.range(4).withColumnRenamed("id", "k"), str(tmp_path / "r")
    A.resume_build(spark, build, todo.filter("k < 2"), ["k"], out)
    A.resume_build(spark, build, todo, ["k"], out)
    assert built == [2, 2] and spark.read.parquet(out).count() == 4
    A.resume_build(spark, build, todo, ["k"], out, force=True)
    assert built[-1] == 4

    axes = {"start": "2024", "stations": "a,b"}
    other = str(tmp_path / "s")
    A.resume_build(spark, build, todo.filter("k < 3"), ["k"], other, axes=axes)
    with pytest.raises(ValueError, match="differ"):
        A.resume_build(spark, build, todo, ["k"], other, axes=axes | {"start": "2023"})
    with pytest.raises(ValueError, match="no axes"):
        A.resume_build(spark, build, todo, ["k"], out, axes=axes)
    A.resume_build(spark, build, todo, ["k"], other, axes=axes)
    assert built[-1] == 1 and spark.read.parquet(other).count() == 4
    A.resume_build(spark, build, todo.filter("k < 1"), ["k"], other, force=True, axes=axes | {"start": "2023"})
    assert spark.read.parquet(other).count() == 1
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith((".", "_SUCCESS"))) == ["k=0"]


def test_nan_is_null_from_the_scans_on(spark, tmp_path):
    df = spark.sql("select 1L as k, double('NaN') as v, float('NaN') as w union all select 2L, 3.0, float(1)")
    df.write.parquet(str(tmp_path / "d"))
    df.write.csv(str(tmp_path / "c"), header=True)
    for got in (A.scan_checked(spark, str(tmp_path / "d"), ["v"], ["k"]), A.scan_wide_csv(spark, str(tmp_path / "c"), "date string, v double, w double", "w")):
        assert got.filter("v is null").count() == 1 and got.filter("w is null").count() == 1
    assert A.scan_labelled_csv(spark, str(tmp_path / "c"), "k long, v double, w double").filter("v = 0 and w = 0").count() == 1
    assert A.explode_nested(spark.sql("select 1 as k, array(double('NaN'), 1.0) as a"), ["k"], "a").filter("value is null").count() == 1


def test_incomplete_where_a_value_is_nan(spark):
    from stationflow.operators import timegrid, windows

    df = spark.createDataFrame([("s", d, v) for d, v in enumerate([1.0, 2.0, float("nan"), 4.0, 5.0, 6.0, float("inf"), None])], "station string, day long, v double")
    got = windows.complete_window(df, ["station"], "day", "v", 3)
    assert [r.complete for r in got.orderBy("day").collect()] == [False, False, False, False, False, True, False, False]
    frames = windows.step_frames(df, df.select("station", "day"), ["station"], "day", "v", 3)
    assert {r.day: (r.frames, r.n) for r in frames.collect()}[4] == ([None, 4.0, 5.0], 2)
    with pytest.raises(ValueError, match="no data"):
        timegrid.clamp_window(df.limit(0), "day", 0, 5)


def brute_frames(rows, width):
    """(station, step) -> the largest finite value of each of the last steps."""
    best = {}
    for s, d, v in rows:
        if v is not None and np.isfinite(v):
            best[s, d] = max(v, best.get((s, d), v))
    return {(s, d): [best.get((s, x)) for x in range(d - width + 1, d + 1)] for s, d, _ in rows}


@pytest.mark.parametrize("width", [1, 3, 288])
def test_long_windows_with_repeats(spark, width):
    from stationflow.operators import windows

    rng = np.random.default_rng(3)
    rows = [("a", int(d), float(v)) for d, v in zip(rng.integers(-400, 900, 2500), rng.normal(size=2500), strict=True)]
    rows += [("b", d, 1.0) for d in range(-300, 500) if d not in (-7, 250)] + [("b", 250, None), ("b", 249, 1.0), ("c", 5, float("nan")), ("c", 5, 2.0)]
    df = spark.createDataFrame(rows, "station string, day long, v double")
    want = brute_frames(rows, width)
    got = windows.complete_window(df, ["station"], "day", "v", width).collect()
    assert len(got) == len(rows) and all(r.complete == (None not in want[r.station, r.day]) for r in got)
    frames = windows.step_frames(df, df.select("station", "day"), ["station"], "day", "v", width)
    assert {(r.station, r.day): r.frames for r in frames.collect()} == want


def test_three_steps_not_three_rows(spark):
    from stationflow.operators import windows

    df = spark.createDataFrame([("s", 1, 1.0), ("s", 1, 2.0), ("s", 3, 3.0)], "station string, day long, v double")
    assert not windows.complete_window(df, ["station"], "day", "v", 3).filter("complete").count()


def test_point_that_repeats_is_found_as_often(spark):
    from stationflow.operators.quality import points_in_polygons

    square = [(7, float(a), float(b), float(c), float(d)) for a, b, c, d in ((0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0))]
    edges = spark.createDataFrame(square, "ring int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 1.5, 1.5)] * 2 + [(1, 1.5, 2.0)] * 3 + [(2, 9.0, 1.0), (3, 0.0, 2.0)], "id int, lat double, lon double")
    assert sorted(r.id for r in points_in_polygons(pts, edges).collect()) == [1, 1, 1, 1, 1, 3]


def yearly(folder, station, year, days, bump=0.0, broken=()):
    """An archive as delivered: a gzipped file for each day."""
    with zipfile.ZipFile(folder / f"{station}.{year}.trop.zip", "w") as z:
        for day in days:
            lines = "".join(f" {station} {year % 100}:{day:03d}:{s:05d} {2000 + day + s / 1e5 + bump} 1.0 {day} \n" for s in range(0, 86400, 1800))
            data = gzip.compress(f"+TROP/SOLUTION\n*c\n{lines}-TROP/SOLUTION\n".encode())
            z.writestr(f"{day}.gz", data[:-9] if day in broken else data)


def test_archive_source_equals_whole_archives(spark, tmp_path):
    from stationflow.sources import archive_source as S

    for station in ("abcd", "efgh"):
        for year in (2023, 2024):
            yearly(tmp_path, station, year, range(1, 9), broken=(3,))
    (tmp_path / "junk.zip").write_bytes(b"nothing")
    archive(tmp_path / "odd.zip", "wxyz", 5.0)
    args = (spark, str(tmp_path), 3600, "2023-01-02", "2024-01-05")
    want = sorted(map(tuple, A.ingest_station_archives(*args).collect()))
    assert want and sorted(map(tuple, S.ingest_archives(*args, partBytes="700").collect())) == want
    assert sorted(map(tuple, S.ingest_archives(*args, mostPlanned="0").collect())) == want
    rows = S.archives(spark, str(tmp_path), partBytes="700")
    assert rows.rdd.getNumPartitions() > 10
    only = rows.filter("station = 'ABCD' and year >= 2024 and total > 0")
    assert {(r.archive, r.member) for r in only.select("archive", "member").distinct().collect()} == {("abcd.2024.trop.zip", f"{d}.gz") for d in (1, 2, 4, 5, 6, 7, 8)}
    assert only.rdd.getNumPartitions() < rows.rdd.getNumPartitions() / 3  # the other archives aren't opened


def test_archive_source_holds_no_member(tmp_path):
    import tracemalloc

    from stationflow.sources import archive_source as S

    with zipfile.ZipFile(tmp_path / "big.2024.zip", "w") as z:
        z.writestr("a.gz", gzip.compress(b"+TROP/SOLUTION\n" + b" big 24:001:00000 2400.5 1.0 100.5\n" * 1_500_000))  # 50 MB of text
    reader = S.ArchiveReader({"path": str(tmp_path)})
    tracemalloc.start()
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1_500_000
    assert tracemalloc.get_traced_memory()[1] < 25 << 20
    tracemalloc.stop()


def above(plan, scan):
    """Names of the operators over a scan, from the tree string of a plan, up to the first aggregate."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and scan in x)
    deep, out = len(lines[at]) - len(lines[at].lstrip(" :+-*")), []
    for x in reversed(lines[:at]):
        d = len(x) - len(x.lstrip(" :+-*"))
        if d < deep:
            deep = d
            name = x.lstrip(" :+-*").lstrip("(0123456789) ").split("(")[0].split(" ")[0]
            out.append(name)
            if name.startswith(("HashAggregate", "ObjectHash", "SortAggregate")):
                break
    return out


def test_bucketed_series_is_not_exchanged(spark):
    from stationflow.operators import timegrid, windows

    rows = [(s, d, float(s * d)) for s in range(40) for d in range(30) if (s * d) % 7]
    series = A.write_bucketed(spark.createDataFrame(rows, "station long, day long, v double"), "series_by_station", "station", "day", 5)
    plain = spark.createDataFrame(rows, "station long, day long, v double")
    edges = spark.createDataFrame([(t, s, 1) for t in range(9) for s in range(t, 40, 9)], "target long, station long, rank int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    try:
        for k, v in zip(before, ("false", "-1", "false"), strict=True):
            spark.conf.set(k, v)
        index = lambda s: windows.valid_neighbours(edges, windows.complete_window(s, ["station"], "day", "v", 3), "target", "station", "day")
        plan = index(series)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in above(plan, "station") and "SortMergeJoin" in above(plan, "station") and "Window" in above(plan, "station")
        dense = timegrid.align_to_axis(series, ["station"], "day")
        plan = dense._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        frames = windows.step_blocks(series, ["station"], "day", "v", 10)
        assert "Exchange" not in frames._jdf.queryExecution().executedPlan().toString()
        assert sorted(index(series).collect()) == sorted(index(plain).collect()) and sorted(dense.collect(), key=str) == sorted(timegrid.align_to_axis(plain, ["station"], "day").collect(), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql("DROP TABLE series_by_station")


def test_metadata_in_one_job(spark, tmp_path):
    df = spark.range(1000).withColumn("v", F.when(F.col("id") % 4 > 0, F.col("id")))
    group = "metadata"
    spark.sparkContext.setJobGroup(group, group)
    try:
        row = A.write_run_metadata(df, str(tmp_path / "m"), {"rule": "x"}, str(tmp_path / "d"), {"missing": F.count_if(F.col("v").isNull()), "times": F.max("v")})
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = spark.read.json(str(tmp_path / "m")).first()
    assert (got.rows, got.missing, got.times, got.rule) == (1000, 250, 999, "x") and row["rows"] == spark.read.parquet(str(tmp_path / "d")).count()


def test_build_that_breaks_off(spark, tmp_path):
    out, built = str(tmp_path / "t"), []

    def build(fail):
        def run(rest):
            keys = sorted(r.k for r in rest.collect())
            built.append(keys)
            if fail and len(built) == 3:
                raise RuntimeError("lost")
            return rest.filter("k <> 5").withColumn("v", F.col("k") * 2)  # a key without rows is done too

        return run

    todo = spark.range(20).withColumnRenamed("id", "k")
    with pytest.raises(RuntimeError):
        A.resume_build(spark, build(True), todo, ["k"], out, batches=4)
    done = {k for keys in built[:2] for k in keys}
    (tmp_path / "t" / "k=77").mkdir()  # what a batch left that was cut off between two partitions isn't in the manifest
    assert {r.k for r in spark.read.parquet(out + ".done").collect()} == done
    built.clear()
    A.resume_build(spark, build(False), todo, ["k"], out, batches=4)
    assert sorted(k for keys in built for k in keys) == sorted(set(range(20)) - done)
    built.clear()
    A.resume_build(spark, build(False), todo, ["k"], out, batches=4)
    assert not built and sorted(r.k for r in spark.read.parquet(out).collect()) == [k for k in range(20) if k != 5]


def test_sketches_within_their_bounds(spark, tmp_path):
    from stationflow.operators import aggregates as G

    df = spark.range(200_000).select((F.col("id") % 6).alias("month"), ((F.col("id") * 7919) % 100_003).cast("double").alias("v"), ((F.col("id") * 31) % 20_011).alias("station"))
    G.value_sketches(df, ["month"], "v", "station").write.parquet(str(tmp_path / "s"))  # months are kept
    kept = spark.read.parquet(str(tmp_path / "s"))
    got = G.read_sketches(G.roll_up_sketches(kept.filter("month < 4").withColumn("half", F.lit(0)), ["half"]), [0.01, 0.5, 0.9, 0.99]).first()
    part = df.filter("month < 4")
    n = part.count()
    assert got.n == n and abs(got.n_keys / part.select("station").distinct().count() - 1) < 0.03
    for share, q in zip([0.01, 0.5, 0.9, 0.99], got.quantiles, strict=True):
        assert abs(part.filter(F.col("v") <= q).count() / n - share) < 0.01
    empty = G.read_sketches(G.value_sketches(df.limit(1).select("month", F.lit(None).cast("double").alias("v"), F.lit(None).cast("long").alias("station")), ["month"], "v", "station"), [0.5]).first()
    assert empty.n == 0 and empty.quantiles is None and empty.n_keys == 0
