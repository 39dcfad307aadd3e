import datetime

from pyspark.sql import functions as F

from stationflow.operators.aggregates import trimmed_mean
from stationflow.streaming import live

SCHEMA = "station long, ts timestamp, value double, slot long, arrival long"


def write(spark, path, rows):
    data = [(s, datetime.datetime(2024, 1, 1, h, m), v, h * 60 + m, a) for s, h, m, v, a in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def drain(df, mode, name, spark, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_ingest_once(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    write(spark, src, [(1, 0, 0, 1.0, 0), (2, 0, 0, 2.0, 0)])
    live.ingest(spark, str(src), SCHEMA, out, cp, ["station"]).awaitTermination()
    write(spark, src, [(1, 1, 0, 3.0, 0)])
    live.ingest(spark, str(src), SCHEMA, out, cp, ["station"]).awaitTermination()
    live.ingest(spark, str(src), SCHEMA, out, cp, ["station"]).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_windows_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(s, h, m, float(s * h + m), 0) for s in (1, 2) for h in range(6) for m in (0, 20, 40) if (s, h) != (2, 3)]
    write(spark, src, [*rows, (9, 20, 0, 0.0, 0)])
    stream = spark.readStream.schema(SCHEMA).parquet(str(src))
    done = drain(live.complete_windows(stream, ["station"], "ts", "value", "1 hour", 3, "1 hour"), "append", "complete", spark, tmp_path)
    got = {(r.station, r.window.end.hour) for r in done.collect()}
    assert {(1, h) for h in range(3, 7)} <= got and (2, 3) in got and not any(s == 2 and h in (4, 5, 6) for s, h in got)
    stream = spark.readStream.schema(SCHEMA).parquet(str(src))
    done = drain(live.tumbling_trimmed(stream, ["station"], "ts", "value", "1 hour", "1 hour"), "append", "tumbling", spark, tmp_path)
    batch = trimmed_mean(spark.read.schema(SCHEMA).parquet(str(src)).withColumn("slot", F.window("ts", "1 hour")), ["station", "slot"], "value", "v").filter("station < 9")
    key = lambda df: {(r.station, r.slot.start, r.v) for r in df.collect()}
    assert key(done.filter("station < 9")) == key(batch)


def test_live_join(spark, tmp_path):
    write(spark, tmp_path / "a", [(1, 0, m, float(m), 0) for m in (0, 10, 50)])
    write(spark, tmp_path / "b", [(1, 1, 0, 9.0, 0)])
    a = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "a")).select("station", "ts", "value")
    b = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "b")).select(F.col("station").alias("key"), "ts").withColumnRenamed("key", "sid")
    out = live.live_series(a.withColumnRenamed("station", "sid"), b, "sid", "30 minutes", "2 hours")
    assert [r.series_value for r in drain(out, "append", "joined", spark, tmp_path).collect()] == [50.0]


def test_last_value_and_repeats(spark, tmp_path):
    write(spark, tmp_path / "s", [(1, 0, 5, 1.0, 0), (1, 0, 5, 2.0, 1), (2, 0, 1, 7.0, 0), (2, 0, 9, 8.0, 0), (2, 0, 9, 8.0, 0)])
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "s"))
    got = {r.station: (r.slot, r.value, r.gap) for r in drain(live.last_values(stream.select("station", "slot", "arrival", "value")), "update", "last", spark, tmp_path).collect()}
    assert got == {1: (5, 2.0, 0), 2: (9, 8.0, 8)}
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "s"))
    once = drain(live.exact_repeats(stream, ["station", "slot", "value"], "ts", "1 hour"), "append", "once", spark, tmp_path)
    assert once.count() == 4


def test_silent_stations_are_told_once(spark, tmp_path):
    import time

    src = tmp_path / "in"
    write(spark, src, [(1, 0, 5, 1.0, 0), (2, 0, 9, 8.0, 0)])
    stream = spark.readStream.schema(SCHEMA).parquet(str(src)).select("station", "slot", "arrival", "value")
    q = live.last_values(stream, silent_ms=1500).writeStream.format("memory").queryName("silent").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    for _ in range(60):
        time.sleep(1)
        if spark.table("silent").filter("value is null").count() == 2:
            break
    time.sleep(3)
    q.stop()
    rows = [(r.station, r.slot, r.value, r.gap) for r in spark.table("silent").collect()]
    assert sorted(rows, key=str) == [(1, 5, 1.0, 0), (1, 5, None, None), (2, 9, 8.0, 0), (2, 9, None, None)]


def test_archives_as_they_come(spark, tmp_path):
    from tests.test_sources import yearly

    from stationflow.sources import station_files as A

    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    folder = tmp_path / "in"
    run = lambda: live.ingest_archive_stream(spark, str(folder / "*"), out, cp, 3600, parts=2).awaitTermination()
    batch = lambda: sorted(map(tuple, A.ingest_station_archives(spark, str(folder / "*"), 3600, "2020-01-01", "2030-01-01").collect()))
    got = lambda: sorted(map(tuple, spark.read.parquet(out).select("station_id", "ts", "total", "wet").collect()))
    for k in range(4):
        (folder / str(k)).mkdir(parents=True)
    yearly(folder / "0", "abcd", 2023, (1, 2))
    yearly(folder / "0", "abcd", 2024, (1,))
    yearly(folder / "0", "efgh", 2024, (1,))
    run()
    assert got() == batch()
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("year=2023/**/*.parquet")}
    yearly(folder / "1", "efgh", 2024, (1,))  # delivered again
    yearly(folder / "2", "efgh2", 2024, (2,))
    run()
    assert got() == batch() and files == {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("year=2023/**/*.parquet")}  # not touched
    later = folder / "3"
    yearly(later, "abcd", 2024, (1, 3), bump=5.0)
    (later / "abcd.2024.trop.zip").rename(later / "abcd.2024.v2.zip")  # corrected: a later name
    run()
    run()
    assert got() == batch() and any(abs(r[2] - 2006) < 0.5 for r in got())


def test_live_samples_equal_batch(spark, tmp_path):
    from stationflow.operators import windows

    lost = {(1, 7), (2, 3), (3, 9), (3, 10)}
    rows = [(s, h, 0, float("nan") if (s, h) == (2, 8) else float(s * h), 0) for s in (1, 2, 3) for h in range(13) if (s, h) not in lost]
    late = [r for r in rows if r[1] in (4, 9)]
    edges = spark.createDataFrame([(10, 1), (10, 2), (11, 3), (11, 3), (12, 1), (12, 2), (12, 3)], "target long, station long")
    reports = [(t, h, 0, float(t + h), 0) for t in (10, 11, 12) for h in range(13) if h % 3]
    flush = [(99, 23, 30, 0.0, 0)]
    feeds = [([r for r in rows if r not in late and r[1] < 10], reports[:20]), (late[:3] + rows[:5], reports[:6]), ([r for r in rows if r[1] >= 10] + late[3:], reports[20:]), (flush, flush), (flush, flush)]

    def streams():
        a = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a")).select("station", "ts", "value")
        b = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b")).select(F.col("station").alias("target"), "ts", "value")
        return live.live_samples(a, edges, b, "1 hour", 3, "9 hours")

    for k, (a, b) in enumerate(feeds):
        write(spark, tmp_path / "a", a)
        write(spark, tmp_path / "b", b)
        q = streams().writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    live_rows = sorted((r.target, r.ts.hour, r.value, r.n_valid) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = spark.read.schema(SCHEMA).parquet(str(tmp_path / "a")).withColumn("step", F.floor(F.unix_seconds("ts") / 3600))
    valid = windows.valid_neighbours(edges.distinct(), windows.complete_window(batch, ["station"], "step", "value", 3).select("station", "step", "complete").distinct(), "target", "station", "step")
    told = spark.read.schema(SCHEMA).parquet(str(tmp_path / "b")).select(F.col("station").alias("target"), "ts", "value").distinct().withColumn("step", F.floor(F.unix_seconds("ts") / 3600))
    want = sorted((r.target, r.ts.hour, r.value, r.n_valid) for r in told.join(valid, ["target", "step"]).collect())
    assert len(want) > 15 and live_rows == want


def test_nan_is_missing_in_live_windows(spark, tmp_path):
    write(spark, tmp_path / "n", [(1, h, 0, float("nan") if h == 2 else 1.0, 0) for h in range(8)] + [(9, 22, 0, 0.0, 0)])
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "n"))
    done = drain(live.complete_windows(stream, ["station"], "ts", "value", "1 hour", 3, "1 hour"), "append", "with_nan", spark, tmp_path)
    assert {r.window.end.hour for r in done.filter("station = 1").collect()} == {6, 7, 8}
