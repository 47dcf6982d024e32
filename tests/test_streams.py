"""Streams with state: stalls and last events by timers, digests that do not pile up."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from symloom.streaming import progress as P
from symloom.streaming import timers as M


@pytest.fixture
def timers(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    M.use_timers(spark)
    yield
    spark.conf.unset(name)


def until(found, want, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if len(rows := found()) >= want:
            return rows
        time.sleep(0.3)
    return found()


def test_a_stall_is_told_by_a_timer(spark, tmp_path, timers):
    """Nothing comes after the last events, and still both files have their row, once."""
    schema = "path string, s long"
    put = lambda k, rows: spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    put(0, [("f", 0), ("f", 1), ("g", 5), ("f", 500)])
    events = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(tmp_path / "in")).select("path", F.timestamp_seconds("s").alias("ts"))
    run = M.stall_alerts(events, given=2.0).writeStream.format("memory").queryName("stalled").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        rows = until(lambda: spark.table("stalled").collect(), 3)
        assert sorted((r["path"], r["closed"], r["n_events"]) for r in rows) == [("f", False, 3), ("f", True, 2), ("g", False, 1)]
        assert [r["seconds"] for r in rows if r["closed"]] == [499.0]
        put(1, [("g", 6)])  # within the timeout of its events, though a timer had told it
        rows = until(lambda: spark.table("stalled").collect(), 4)
        assert sorted((r["path"], r["closed"], r["n_events"]) for r in rows)[2:] == [("g", False, 1), ("g", False, 2)]
    finally:
        run.stop()


def test_timeouts_by_size(spark):
    rows = spark.createDataFrame([(0,), (10_000_000,), (30_000_000,), (10**9,)], "chars long")
    assert [r[0] for r in rows.select(P.stall_timeout(F.col("chars"))).collect()] == [300.0, 300.0, 600.0, 1200.0]


def test_the_last_event_is_let_through(spark, tmp_path, timers):
    """In one batch or several, a stream keeps what a batch job keeps."""
    times = [0, 50, 199, 200, 350, 401, 402]
    rows = [("f", i, t) for i, t in enumerate(times)]
    for k, own in enumerate([rows[:3], rows[3:]]):
        spark.createDataFrame(own, "path string, seq long, ms long").coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    events = spark.readStream.schema("path string, seq long, ms long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("ms"))
    run = M.throttled(events, 200, 1500).writeStream.format("memory").queryName("thin").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
    try:
        rows = until(lambda: spark.table("thin").collect(), 4)
        assert [(r["seq"], r["last"]) for r in rows if r["seq"] not in (2,)] == [(0, False), (3, False), (5, False), (6, True)]
    finally:
        run.stop()


def test_digests_are_forgotten(spark, tmp_path):
    """Copies of the same day come once; the state stays as small as a day's texts."""
    folder = tmp_path / "in"
    folder.mkdir()
    sizes = []
    for day in range(6):
        for k in range(3):
            path = folder / f"d{day}_{k}.js"
            path.write_text(f"var a{k} = {day if k else 0};")
            os.utime(path, (86400 * 3 * day + 100 * k, 86400 * 3 * day + 100 * k))
            twin = folder / f"d{day}_{k}_twin.js"
            twin.write_text(path.read_text())
            os.utime(twin, (86400 * 3 * day + 100 * k + 7, 86400 * 3 * day + 100 * k + 7))
        run = P.stream_bindings(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        run.awaitTermination()
        sizes += [op["numRowsTotal"] for p in run.recentProgress[-1:] for op in p["stateOperators"]]
    got = spark.read.parquet(str(tmp_path / "out"))
    # two texts a day are new; the third is that of every day, and comes again once the watermark,
    # which a batch moves for the next one, has left it behind
    assert 15 <= got.count() <= 18 and max(sizes) <= 9
