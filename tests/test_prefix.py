"""Running sums, ranks and sums by blocks: against plain sums, with one group of most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from symloom.operators import answers as A
from symloom.operators import batching as B
from symloom.prefix import block_sums, ranked, running_sums


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_and_ranks(spark, many_tasks):
    rnd = random.Random(1)
    rows = [(None if i % 11 == 0 else "big" if rnd.random() < 0.9 else f"g{i % 4}", rnd.choice([None, *range(50)]), i, rnd.randint(-5, 5), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, o int, i int, v long, w long").repartition(5)
    got = {r["i"]: r for r in running_sums(df, ["g"], ["o", "i"], ["v", "w"]).collect()}
    order = lambda r: (r[1] is None, r[1] or 0, r[2])
    for r in rows:
        before = [x for x in rows if x[0] == r[0] and order(x) < order(r)]
        assert (got[r[2]]["before_v"], got[r[2]]["before_w"]) == (sum(x[3] for x in before), sum(x[4] for x in before))
    places = {r["i"]: r["n"] for r in ranked(df, ["g"], ["o", "i"], "n").collect()}
    assert all(places[r[2]] == 1 + sum(x[0] == r[0] and order(x) < order(r) for x in rows) for r in rows)


def test_block_sums(spark):
    rows = [(f"f{i % 3}" if i % 10 == 0 else "big", i * 2, i % 7) for i in range(400)]
    got = {(r["g"], r["n"]): r["s"] for r in block_sums(spark.createDataFrame(rows, "g string, n int, v int"), "g", "n", F.col("v"), "s", 16).collect()}
    assert got == {(g, n): sum(x[2] for x in rows if x[0] == g and x[1] <= n) for g, n, _ in rows}


def test_no_window_reads_a_whole_file(spark, many_tasks):
    """One file of nine tenths of all lines, renames and batches: right, and no window by path."""
    lines = spark.createDataFrame([("big" if i < 9000 else f"f{i % 9}", i if i < 9000 else (i - 9000) // 9, "x" * (i % 5)) for i in range(10000)], "path string, line int, text string")
    sums = B.prefix_chars(lines)
    got = {(r["path"], r["line"]): r["chars"] for r in sums.where("path = 'big'").collect()}
    total = 0
    for i in range(9000):
        total += i % 5 + 1
        assert got["big", i] == total
    renames = spark.createDataFrame([("big" if i < 900 else "f", i, f"k{i % 800}", f"n{i}") for i in range(1000)], "path string, seq long, key string, new_name string")
    merged = A.merge_renames(renames, renames.where("seq < 10").withColumn("new_name", F.lit("late")))
    rows = sorted((r["seq"], r["key"], r["new_name"]) for r in merged.where("path = 'big'").collect())
    assert [r[0] for r in rows] == list(range(800))
    assert rows[:2] == [(0, "k0", "late"), (1, "k1", "late")] and rows[10] == (10, "k10", "n810")
    batches = spark.createDataFrame([("big", f"b{i}", i % 7, i % 7 + i % 3, 1 + i % 4) for i in range(500)], "path string, batch_id string, start_row int, end_row int, n_identifiers int")
    order = [r["batch_id"] for r in B.order_batches(batches).orderBy("batch_seq").collect()]
    assert order == [b for _, b in sorted(((i % 3 + 1, 1 + i % 4, i % 7, f"b{i}"), f"b{i}") for i in range(500))]
    for frame in (merged, B.order_batches(batches)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(path" not in plan
