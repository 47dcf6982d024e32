from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from symloom.llm.common import running
from symloom.llm.sharding import grow, place, shard_documents, shard_draw, shard_tree


def placed(spark, n, *trees):
    rows = spark.range(n)
    for i, tree in enumerate(trees):
        got = place(spark.range(n), "id", tree).select("id", F.struct("region", "rack", "shard").alias(f"t{i}"))
        rows = rows.join(got, "id")
    return rows.collect()


def test_one_more_shard_takes_rows_only_into_itself(spark):
    """For every number of shards to 40, in the tree of one more, and grown as a region."""
    rows = spark.range(1500)
    for n in range(1, 42):
        rows = place(rows, "id", shard_tree(n)).select("id", *[c for c in rows.columns if c != "id"], F.col("shard").alias(f"n{n}"))
    rows = rows.collect()
    for n in range(1, 41):
        assert all(r[f"n{n + 1}"] in (r[f"n{n}"], n) for r in rows)
        shares = Counter(r[f"n{n}"] for r in rows)
        assert all(abs(shares[s] - 1500 / n) < 5 * (1500 / n) ** 0.5 + 1 for s in range(n))
    grown = placed(spark, 1500, shard_tree(16), grow(shard_tree(16)), shard_tree(17))
    assert all(r["t1"]["shard"] == r["t2"]["shard"] for r in grown)


@pytest.mark.parametrize("n", [1, 7, 16, 39])
def test_grown_shard_is_the_placing_of_one_more(spark, docs, n):
    of = lambda r: (str(r["doc_id"]), r["text_crc32"])
    now, more = shard_documents(docs, n).collect(), shard_documents(docs, n + 1).collect()
    assert {(*of(r), r["grown_shard"]) for r in now} == {(*of(r), r["shard"]) for r in more}


def test_every_level_takes_its_least_draw(spark):
    """Plain descents: nodes draw the least of their shards' draws; shares go by weight."""
    weights = [1.0 + s % 3 for s in range(16)]
    tree = shard_tree(16, weights=weights)
    draws = spark.range(800).select("id", *[shard_draw(F.col("id"), F.lit(s), F.lit(weights[s])).alias(str(s)) for s in range(16)]).collect()

    def descend(draw):
        rack = lambda shards: min(draw[s] for s in shards)
        region = min(tree, key=lambda g: min(map(rack, tree[g].values())))
        name = min(tree[region], key=lambda r: rack(tree[region][r]))
        return region, name, min(tree[region][name], key=lambda s: draw[s])

    want = {r["id"]: descend([r[str(s)] for s in range(16)]) for r in draws}
    assert {r["id"]: tuple(r["t0"]) for r in placed(spark, 800, tree)} == want
    shares = Counter(x[0] for x in want.values())
    assert abs(shares["region0"] / 800 - sum(weights[:8]) / sum(weights)) < 0.06


def test_movement_stays_with_changed_weights(spark):
    """A heavier shard takes keys from all, a lighter one gives them away; nothing else moves."""
    weights = [1.0] * 16
    more = [*weights]
    more[5] = 3.0
    rows = placed(spark, 4000, shard_tree(16, weights=weights), shard_tree(16, weights=more))
    moved = [r for r in rows if r["t0"] != r["t1"]]
    assert moved and all(tuple(r["t1"]) == ("region0", "rack1", 5) for r in moved)
    share = sum(r["t1"]["shard"] == 5 for r in rows) / len(rows)
    assert 0.13 < share < 0.2  # 3 of 18
    none = [*weights]
    none[0] = 0.0
    rows = placed(spark, 4000, shard_tree(16, weights=weights), shard_tree(16, weights=none))
    assert all(r["t0"]["shard"] == 0 for r in rows if r["t0"] != r["t1"])
    assert all(r["t1"]["shard"] != 0 for r in rows)


def test_query(docs, rows, empty):
    got = shard_documents(docs, 16).collect()
    assert len(got) == len(rows)
    size = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((r[0], *size(r[1])) for r in rows), key=str)
    slots: dict[int, list[int]] = {}
    by_id: dict[int | None, set] = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        by_id.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(v) == 1 for v in by_id.values())
    assert shard_documents(empty, 16).collect() == []


def test_running_sums(spark):
    data = [(None if i % 7 == 0 else f"g{i % 3 if i % 2 else 0}", i * 37 % 101, i % 5, i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, o long, v long, i long").repartition(5)
    got = {r["i"]: r["before"] for r in running(df, ["g"], ["o", "i"], "v").collect()}
    for g, o, _, i in data:
        assert got[i] == sum(v2 for g2, o2, v2, i2 in data if g2 == g and (o2, i2) < (o, i))
