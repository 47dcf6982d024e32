from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.llm.mixing import apportion, mix_documents, mixed, n_blocks, plan, shard_quotas, shard_words, targets, times_modulo

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def highest_quotients(wanted, seats, limits):
    got = [0] * len(wanted)
    for _ in range(seats):
        q = [w / (2 * g + 1) if g < n and w > 0 else -1 for w, g, n in zip(wanted, got, limits, strict=True)]
        if max(q) < 0:
            break
        got[q.index(max(q))] += 1
    return got


@pytest.mark.parametrize("seed", range(40))
def test_sainte_lague(seed):
    rnd = random.Random(seed)
    wanted = [rnd.choice([0, rnd.randint(1, 9), rnd.random() * 1000]) for _ in range(rnd.randint(1, 8))]
    limits = [rnd.randint(0, 40) for _ in wanted]
    for seats in (0, 1, 7, 60, 500):
        assert apportion(wanted, seats, limits) == highest_quotients(wanted, seats, limits)


def test_targets():
    sizes = {"a": 100, "b": 100, "c": 800, None: 1000}
    got = targets(sizes)
    weight = {"a": 5, "b": 2, "c": 1, None: 5}
    assert abs(sum(got.values()) - 2000) < 1e-6 and got["a"] == 300 and list(got) != []
    free = [s for s in sizes if got[s] < 3 * sizes[s]]
    share = got[free[0]] / weight[free[0]]
    assert all(abs(got[s] / weight[s] - share) < 1e-9 for s in free)
    assert all(got[s] == 3 * sizes[s] and 3 * sizes[s] <= weight[s] * share for s in sizes if s not in free)
    assert targets({}) == {} and targets({"x": 0}) == {"x": 0.0}


def test_quotas_of_shards_are_those_of_the_whole():
    sizes = {f"s{i}": 10_000 * (i + 1) for i in range(6)}
    whole = {q.source: q.seats for q in plan(sizes)}
    parts = shard_quotas(sizes, 7)
    assert {s: sum(p[s] for p in parts) for s in sizes} == whole
    totals = [sum(p.values()) for p in parts]
    assert max(totals) - min(totals) <= 1 and all(n >= 0 for p in parts for n in p.values())


def test_query(docs, rows, empty):
    got = mix_documents(docs, block=16).collect()
    again = mix_documents(docs.repartition(2), block=16).collect()
    words = lambda t: len(WORD.findall(t or ""))
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((r[0], words(r[1])) for r in rows), key=str)
    sizes: Counter = Counter()
    for _, text, _, source in rows:
        sizes[source] += words(text)
    goal, taken = targets(dict(sizes)), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 4 * 16 for s in sizes)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mix_documents(empty).collect() == []


def test_shards_take_their_quotas(docs, rows):
    """Seat by seat: highest quotients, cut into shards, each seat's block in the permutation."""
    block, shards = 16, 5
    got = mix_documents(docs, block=block, shards=shards).collect()
    lines: dict = {}
    for r in got:
        lines.setdefault(r["source"], []).append(r)
    sizes = {s: sum(r["size"] for r in own) for s, own in lines.items()}
    quotas = {q.source: q for q in plan(sizes, block, shards=shards)}
    goal = targets(sizes)
    # what a source wants, in blocks of its own size
    want = {s: goal[s] * n_blocks(sizes[s], block) / max(1, sizes[s]) for s in goal}
    total, seats, shard_of = round(sum(want.values())), dict.fromkeys(goal, 0), {s: [] for s in goal}
    for seat in range(total):
        open_ones = [s for s in goal if seats[s] < 3 * -(-sizes[s] // block) and goal[s] > 0]
        if not open_ones:
            break
        s = max(open_ones, key=lambda s: want[s] / (2 * seats[s] + 1))
        seats[s] += 1
        shard_of[s].append(next(m for m in range(shards) if seat < total * (m + 1) // shards))
    for s, own in lines.items():
        q = quotas[s]
        assert q.seats == seats[s] and [shard_of[s].count(m) for m in range(shards)] == [b - a for a, b in zip(q.upto, q.upto[1:], strict=False)]
        at = {(q.step * j + q.shift) % max(1, q.blocks): j for j in range(q.blocks)}
        inside = [sizes[s] // q.blocks + (j < sizes[s] % q.blocks) for j in range(q.blocks)]
        by_shard = [sum(inside[at[k % q.blocks]] for k, m in enumerate(shard_of[s]) if m == x) for x in range(shards)]
        assert [sum(r["shard_taken"][m] for r in own) for m in range(shards)] == by_shard
        assert all(sum(r["shard_taken"]) == r["taken"] and min(r["shard_taken"]) >= 0 for r in own)


@pytest.mark.parametrize("at", range(0, 64, 5))
def test_words_of_one_document(spark, at):
    """Each word's block and its turns, by going through all seats."""
    whole, size, blocks, step, shift, upto = 86, 21, 11, 7, 4, [0, 3, 3, 19, 25]
    block_of = [j for j in range(blocks) for _ in range(whole // blocks + (j < whole % blocks))]
    want = [0] * 4
    for word in range(at, at + size):
        turn = (block_of[word] * step + shift) % blocks
        for m in range(4):
            want[m] += sum(1 for seat in range(upto[m], upto[m + 1]) if seat % blocks == turn)
    df = spark.createDataFrame([(at, size, whole, blocks, step, shift, upto)], "before long, size long, source_size long, blocks long, step long, shift long, upto array<long>")
    assert df.select(shard_words(F.col("before"), F.col("size")).alias("w")).first()["w"] == want


def test_products_beyond_a_long():
    rnd = random.Random(2)
    rows = [(rnd.randrange(m), rnd.randrange(m), m) for m in (rnd.randrange(1, 1 << 40) for _ in range(500))]
    a, b, m = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    assert times_modulo(a, b, m).tolist() == [x * y % z for x, y, z in rows]


@pytest.mark.parametrize(("seed", "large"), [(1, 20000), (2, 3000), (3, 0)])
def test_small_sources_come_near_their_targets(spark, seed, large):
    """Sources of 1 to 1000 words: within one block or one document of the target."""
    rnd = random.Random(seed)
    sizes = {"a": [100], "b": [300], "c": [10], "d": [1], "e": [rnd.randint(1, 1000)], "f": [7] * 30, "g": [rnd.randint(1, 40) for _ in range(9)], "z": [200] * (large // 200)}
    rows = [(i * 100 + k, " ".join(["w"] * n), s) for i, (s, own) in enumerate(sizes.items()) for k, n in enumerate(own)]
    got = mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken: Counter = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    goal = {r["source"]: r["target"] for r in got}
    for s, own in sizes.items():
        if own:
            block = -(-sum(own) // n_blocks(sum(own)))
            assert abs(taken[s] - goal[s]) <= max(block, max(own)), (s, taken[s], goal[s])
    if large == 20000:
        assert (taken["a"], taken["c"], taken["d"]) == (300, 30, 3) and abs(taken["b"] - 900) <= 150


def test_twins_share_their_copies(spark):
    rows = [(1, "a b c d e f", "s", "en"), (1, "a b c d e f", "s", "de"), (2, "g h i " * 40, "s", "en"), (3, "x " * 300, "t", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    taken = mix_documents(docs, block=4).collect()
    chosen = Counter(r["doc_id"] for r in mixed(docs, block=4).collect())
    for d in (1, 2, 3):
        own = [r["taken"] / r["size"] for r in taken if r["doc_id"] == d]
        assert sum(map(int, own)) <= chosen[d] <= sum(int(x) + 1 for x in own)


def test_the_mix_itself(docs, empty):
    got = mixed(docs, block=16)
    assert got.columns == docs.columns
    want = {r["doc_id"]: r["taken"] / r["size"] for r in mix_documents(docs, block=16).where("size > 0 and doc_id is not null and doc_id <> 5").collect()}
    copies = Counter(r["doc_id"] for r in got.collect())
    assert all(abs(copies[d] - x) < 1 for d, x in want.items())
    assert mixed(empty).collect() == []
