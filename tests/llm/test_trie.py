from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from symloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, p0 long, top_conv string"


def brute(rows):
    """Nodes by walking all prefixes: (conv_id, depth) -> parent, convs, children, leaves, saved, digest."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    talk = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    built = {}
    for c, own in talk.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = talk.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, own in built.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}

    def walk(p):
        leaves, saved = int(not children[p]), (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for q in children[p]:
            a, b = walk(q)
            leaves, saved = leaves + a, saved + b
        ends = sorted(c for c in members[p] if len(built[c]) == len(p))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves, saved, digest)
        return leaves, saved

    if built:
        walk(())
    return out


def conversations(seed, n):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-60, 400), n):
        for t in range(rnd.choice([1, 1, 2, 3, 4, 7, 12])):
            rows.append((c, t if rnd.random() < 0.97 else None, rnd.choice(["user", "user", None]), rnd.choice(["a", "b b", "a", None, "", "c\td e"])))
    seen, out = set(), []
    for r in rows:  # turns of one number have no order: one of each
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append(r)
    return out


def got_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    found = trie.conversation_trie(df).collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in found}
    assert len(out) == len(found)
    return out, found


@pytest.mark.parametrize(("seed", "n"), [(1, 40), (2, 300)])
def test_same_as_brute_force(spark, seed, n):
    rows = conversations(seed, n)
    assert got_of(spark, rows)[0] == brute(rows)


def test_paths_are_heavy_and_short(spark):
    """Each node has one heavy child, paths are vertical, and light edges are few."""
    rows = conversations(3, 250)
    got, found = got_of(spark, rows)
    top = {(r["conv_id"], r["depth"]): (r["top_conv"], r["top_depth"]) for r in found}
    kids = defaultdict(list)
    for (c, d), x in got.items():
        if d:
            kids[x[0], d - 1].append((-x[1], c))
    for (c, d), own in kids.items():
        heavy = min(own)[1]
        assert top[heavy, d + 1] == top[c, d]
        assert all(top[k, d + 1] == (k, d + 1) for _, k in own if k != heavy)
    def light(node):
        n = 0
        while node[1]:
            n += top[node] == node
            node = (got[node][0], node[1] - 1)
        return n
    assert max(map(light, got)) <= max(x[1] for x in got.values()).bit_length()


def test_one_conversation_holds_most_rows(spark):
    rows = [(3, t, "user", f"w{t % 5}") for t in range(700)] + [(c, t, "user", f"w{t % 5}") for c in range(40, 60) for t in range(4)]
    assert got_of(spark, rows)[0] == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "no id"), (0, 0, "user", "x"), (0, 0, "user", "x"), (0, None, None, None), (5, 3, "user", "only"), (27, 0, "a", "only")]
    got, _ = got_of(spark, rows)
    assert got == brute(rows)
    assert (0, 0) in got and got[0, 0][1] == 3


def test_many_ends_in_one_node(spark, monkeypatch):
    """Pieces of ids join to the same digest, wherever they are cut."""
    monkeypatch.setattr(trie, "PIECE", 16)
    ends = spark.range(0, 3000).select(F.col("id").alias("conv_id"), (F.col("id") % 2).alias("depth"), *[F.lit(0).cast("long").alias(f"p{k}") for k in range(3)]).repartition(7)
    got = {r["depth"]: r["ends_sha256"] for r in trie.ends_digests(ends).collect()}
    assert got == {d: hashlib.sha256(",".join(map(str, range(d, 3000, 2))).encode()).hexdigest() for d in (0, 1)}


def test_empty(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
