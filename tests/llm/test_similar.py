from __future__ import annotations

import random
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest

from symloom.llm import similar as S
from symloom.llm.queries import keep_one_of_near_duplicates

COLUMNS = "doc_id long, text string"


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept(rows):
    """Least doc_ids of the groups, by comparing all pairs."""
    left, out = {d: sets(t) for d, t in rows}, []
    while left:
        todo, group = [left.popitem()], []
        while todo:
            doc, a = todo.pop()
            group.append(doc)
            near = [d for d, b in left.items() if len(a & b) * 5 >= len(a | b) * 4]
            todo += [(d, left.pop(d)) for d in near]
        out.append(min(group))
    return sorted(out)


@pytest.fixture(scope="module")
def planted():
    """Texts of 100 and 400 words with copies of similarity 0.75 to 0.97, a chain, and odd texts."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows, near = [], []
    for i in range(60):
        own = rnd.choices(words, k=100 if i % 2 else 400)
        copy = list(own)
        for at in rnd.sample(range(5, len(own) - 5), rnd.randint(1, 2) if i % 2 else rnd.randint(1, 9)):
            copy[at] = "changed"
        rows += [(i, " ".join(own)), (100 + i, " ".join(copy))]
        a, b = sets(rows[-2][1]), sets(rows[-1][1])
        if 0.8 <= len(a & b) / len(a | b) < 0.95:
            near.append(100 + i)
    step = rnd.choices(words, k=120)
    for i in range(30):
        rows.append((300 + i, " ".join(step)))
        step[(i * 7) % 110] = f"s{i}"
    rows += [(400, None), (401, ""), (402, " \n"), (403, "two words"), (404, "Two  words"), (405, "other words")]
    return rows, near


def test_stage_drops_copies_from_four_fifths(spark, planted):
    rows, near = planted
    got = sorted(r["doc_id"] for r in keep_one_of_near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), "").collect())
    assert len(near) > 20 and not set(near) & set(got)
    assert got == kept(rows)


@pytest.mark.parametrize(("part", "sets"), [(4096, 512), (20, 16)])
def test_large_keys_are_cut(spark, part, sets):
    """Texts that mostly are one common passage: many sets a key, of several groups."""
    rnd = random.Random(8)
    base = [rnd.choices([f"v{i}" for i in range(500)], k=60) for _ in range(2)]
    rows = []
    for i in range(120):
        own = list(base[i % 2])
        for at in rnd.sample(range(60), rnd.randint(0, 3)):
            own[at] = f"x{i}"
        rows.append((i, " ".join(own)))
    want = kept(rows)
    assert 2 < len(want) < 100
    got = S.similar_groups(spark.createDataFrame(rows, COLUMNS), part=part, sets=sets).collect()
    least: dict = {}
    for r in got:
        least[r["group"]] = min(r["doc_id"], least.get(r["group"], r["doc_id"]))
    assert sorted(least.values()) == want


def changed(rnd, own, n):
    copy = list(own)
    for at in rnd.sample(range(len(own)), n):
        copy[at] = f"c{rnd.random()}"
    return copy


def test_near_sets_meet_and_pass():
    """Pairs just above the similarity share two anchors and lie within the radius; others do not."""
    rnd, near, met, far = random.Random(5), 0, 0, 0
    for i in range(600):
        own = [f"w{rnd.random()}" for _ in range(rnd.choice([14, 40, 120, 400]))]
        a = S.shingles_of(" ".join(own))
        b = S.shingles_of(" ".join(changed(rnd, own, max(1, len(own) // 50))))
        other = S.shingles_of(" ".join(changed(rnd, own, len(own) // 5)))
        distance = lambda x, y: sum(int(p ^ q).bit_count() for p, q in zip(S.fingerprint_of(x).tolist(), S.fingerprint_of(y).tolist(), strict=True))
        if S.is_near(a, b):
            near += 1
            met += (S.anchors_of(a) == S.anchors_of(b)).sum() >= 2 and distance(a, b) <= S.RADIUS
        far += len(own) > 14 and distance(a, other) <= S.RADIUS
    assert near > 200 and met == near and far < 20


@pytest.mark.parametrize("n", [2, 65, 200])
def test_wide_bit_sliced_comparison(n):
    rng = np.random.default_rng(n)
    own = rng.integers(0, 1 << 63, (1, S.LONGS), dtype=np.uint64).repeat(n, axis=0)
    for i in range(n):
        for at in rng.integers(0, 64 * S.LONGS, rng.integers(0, 90)).tolist():
            own[i, at // 64] ^= np.uint64(1 << at % 64)
    planes = S.BitPlanes(own)
    for radius in (4, 7, 8, 40, 72, 100, 255):
        for lag in {1, n // 2, n - 1} - {0}:
            wanted = rng.random(n - lag) < 0.8
            want = [i for i in range(n - lag) if wanted[i] and sum(int(x).bit_count() for x in own[i] ^ own[i + lag]) <= radius]
            assert planes.within(lag, wanted, radius).tolist() == want


def test_whole_blocks():
    rnd = random.Random(1)
    keys = sorted(rnd.randint(0, 20) for _ in range(500))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7]), pa.array(range(i, min(i + 7, 500)))], names=["k", "i"]) for i in range(0, 500, 7)]
    got = [t.to_pydict() for t in S.whole_blocks(iter(batches), ["k"], 30, 1 << 30)]
    assert [i for t in got for i in t["i"]] == list(range(500)) and len(got) > 5
    assert all(not set(a["k"]) & set(b["k"]) for a, b in pairwise(got))


def test_odd_tables(spark, docs, empty):
    assert S.drop_similar(empty).collect() == []
    kept_rows = S.drop_similar(docs).collect()
    assert kept_rows[0].asDict().keys() == docs.first().asDict().keys()
    sets_of = [sets(r["text"]) for r in kept_rows]
    assert all(len(a & b) * 5 < len(a | b) * 4 for i, a in enumerate(sets_of) for b in sets_of[:i])
