from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from symloom.llm import simhash as S


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=3):
    values = sorted(set(prints.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def clustered(rng, n):
    centers = rng.integers(0, 1 << 63, max(1, n // 12), dtype=np.uint64)
    out = rng.choice(centers, n)
    for _ in range(3):
        out ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return out


@pytest.mark.parametrize("n", [2, 63, 64, 65, 300])
@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_comparison(n, radius):
    rng = np.random.default_rng(n + radius)
    own = clustered(rng, n)
    planes = S.BitPlanes(own)
    for lag in {1, 2, n // 2, n - 1} - {0}:
        wanted = rng.random(n - lag) < 0.8
        want = [i for i in range(n - lag) if wanted[i] and int(own[i] ^ own[i + lag]).bit_count() <= radius]
        assert planes.within(lag, wanted, radius).tolist() == want


def test_shingles(rows):
    for _, text, *_ in rows:
        assert S.simhash_of(text) == fingerprint(text)


def test_masks_cover_every_pair():
    masks = [m & (1 << 64) - 1 for m in S.block_masks()]
    rng = np.random.default_rng(0)
    for _ in range(500):
        flip = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not flip & m for m in masks)


@pytest.mark.parametrize("part", [20, 4096])
def test_links_and_components(spark, part):
    own = np.unique(clustered(np.random.default_rng(9), 700)).view(np.int64).tolist()
    own += [(own[0] ^ (i << 40)) for i in range(1, 60)]  # one key holds many
    own = sorted(set(own))
    links = S.near_links(spark.createDataFrame([(x,) for x in own], "fp long"), part=part)
    found = {r["node"]: r["root"] for r in S.connected_components(links).collect()}
    want = components({i: x & (1 << 64) - 1 for i, x in enumerate(own)})
    groups = {}
    for x in own:
        groups.setdefault(want[x & (1 << 64) - 1], []).append(x)
    assert {tuple(sorted(g)) for g in groups.values() if len(g) > 1} == {tuple(sorted(x for x in found if found[x] == r)) for r in set(found.values())}
    assert all(r == min(x for x in found if found[x] == r) for r in set(found.values()))


def test_components_of_a_chain(spark):
    chain = [(i + 1, i) for i in range(60)]
    got = S.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(i, 0) for i in range(61)}


def test_query(docs, rows, empty):
    got = S.near_duplicates(docs).collect()
    prints = {i: fingerprint(r[1]) for i, r in enumerate(rows)}
    root = components(prints)
    first: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            first[root[prints[i]]] = min(first.get(root[prints[i]], r[0]), r[0])
    want = sorted((str(r[0]), f"{prints[i]:016x}", str(first.get(root[prints[i]]))) for i, r in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert S.near_duplicates(empty).collect() == []


def test_one_of_each_stays(docs, rows, empty):
    got = S.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert {r["_k_digest"] for r in kept} == {"k"}
    prints = {i: fingerprint(r[1]) for i, r in enumerate(rows)}
    root = components(prints)
    assert sorted(root[fingerprint(r["text"])] for r in kept) == sorted(set(root.values()))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root[prints[i]], []).append(r[0])
    for r in kept:
        ids = [x for x in groups[root[fingerprint(r["text"])]] if x is not None]
        assert r["doc_id"] == (min(ids) if ids else None)
    assert S.drop_near_duplicates(empty).collect() == []
