from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from symloom.llm import codebooks as C

SCHEMA = "vec_id long, embedding array<float>, label int, x int, codes string, error int"


def brute(rows):
    """Plain Lloyd over Python integers."""
    kept = [(v, [math.floor(1024 * x) for x in e], label) for v, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    part = lambda x, p: x[p * w : (p + 1) * w]
    books = [[part(x, p) for _, x, _ in kept[:256]] for p in range(4)]
    dist = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    near = lambda x, p: min((dist(part(x, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(4):
        codes = [[near(x, p)[1] for p in range(4)] for _, x, _ in kept]
        for p in range(4):
            for k in range(len(books[p])):
                own = [part(x, p) for (_, x, _), c in zip(kept, codes, strict=True) if c[p] == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = [[near(x, p) for p in range(4)] for _, x, _ in kept]
    errors = [sum(d for d, _ in r) for r in last]
    labels = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(i) for b in books for e in b for i in e).encode()).hexdigest()
    return sorted(((v, "".join(f"{k:02x}" for _, k in r), e, labels[label], digest) for (v, _, label), r, e in zip(kept, last, errors, strict=True)), key=str)


def got_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA).repartition(3)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in C.compress(df).collect()), key=str)


def vectors(seed, n, spread):
    rnd = random.Random(seed)
    return [(i * 3, [rnd.choice(spread) * rnd.random() if len(spread) > 2 else rnd.choice(spread) for _ in range(8)], rnd.choice([0, 0, 0, 1, None])) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "spread"), [(1, 500, [0.01, 0.1, -0.2]), (2, 400, [0.0, 0.001])])
def test_same_as_plain_lloyd(spark, seed, n, spread):
    """The second table has components 0 and 1 only: ties everywhere, many equal entries."""
    rows = vectors(seed, n, spread)
    assert got_of(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(3, 30, [0.5, -0.1, 2.0])
    rows += [(1, None, 0), (2, [0.1] * 7 + [None], 0), (4, [0.1] * 7 + [float("nan")], 0), (5, [float("-inf")] * 8, 1), rows[4], rows[4], (None, [0.25] * 8, 1), (-7, [0.5] * 8, 9)]
    assert got_of(spark, rows) == brute(rows)
    other = [(900, [0.1] * 7, 3), (901, [], 3), (902, [0.5] * 12, None)]
    got = {r[0]: r for r in got_of(spark, [*rows, *other])}
    assert {r[0]: r for r in brute(rows)}[-7] == got[-7]
    assert all(got[k][1] is None and got[k][2] is None for k in (900, 901, 902))
    assert got_of(spark, []) == [] and got_of(spark, rows[30:33]) == []
    assert [r[1:3] for r in got_of(spark, [(1, [], 0), (2, [], 0)])] == [("00000000", 0)] * 2


def test_bounds_hold_and_spare_distances():
    """After each move: codes of all distances, bounds below the true ones, far fewer distances."""
    rnd = np.random.default_rng(5)
    centers = rnd.integers(-900, 900, (40, 6))
    x = centers[rnd.integers(0, 40, 3000)] + rnd.integers(-30, 30, (3000, 6))
    book = x[:256].copy()
    group = C.entry_groups(book)
    n = int(group.max()) + 1
    code, bounds = C.scan_all(x, book, group, n)
    total = 0
    for _ in range(4):
        moved = book.copy()
        for k in range(256):
            if (code == k).any():
                moved[k] = x[code == k].sum(0) // (code == k).sum()
        drift = np.floor(np.sqrt(((moved - book) ** 2).sum(1))).astype(np.int64) + (moved != book).any(1)
        code, bounds, computed = C.scan_failed(x, code, bounds, moved, drift, group, n)
        total += computed
        book = moved
        d = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all()
        d[np.arange(len(x)), code] = np.iinfo(np.int64).max
        for g in range(n):
            if (group == g).any():
                assert (bounds[:, g] ** 2 <= d[:, group == g].min(1)).all()
    assert total < 4 * 3000 * 256 / 3


def test_large_components_are_exact_or_refused(spark):
    far = C.squares(np.array([[C.LIMIT - 1] * 3]), np.array([[1 - C.LIMIT] * 3]))
    assert far[0, 0] == 3 * (2 * C.LIMIT - 2) ** 2
    with pytest.raises(Exception, match="not supported"):
        got_of(spark, [(1, [70000.0] * 8, 0)])
