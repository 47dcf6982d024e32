from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from symloom.llm import winnowing as X

COLUMNS = "doc_id long, text string, n_hit long, d1 long, fps string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    own, hit, ids = words(text), set(), set()
    for item, t in items:
        theirs = words(t)
        m = min(10, len(theirs))
        for i in range(len(theirs) - m + 1 if m else 0):
            for j in range(len(own) - m + 1):
                if own[j : j + m] == theirs[i : i + m]:
                    hit |= set(range(j, j + m))
                    ids.add("" if item is None else str(item))
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def check(spark, docs, items):
    df = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], COLUMNS).repartition(3)
    got = X.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = sorted(((d, *brute(t, items)) for d, t in docs), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=str) == want
    assert all(sum(s["stop"] - s["start"] for s in r["spans"] or ()) == r["n_hit"] for r in got)
    return want


@pytest.mark.parametrize(("seed", "vocabulary"), [(1, 3), (2, 400)])
def test_same_as_brute_force(spark, seed, vocabulary):
    """Texts with passages of items of 7 to 30 words; with three words, hits everywhere."""
    rnd = random.Random(seed)
    word = [f"{c}{i}" for i in range(vocabulary) for c in ("w",)] if vocabulary > 3 else ["a", "É", "7"]
    items = [(i, ", ".join(rnd.choices(word, k=rnd.choice([1, 2, 5, 7, 8, 9, 10, 11, 12, 18, 30]) if vocabulary > 3 else rnd.choice([9, 10, 14])))) for i in range(30)]
    items += [items[3], (40, items[5][1]), (41, None), (42, " - "), (None, items[6][1])]
    docs = []
    for i in range(120):
        own = rnd.choices(word, k=rnd.randint(0, 40))
        for _ in range(rnd.randint(0, 2)):
            source = words(rnd.choice(items)[1])
            a = rnd.randint(0, max(0, len(source) - 10))
            at = rnd.randint(0, len(own))
            own[at:at] = source[a : a + rnd.randint(7, 20)]
        docs.append((i, rnd.choice([" ", "; ", "\n"]).join(w.upper() if rnd.random() < 0.2 and w.isascii() else w for w in own)))
    docs += [(200, None), (201, ""), (None, docs[4][1]), docs[4], (202, docs[4][1])]
    want = check(spark, docs, items)
    assert 10 < sum(w[-1] for w in want) < len(want)


def test_long_texts_and_empty_tables(spark):
    rnd = random.Random(4)
    item = " ".join(f"i{k}" for k in range(25))
    text = " ".join(f"t{rnd.randint(0, 99)}" for _ in range(60000))
    docs = [(1, text + " " + item), (2, text), (3, item[: len(item) // 2])]
    assert [w[-1] for w in check(spark, docs, [(7, item)])] == [True, False, True]
    check(spark, docs, [])
    check(spark, [], [(7, item)])


def test_filter_leaves_the_others(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (None, "one two three"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("q", "TWO three")], "item_id string, text string")
    assert [r["doc_id"] for r in X.drop_contaminated(docs, items).orderBy("doc_id").collect()] == [2, 3]


def test_shared_spans_share_a_fingerprint():
    """The guarantee: ten words that two texts share give both the same fingerprint, at one word."""
    rnd = random.Random(6)
    for _ in range(300):
        span = [rnd.choice("abc") for _ in range(10)]
        places = []
        for _ in range(2):
            before = [rnd.choice("abc") for _ in range(rnd.randint(0, 9))]
            text = " ".join([*before, *span, *[rnd.choice("abc") for _ in range(rnd.randint(0, 9))]]).encode()
            hashes, n = X.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            fps, _, at = X.fingerprints_of(hashes, np.cumsum(n), (), None)
            places.append({(f, a - len(before)) for f, a in zip(fps.tolist(), at.tolist(), strict=True)})
        assert any(0 <= a <= 2 for _, a in places[0] & places[1])


def test_word_hashes():
    texts = ["Aé-b", "", "é7", "x", None, "x\x7fAé", "7"]
    (data, cuts), *rest = X._chunks(pa.array(texts)[0:])
    hashes, n = X.word_hashes(data, cuts)
    assert not rest and n.tolist() == [2, 0, 1, 1, 0, 2, 1]
    assert hashes[0] == hashes[5] and hashes[3] == hashes[4] and len(set(hashes.tolist())) == 5
