from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.llm import quality
from symloom.llm.quality import COUNTS, Condition, Rule, drop_bad, judge, learn, learn_rules, midpoints, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_repeats_stay_exact_with_many_words():
    rnd = random.Random(2)
    words = [str(i).encode() for i in range(9000)] + [str(rnd.randint(0, 9000)).encode() for _ in range(500)]
    words += words[100:107]
    assert repeated_words(words) == 14
    assert repeated_words([b"a"] * 5) == 0 and repeated_words([b"a"] * 6) == 6 and repeated_words([]) == 0


def test_query(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(96, 0, 0), (None, 0, 0), (3, None, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    rules = learn_rules(docs, labels)
    got = judge(docs, rules).collect()
    assert len(got) == len(rows)
    short = [r for r in rows if r[1] is None or len(r[1]) < 5000]
    want = sorted(str((r[0], *brute(r[1]))) for r in short)
    assert sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in got if r["doc_id"] != 94) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert judge(empty, rules).collect() == [] and learn_rules(empty, labels) == [] and learn_rules(docs, labels.where("false")) == []


def test_lines_count_once_each(spark):
    text = "a b\na b\n \n \na b\nc"
    r = judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), []).first()
    assert (r["n_dup_lines"], r["n_lines"], r["n_words"]) == (2, 4, 7)
    assert set(COUNTS) <= set(r.asDict())


def test_lists_are_learned_pruned_and_applied(spark):
    rng = np.random.default_rng(4)
    n = 3000
    table = {"symbols": rng.random(n), "capitals": rng.random(n), "noise": rng.random(n)}
    bad = (table["symbols"] > 0.8) | ((table["capitals"] > 0.7) & (table["symbols"] < 0.3))
    rules = learn(table, bad, rng.integers(0, 3, n))
    hit = np.logical_or.reduce([r.holds(table) for r in rules])
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.03 * hit.sum()
    assert learn(table, np.zeros(n, bool), rng.integers(0, 3, n)) == []
    shuffled = rng.random(n) < 0.3
    assert sum((r.holds(table)).sum() for r in learn(table, shuffled, rng.integers(0, 3, n))) < 0.02 * n
    good = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, good), (2, good.upper()), (3, None)], "doc_id long, text string")
    rule = Rule((Condition("capitals", True, 0.5), Condition("words", False, 100.0)))
    assert {r["doc_id"]: (r["kept"], r["rule"]) for r in judge(docs, [rule]).collect()} == {1: (True, 0), 2: (False, 1), 3: (False, -1)}
    assert [r["doc_id"] for r in drop_bad(docs, [rule]).collect()] == [1] and str(rule) == "capitals > 0.5 and words <= 100"


def test_thresholds_lie_in_the_middle():
    x, bad = np.array([0, 0, 0.1, 0.4, 0.5, 0.5]), np.array([0, 0, 0, 1, 1, 1], bool)
    assert midpoints(x, bad) == [(0.25, 0.30000000000000004)]
    assert midpoints(np.zeros(5), np.ones(5, bool)) == []
    mixed = midpoints(np.arange(1000.0), np.arange(1000) % 2 == 0)
    assert len(mixed) <= 64 and all(t % 1 == 0.5 for t, _ in mixed)


def test_no_rule_without_support():
    rng = np.random.default_rng(1)
    table = {"a": rng.random(400), "b": rng.random(400)}
    few = np.zeros(400, bool)
    few[:4] = True
    table["a"][:4] = 5
    assert learn(table, few, np.arange(400) % 3) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_rules_of_the_given_tables_hold_for_others(spark, sf):
    """A list learned from half of the labels judges the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    whole = learn_rules(docs, labels)
    assert [str(r) for r in whole] and str(whole[0]).startswith("symbols > 0.0")
    assert 0.02 < whole[0].conditions[0].limit < 0.08  # between none and the junk's share
    if sf == "sf0.001":
        return
    half = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(2)) == 0
    rules = learn_rules(docs, labels.where(half))
    rows = judge(docs, rules).join(labels.where(~half), "doc_id").where("not base_failed").collect()
    dropped = [r["quality"] for r in rows if not r["kept"]]
    bad = sum(r["quality"] == 0 for r in rows)
    assert bad >= 5 and dropped.count(0) >= 0.9 * bad and dropped.count(0) >= 0.95 * len(dropped)


def test_repeated_doc_ids_count_once(spark):
    """A document that stands there many times is one example, and pushes no other one out."""
    good = [(i, " ".join(f"w{i}_{k}" for k in range(40))) for i in range(60)]
    bad = [(100 + i, " ".join(f"w{i}_{k} ##$$%%" for k in range(40))) for i in range(30)]
    rows = [*good, *bad, *[good[0]] * 300, *[(0, f"another text under the first id {i} and some more words here") for i in range(50)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 100)) for d, _ in good + bad], "doc_id long, quality int")
    got = quality.labelled_counts(docs, labels, sample=90)
    assert got.count() == 90
    rules = quality.learn_rules(docs, labels, sample=90)
    kept = {r["doc_id"] for r in quality.judge(docs, rules).where("kept").collect()}
    assert kept == {d for d, _ in good}
