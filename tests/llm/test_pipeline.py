from __future__ import annotations

import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from symloom.llm import langid, mixing, quality  # noqa: E402
from symloom.llm.bpe_automaton import compiled  # noqa: E402
from symloom.llm.queries import queries, vocabulary  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SF).write.parquet(f"{folder}/{name}")
        out.append((docs, again := spark.read.parquet(f"{folder}/{name}")))
        docs = again
    return out


def test_stages_return_documents(stages):
    assert len(stages) == 5
    for before, after in stages[:4]:
        assert after.columns == before.columns


def test_filters_do_what_the_operators_say(spark, stages):
    before, after = stages[0]
    model = langid.train(langid.sample(before))
    want = {r["doc_id"] for r in langid.identify(before, model).where("not rejected").collect()}
    assert {r["doc_id"] for r in after.collect()} == want and len(want) > 150
    before, after = stages[1]
    rules = quality.learn_rules(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in quality.judge(before, rules).where("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == want


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_one_of_each_group_stays(stages):
    """Groups of texts of five-word similarity 0.8 or more, by comparing all pairs."""
    before, after = stages[2]
    left = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
    kept = {r["doc_id"] for r in after.collect()}
    groups = []
    while left:
        todo, group = [left.popitem()], []
        while todo:
            doc, a = todo.pop()
            group.append(doc)
            near = [d for d, b in left.items() if 5 * len(a & b) >= 4 * len(a | b)]
            todo += [(d, left.pop(d)) for d in near]
        groups.append(min(group))
    assert kept == set(groups) and after.count() == len(kept) < before.count()


def test_mix_comes_near_its_targets(stages):
    """Of each source: whole texts, a fraction of them by chance, so within a few texts' words."""
    before, after = stages[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, squares, taken = Counter(), Counter(), Counter()
    for r in before.collect():
        sizes[r["source"]] += size(r["text"])
        squares[r["source"]] += size(r["text"]) ** 2
    for r in after.collect():
        taken[r["source"]] += size(r["text"])
    goal = mixing.targets(dict(sizes))
    for s in sizes:  # the fraction's deviation is at most half a text's words each
        assert abs(taken[s] - goal[s]) < 4 * (squares[s] ** 0.5 / 2) + 3 * mixing.BLOCK


def write_tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(50)] + [(96, 0, 0), (None, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_over_odd_rows(spark, docs, rows, tmp_path):
    """Nulls, empty texts, repeated rows and columns with the names that stages use."""
    got = corpus_pipeline.run(spark, write_tables(spark, tmp_path, docs)).collect()
    assert set(got[0].asDict()) == {"doc_id", "source", "lang", "n_tokens", "ids_sha256", "decoded_sha256"}
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    assert got and all(r["n_tokens"] > 0 for r in got)
    assert not {r["doc_id"] for r in got} & {90, 91, 92, 95, 96}  # null, empty, no letters, junk
    bpe = compiled(vocabulary())
    for r in got:
        if r["doc_id"] not in (None, 5):
            assert r["n_tokens"] == len(bpe.encode(texts[r["doc_id"]]))


def test_run_over_an_empty_table(spark, empty, tmp_path):
    assert corpus_pipeline.run(spark, write_tables(spark, tmp_path, empty)).collect() == []


def test_last_stage_encodes(stages):
    before, after = stages[4]
    bpe = compiled(vocabulary())
    want = Counter((r["doc_id"], len(bpe.encode(r["text"]))) for r in before.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in after.collect()) == want


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 14))
