"""Attempts within a request, the checkpoint log, parser output that cannot be read, kept indexes."""

from __future__ import annotations

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from symloom.jobs.directory import run_directory
from symloom.operators import attempts as T
from symloom.operators import context as K
from symloom.operators import extract as E
from symloom.operators.answers import dispatch
from symloom.sources import files as S
from symloom.sources import statelog as L

COLUMNS = ["path", "batch_id", "body", "error"]
AGAIN, FATAL = "Error code: 429 - slow down", "OpenAI-compatible API returned no usable content"


def flaky(folder, times, error=AGAIN):
    """A naming function that fails ``times[batch]`` times for each request, counted in files."""

    def fn(frames):
        for f in frames:
            rows = []
            for path, batch in zip(f["path"], f["batch_id"], strict=True):
                mark = os.path.join(folder, batch)
                with open(mark, "a") as out:
                    out.write("x")
                n = os.path.getsize(mark)
                rows.append((path, batch, None, error) if n <= times.get(batch, 0) else (path, batch, "{}", None))
            yield pd.DataFrame(rows, columns=COLUMNS).assign(retry_after=None)

    return fn


def requests(spark, names):
    return spark.createDataFrame([("f", b, "x", {"s": "y"}) for b in names], "path string, batch_id string, context string, snippets map<string,string>")


def test_a_request_is_asked_until_it_is_answered(spark, tmp_path):
    times = {"twice": 2, "five": 5, "always": 99}
    names = ["good", *times, *[f"g{i}" for i in range(20)]]
    got = {r["batch_id"]: (r["attempt"], r["body"], r["error"]) for r in dispatch(requests(spark, names), flaky(str(tmp_path), times), 3, pace=0.01).collect()}
    assert (got["good"], got["twice"], got["five"], got["always"]) == ((1, "{}", None), (3, "{}", None), (6, "{}", None), (6, None, AGAIN))
    assert len(got) == len(names)
    assert os.path.getsize(tmp_path / "always") == 6 and os.path.getsize(tmp_path / "g7") == 1


def test_only_what_may_be_retried_is(spark, tmp_path):
    times = {"a": 1, "b": 1}
    got = dispatch(requests(spark, ["a", "b"]), flaky(str(tmp_path), times, FATAL), 2, pace=0.01).collect()
    assert {(r["batch_id"], r["attempt"], r["error"]) for r in got} == {("a", 1, FATAL), ("b", 1, FATAL)}
    assert T.may_be_retried("Rate limit reached") and not T.may_be_retried("rate limit: context length") and not T.may_be_retried(None) and not T.may_be_retried("bad key")


def test_delays(monkeypatch):
    monkeypatch.setattr(T.random, "uniform", lambda a, b: 0.0)
    assert [T.seconds_until(k) for k in range(1, 8)] == [1.5, 3, 6, 12, 24, 48, 60]
    assert [T.seconds_until(1, h) for h in (0.1, 7, 900, float("nan"))] == [1.0, 7.0, 120.0, 1.5]
    waits, clock = [], [0.0]
    monkeypatch.setattr(T.time, "monotonic", lambda: clock[0])
    monkeypatch.setattr(T.time, "sleep", lambda s: (waits.append(round(s, 3)), clock.__setitem__(0, clock[0] + s)))
    asked = []

    def fn(frames):
        for f in frames:
            asked.append(list(f["batch_id"]))
            yield pd.DataFrame([("f", b, None, AGAIN, {"h": 30.0}.get(b)) for b in f["batch_id"]], columns=[*COLUMNS, "retry_after"])

    frame = pd.DataFrame([("f", "h"), ("f", "d"), ("f", "e")], columns=["path", "batch_id"])
    out = pd.concat(T.with_attempts(fn, 3)(iter([frame])))
    # the delays are waited for in the order in which requests are due; the hint is the provider's
    assert asked == [["h", "d", "e"], ["d", "e"], ["d", "e"], ["h"], ["h"]] and [w for w in waits if w] == [1.5, 3.0, 25.5, 30.0]
    assert sorted(zip(out["batch_id"], out["asked"], strict=True)) == [("d", 3), ("e", 3), ("h", 3)]


HEAD = "input_file string, output_file string, total_scopes int, processed_scopes int, config map<string,string>, status string"


def heads(spark, rows):
    scopes = F.array().cast("array<struct<scope_id:string,scope_index:int,renames:map<string,string>>>")
    return spark.createDataFrame([(f, f, 10, n, {}, s) for f, n, s in rows], HEAD).withColumn("scope_renames", scopes).withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())


def renames(spark, rows):
    return spark.createDataFrame(rows, "path string, seq long, key string, new_name string")


def states(spark, folder):
    return {r["input_file"]: (r["processed_scopes"], r["status"], dict(r["all_renames"])) for r in L.read_log(spark, folder).collect()}


def test_log_is_the_state_after_all_rounds(spark, tmp_path):
    """Random rounds, with snapshots: the log reads as a plain map does; bytes are those of the new."""
    rnd, folder, want, sizes = random.Random(3), str(tmp_path / "log"), {}, []
    assert states(spark, folder) == {}
    L.append(heads(spark, [(f"f{i}", 0, "in_progress") for i in range(3)]), None, folder, fresh=True)
    want = {f"f{i}": (0, "in_progress", {}) for i in range(3)}
    for k in range(1, 9):
        file = f"f{rnd.randint(0, 2)}"
        new = [(file, s, f"k{rnd.randint(0, 12)}", f"n{k}_{s}") for s in range(3)]
        new = list({r[2]: r for r in new}.values())
        L.append(heads(spark, [(file, k, "in_progress")]), renames(spark, new), folder, every=4)
        want[file] = (k, "in_progress", want[file][2] | {r[2]: r[3] for r in new})
        assert states(spark, folder) == want
        sizes.append(sum(len(r["new"]) for r in spark.read.schema(L.ROW).parquet(L.versions(spark, folder)[-1][2]).collect()) if L.versions(spark, folder)[-1][1] == "delta" else 0)
    assert max(sizes) <= 3
    assert [kind for _, kind, _ in L.versions(spark, folder)].count("snapshot") == 2
    L.append(heads(spark, [("f1", 0, "in_progress")]), None, folder, fresh=True)  # begins anew
    want["f1"] = (0, "in_progress", {})
    assert states(spark, folder) == want
    assert {r["input_file"] for r in S.read_state(spark, folder).collect()} == set(want)


def test_readers_of_a_log_see_one_state(spark, tmp_path):
    folder = str(tmp_path / "log")
    L.append(heads(spark, [("f", 1, "in_progress")]), renames(spark, [("f", 0, "a", "x")]), folder, fresh=True)
    L.append(heads(spark, [("f", 2, "in_progress")]), renames(spark, [("f", 0, "b", "y")]), folder)
    reader = L.read_log(spark, folder)  # has chosen its versions
    L.compact(spark, folder)
    L.append(heads(spark, [("f", 3, "in_progress")]), renames(spark, [("f", 0, "a", "z")]), folder)
    os.makedirs(f"{folder}/{9:012d}-delta")  # a write that is not whole counts as absent
    assert [(r["processed_scopes"], dict(r["all_renames"])) for r in reader.collect()] == [(2, {"a": "x", "b": "y"})]
    assert states(spark, folder) == {"f": (3, "in_progress", {"a": "z", "b": "y"})}


def test_files_whose_parser_output_is_broken(spark, tmp_path):
    """Every file is in the summary: by the parser, by pattern where its JSON is broken or missing."""
    names = {"a": "first", "b": "second", "qq": "third"}

    def naming(frames):
        for f in frames:
            rows = [(p, b, json.dumps({s: names[s] for s in symbols}), None) for p, b, symbols in zip(f["path"], f["batch_id"], f["symbols"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "batch_id", "body", "error"])

    src, parsed = tmp_path / "src", tmp_path / "parsed"
    (src / "deep").mkdir(parents=True)
    (parsed / "deep").mkdir(parents=True)
    (src / "one.js").write_text("function f(a) { return a; }\nuse({a});")
    (src / "deep/two.js").write_text("var qq = 2; use(qq);")
    (src / "three.js").write_text("var b = 1;")
    scope = {"id": "scope_0", "type": "program", "range": {"start": {"row": 0, "column": 0}, "end": {"row": 1, "column": 9}}, "bindings": [], "children": ["scope_1"]}
    inner = {"id": "scope_1", "type": "function", "parentId": "scope_0", "range": {"start": {"row": 0, "column": 0}, "end": {"row": 0, "column": 27}}, "bindings": [{"name": "a", "line": 0, "column": 11, "type": "parameter"}], "children": []}
    (parsed / "one.js.json").write_text(json.dumps({"scopes": {"scope_0": scope, "scope_1": inner}}))
    (parsed / "deep/two.js.json").write_text('{"scopes": {"scope_0": ')
    assert S.read_parse_files(spark, str(parsed)).where("error is not null").count() == 1
    assert S.read_parse_json(spark, str(parsed))[0].count() == 2
    got = run_directory(spark, str(src), str(tmp_path / "work"), naming, 1, str(tmp_path / "out"), parsed=str(parsed))
    rows = {r["path"].rpartition("/")[2]: (r["status"], r["symbols_renamed"], r["note"]) for r in got.collect()}
    assert rows == {"one.js": ("ok", 1, None), "two.js": ("ok", 1, "parser output is not a JSON object"), "three.js": ("ok", 1, "no parser output")}
    assert (tmp_path / "out/one.js").read_text() == "function f(first) { return first; }\nuse({a: first});"  # undeclared: the entry of the file
    assert (tmp_path / "out/deep/two.js").read_text() == "var third = 2; use(third);" and (tmp_path / "out/three.js").read_text() == "var second = 1;"


@pytest.mark.parametrize("seed", [1, 2])
def test_an_index_that_follows_changed_lines(spark, seed):
    rnd = random.Random(seed)
    texts = {("f" + str(i % 2), i // 2): " ".join(rnd.choices(["a", "b.c", "$d", "e", "1x"], k=4)) for i in range(40)}
    frame = lambda t: spark.createDataFrame([(p, n, x) for (p, n), x in t.items()], "path string, line int, text string")
    index, hits = E.line_names(frame(texts)), None
    for k in range(2):
        some = [("f" + str(rnd.randint(0, 1)), rnd.randint(0, 19), 0, f"n{rnd.randint(0, 2)}{k}") for _ in range(6)]
        before, hits = hits, spark.createDataFrame(list({x[:2]: x for x in some}.values()), "path string, line int, column int, new_name string")
        now = texts | {(r["path"], r["line"]): r["new_name"] + " z" for r in hits.collect()}
        changed = K.changed_lines(before, hits)
        index = E.updated_names(index, frame(now), changed)
        assert sorted(map(tuple, index.collect())) == sorted(map(tuple, E.line_names(frame(now)).collect()))
        names = spark.createDataFrame([("f0", "a"), ("f1", "z")], "path string, name string")
        assert sorted(map(tuple, E.occurrences(frame(now), names, index).collect())) == sorted(map(tuple, E.occurrences(frame(now), names).collect()))
