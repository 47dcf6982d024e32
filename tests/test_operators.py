from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from symloom.jobs.chain import Chain
from symloom.jobs.rounds import rename_all
from symloom.operators import answers as A
from symloom.operators import batching as B
from symloom.operators import context as K
from symloom.operators import extract as E
from symloom.operators import indexes as D
from symloom.sources import files as S
from symloom.streaming import progress as P

SAMPLE = "var a = 1;\nfunction first(b, c) {\n  let dd = a + b; const e = c;\n  // the function has a name\n  return a.b + dd;\n}\nvar o = {a: 1};\n"
BINDING = "path string, scope_id string, binding_seq int, name string, line int, column int, binding_type string"


def text_lines(spark, text, path="f"):
    return S.explode_lines(spark.createDataFrame([(path, text)], "path string, source string"))


def test_lines(spark):
    got = text_lines(spark, "a\n\nb\n").orderBy("line").collect()
    assert [(r["line"], r["text"]) for r in got] == [(0, "a"), (1, ""), (2, "b"), (3, "")]
    assert [r["text"] for r in text_lines(spark, "").collect()] == [""]
    end = S.program_scopes(text_lines(spark, "ab\ncd\nxyz")).first()
    assert (end["end_row"], end["end_col"]) == (2, 3)


def test_bindings(spark):
    got = E.extract_bindings(text_lines(spark, SAMPLE)).orderBy("line", "seq").collect()
    assert [(r["name"], r["line"], r["column"], r["binding_type"]) for r in got] == [("a", 0, 4, "variable"), ("first", 1, 9, "function"), ("dd", 2, 6, "variable"), ("e", 2, 24, "variable"), ("has", 3, 18, "function"), ("o", 6, 4, "variable")]


def test_occurrences(spark):
    lines = text_lines(spark, "var di = 1;\nobj.di = 2;\nconsole.log(di);\nconst x = di + 1;")
    names = spark.createDataFrame([("f", "di")], "path string, name string")
    assert [r["line"] for r in E.occurrences(lines, names).orderBy("line").collect()] == [0, 2, 3]


def test_global_context(spark):
    rows = [f"filler_{i}();" for i in range(119)]
    rows[20], rows[58], rows[95] = "var di = create();", "use(di);", "other(di);"
    lines = text_lines(spark, "\n".join(rows))
    bindings = spark.createDataFrame([("f", "scope_0", 1, "di", 20, 4, "variable", [])], BINDING + ", reference_lines array<int>")
    symbols = bindings.select("path", "name", "line")
    got = K.global_context(symbols, bindings, lines, 40).first()["context"]
    assert "Declaration line: 21\n" in got and "Reference lines: 59, 96\n" in got and "    21 | var di = create();" in got
    assert len(got.split("\n")) <= 43
    snippet = K.global_snippets(symbols, bindings, lines).first()["snippet"]
    assert snippet.startswith("Declaration:\n") and "Reference 1 (line 59):" in snippet



def model(renames, bindings):
    """The sequential rule for one file, plain."""
    scope_of, names, lines = {}, {}, {}
    for scope, name, line in bindings:
        scope_of[name, line] = scope
        names.setdefault(scope, set()).add(name)
        lines.setdefault(name, []).append(line)

    def scope(key):
        name, sep, n = key.rpartition(":")
        if sep and name and n.isdigit():
            return name, scope_of.get((name, int(n) - 1))
        return key, scope_of.get((key, lines[key][0])) if len(lines.get(key, [])) == 1 else None

    leaving: dict = {}
    for k in renames:
        name, s = scope(k)
        if s:
            leaving.setdefault(s, set()).add(name)
    used: dict = {}
    out = {}
    for k, new in renames.items():
        _, s = scope(k)
        if not s:
            out[k] = (new, "accepted")
            continue
        blocked = names.get(s, set()) - leaving.get(s, set()) | used.setdefault(s, set())
        got, i = new, 1
        while got in blocked:
            got, i = f"{new}_{i}", i + 1
        used[s].add(got)
        out[k] = (got, "accepted" if got == new else "adjusted")
    return out


@pytest.mark.parametrize("seed", range(2))
def test_global_conflicts(spark, seed):
    rnd = random.Random(seed)
    pool = ["a", "b", "value", "value_1", "x", "item"]
    rows, renames, want = [], [], {}
    for f in range(8):
        bindings = [(f"s{rnd.randint(0, 2)}", rnd.choice(pool), rnd.randint(0, 5)) for _ in range(10)]
        rows += [(f"f{f}", s, i, n, line, 0, "variable") for i, (s, n, line) in enumerate(bindings)]
        keys = list(dict.fromkeys(rnd.choice([n, f"{n}:{line + 1}", "ghost"]) for _, n, line in bindings))
        asked = {k: rnd.choice(["value", "value_1", "x", "y"]) for k in keys}
        renames += [(f"f{f}", i, k, v) for i, (k, v) in enumerate(asked.items())]
        want |= {(f"f{f}", k): v for k, v in model(asked, bindings).items()}
    got = A.resolve_global_conflicts(spark.createDataFrame(renames, "path string, seq long, key string, new_name string"), spark.createDataFrame(rows, BINDING)).collect()
    assert {(r["path"], r["key"]): (r["new_name"], r["outcome"]) for r in got} == want and len(got) == len(want)


def test_keys_fold(spark):
    counts = spark.createDataFrame([("f", "a__u1", 1), ("f", "a__u2", 1), ("f", "b", 2)], "path string, name string, n long")
    renames = spark.createDataFrame([("f", 0, "a__u1:2", "firstValue"), ("f", 1, "a__u2:3", "paramValue"), ("f", 2, "b:1", "x"), ("f", 3, "b:9", "y"), ("f", 4, "a__u2", "plain")], "path string, seq long, key string, new_name string")
    got = {r["key"]: r["new_name"] for r in A.normalize_keys(renames, counts).collect()}
    assert got == {"a__u1": "firstValue", "a__u2": "plain", "b:1": "x", "b:9": "y"}


@pytest.mark.parametrize("seed", range(2))
def test_unique_names(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"f{rnd.randint(0, 3)}", "s", i, rnd.choice(["a", "a__u1", "a__u2", "a__u4", "b", "b__u1"]), rnd.randint(0, 40), rnd.randint(0, 9), "variable") for i in range(150)]
    got = D.uniquify(spark.createDataFrame(rows, BINDING)).collect()
    want = set()
    once = sorted({(r[0], r[3], r[4], r[5]) for r in rows})
    for path, name in {(r[0], r[1]) for r in once}:
        members = [r for r in once if r[:2] == (path, name)]
        if len(members) > 1:
            used, k = {r[1] for r in once if r[0] == path}, 0
            for m in members:
                k += 1
                while f"{name}__u{k}" in used:
                    k += 1
                want.add((*m, f"{name}__u{k}"))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


SCOPE = "path string, scope_id string, scope_seq int, scope_type string, start_row int, start_col int, end_row int, end_col int, parent_id string, children array<string>"


def rewritten(spark, text, renames, scopes=None, bindings=None):
    """Lines of one file after renames ``(symbol, line from 1 or None, new name)``."""
    return rewritten_files(spark, [(text, renames)], scopes, bindings)[0]


def rewritten_files(spark, cases, scopes=None, bindings=None):
    """Lines of several files, each with its renames."""
    path = lambda i: "f" if i == 0 else f"f{i}"
    lines = S.explode_lines(spark.createDataFrame([(path(i), t) for i, (t, _) in enumerate(cases)], "path string, source string"))
    if scopes is None:
        bindings = E.extract_bindings(lines, ("variable",)).withColumn("binding_seq", F.col("line"))
        scopes = S.program_scopes(lines)
    tokens = E.tokens(lines, scopes, bindings)
    given = spark.createDataFrame([(path(i), *r) for i, (_, own) in enumerate(cases) for r in own], "path string, symbol string, line int, new_name string")
    rows = K.apply_renames(lines, tokens, given).orderBy("line").collect()
    return [[r["text"] for r in rows if r["path"] == path(i)] for i in range(len(cases))]


def test_apply_renames(spark):
    odd = 'var a = {a: 1, b: a.a}; f("a", \'a\', a ? a : b); // a\nnothing'
    cases = [
        ("var a = 1; console.log(a);", [("a", None, "value")], ["var value = 1; console.log(value);"]),
        ("var a = 1;\nvar a = 2;\nconsole.log(a);", [("a", 2, "second_a")], ["var a = 1;", "var second_a = 2;", "console.log(second_a);"]),
        ("var ab = 1; var abc = 2;", [("ab", None, "first")], ["var first = 1; var abc = 2;"]),
        ("var a = 1; var b = 2; console.log(a + b);", [("a", None, "first"), ("b", None, "second")], ["var first = 1; var second = 2; console.log(first + second);"]),
        ("var a = 1;", [], ["var a = 1;"]),
        (odd, [("a", None, "x"), ("f", None, "call"), ("b", 9, "no")], ['var x = {a: 1, b: x.a}; call("a", \'a\', x ? x : b); // a', "nothing"]),
        ("var a = 1;\nf({a}); /* about\n a here */ g(`a ${a}\n a`, /a/);", [("a", None, "n")], ["var n = 1;", "f({a: n}); /* about", " a here */ g(`a ${n}", " a`, /a/);"]),
        ("class C { a() {} }\nvar a = {a() {}, b: a};\nexport {a};", [("a", None, "n")], ["class C { a() {} }", "var n = {a() {}, b: n};", "export {n as a};"]),
    ]
    assert rewritten_files(spark, [c[:2] for c in cases]) == [c[2] for c in cases]


def test_references_take_their_own_declaration(spark):
    text = "var a = 1;\nfunction g(a) {\n  { let a = 2; use(a); }\n  return a;\n}\nuse(a);"
    scopes = [("f", "scope_0", 0, "program", 0, 0, 5, 7, None, ["scope_1"]), ("f", "scope_1", 1, "function", 1, 0, 4, 1, "scope_0", ["scope_2"]), ("f", "scope_2", 2, "block", 2, 2, 2, 24, "scope_1", [])]
    rows = [("f", "scope_0", 1, "a", 0, 4, "variable"), ("f", "scope_0", 2, "g", 1, 9, "function"), ("f", "scope_1", 3, "a", 1, 11, "parameter"), ("f", "scope_2", 4, "a", 2, 8, "variable")]
    scopes, bindings = spark.createDataFrame(scopes, SCOPE), spark.createDataFrame(rows, BINDING)
    got = rewritten(spark, text, [("a", 1, "top"), ("a", 2, "given"), ("a", 3, "inner")], scopes, bindings)
    assert got == ["var top = 1;", "function g(given) {", "  { let inner = 2; use(inner); }", "  return given;", "}", "use(top);"]
    assert rewritten(spark, text, [("a", 2, "given")], scopes, bindings)[3:] == ["  return given;", "}", "use(a);"]


def test_merge_of_function_locals(spark):
    text = "function g(a) {\n  try { f(a) } catch (e) {\n    const d = e;\n  }\n}\n"
    scopes = [("f", "scope_0", 0, "program", 0, 5, None, ["scope_1"]), ("f", "scope_1", 1, "function", 0, 4, "scope_0", ["scope_2"]), ("f", "scope_2", 2, "catch", 1, 3, "scope_1", [])]
    scopes = spark.createDataFrame(scopes, "path string, scope_id string, scope_seq int, scope_type string, start_row int, end_row int, parent_id string, children array<string>")
    rows = [("f", "scope_0", 1, "g", 0, 9, "function"), ("f", "scope_1", 2, "a", 0, 11, "parameter"), ("f", "scope_2", 3, "e", 1, 23, "parameter"), ("f", "scope_2", 4, "d", 2, 10, "variable")]
    got = B.analyze(spark.createDataFrame(rows, BINDING), scopes, text_lines(spark, text)).orderBy("batch_seq").collect()
    assert [(r["batch_id"], [i["name"] for i in r["identifiers"]]) for r in got] == [("scope_1_local_merge", ["a", "e", "d"]), ("scope_0_program_batch_0", ["g"])]


def test_rename_until_done(spark):
    text = "var a = 1;\nvar b = a;\nvar c = b;\n"
    lines = text_lines(spark, text)
    bindings = E.extract_bindings(lines).withColumn("binding_seq", F.col("line")).withColumn("reference_lines", F.array().cast("array<int>"))
    scopes = S.program_scopes(lines)

    def fn(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame([(p, b, "{" + ", ".join(f'"{s}": "value"' for s in symbols) + "}", None) for p, b, symbols in zip(f["path"], f["batch_id"], f["symbols"], strict=True)], columns=["path", "batch_id", "body", "error"])

    # the smallest batch is asked first, so c has the name when a and b want it
    got = rename_all(bindings, scopes, lines, fn, 1, program_max=2)
    assert {r["key"]: r["new_name"] for r in got.renames.collect()} == {"c": "value", "a": "value_1", "b": "value_2"}
    assert got.remaining.isEmpty()


def test_dispatch_asks_once_more_when_too_long(spark):
    requests = spark.createDataFrame([("f", "b1", "x" * 9000, {"s": "y" * 3000}), ("f", "b2", "x", {"s": "y"})], "path string, batch_id string, context string, snippets map<string,string>")

    def fn(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame([(p, b, None if len(c) > 8000 else f"{len(c)}", "input length" if len(c) > 8000 else None) for p, b, c in zip(f["path"], f["batch_id"], f["context"], strict=True)], columns=["path", "batch_id", "body", "error"])

    got = {r["batch_id"]: (r["attempt"], r["body"], r["error"]) for r in A.dispatch(requests, fn, 2).collect()}
    assert got == {"b1": (2, "8000", None), "b2": (1, "1", None)}


def test_throttle(spark):
    times = [0, 50, 199, 200, 350, 401, 402]
    events = spark.createDataFrame([("f", i, t) for i, t in enumerate(times)], "path string, seq long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    assert [r["ms"] for r in P.throttle(events).orderBy("ms").collect()] == [0, 200, 401, 402]


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [("f", '__PROGRESS__{"event":"started","totalBindingsToRename":2}'), ("f", '__PROGRESS__{"event":"rename_progress","renamedBindings":1,"totalBindingsToRename":2}'), ("g", "noise"), ("g", '__PROGRESS__{"event":""}'), ("g", '__PROGRESS__{"event":7}'), ("g", "__PROGRESS__")]
    lines = spark.createDataFrame(rows, "path string, raw string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    lines.write.parquet(str(tmp_path / "in"))
    stream = P.progress_latest(P.parse_progress(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))))
    run = stream.writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    batch = P.progress_latest(P.parse_progress(lines)).collect()
    assert [tuple(r) for r in spark.table("latest").collect()] == [tuple(r) for r in batch] == [("f", 1, 2)]


def test_stall_sessions(spark, tmp_path):
    events = spark.createDataFrame([("f", s) for s in (0, 10, 500, 510)], "path string, s long").select("path", F.timestamp_seconds("s").alias("ts"))
    got = P.stall_sessions(events, "300 seconds").orderBy("first_ts").collect()
    assert [r["n_events"] for r in got] == [2, 2]


def test_chain_order(spark):
    add = lambda x: lambda d: d.withColumn("s", F.concat("s", F.lit(x)))
    chain = Chain().add(add("late"), 200).add(add("b")).add(add("c")).add(add("never"), 1, lambda d: False) | Chain().add(add("a"), 5)
    assert chain.run(spark.createDataFrame([("",)], "s string")).first()["s"] == "abclate"
