"""What grows with the tables: broadcasts, shuffles of the derived tables, files of a tree."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from symloom.jobs import inputs as I
from symloom.jobs import registry as R
from symloom.operators import answers as A
from symloom.operators import batching as B
from symloom.operators import context as K
from symloom.sources import files as S
from symloom.storage import materialize

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_small_files_of_many_rows_are_not_broadcast(spark):
    I.Tables(spark, SF)
    keys = materialize(spark.range(400_000).select(F.concat(F.lit("f"), F.floor(F.col("id") / 1000)).alias("path"), (F.col("id") % 7).alias("line")), "keys")
    assert "BroadcastHashJoin" not in planned(keys.join(keys.select("path").distinct(), "path"))
    assert "BroadcastHashJoin" in planned(keys.join(F.broadcast(keys.select("path").distinct()), "path"))


def test_derived_tables_are_read_from_one(spark):
    t = I.Tables(spark, SF)
    for got, sql in ((t.rows(), I.BINDINGS), (t.lines(), I.LINES), (t.sql(I.SCOPES), I.SCOPES), (t.sql(I.FINE_SCOPES), I.FINE_SCOPES), (t.sql(I.RENAMES), I.RENAMES)):
        want = spark.sql(sql, lineitem=t.given("lineitem"))
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert "Window" not in planned(got)


def exchanges(df):
    I.Tables(df.sparkSession, SF)  # broadcasts go by measure
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_trees_are_written_without_a_commit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "shared_dir", lambda _: str(tmp_path))
    found = R.queries()["read_sources"](spark, SF), *(R.queries()[f"read_parse_json_{x}"](spark, SF) for x in ("scopes", "bindings"))
    assert all(f.count() > 0 for f in found)
    assert not list(tmp_path.rglob("_SUCCESS")) and list(tmp_path.rglob("path=*.txt")) and list(tmp_path.rglob("path=*.json"))


def test_written_files_do_not_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "shared_dir", lambda _: str(tmp_path))
    got = R.queries()["write_sources"](spark, SF)
    assert got.count() > 1000
    assert not [x for x in tmp_path.rglob("*") if x.is_file()]  # a file a path before, each a block of the disk


def test_passing_files_are_read_from_few_at_once(tmp_path, monkeypatch):
    most, put = [], S._put

    def counted(*args):
        put(*args)
        most.append(len([x for x in tmp_path.rglob("*") if x.is_file()]))

    monkeypatch.setattr(S, "_put", counted)
    rows = [(f"out/{i % 3}/f{i}.js", f"\u00e4{i}\r\n//" if i else None) for i in range(10)]
    batches = [pa.RecordBatch.from_pylist([{"path": p, "source": s} for p, s in part]) for part in (rows[:7], rows[7:])]
    found = [r for b in S._passed(iter(batches), str(tmp_path), 3) for r in b.to_pylist()]
    assert sorted((r["path"], r["source"]) for r in found) == sorted((p, s or "") for p, s in rows)
    assert max(most) == 3 and len(most) == 10 and not list(tmp_path.iterdir())


def test_passing_files_are_dealt_over_tasks(spark, tmp_path):
    files = spark.range(40).select(F.concat(F.lit("a b/"), "id", F.lit(".js")).alias("path"), F.concat(F.lit("x"), "id").alias("source")).coalesce(1)
    got = S.pass_sources(files, f"file:{tmp_path}", 4)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.path, r.source) for r in got.collect()} == {(f"a b/{i}.js", f"x{i}") for i in range(40)}


def test_conflicts_shuffle_what_clashes_only(spark):
    bindings = spark.createDataFrame([("f", "s", i, n, i) for i, n in enumerate("abcd")], "path string, scope_id string, binding_seq int, name string, line int")
    renames = spark.createDataFrame([("f", i, n, new, i + 1) for i, (n, new) in enumerate([("a", "x"), ("b", "x"), ("c", "d")])], "path string, seq long, key string, new_name string, line int")
    got = A.resolve_conflicts(renames, bindings, ("path",))
    assert {(r.key, r.new_name, r.outcome, r.line) for r in got.collect()} == {("a", "x", "accepted", 1), ("b", "x_1", "adjusted", 2), ("c", "d_1", "adjusted", 3)}
    assert exchanges(got) <= 45  # those of the clashing groups; 104 before


def test_snippets_shuffle_lines_once(spark):
    lines = spark.range(3000).select(F.concat(F.lit("f"), F.floor(F.col("id") / 3000)).alias("path"), F.col("id").cast("int").alias("line"), F.concat(F.lit("t"), "id").alias("text")).where("line <> 1023")
    ids = spark.createDataFrame([("f0", n) for n in (0, 1021, 1022, 1023, 1024, 2999, 3001, 5000)], "path string, line int")
    got = K.line_snippets(ids, lines)
    assert exchanges(got) <= 2
    found = {r.line: [int(x.split("t")[1]) for x in r.snippet.split("\n")] for r in got.collect()}
    near = lambda n: [i for i in range(n - 3, n + 4) if 0 <= i < 3000 and i != 1023]
    assert found == {n: near(n) for n in (0, 1021, 1022, 1023, 1024, 2999, 3001)}


def test_contexts_meet_lines_by_packs(spark):
    lines = spark.range(300).select(F.lit("f").alias("path"), F.col("id").cast("int").alias("line"), F.concat(F.lit("t"), "id").alias("text"))
    batches = spark.createDataFrame([("f", "b", 60, 140, [(100,)]), ("f", "c", 290, 400, [(299,)])], "path string, batch_id string, start_row int, end_row int, identifiers array<struct<line:int>>")
    for got in (K.scope_context(batches, lines, 500), K.small_scope_context(batches, lines, 500)):
        assert "line#" not in "".join(x for x in planned(got).split("\n") if "Join" in x)
        found = {r.batch_id: [int(x.split("t")[1]) for x in r.context.split("\n")] for r in got.collect()}
        assert found == {"b": list(range(50, 150)), "c": list(range(280, 300))}


def test_batches_are_placed_from_a_written_table(spark):
    ids = spark.range(200).select(F.lit("f").alias("path"), F.concat(F.lit("b"), F.col("id") % 20).alias("batch_id"), (F.col("id") % 20).cast("int").alias("start_row"))
    batches = ids.groupBy("path", "batch_id", "start_row").agg(F.count("*").cast("int").alias("n_identifiers")).withColumn("end_row", F.col("start_row") + 1)
    got = B.order_batches(batches)
    assert "Aggregate" not in planned(got)  # it was computed for the keys and for the batches
    assert {r.batch_id: r.batch_seq for r in got.collect()} == {f"b{i}": i + 1 for i in range(20)}


def test_merges_meet_names_of_small_functions_only(spark):
    scopes = spark.createDataFrame([("f", "s", "function", 0, 1, None), ("f", "t", "block", 0, 1, "s"), ("f", "big", "function", 0, 90, None)], "path string, scope_id string, scope_type string, start_row int, end_row int, parent_id string")
    lines = spark.range(100).select(F.lit("f").alias("path"), F.col("id").cast("int").alias("line"), F.lit("x").alias("text"))
    rows = [(1, "s", "a", 0), (2, "t", "b", 1), (3, "t", "b", 1), (4, "big", "c", 5), (5, "big", "d", 6)]
    ids = spark.createDataFrame([("f", s, i, n, k, 0, "variable") for i, s, n, k in rows], "path string, scope_id string, binding_seq int, name string, line int, column int, binding_type string")
    got = B.local_merges(ids, scopes, lines)
    assert sorted((r.scope_id, r.boundary_id, r.binding_seq) for r in got.collect()) == [("s", "s", 1), ("t", "s", 2)]
    more = ids.unionByName(ids.where("binding_seq = 1").withColumn("line", F.lit(1)))  # a name twice
    assert B.local_merges(more, scopes, lines).isEmpty()
    assert planned(got).count("LeftSemi") == 1  # of scopes, none of names


def test_name_rules_run_once_a_query(spark):
    for name in ("program_batches", "program_batch_eligible", "top_level_func_eligible", "request_small_scope", "global_symbol_snippet"):
        assert "__u" not in planned(R.queries()[name](spark, SF))  # the rules' pattern, with every reading before


def test_placed_renames_find_scopes_as_they_are_dealt(spark):
    I.Tables(spark, SF)
    bindings = spark.createDataFrame([("f", "s", 0, "a", 0)], "path string, scope_id string, binding_seq int, name string, line int")
    renames = spark.createDataFrame([("f", 0, "a", "x", 1)], "path string, seq long, key string, new_name string, line int")
    found = []
    keep = lambda df, name: found.append((name, planned_exchanges(df))) or materialize(df, name)
    before, A.materialize = A.materialize, keep
    try:
        assert [r.new_name for r in A.resolve_conflicts(renames, bindings, ("path",)).collect()] == ["x"]
    finally:
        A.materialize = before
    assert dict(found)["placed"] == 2  # 3 before: lines were dealt as ints, then as longs


def planned_exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_requests_move_what_they_show_once(spark):
    I.Tables(spark, SF)
    lines = spark.range(200).select(F.concat(F.lit("f"), F.floor(F.col("id") / 3000)).alias("path"), F.col("id").cast("int").alias("line"), F.concat(F.lit("t"), "id").alias("text")).where("line <> 66")
    keys = ["path", "batch_id", "role"]
    wanted = spark.createDataFrame([("f0", "b", 0, [65, 63, 64, 66, 900]), ("f0", "b", 1, [66]), ("f0", "c", 0, [199])], "path string, batch_id string, role int, at array<int>")
    got = K._blocks(wanted, keys, lines, {"shown": F.col("text")}, lambda x: x["shown"], ["path", "batch_id"])
    whole = got.groupBy("path", "batch_id").agg(F.collect_list("block").alias("blocks"))
    assert planned_exchanges(whole) <= 3  # of both sides of the join, and of what was found; 4 before
    assert {r.batch_id: r.blocks for r in whole.collect()} == {"b": ["t63\nt64\nt65"], "c": ["t199"]}


def test_requests_are_not_built_again_where_none_was_too_long(spark):
    built = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(x):
        built.add(1)
        return x

    rows = spark.range(5).select(F.lit("f").alias("path"), F.col("id").cast("string").alias("batch_id"), F.array(F.lit("a")).alias("symbols"), text(F.lit("c")).alias("context"), F.create_map(F.lit("a"), F.lit("s")).alias("snippets"))

    def naming(frames):
        for f in frames:
            yield f[["path", "batch_id"]].assign(body="{}", error=None)

    assert sorted(map(tuple, A.dispatch(rows, naming, 2).select("batch_id", "attempt", "body").collect())) == [(str(i), 1, "{}") for i in range(5)]
    assert built.value == 5  # 10 before


def test_tables_that_are_sent_are_small(spark):
    from symloom.storage import broadcast_by_measure

    files, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    session = spark.newSession()
    for given, sent in (("10MB", 1 << 20), ("10485760b", 1 << 20), ("256k", 256 << 10)):
        session.conf.unset(measured)
        session.conf.set(files, given)
        broadcast_by_measure(session)
        assert (session.conf.get(files), session.conf.get(measured)) == ("-1", str(sent))  # what was given, before
    session.conf.set(files, "10MB")
    session.conf.set(measured, "5m")  # asked for by the session
    broadcast_by_measure(session)
    assert session.conf.get(measured) == "5m"


def test_names_that_are_applied_are_not_placed(spark, monkeypatch):
    rows = spark.createDataFrame([("f", 1, "a", "x"), ("f", 3, "a", "y"), ("f", 2, "b:1", "z"), ("g", 1, "a", "w")], "path string, seq long, key string, new_name string")
    want = {(r.path, r.key, r.new_name) for r in A.merge_renames(rows).collect()}
    assert {tuple(r) for r in A.last_names(rows).collect()} == want == {("f", "a", "y"), ("f", "b:1", "z"), ("g", "a", "w")}
    placed = []
    monkeypatch.setattr(A, "ranked", lambda *a: placed.append(a))
    assert R.queries()["apply_renames"](spark, SF).columns == ["path", "line", "text"] and not placed  # once before


def test_passing_files_are_written_in_their_place(tmp_path, monkeypatch):
    calls = []

    class Noted:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return lambda *a, **k: calls.append(name) or getattr(self.system, name)(*a, **k)

    located = S._located
    monkeypatch.setattr(S, "_located", lambda path: (Noted(located(path)[0]), located(path)[1]))
    rows = [{"path": f"out/{i % 2}/f{i}.js.gz", "source": f"x{i}"} for i in range(8)]
    found = [r for b in S._passed(iter([pa.RecordBatch.from_pylist(rows)]), str(tmp_path), 4) for r in b.to_pylist()]
    assert sorted((r["path"], r["source"]) for r in found) == sorted((r["path"], r["source"]) for r in rows)
    assert calls.count("move") == 0 and calls.count("create_dir") == 6  # a move and a folder a file before


def test_written_tables_leave_no_shuffles(spark):
    import time
    from pathlib import Path

    root, passing = Path(spark.conf.get("spark.local.dir")), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = set(root.rglob("shuffle_*"))
    rows = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    assert materialize(rows, "rows").count() == 100 and spark.conf.get(passing, "false") == "false"
    own = lambda: set(root.rglob("shuffle_*")) - before
    last = time.monotonic() + 20
    while len(own()) > 8 and time.monotonic() < last:  # of the count only; they go by a thread of their own
        time.sleep(0.2)
    written = {x.name.split("_")[1] for x in own()}
    assert len(written) <= 1  # the write's two shuffles stayed before


def test_lines_tell_of_their_own_statements(spark):
    texts = ["var a = 1;", "let b = 2", ";", "const c = () => 1;", "d = 1;", "var e;", "var f = function g() {};", "var h =", "1", "+ 2;", "var " + "i" * 120 + " = 1;", "var j = 1; var k = 2;"]
    lines = spark.createDataFrame([("f", n, t) for n, t in enumerate(texts)], "path string, line int, text string")
    ids = spark.createDataFrame([("f", n, n) for n in (*range(12), 40)] + [("g", 1, 0), ("f", None, 0)], "path string, binding_seq int, line int")
    got = B.variable_eligible(ids, lines)
    assert sorted((r.path, r.binding_seq) for r in got.collect()) == [("f", 0), ("f", 1), ("f", 11)]
    assert sorted(r.binding_seq for r in B.variable_eligible(ids, lines, max_lines=3).collect()) == [0, 1, 7, 11]
    closed = B.variable_eligible(ids.where("path = 'f' and line in (0, 3, 4, 5, 6)"), lines)
    assert "explode" not in planned(closed) and planned(closed).count("Join") == 0  # each id met four lines and their text before


def test_requests_are_put_together_once(spark):
    batches = spark.createDataFrame([("f", "p", "s0", "program", 0, 5, [("a", 0), ("b", 2), ("a", 4)]), ("f", "q", "s1", "function", 1, 3, [("c", 1)])], "path string, batch_id string, scope_id string, scope_type string, start_row int, end_row int, identifiers array<struct<name:string,line:int>>")
    lines = spark.createDataFrame([("f", i, f"t{i}") for i in range(6)], "path string, line int, text string")
    bindings = spark.createDataFrame([("f", "a", 4, 1, [5]), ("f", "b", 2, 2, [2])], "path string, name string, line int, binding_seq int, reference_lines array<int>")
    got = K.build_requests(batches, lines, bindings)
    plan = planned(got)
    assert "array_position" not in plan and "try_element_at" not in plan  # looked up name by name, in lists and maps, before
    rows = {r.batch_id: r for r in got.collect()}
    assert list(rows["p"].symbols) == ["a", "b"] and rows["p"].symbol_lines == {"a": 5, "b": 3}
    near = lambda n, a, z: "\n".join((" >>> " if i == n else "     ") + f"{i + 1:>6} | t{i}" for i in range(a, z))
    assert rows["p"].snippets == {"a": "Declaration:\n" + near(4, 1, 6) + "\n\nReference 1 (line 6):\n" + near(5, 2, 6), "b": "Declaration:\n" + near(2, 0, 6)}
    assert rows["q"].snippets == {"c": near(1, 0, 5)} and rows["q"].context == "\n".join(f"{i + 1:>6} | t{i}" for i in range(6))
