"""Bindings, occurrences and references from lines of source text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.names import is_obfuscated
from symloom.storage import materialize

#: The patterns that say what counts as a declaration.
VARIABLE = r"\b(?:var|let|const)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)"
FUNCTION = r"\bfunction\s+([a-zA-Z_$][a-zA-Z0-9_$]*)"
#: An identifier that is no member of something before it.
TOKEN = r"(?<![A-Za-z0-9_$.])[A-Za-z_$][A-Za-z0-9_$]*(?![A-Za-z0-9_$])"


def extract_bindings(lines: DataFrame, kinds: tuple[str, ...] = ("variable", "function")) -> DataFrame:
    """Declared names of each line with their columns: variables first, then functions.

    Matches need offsets, which no SQL function gives, so lines that hold a keyword (tested by
    Spark) go through one compiled pattern a batch; the others never leave the JVM.
    """
    patterns = [(k, re.compile({"variable": VARIABLE, "function": FUNCTION}[k], re.ASCII)) for k in kinds]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, rows, texts = (c.to_pylist() for c in batch.columns)
            out = [(p, n, i, m[1], m.start(1), m.end(1), kind) for p, n, t in zip(paths, rows, texts, strict=True) for i, (kind, m) in enumerate((k, m) for k, pattern in patterns for m in pattern.finditer(t))]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "line", "seq", "name", "column", "end_column", "binding_type"])

    some = lines.where(F.col("text").rlike(r"\b(var|let|const|function)\s"))
    found = some.select(F.col("path").cast("string").alias("path"), F.col("line").cast("int").alias("line"), "text").mapInArrow(find, "path string, line int, seq int, name string, column int, end_column int, binding_type string")
    return found.select("path", F.lit("scope_0").alias("scope_id"), "line", "seq", "name", "column", "end_column", "binding_type", F.lit(True).alias("is_declaration"), is_obfuscated(F.col("name")).alias("is_obfuscated"))


def identifiers(text: Column) -> Column:
    """Distinct identifiers of a line, member accesses left out."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


#: Lines that are read together; what is open at the start of a block comes from the blocks before.
BLOCK_LINES = 1024


def _whole_blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Keys (the first ``n`` columns) and rows of consecutive rows of one key."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n], []
            rows.append(row[n:])
    if rows:
        yield key, rows


def block_states(lines: DataFrame, block: int = BLOCK_LINES) -> DataFrame:
    """``path, block, state, stack, after`` of the blocks of lines of files that have several.

    A segmented scan: each block is read by itself, from every state, to a map from what stands
    before it to what stands after it; then a file's maps, a narrow row a block, are followed in
    order. ``after`` is the first token behind a block.
    """
    import json

    from symloom.functions.lexer import START, block_map, follow

    last = lines.groupBy("path").agg(F.max("line").alias("_last"))
    long = last.where(F.col("_last") >= block).select("path")
    if long.isEmpty():  # each file is one block, which starts anew
        return lines.sparkSession.createDataFrame([], "path string, block int, state string, stack string, after string")
    rows = lines.join(long, "path", "left_semi").select("path", F.floor(F.col("line") / block).cast("int").alias("block"), "line", "text")
    rows = rows.repartition("path", "block").sortWithinPartitions("path", "block", "line")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, number), own in _whole_blocks(batches, 2):
            mapped = block_map([text or "" for _, text in own])
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([number], pa.int32()), pa.array([json.dumps(mapped)])], names=["path", "block", "mapped"])

    mapped = materialize(rows.mapInArrow(maps, "path string, block int, mapped string"), "blocks")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state, stack, waiting = None, START, [], []

        def told(after: str | None) -> Iterator[pa.RecordBatch]:
            if waiting:
                columns = zip(*[(*w, after) for w in waiting], strict=True)
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "block", "state", "stack", "after"])
                waiting.clear()

        for batch in batches:
            for file, number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != path:
                    yield from told(None)
                    path, state, stack = file, START, []
                own = json.loads(text)
                first = own["first"][state]
                if first is not None:  # of blocks without a token too
                    yield from told(first)
                waiting.append((file, number, state, "".join(stack)))
                state = follow(own, state, stack)
        yield from told(None)

    dealt = mapped.repartition("path").sortWithinPartitions("path", "block")
    return materialize(dealt.mapInArrow(walk, "path string, block int, state string, stack string, after string"), "blocks")


def line_identifiers(lines: DataFrame, block: int = BLOCK_LINES) -> DataFrame:
    """``path, line, column, name, role`` of the identifiers of each line that may be variables.

    Left out are reserved words, members after a dot, keys of objects and classes, labels, and what
    stands in strings, comments, template texts and regular expressions, also in those that began
    lines before. ``role`` tells names that are written short (see ``functions.lexer``). Lines are
    read by blocks, whose states at the start come from ``block_states``; no file is one task.
    """
    from symloom.functions.lexer import START, variable_names

    rows = lines.select(F.col("path").cast("string").alias("path"), F.col("line").cast("int").alias("line"), "text", F.floor(F.col("line") / block).cast("int").alias("block"))
    states = block_states(rows, block).select(F.col("path").alias("_path"), F.col("block").alias("_block"), "state", "stack", "after")
    rows = rows.repartition("path", "block").join(states, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")), "left")
    rows = rows.select("path", "block", "line", "text", "state", "stack", "after").repartition("path", "block").sortWithinPartitions("path", "block", "line")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "line", "column", "name", "role"])

        for (path, _), own in _whole_blocks(batches, 2):
            _, _, state, stack, after = own[0]
            out.extend((path, *x) for x in variable_names([(row, text or "") for row, text, *_ in own], state or START, stack or "", after))
            if len(out) > 1 << 14:
                yield told()
        yield told()

    return rows.mapInArrow(find, "path string, line int, column int, name string, role int")


def tokens(lines: DataFrame, scopes: DataFrame, bindings: DataFrame, names: DataFrame | None = None, block: int = BLOCK_LINES) -> DataFrame:
    """``path, line, column, name, scope_id, is_declaration, role`` of every identifier.

    ``scope_id`` is the scope in which the identifier is declared: a declaration's own, else the
    innermost one around it that declares the name, null if none does. With ``names(path, name)``
    only these are looked at.

    Scopes nest, so the declaring scopes of one name, sorted with its tokens by place, are a stack.
    Rows are dealt by ranges of (path, name, place), so a name that stands in half of all lines is
    many tasks: each resolves what its own scopes enclose and hands the scopes that are still open
    at its end, as many as scopes nest, to the tasks that go on with the same name.
    """
    keys = ["path", "name", "row", "col"]
    far = [(-F.col("end_row")).alias("far_a"), (-F.col("end_col")).alias("far_b")]
    none, zero = F.lit(None).cast("int"), F.lit(0)
    blank = [zero.alias("far_a"), zero.alias("far_b"), none.alias("end_row"), none.alias("end_col")]
    opens = bindings.select("path", "name", "scope_id").distinct().join(scopes.select("path", "scope_id", "start_row", "start_col", "end_row", "end_col"), ["path", "scope_id"])
    opens = opens.select("path", "name", F.col("start_row").alias("row"), F.col("start_col").alias("col"), zero.alias("kind"), *far, "end_row", "end_col", "scope_id", zero.alias("role"))
    marks = bindings.select("path", "name", F.col("line").alias("row"), F.col("column").alias("col"), F.lit(1).alias("kind"), *blank, F.coalesce("scope_id", F.lit("")).alias("scope_id"), zero.alias("role"))
    seen = line_identifiers(lines, block).select("path", "name", F.col("line").alias("row"), F.col("column").alias("col"), F.lit(2).alias("kind"), *blank, F.lit(None).cast("string").alias("scope_id"), "role")
    rows = opens.unionByName(marks).unionByName(seen)
    if names is not None:
        rows = rows.join(names.select("path", "name").distinct(), ["path", "name"], "left_semi")
    # written, as dealing by ranges reads it twice
    rows = materialize(rows.select("path", "name", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "kind", "far_a", "far_b", "end_row", "end_col", "scope_id", "role"), "marks")
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "kind", "far_a", "far_b", "scope_id")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        # what: token, token that waits for the tasks before, open scope at the end, the first place
        key, first, stack, mark = None, None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            paths, names, scopes = batch.column(0), batch.column(1), batch.column(9)
            codes = [c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in (paths, names)]
            starts = (np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)
            # numbers as they are, and which rows begin a name: strings are read once a name
            rows_, cols, kinds, ends, end_cols = (batch.column(i).fill_null(-1).to_numpy(zero_copy_only=False).tolist() for i in (2, 3, 4, 7, 8))
            changes, own_scopes = [True, *starts.tolist()], scopes.to_pylist()
            told, what, scope_of, declares = [], [], [], []
            for i, (row, col, kind, end_row, end_col, scope, change) in enumerate(zip(rows_, cols, kinds, ends, end_cols, own_scopes, changes, strict=True)):
                if change and key != (now := (paths[i].as_py(), names[i].as_py())):
                    key, stack, mark = now, [], None
                if first is None:
                    first = key
                    yield _resolved([(part, "first", *key, row, col, None, None, None, None, None)])
                while stack and stack[-1][0] <= (row, col):
                    stack.pop()
                if kind == 0:
                    stack.append(((end_row, end_col), scope, (row, col)))
                    continue
                if kind == 1:
                    mark = (row, col, scope)
                    continue
                told.append(i)
                if mark is not None and mark[:2] == (row, col):
                    what.append("token")
                    scope_of.append(mark[2])
                    declares.append(True)
                else:
                    what.append("token" if stack or key != first else "waits")
                    scope_of.append(stack[-1][1] if stack else None)
                    declares.append(False)
            # tokens go on as the columns in which they came
            kept, n = batch.take(pa.array(told, pa.int64())), len(told)
            none = pa.nulls(n, pa.int32())
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(what, pa.string()), kept.column(0), kept.column(1), kept.column(2), kept.column(3), none, none, pa.array(scope_of, pa.string()), pa.array(declares, pa.bool_()), kept.column(10)]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
        yield _resolved([(part, "open", *key, *start, *end, scope, None, None) for end, scope, start in stack])

    found = materialize(dealt.mapInArrow(resolve, _RESOLVED), "resolved")
    opened = found.where("what = 'open'").select(F.col("part").alias("_from"), "path", "name", F.struct("row", "col", (-F.col("end_row")).alias("a"), (-F.col("end_col")).alias("b"), "scope_id").alias("o"))
    begins = found.where("what = 'first'").select("part", "path", "name", "row", "col")
    after = F.struct(-F.col("o.a"), -F.col("o.b")) > F.struct("row", "col")
    carried = begins.join(opened, ["path", "name"]).where((F.col("_from") < F.col("part")) & after)
    carried = materialize(carried.groupBy(F.col("part").alias("_part")).agg(F.array_sort(F.collect_list("o")).alias("stack")), "carried")
    waits = found.where("what = 'waits'").join(carried, F.col("part") == F.col("_part"), "left")
    here = F.filter("stack", lambda o: F.struct(-o["a"], -o["b"]) > F.struct("row", "col"))
    columns = ["path", F.col("row").alias("line"), F.col("col").alias("column"), "name"]
    known = found.where("what = 'token'").select(*columns, "scope_id", "is_declaration", "role")
    return known.unionByName(waits.select(*columns, F.try_element_at(here, F.lit(-1))["scope_id"].alias("scope_id"), "is_declaration", "role"))


_RESOLVED = "part int, what string, path string, name string, row int, col int, end_row int, end_col int, scope_id string, is_declaration boolean, role int"
_NAMES = [c.split()[0] for c in _RESOLVED.split(", ")]


def _resolved(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k.split()[1]]) for c, k in zip(columns, _RESOLVED.split(", "), strict=True)], names=_NAMES)


def line_names(lines: DataFrame) -> DataFrame:
    """An inverted index: ``path, name, line`` of every identifier, each line once.

    Rows lie by (path, name), sorted, so that written files hold runs of one name with rising lines,
    which Parquet stores as differences.
    """
    cut = lines.select("path", "line", F.explode(identifiers(F.col("text"))).alias("name"))
    return cut.select("path", "name", "line").repartition("path", "name").sortWithinPartitions("path", "name", "line")


def updated_names(index: DataFrame, lines: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after some lines have changed: only ``changed(path, line)`` are cut anew."""
    kept = index.join(changed, ["path", "line"], "left_anti").select("path", "name", "line")
    return kept.unionByName(line_names(lines.join(changed, ["path", "line"], "left_semi")))


def occurrences(lines: DataFrame, names: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``path, name, line`` wherever one of ``names(path, name)`` occurs as an identifier.

    Each line is cut into identifiers once, or not at all where ``index`` has them; the join is on
    (path, name), so names that stand in every file meet only their own file's lines.
    """
    cut = lines.select("path", "line", F.explode(identifiers(F.col("text"))).alias("name")) if index is None else index
    return cut.join(names.select("path", "name").distinct(), ["path", "name"], "left_semi").select("path", "name", "line")


def binding_references(bindings: DataFrame) -> DataFrame:
    """Reference lines of each ``(path, name, line)``: those of its first binding, declaration line
    apart, distinct and sorted; null where there are none at all."""
    first = bindings.groupBy("path", "name", "line").agg(F.min_by("reference_lines", "binding_seq").alias("r"))
    own = F.array_sort(F.array_distinct(F.filter("r", lambda x: x != F.col("line"))))
    return first.select("path", "name", "line", F.when(F.size("r") > 0, own).alias("reference_lines"))


def attach_references(bindings: DataFrame, references: DataFrame) -> DataFrame:
    """``reference_lines`` of bindings from ``references(path, name, line, column, ref_line)``."""
    lines = references.groupBy("path", "name", "line", "column").agg(F.array_sort(F.collect_set("ref_line")).alias("reference_lines"))
    joined = bindings.drop("reference_lines").join(lines, ["path", "name", "line", "column"], "left")
    return joined.withColumn("reference_lines", F.coalesce("reference_lines", F.array().cast("array<int>")))
