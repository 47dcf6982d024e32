"""Grouping flagged names into bounded batches for a naming function.

Everything is keyed by path first and then by scope; a scope's identifiers are what one task has
together. Ancestry is walked over keys only, sizes of ranges come from a prefix sum over lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.functions.names import is_obfuscated
from symloom.prefix import block_sums, ranked
from symloom.storage import materialize

FUNCTIONS = ["function", "arrow", "method"]
BOUNDARIES = [*FUNCTIONS, "class"]
IDENTIFIER = ("binding_seq", "name", "line", "column", "binding_type")


def flagged(bindings: DataFrame) -> DataFrame:
    """Bindings whose names look machine-made, with what a batch needs of them."""
    return bindings.where(is_obfuscated(F.col("name"))).select("path", "scope_id", *IDENTIFIER)


def scope_identifiers(bindings: DataFrame, scopes: DataFrame) -> DataFrame:
    """Scopes with flagged names, and these in binding order; scopes without any are left out."""
    rows = flagged(bindings).groupBy("path", "scope_id").agg(F.array_sort(F.collect_list(F.struct(*IDENTIFIER))).alias("identifiers"))
    return rows.join(scopes.select("path", "scope_id", "scope_type", "start_row", "end_row", "parent_id", "children"), ["path", "scope_id"])


def prefix_chars(lines: DataFrame) -> DataFrame:
    """``path, line, chars``: characters and newlines of a file up to and with a line.

    Summed by blocks of lines (``block_sums``): no file is one task, and the text is not sorted.
    """
    narrow = lines.select("path", "line", (F.length("text") + 1).alias("n"))
    return block_sums(narrow, "path", "line", F.col("n"), "chars")


def small_ranges(ranges: DataFrame, lines: DataFrame, max_chars: int, max_lines: int) -> DataFrame:
    """``ranges(path, id, start_row, end_row)`` of at most so many lines and characters.

    Ranges are clamped to their file; two point lookups in the prefix sums give the characters.
    ``lines`` may have the prefix sums (``chars``) already.
    """
    sums = lines.select("path", "line", "chars") if "chars" in lines.columns else prefix_chars(lines)
    last = sums.groupBy("path").agg(F.max("line").alias("last"))
    own = ranges.join(last, "path").withColumn("a", F.greatest("start_row", F.lit(0))).withColumn("b", F.least("end_row", "last"))
    own = own.where((F.col("b") >= F.col("a")) & (F.col("b") - F.col("a") + 1 <= max_lines))
    end = sums.select("path", F.col("line").alias("b"), F.col("chars").alias("upto"))
    before = sums.select("path", (F.col("line") + 1).alias("a"), F.col("chars").alias("before"))
    own = own.join(end, ["path", "b"]).join(before, ["path", "a"], "left")
    return own.where(F.col("upto") - F.coalesce("before", F.lit(0)) <= max_chars).select("path", "id")


def scope_boundaries(scopes: DataFrame) -> DataFrame:
    """``path, scope_id, boundary_id``: the function or class that each scope's names belong to.

    Boundary scopes are their own; the others go up to the nearest one. Steps are doubled, so the
    rounds of joins, over keys only, are the logarithm of the depth; scopes below none are left
    out. A parent that is not there ends the walk.
    """
    kind = F.col("scope_type").isin(BOUNDARIES)
    way = scopes.select("path", "scope_id", F.when(kind, F.col("scope_id")).otherwise(F.col("parent_id")).alias("at"), kind.alias("done"))
    way, open_ways = materialize(way, "boundaries"), F.count_if(~F.col("done") & F.col("at").isNotNull())
    while way.agg(open_ways).first()[0]:
        above = way.select("path", F.col("scope_id").alias("at"), F.col("at").alias("next"), F.col("done").alias("end"))
        further = way.join(above, ["path", "at"], "left")
        way = further.select("path", "scope_id", F.when(F.col("done"), F.col("at")).otherwise(F.col("next")).alias("at"), F.coalesce(F.col("done") | F.col("end"), F.col("done")).alias("done"))
        way = materialize(way, "boundaries")
    return way.where("done").select("path", "scope_id", F.col("at").alias("boundary_id"))


def local_merges(ids: DataFrame, scopes: DataFrame, lines: DataFrame, max_symbols: int = 50, max_chars: int = 1200, max_lines: int = 40) -> DataFrame:
    """Flagged names of small functions and their inner scopes, as one batch each.

    Rows ``path, scope_id, boundary_id, binding_seq, name, line, column, binding_type`` of the
    functions that have 2 to ``max_symbols`` such names, all different.
    """
    owners = scopes.where(F.col("scope_type").isin(FUNCTIONS)).select("path", F.col("scope_id").alias("id"), "start_row", "end_row")
    small = small_ranges(owners, lines, max_chars, max_lines).withColumnRenamed("id", "boundary_id")
    # boundaries are few and narrow: they are cut to the small ones before any name meets them
    within = scope_boundaries(scopes).join(small, ["path", "boundary_id"], "left_semi")
    rows = ids.join(within, ["path", "scope_id"]).repartition("path", "boundary_id")
    # a function's names stand together: doubles of a place, then of a name, by windows over it
    function, place = ["path", "boundary_id"], ["scope_id", "name", "line", "column"]
    first = W.partitionBy(*function, *place).orderBy("binding_seq", "binding_type")
    rows = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    rows = rows.withColumn("_n", F.count("*").over(W.partitionBy(*function))).where((F.col("_n") >= 2) & (F.col("_n") <= max_symbols))
    rows = rows.withColumn("_same", F.count("*").over(W.partitionBy(*function, "name")))
    rows = rows.withColumn("_most", F.max("_same").over(W.partitionBy(*function))).where("_most = 1")
    return rows.select(*function, *place, "binding_seq", "binding_type")


def variable_eligible(ids: DataFrame, lines: DataFrame, max_chars: int = 120, max_lines: int = 2) -> DataFrame:
    """Top-level variables whose statement is short, closed and simple; rows of ``ids``.

    Most lines tell by themselves, as they end a statement or begin none: of these a mark moves. The
    text of lines below is looked up only for the others, and for lines that are not there.
    """
    heads = lambda text: text.rlike(r"\b(?:var|let|const)\b")
    simple = lambda x: F.contains(x, F.lit("=")) & ~F.contains(x, F.lit("function")) & ~F.contains(x, F.lit("=>")) & (F.length(x) <= max_chars)
    text, closed = F.col("text"), F.contains("text", F.lit(";"))
    told = F.when(~heads(text), F.lit(False)).when(closed, simple(text) & F.lit(max_lines >= 1))
    marks = lines.select("path", "line", told.alias("_good")).where("_good is not null")
    # written, as it is read twice below
    marked = materialize(ids.join(marks, ["path", "line"], "left").select(*ids.columns, "_good"), "marked")
    known, rest = marked.where("_good and binding_seq is not null").drop("_good"), marked.where("_good is null").drop("_good")
    if rest.isEmpty():
        return known
    scan = max(1, max_lines + 2)
    wanted = rest.select("path", "binding_seq", "line", F.explode(F.sequence(F.col("line"), F.col("line") + scan - 1)).alias("at"))
    found = wanted.join(lines.select("path", F.col("line").alias("at"), "text"), ["path", "at"])
    rows = F.array_sort(F.collect_list(F.struct("at", "text")))
    own = found.groupBy("path", "binding_seq", "line").agg(F.min(F.when(F.contains("text", F.lit(";")), F.col("at"))).alias("end"), rows.alias("rows"))
    taken = F.filter("rows", lambda r: r["at"] <= F.col("end"))
    own = own.where(F.col("end").isNotNull()).select("path", "binding_seq", F.size(taken).alias("n"), F.get(F.col("rows"), F.lit(0))["text"].alias("head"), F.array_join(F.transform(taken, lambda r: r["text"]), "\n").alias("statement"))
    good = own.where(heads(F.col("head")) & (F.col("n") <= max_lines) & simple(F.col("statement")))
    return known.unionByName(rest.join(good.select("path", "binding_seq"), ["path", "binding_seq"], "left_semi"))


def function_eligible(ids: DataFrame, scopes: DataFrame, lines: DataFrame, max_chars: int = 600, max_lines: int = 20) -> DataFrame:
    """Top-level functions whose scope, the first child that starts on their line, is small."""
    program = scopes.where(F.col("scope_type") == "program").select("path", "scope_id", F.posexplode("children").alias("place", "child"))
    inner = scopes.where(F.col("scope_type").isin(["function", "arrow"])).select("path", F.col("scope_id").alias("child"), F.col("start_row").alias("line"), "start_row", "end_row")
    starts = program.join(inner, ["path", "child"]).groupBy("path", "scope_id", "line").agg(F.min_by(F.struct("start_row", "end_row"), "place").alias("s"))
    owned = ids.join(starts, ["path", "scope_id", "line"]).select("path", F.col("binding_seq").alias("id"), "s.start_row", "s.end_row")
    good = small_ranges(owned, lines, max_chars, max_lines).withColumnRenamed("id", "binding_seq")
    return ids.join(good, ["path", "binding_seq"], "left_semi")


def program_eligible(ids: DataFrame, scopes: DataFrame, lines: DataFrame, variable_chars: int = 120, variable_lines: int = 2, function_chars: int = 600, function_lines: int = 20, sums: DataFrame | None = None) -> DataFrame:
    """Top-level names that may share a batch: short variables and small functions only."""
    variables = variable_eligible(ids.where("binding_type = 'variable'"), lines, variable_chars, variable_lines)
    functions = function_eligible(ids.where("binding_type = 'function'"), scopes, lines if sums is None else sums, function_chars, function_lines)
    return variables.unionByName(functions)


def chunked(ids: DataFrame, size: int, batch: str) -> DataFrame:
    """Names of each scope in binding order, cut into batches ``<scope><batch><n>``."""
    place = F.row_number().over(W.partitionBy("path", "scope_id").orderBy("binding_seq")) - 1
    return ids.withColumn("batch_id", F.concat("scope_id", F.lit(batch), F.floor(place / size).cast("string")))


def program_batches(ids: DataFrame, scopes: DataFrame, lines: DataFrame, max_symbols: int = 50, program_max: int = 10, batching: bool = True, sums: DataFrame | None = None) -> DataFrame:
    """Batches of the top-level names: eligible ones in chunks, each other one alone."""
    if not batching:
        return singletons(ids, "_single_")
    good = program_eligible(ids, scopes, lines, sums=sums)
    rest = ids.join(good.select("path", "scope_id", "binding_seq"), ["path", "scope_id", "binding_seq"], "left_anti")
    return chunked(good, max(1, min(max_symbols, program_max)), "_program_batch_").unionByName(chunked(rest, 1, "_program_ineligible_single_"))


def scope_chunks(ids: DataFrame, max_symbols: int = 50) -> DataFrame:
    """Batches of other scopes: the whole scope, or chunks where it has too many names."""
    n = F.count("*").over(W.partitionBy("path", "scope_id"))
    own = chunked(ids, max_symbols, "_chunk_").withColumn("_n", n)
    return own.withColumn("batch_id", F.when(F.col("_n") > max_symbols, F.col("batch_id")).otherwise(F.col("scope_id"))).drop("_n")


def singletons(ids: DataFrame, batch: str = "_single_") -> DataFrame:
    """One batch for each name; a scope's only name keeps the scope's id."""
    n = F.count("*").over(W.partitionBy("path", "scope_id"))
    own = chunked(ids, 1, batch).withColumn("_n", n)
    return own.withColumn("batch_id", F.when(F.col("_n") > 1, F.col("batch_id")).otherwise(F.col("scope_id"))).drop("_n")


def order_batches(batches: DataFrame) -> DataFrame:
    """``batch_seq`` from 1 in each file: small scopes and small batches first, then from the top."""
    span = F.greatest(F.col("end_row") - F.col("start_row") + 1, F.lit(1))
    # written, as the keys and the join back read it: else all before it would run twice
    batches = materialize(batches, "placed")
    keys = batches.select("path", "batch_id", "n_identifiers", "start_row", span.alias("_span"))
    # keys alone are dealt by ranges and numbered, so that a file of many batches is many tasks
    places = ranked(keys, ["path"], ["_span", "n_identifiers", "start_row", "batch_id"], "batch_seq", "order")
    return batches.join(places.select("path", "batch_id", "batch_seq"), ["path", "batch_id"])


def merge_ids(merged: DataFrame, scopes: DataFrame) -> DataFrame:
    """Merged rows with their ``batch_id``: ``<scope>_local_merge``, with the first free ``_<k>``
    where a scope has that id itself."""
    pattern = r"^(.+_local_merge)(?:_([1-9][0-9]*))?$"
    taken = scopes.where(F.col("scope_id").rlike(pattern)).select("path", F.regexp_extract("scope_id", pattern, 1).alias("batch_id"), F.coalesce(F.nullif(F.regexp_extract("scope_id", pattern, 2), F.lit("")).cast("int"), F.lit(0)).alias("k"))
    taken = taken.groupBy("path", "batch_id").agg(F.collect_set("k").alias("used"))
    rows = merged.withColumn("batch_id", F.concat("boundary_id", F.lit("_local_merge"))).join(taken, ["path", "batch_id"], "left")
    free = F.get(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")), F.lit(0))
    return rows.withColumn("batch_id", F.when(free > 0, F.concat_ws("_", "batch_id", free.cast("string"))).otherwise(F.col("batch_id"))).drop("used")


def analyze(bindings: DataFrame, scopes: DataFrame, lines: DataFrame, max_symbols: int = 50, program_max: int = 10, batching: bool = True, merge: bool = True, merge_chars: int = 1200, merge_lines: int = 40) -> DataFrame:
    """Ordered batches of the flagged names of all files.

    Rows ``path, batch_id, scope_id, scope_type, start_row, end_row, n_identifiers, identifiers,
    batch_seq``; identifiers are structs in binding order, those of a merged batch by place.
    """
    # narrow rows that every step below reads: written once instead of being derived each time
    ids = materialize(flagged(bindings).join(scopes.select("path", "scope_id", "scope_type"), ["path", "scope_id"]), "flagged")
    # likewise the prefix sums, which merges and top-level functions look up
    sums = materialize(prefix_chars(lines), "chars")
    merged = None
    if merge:
        merged = materialize(local_merges(ids.drop("scope_type"), scopes, sums, max_symbols, merge_chars, merge_lines), "merged")
        ids = ids.join(merged.select("path", "scope_id").distinct(), ["path", "scope_id"], "left_anti")
    program = program_batches(ids.where("scope_type = 'program'").drop("scope_type"), scopes, lines, max_symbols, program_max, batching, sums)
    others = scope_chunks(ids.where("scope_type <> 'program'").drop("scope_type"), max_symbols)
    rows = program.unionByName(others).withColumn("place", F.struct(F.col("binding_seq").alias("a"), F.lit(0).alias("b"), F.lit("").alias("c")))
    if merge:
        mine = merge_ids(merged, scopes).select("path", F.col("boundary_id").alias("scope_id"), *IDENTIFIER, "batch_id", F.struct(F.col("line").cast(rows.schema["binding_seq"].dataType).alias("a"), F.col("column").cast("int").alias("b"), F.col("name").alias("c")).alias("place"))
        rows = rows.unionByName(mine)
    own = F.array_sort(F.collect_list(F.struct("place", *IDENTIFIER)))
    # dealt by scope as narrow rows: batches and their join to the scopes need no other shuffle
    grouped = rows.repartition("path", "scope_id").groupBy("path", "scope_id", "batch_id").agg(F.transform(own, lambda x: x.dropFields("place")).alias("identifiers"))
    grouped = grouped.withColumn("n_identifiers", F.size("identifiers"))
    placed = grouped.join(scopes.select("path", "scope_id", "scope_type", "start_row", "end_row"), ["path", "scope_id"])
    return order_batches(placed).select("path", "batch_id", "scope_id", "scope_type", "start_row", "end_row", "n_identifiers", "identifiers", "batch_seq")


def scope_report(batches: DataFrame) -> DataFrame:
    """A row for each identifier of each batch, with lines counted from 1."""
    rows = batches.select("path", "batch_seq", "batch_id", "scope_type", (F.col("start_row") + 1).alias("first_line"), (F.col("end_row") + 1).alias("last_line"), F.explode("identifiers").alias("i"))
    return rows.select("path", "batch_seq", "batch_id", "scope_type", "first_line", "last_line", F.col("i.name").alias("name"), (F.col("i.line") + 1).alias("line"), F.col("i.binding_type").alias("binding_type"))
