"""Cleaning answers: what was asked for, valid names, keys, clashes, merging, what remains."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.functions.names import IDENTIFIER, NOT_A_NAME, is_obfuscated, is_valid_identifier, parse_rename_key
from symloom.functions.text import answer_keys, classify_error, compact_prompt, extract_json
from symloom.operators.attempts import ATTEMPTS, Naming, with_attempts
from symloom.operators.indexes import name_counts, scope_of_line
from symloom.prefix import ranked
from symloom.storage import materialize

#: Suffixes that are tried before a clash counts as unresolved.
MOST_SUFFIXES = 10000
IDENTIFIER_PATTERN = re.compile(IDENTIFIER)


def dispatch(requests: DataFrame, fn: Naming, concurrency: int, max_size: int = 32000, attempts: int = ATTEMPTS, pace: float = 1.0) -> DataFrame:
    """Ask the naming function: ``(path, batch_id, attempt, body, error)`` of each request.

    ``fn`` maps frames of requests to frames ``path, batch_id, body, error`` and, where a provider
    gives it, ``retry_after``. As many partitions ask at once as ``concurrency`` says. An answer that
    may be tried again is, up to ``attempts`` times, when it is due (``with_attempts``). Answers are
    written before anything reads them, so none is asked for twice; requests that were too long
    are asked once more with compact limits.
    """
    asking, answer = with_attempts(fn, attempts, pace), "path string, batch_id string, body string, error string, asked int"
    first = materialize(requests.repartition(concurrency).mapInPandas(asking, answer), "answers")
    again = first.where(classify_error(F.col("error")) == "too_long").select("path", "batch_id", F.col("asked").alias("_before"))
    columns = ["path", "batch_id", "attempt", "body", "error"]
    if again.isEmpty():  # requests need not be built once more
        return first.select("path", "batch_id", F.col("asked").alias("attempt"), "body", "error")
    short = requests.join(again, ["path", "batch_id"]).withColumn("_c", compact_prompt(F.col("context"), F.col("snippets"), max_size))
    short = short.withColumn("context", F.col("_c.context")).withColumn("snippets", F.col("_c.snippets")).drop("_c")
    second = materialize(short.drop("_before").repartition(concurrency).mapInPandas(asking, answer), "answers")
    second = second.join(again, ["path", "batch_id"]).withColumn("attempt", F.col("asked") + F.col("_before"))
    kept = first.join(again, ["path", "batch_id"], "left_anti").withColumn("attempt", F.col("asked"))
    return kept.select(*columns).unionByName(second.select(*columns))


def filter_answers(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """``path, batch_id, seq, key, new_name``: the answers to what was asked, in symbol order.

    A symbol's plain key first, then its ``symbol:line`` key, then, of one symbol and one answer,
    that answer if it is not blank.
    """
    rows = requests.join(answers.where("error is null").select("path", "batch_id", extract_json(F.col("body")).alias("m")), ["path", "batch_id"]).where("m is not null")
    rows = rows.select("path", "batch_id", "symbol_lines", "m", F.size("symbols").alias("n"), F.posexplode("symbols").alias("seq", "symbol"))
    keyed = F.concat("symbol", F.lit(":"), F.try_element_at("symbol_lines", "symbol").cast("string"))
    only = F.btrim(F.get(F.map_values("m"), F.lit(0)))
    plain, by_line = F.try_element_at("m", "symbol"), F.try_element_at("m", keyed)
    has = lambda k: F.coalesce(F.map_contains_key("m", k), F.lit(False))
    key = F.when(has(F.col("symbol")), F.col("symbol")).when(has(F.coalesce(keyed, F.lit("\0"))), keyed).when((F.col("n") == 1) & (F.size("m") == 1) & (only != ""), F.col("symbol"))
    name = F.when(has(F.col("symbol")), plain).when(has(F.coalesce(keyed, F.lit("\0"))), by_line).otherwise(only)
    return rows.select("path", "batch_id", "seq", key.alias("key"), name.alias("new_name")).where("key is not null")


def split_invalid(renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Renames with valid names, trimmed, and the others."""
    good = is_valid_identifier(F.col("new_name"))
    return renames.where(good).withColumn("new_name", F.btrim("new_name", F.lit(" \t\n\r\f\x0b"))), renames.where(~good)


def _numbered(rows: DataFrame) -> DataFrame:
    """``path, seq, key, new_name`` of ``(path, key, turn, new_name)``: places from 0 by ``turn``;
    a file of many renames is many tasks."""
    rows = ranked(rows, ["path"], ["turn"], "_place", "renames")
    return rows.select("path", (F.col("_place") - 1).cast("long").alias("seq"), "key", "new_name")


def normalize_keys(renames: DataFrame, counts: DataFrame) -> DataFrame:
    """``path, seq, key, new_name``: ``name:line`` becomes ``name`` where a name is declared once.

    Plain keys come first and win; of several lines that fold, the first one does.
    """
    rows = renames.select("path", "seq", "key", "new_name", parse_rename_key(F.col("key")).alias("k"))
    rows = rows.join(counts.select("path", F.col("name").alias("_name"), "n"), (rows["path"] == counts["path"]) & (F.col("k.name") == F.col("_name")), "left").select(rows["path"], "seq", "key", "new_name", "k", "n")
    folded = F.when(F.col("k").isNull(), F.col("key")).when(F.col("n") == 1, F.col("k.name")).otherwise(F.col("key"))
    rows = rows.select("path", folded.alias("key"), F.struct(F.col("k").isNotNull().cast("int").alias("late"), "seq").alias("turn"), "new_name")
    best = rows.groupBy("path", "key").agg(F.min("turn").alias("turn"), F.min_by("new_name", "turn").alias("new_name"))
    return _numbered(best)


def symbols_of_keys(renames: DataFrame) -> DataFrame:
    """Distinct base names of rename keys."""
    key = parse_rename_key(F.col("key"))
    return renames.select("path", F.coalesce(key["name"], F.col("key")).alias("name")).distinct()


def _merged(*parts: DataFrame) -> DataFrame:
    """``path, key, turn, new_name``: of one key the last value, at the first one's turn."""
    whole = None
    for i, p in enumerate(parts):
        rows = p.select("path", F.struct(F.lit(i).alias("part"), F.col("seq").alias("seq")).alias("turn"), "key", "new_name")
        whole = rows if whole is None else whole.unionByName(rows)
    return whole.groupBy("path", "key").agg(F.min("turn").alias("turn"), F.max_by("new_name", "turn").alias("new_name"))


def last_names(*parts: DataFrame) -> DataFrame:
    """``path, key, new_name`` of ``merge_renames``, for what needs no places: nothing is sorted."""
    return _merged(*parts).select("path", "key", "new_name")


def merge_renames(*parts: DataFrame) -> DataFrame:
    """Union of rename tables ``(path, seq, key, new_name)``, later ones after earlier ones: of
    one key the last value stays, at the first one's place. ``seq`` is anything that has an order,
    of one type in all parts."""
    return _numbered(_merged(*parts))


def _settle(names: list[str], blocked: set[str]) -> list[tuple[str | None, bool]]:
    """For each wanted name in turn the one it gets, and whether it was changed."""
    out: list[tuple[str | None, bool]] = []
    for name in names:
        got: str | None = name
        if name in blocked:
            tries = (f"{name}_{k}" for k in range(1, MOST_SUFFIXES + 1))
            got = next((t for t in tries if t not in blocked and IDENTIFIER_PATTERN.match(t) and t not in NOT_A_NAME), None)
        if got is not None:
            blocked.add(got)
        out.append((got, got != name))
    return out


def resolve_conflicts(renames: DataFrame, bindings: DataFrame, by: tuple[str, ...] = ("path", "batch_id")) -> DataFrame:
    """Renames with ``outcome``: accepted, adjusted or unresolved, per scope in key order.

    ``renames(path, ..., seq, key, new_name, line)`` with the declaration's line from 1 (null if
    unknown: accepted as it is). In a scope a new name must differ from the names that stay there
    and from those given before; else the first free ``name_<k>`` is taken. Only scopes in which
    some wanted name is blocked or wanted twice go through the sequential helper, which holds one
    scope's clashing keys; the others are settled by joins.
    """
    known = parse_rename_key(F.col("key"))
    rows = renames.withColumn("symbol", F.coalesce(known["name"], F.col("key"))).withColumn("_line", F.coalesce(known["line"], F.col("line").cast("long")) - 1)
    # lines are longs before they are grouped, so that the join finds them dealt as it needs them
    places = scope_of_line(bindings.withColumn("line", F.col("line").cast("long"))).select("path", F.col("name").alias("symbol"), F.col("line").alias("_line"), F.col("scope_id").alias("_scope"))
    # written, as what follows reads it several times
    rows = materialize(rows.join(places, ["path", "symbol", "_line"], "left"), "placed")
    free = rows.where("_scope is null or _scope = ''").withColumn("outcome", F.lit("accepted"))
    held = rows.where("_scope is not null and _scope <> ''")
    group = [*by, "_scope"]
    leaving = held.select(*group, "symbol").distinct()
    names = bindings.select("path", F.col("scope_id").alias("_scope"), F.col("name").alias("symbol")).distinct()
    # written too, as are the clashing scopes: names and what stays of them are found once
    staying = materialize(held.select(*group).distinct().join(names, ["path", "_scope"]).join(leaving, [*group, "symbol"], "left_anti"), "staying")
    wanted = held.groupBy(*group, "new_name").agg(F.count("*").alias("_n"))
    taken = wanted.join(staying.withColumnRenamed("symbol", "new_name").withColumn("_stays", F.lit(True)), [*group, "new_name"], "left")
    clashing = materialize(taken.where("_n > 1 or _stays").select(*group).distinct(), "clashing")
    # what a scope's sequence needs: its wanted names in order, and the names that stay
    stays = staying.join(clashing, group, "left_semi").groupBy(*group).agg(F.collect_set("symbol").alias("stays"))
    marked = materialize(held.join(clashing.withColumn("_clash", F.lit(True)), group, "left"), "marked")
    calm = marked.where("_clash is null").withColumn("outcome", F.lit("accepted"))
    others = [c for c in renames.columns if c not in (*by, "seq", "key", "new_name")]
    asked = marked.where("_clash").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("seq", "key", "new_name", *others))).alias("asked"))
    both = asked.join(stays, group, "left")

    @F.arrow_udf("array<struct<got:string,outcome:string>>")
    def settle(names: pa.Array, stays: pa.Array) -> pa.Array:
        out = []
        for wanted, s in zip(names.to_pylist(), stays.to_pylist(), strict=True):
            given = _settle(wanted, set(s or ()))
            out.append([{"got": got, "outcome": "unresolved" if got is None else "adjusted" if changed else "accepted"} for got, changed in given])
        return pa.array(out, pa.list_(pa.struct([("got", pa.string()), ("outcome", pa.string())])))

    # every rename stands beside what became of it, so that nothing is joined back
    settled = both.withColumn("_got", settle(F.transform("asked", lambda x: x["new_name"]), F.col("stays")))
    rough = settled.select(*group, F.explode(F.arrays_zip(F.col("asked").alias("a"), F.col("_got").alias("g"))).alias("s"))
    rough = rough.select(*group, "s.a.*", F.col("s.g.got").alias("got"), F.col("s.g.outcome").alias("outcome")).withColumn("new_name", F.coalesce("got", "new_name"))
    columns = [*renames.columns, "outcome"]
    return free.select(*columns).unionByName(calm.select(*columns)).unionByName(rough.select(*columns))


def resolve_scope_conflicts(renames: DataFrame, requests: DataFrame, bindings: DataFrame) -> DataFrame:
    """Clashes within each request; plain keys have their symbol's line in the request."""
    lines = requests.select("path", "batch_id", F.explode("symbol_lines").alias("key", "line"))
    return resolve_conflicts(renames.join(lines, ["path", "batch_id", "key"], "left"), bindings, ("path", "batch_id")).drop("line")


def resolve_global_conflicts(renames: DataFrame, bindings: DataFrame) -> DataFrame:
    """Clashes within each file; plain keys have a line if their name is declared once."""
    once = bindings.groupBy("path", F.col("name").alias("key")).agg(F.count("*").alias("n"), (F.min("line") + 1).alias("line")).where("n = 1").drop("n")
    return resolve_conflicts(renames.join(once, ["path", "key"], "left"), bindings, ("path",)).drop("line")


def remaining_symbols(bindings: DataFrame, renames: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Flagged names without a rename under their plain key, and not skipped."""
    names = bindings.where(is_obfuscated(F.col("name"))).select("path", "name").distinct()
    left = names.join(renames.select("path", F.col("key").alias("name")), ["path", "name"], "left_anti")
    return left if skipped is None else left.join(skipped.select("path", "name"), ["path", "name"], "left_anti")


OUTCOMES = ["accepted", "adjusted", "unresolved", "invalid", "skipped", "retryable"]


def outcome_counts(log: DataFrame) -> DataFrame:
    """Rows of each outcome per request and round; ``log(path, batch_id, round, outcome)``."""
    return log.groupBy("path", "batch_id", "round").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def clean_round(requests: DataFrame, answers: DataFrame, bindings: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A round's answers to its renames ``(path, seq, key, new_name)``, a log of outcomes, and the
    usable keys ``(path, batch_id, key)`` that were answered at all.

    ``bindings`` have the names that earlier rounds gave; ``order(path, batch_id, round_place)`` is
    the order of the batches, in which answers are merged. The order of the steps is part of the
    meaning: clashes within requests are settled before names are validated, clashes within files
    after.
    """
    # each is read several times below
    asked = materialize(filter_answers(requests, answers), "asked")
    scoped = materialize(resolve_scope_conflicts(asked, requests, bindings), "scoped")
    kept = scoped.where("outcome <> 'unresolved'").join(order, ["path", "batch_id"])
    flat = kept.select("path", F.struct("round_place", "seq").alias("seq"), "key", "new_name")
    normal = normalize_keys(merge_renames(flat), name_counts(bindings))
    valid, invalid = split_invalid(materialize(normal, "normal"))
    settled = materialize(resolve_global_conflicts(valid, bindings), "settled")
    whole = F.lit(None).cast("string").alias("batch_id")
    log = scoped.select("path", "batch_id", "key", "outcome")
    log = log.unionByName(invalid.select("path", whole, "key", F.lit("invalid").alias("outcome")))
    log = log.unionByName(settled.select("path", whole, "key", F.concat(F.lit("file_"), "outcome").alias("outcome")))
    return settled.where("outcome <> 'unresolved'").select("path", "seq", "key", "new_name"), log, asked.select("path", "batch_id", "key")
