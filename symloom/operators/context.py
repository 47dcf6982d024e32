"""Joins that build the context of a request: numbered lines around scopes, names, references.

Every window of lines is bounded, so the wanted line numbers are exploded and met with the lines
by an equi-join on (path, line); text is joined last, after limits have cut the numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.functions.lexer import EXPORTED, IMPORTED, SHORT
from symloom.functions.text import LINE_CHARS, clip_line, limit_prompt, numbered_line
from symloom.operators.extract import binding_references, occurrences
from symloom.storage import materialize

PADDING = 10
#: Marks and headings of the texts that a naming function reads.
MARK, NO_MARK = " >>> ", "     "


#: Lines that are joined together, as one row, and those that are read together for snippets.
PACK, SPAN = 64, 1024


def _found(wanted: DataFrame, keys: list[str], lines: DataFrame, forms: dict[str, Column]) -> DataFrame:
    """``keys``, ``_pack`` and ``_lines``: the lines of ``at`` in order, a row a pack in which there are some."""
    pack = lambda n: F.shiftright(n, PACK.bit_length() - 1).cast("int")
    rows = lines.select("path", "line", *[c.alias(name) for name, c in forms.items()])
    packs = rows.groupBy("path", pack(F.col("line")).alias("_pack")).agg(F.collect_list(F.struct("line", *forms)).alias("_lines"))
    place = lambda i: F.get(F.filter("_lines", lambda x: x["line"] == F.col("_pack") * PACK + i), F.lit(0))
    packs = packs.select("path", "_pack", F.transform(F.sequence(F.lit(0), F.lit(PACK - 1)), place).alias("_lines"))
    own = wanted.select(*keys, "at", F.explode(F.array_distinct(F.transform("at", pack))).alias("_pack"))
    own = own.withColumn("at", F.sort_array(F.filter("at", lambda x: pack(x) == F.col("_pack"))))
    found = own.join(packs, ["path", "_pack"]).withColumn("_lines", F.filter(F.transform("at", lambda x: F.get("_lines", (x - F.col("_pack") * PACK).cast("int"))), lambda x: x.isNotNull()))
    return found.where(F.size("_lines") > 0).select(*keys, "_pack", "_lines")


def _blocks(wanted: DataFrame, keys: list[str], lines: DataFrame, forms: dict[str, Column], text: Callable[[Column], Column], dealt: list[str] | None = None) -> DataFrame:
    """``keys`` and ``block``: the lines of ``at``, an array of numbers, as text in order; keys that show none
    are left out.

    ``path`` is one of ``keys``; a file has a line once. Lines are packed by 64, a place for each, and meet a
    key once a pack, so that keys are not shuffled with every line and take theirs by number. ``forms`` are
    made once a line, from ``line`` and ``text``; ``text`` says what a key shows of a line's forms. What is
    found of a pack moves as text, by ``dealt``, a part of ``keys``, where what follows groups by it.
    """
    found = _found(wanted, keys, lines, forms)
    # a pack whose lines have no text adds nothing, not even a line's end
    part = F.nullif(F.array_join(F.transform("_lines", text), "\n"), F.lit(""))
    found = found.select(*keys, "_pack", part.alias("_part"))
    found = found if dealt is None else found.repartition(*dealt)
    parts = F.sort_array(F.collect_list(F.struct("_pack", "_part")))
    return found.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["_part"]), "\n").alias("block"))


def _joined(text: Callable[[Column, Column], Column]) -> Column:
    """The shown lines as text, each by its number and text."""
    return F.array_join(F.transform("shown", lambda x: text(x["line"], x["text"])), "\n")


def _contexts(wanted: DataFrame, lines: DataFrame, clip: int | None = None) -> DataFrame:
    """``path, batch_id, context`` of ``wanted(path, batch_id, at)``."""
    form = numbered_line(F.col("line"), F.col("text"), *([] if clip is None else [clip]))
    return _blocks(wanted, ["path", "batch_id"], lines, {"shown": form}, lambda x: x["shown"]).withColumnRenamed("block", "context")


def _marked(text: Column, here: Column) -> Column:
    return F.concat(F.when(here, F.lit(MARK)).otherwise(F.lit(NO_MARK)), text)


def file_ends(lines: DataFrame) -> DataFrame:
    return lines.groupBy("path").agg((F.max("line") + 1).cast("int").alias("n_lines"))


def _between(first: Column, after: Column) -> Column:
    """Numbers from ``first`` to before ``after``; none if there are none."""
    return F.when(after > first, F.sequence(first, after - 1)).otherwise(F.array().cast("array<int>"))


def scope_context(batches: DataFrame, lines: DataFrame, max_lines: int = 500) -> DataFrame:
    """``path, batch_id, context``: a batch's lines with ten around, numbered.

    Longer ones: the first and last 50 lines and five around each identifier; within the file.
    """
    own = batches.join(file_ends(lines), "path")
    first, after = F.greatest(F.col("start_row") - PADDING, F.lit(0)), F.least(F.col("end_row") + PADDING, F.col("n_lines"))
    own = own.select("path", "batch_id", "identifiers", "n_lines", first.alias("a"), after.alias("b"))
    a, b = F.col("a"), F.col("b")
    near = F.flatten(F.transform("identifiers", lambda i: _between(F.greatest(a, i["line"] - 5), F.least(b, i["line"] + 5))))
    ends = F.concat(_between(a, F.least(a + 50, F.col("n_lines"))), _between(F.greatest(b - 50, F.lit(0)), b), near)
    return _contexts(own.select("path", "batch_id", F.when(b - a > max_lines, F.array_distinct(ends)).otherwise(_between(a, b)).alias("at")), lines, 0)


def line_snippets(ids: DataFrame, lines: DataFrame, radius: int = 3, clip: int = 0) -> DataFrame:
    """``path, line, snippet``: the lines around each wanted line, which is marked."""
    wanted = ids.select("path", "line").distinct().withColumn("wanted", F.lit(True))
    # a line goes to its block, at its ends to the next one too, and is read there with those around it
    block = lambda n: F.floor(n / SPAN).cast("int")
    n = F.col("line")
    here = lines.select("path", "line", F.struct("line", "text").alias("l"), F.explode(F.sequence(block(F.greatest(n - radius, F.lit(0))), block(n + radius))).alias("block"), F.lit(False).alias("wanted"))
    rows = here.unionByName(wanted.select("path", "line", F.lit(None).cast(here.schema["l"].dataType).alias("l"), block(n).alias("block"), "wanted"))
    near = W.partitionBy("path", "block").orderBy("line").rangeBetween(-radius, radius)
    rows = rows.select("path", "line", "wanted", F.collect_list("l").over(near).alias("shown")).where(F.col("wanted") & (F.size("shown") > 0))
    rows = rows.withColumn("shown", F.array_sort("shown"))
    return rows.select("path", "line", _joined(lambda x, t: _marked(numbered_line(x, t, clip), x == F.col("line"))).alias("snippet"))


def small_scope_context(requests: DataFrame, lines: DataFrame, max_lines: int = 200) -> DataFrame:
    """Context of requests whose scope has at most ``max_lines`` lines: all of it, ten around."""
    own = requests.where(F.col("end_row") - F.col("start_row") + 1 <= max_lines).join(file_ends(lines), "path")
    span = _between(F.greatest(F.col("start_row") - PADDING, F.lit(0)), F.least(F.col("end_row") + PADDING, F.col("n_lines")))
    return _contexts(own.select("path", "batch_id", span.alias("at")), lines)


def large_scope_context(requests: DataFrame, lines: DataFrame, max_lines: int = 200, around: int = 20) -> DataFrame:
    """Context of requests with larger scopes: lines around their symbols, the first ones only
    where these are more than ``max_lines``."""
    own = requests.where(F.col("end_row") - F.col("start_row") + 1 > max_lines).join(file_ends(lines), "path")
    near = F.flatten(F.transform("identifiers", lambda i: F.sequence(F.greatest(i["line"] - around, F.lit(0)), i["line"] + around - 1)))
    near = F.array_sort(F.array_distinct(F.filter(near, lambda x: x < F.col("n_lines"))))
    return _contexts(own.select("path", "batch_id", F.slice(near, 1, max_lines).alias("at")), lines)


def symbol_references(symbols: DataFrame, bindings: DataFrame, lines: DataFrame, most: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """``path, name, line, place, ref_line``: where a declared name is referred to, in order.

    ``symbols(path, name, line)``. The binding's own references, or, where it has none, the other
    lines in which the name occurs (by ``index``, if there is one); ``place`` counts from 1.
    """
    known = symbols.join(binding_references(bindings), ["path", "name", "line"], "left")
    own = known.where("reference_lines is not null").select("path", "name", "line", F.explode("reference_lines").alias("ref_line"))
    seen = known.where("reference_lines is null").select("path", "name", "line").join(occurrences(lines, symbols, index).withColumnRenamed("line", "ref_line"), ["path", "name"]).where("ref_line <> line")
    rows = own.unionByName(seen)
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("path", "name", "line").orderBy("ref_line")))
    return rows if most is None else rows.where(F.col("place") <= most)


def _first(references: DataFrame, most: int) -> DataFrame:
    return references.where(F.col("place") <= most)


def global_context(symbols: DataFrame, bindings: DataFrame, lines: DataFrame, max_lines: int = 200, around: int = 12, ref_around: int = 2, most: int = 10, references: DataFrame | None = None) -> DataFrame:
    """``path, name, line, context`` of top-level symbols: a header, the declaration's lines, then
    those around the references, in this order until ``max_lines``, sorted."""
    references = _first(references, most) if references is not None else symbol_references(symbols, bindings, lines, most)
    keys = ["path", "name", "line"]
    refs = F.transform(F.array_sort(F.collect_list(F.struct("place", "ref_line"))), lambda x: x["ref_line"])
    own = symbols.join(references.groupBy(*keys).agg(refs.alias("refs")), keys, "left").join(file_ends(lines), "path")
    around_refs = F.flatten(F.transform(F.coalesce("refs", F.array().cast("array<int>")), lambda r: _near(r, ref_around)))
    turns = F.filter(F.concat(_near(F.col("line"), around), around_refs), lambda x: x < F.col("n_lines"))
    # each line once, at its first turn, as far as there is room
    own = own.select(*keys, "refs", F.slice(F.array_distinct(turns), 1, max_lines).alias("at"))
    own = own.withColumn("refs", F.array_join(F.transform(F.array_sort("refs"), lambda x: (x + 1).cast("string")), ", "))
    form = numbered_line(F.col("line"), F.col("text"))
    out = _blocks(own, [*keys, "refs"], lines.select("path", "line", "text"), {"shown": form}, lambda x: x["shown"])
    header = F.concat(F.lit("Global symbol: "), "name", F.lit("\nDeclaration line: "), (F.col("line") + 1).cast("string"), F.lit("\nReference lines: "), F.coalesce("refs", F.lit("none")), F.lit("\n"))
    return out.select("path", "name", "line", F.concat(header, "block").alias("context"))


def global_snippets(symbols: DataFrame, bindings: DataFrame, lines: DataFrame, radius: int = 3, most: int = 3, references: DataFrame | None = None) -> DataFrame:
    """``path, name, line, snippet``: the declaration's block and those of the first references."""
    references = _first(references, most) if references is not None else symbol_references(symbols, bindings, lines, most)
    parts = symbols.select("path", "name", "line", F.lit(0).alias("place"), F.col("line").alias("center"))
    parts = parts.unionByName(references.select("path", "name", "line", "place", F.col("ref_line").alias("center")))
    blocks = line_snippets(parts.select("path", F.col("center").alias("line")), lines, radius)
    rows = parts.join(blocks.select("path", F.col("line").alias("center"), "snippet"), ["path", "center"])
    title = F.when(F.col("place") == 0, F.lit("Declaration:\n")).otherwise(F.concat(F.lit("Reference "), F.col("place").cast("string"), F.lit(" (line "), (F.col("center") + 1).cast("string"), F.lit("):\n")))
    own = F.array_sort(F.collect_list(F.struct("place", F.concat(title, "snippet").alias("t"))))
    return rows.groupBy("path", "name", "line").agg(F.array_join(F.transform(own, lambda x: x["t"]), "\n\n").alias("snippet"))


def reference_preview(symbols: DataFrame, bindings: DataFrame, lines: DataFrame, most: int = 5, clip: int = 300) -> DataFrame:
    """Text of the declaration and of the first references of a binding, clipped."""
    known = symbols.join(binding_references(bindings), ["path", "name", "line"], "left")
    head = known.join(lines.select("path", "line", clip_line(F.col("text"), clip).alias("declaration_text")), ["path", "line"], "left")
    refs = known.select("path", "name", "line", F.explode(F.slice("reference_lines", 1, most)).alias("at")).join(lines.select("path", F.col("line").alias("at"), "text"), ["path", "at"])
    own = F.array_sort(F.collect_list(F.struct("at", F.concat((F.col("at") + 1).cast("string"), F.lit(": "), clip_line(F.col("text"), clip)).alias("t"))))
    texts = refs.groupBy("path", "name", "line").agg(F.transform(own, lambda x: x["t"]).alias("reference_texts"))
    out = head.select("path", "name", "line", F.coalesce("declaration_text", F.lit("")).alias("declaration_text")).join(texts, ["path", "name", "line"], "left")
    return out.withColumn("reference_texts", F.coalesce("reference_texts", F.array().cast("array<string>")))


def _near(center: Column, radius: int) -> Column:
    """Line numbers around a line, from 0."""
    return F.sequence(F.greatest(center - radius, F.lit(0)), center + radius)


def request_lines(batches: DataFrame, references: DataFrame, max_lines: int = 200, around: int = 20) -> DataFrame:
    """``batches`` with ``refs(place, refs)`` of their top-level symbols, ``context``: the lines of the
    context, and ``at``: all lines that the request shows, in arrays of numbers.

    ``batches`` with ``n_lines`` of their files; ``references(path, batch_id, place, refs)`` of
    top-level symbols, at most ten each, in order. For contexts see ``small_scope_context``,
    ``large_scope_context`` and ``global_context``; snippets show three lines around each symbol, and
    around the first three references of a top-level one.
    """
    top, alone = F.col("scope_type") == "program", (F.col("scope_type") == "program") & (F.size("identifiers") == 1)
    ends = lambda own: F.filter(own, lambda x: x < F.col("n_lines"))
    small = _between(F.greatest(F.col("start_row") - PADDING, F.lit(0)), F.least(F.col("end_row") + PADDING, F.col("n_lines")))
    near = F.flatten(F.transform("identifiers", lambda i: F.sequence(F.greatest(i["line"] - around, F.lit(0)), i["line"] + (around - 1))))
    large = F.slice(F.array_sort(F.array_distinct(ends(near))), 1, max_lines)
    known = references.groupBy("path", "batch_id").agg(F.collect_list(F.struct("place", "refs")).alias("refs"))
    own = batches.join(known, ["path", "batch_id"], "left")
    none = F.array().cast("array<int>")
    own = own.withColumn("refs", F.when(top & F.col("refs").isNotNull(), F.col("refs")).otherwise(F.array().cast("array<struct<place:int,refs:array<int>>>")))
    # declaration first, then the references in order: each line once, as far as there is room
    first = F.coalesce(F.get(F.filter("refs", lambda x: x["place"] == 0), F.lit(0))["refs"], none)
    turns = F.array_distinct(ends(F.concat(_near(F.get("identifiers", F.lit(0))["line"], 12), F.flatten(F.transform(first, lambda r: _near(r, 2))))))
    small_one = F.col("end_row") - F.col("start_row") + 1 <= max_lines
    own = own.withColumn("context", F.when(alone, F.slice(turns, 1, max_lines)).when(small_one, small).otherwise(large))
    symbols = F.flatten(F.transform("identifiers", lambda i: _near(i["line"], 3)))
    outer = F.flatten(F.transform("refs", lambda x: F.flatten(F.transform(F.slice(x["refs"], 1, 3), lambda r: _near(r, 3)))))
    return own.withColumn("at", F.array_distinct(F.concat("context", symbols, outer)))


def build_requests(batches: DataFrame, lines: DataFrame, bindings: DataFrame, max_lines: int = 200, max_size: int = 32000, index: DataFrame | None = None) -> DataFrame:
    """Request rows of batches: symbols, their lines (from 1; the last one of a name), context by
    the kind and size of the scope, snippets, all within the size limits.

    A request's lines, those of its context and of all its snippets, meet the text in one join and move
    once, however many snippets show a line (``_found``); its texts are put together from them.
    """
    batches = materialize(batches.join(file_ends(lines), "path"), "batches")
    top = batches.where("scope_type = 'program'").select("path", "batch_id", F.posexplode("identifiers").alias("place", "i")).select("path", "batch_id", "place", F.col("i.name").alias("name"), F.col("i.line").alias("line"))
    found = symbol_references(top.select("path", "name", "line").distinct(), bindings, lines, 10, index)
    found = found.groupBy("path", "name", "line").agg(F.array_sort(F.collect_list(F.struct("place", "ref_line"))).alias("r")).select("path", "name", "line", F.transform("r", lambda x: x["ref_line"]).alias("refs"))
    references = top.join(found, ["path", "name", "line"]).select("path", "batch_id", "place", "refs")
    wanted = materialize(request_lines(batches, references, max_lines), "wanted")
    texts = _found(wanted.select("path", "batch_id", "at"), ["path", "batch_id"], lines, {"text": F.col("text")})
    texts = texts.select("path", "batch_id", "_lines").repartition("path", "batch_id").groupBy("path", "batch_id").agg(F.flatten(F.collect_list("_lines")).alias("_l"))
    rows = wanted.drop("at").join(texts, ["path", "batch_id"])
    each = lambda column, field: F.transform(column, lambda x: x[field])
    top, alone = F.col("scope_type") == "program", (F.col("scope_type") == "program") & (F.size("identifiers") == 1)
    refs = each("refs", "refs")
    put = _assembled()(top, each("identifiers", "name"), each("identifiers", "line"), F.col("context"), each("refs", "place"), F.transform(refs, F.size), F.flatten(refs), each("_l", "line"), each("_l", "text"))
    first = F.get(F.filter("refs", lambda x: x["place"] == 0), F.lit(0))["refs"]
    listed = F.nullif(F.array_join(F.transform(F.array_sort(first), lambda x: (x + 1).cast("string")), ", "), F.lit(""))
    header = F.concat(F.lit("Global symbol: "), F.get("identifiers", F.lit(0))["name"], F.lit("\nDeclaration line: "), (F.get("identifiers", F.lit(0))["line"] + 1).cast("string"), F.lit("\nReference lines: "), F.coalesce(listed, F.lit("none")), F.lit("\n"))
    keep = ["path", "batch_id", "scope_id", "scope_type", "range_start_row", "range_end_row"]
    rows = rows.withColumnsRenamed({"start_row": "range_start_row", "end_row": "range_end_row"})
    out = rows.select(*keep, F.when(alone, header).otherwise(F.lit("")).alias("_header"), put.alias("_p"))
    snippets = F.map_from_arrays("_p.symbols", "_p.snippets")
    out = out.select(*keep, F.col("_p.symbols").alias("symbols"), F.map_from_arrays("_p.symbols", "_p.lines").alias("symbol_lines"), limit_prompt(F.concat("_header", "_p.context"), snippets, max_size).alias("_l"))
    return out.select(*keep, "symbols", "symbol_lines", F.col("_l.context").alias("context"), F.col("_l.snippets").alias("snippets"))


def _assembled():
    """A function of columns: of a request whether it is top-level, its names, their lines, its context's
    lines, places of names with references, their numbers and lines, and the text of all its lines, to its
    symbols, their lines (from 1), its context and the snippets.

    A name that stands twice in a batch keeps its first place and its last line and snippet. Contexts
    and the snippets of a scope's own names are clipped (``numbered_line``), those of top-level names
    are not: their declaration and first three references have titles.
    """
    text, number, most = pa.string(), pa.int32(), LINE_CHARS
    kind = pa.struct([("symbols", pa.list_(text)), ("lines", pa.list_(number)), ("context", text), ("snippets", pa.list_(text))])

    def rows(column: pa.Array) -> Iterator[list]:
        own = column.flatten()
        values = own.to_numpy(zero_copy_only=False).tolist() if pa.types.is_integer(own.type) else own.to_pylist()
        at = 0
        for n in column.value_lengths().to_numpy(zero_copy_only=False).tolist():
            yield values[at : at + n]
            at += n

    @F.arrow_udf("struct<symbols:array<string>,lines:array<int>,context:string,snippets:array<string>>")
    def assemble(top: pa.Array, names: pa.Array, lines: pa.Array, contexts: pa.Array, places: pa.Array, sizes: pa.Array, refs: pa.Array, numbers: pa.Array, texts: pa.Array) -> pa.Array:
        symbols, at, shown, snippets, ends = [], [], [], [], [0]
        for outer, name, line, context, place, size, ref, n, t in zip(top.to_pylist(), *map(rows, (names, lines, contexts, places, sizes, refs, numbers, texts)), strict=True):
            # a line without text is there, but adds nothing
            whole = {k: x if x is None else f"{k + 1:>6} | {x}" for k, x in zip(n, t, strict=True)}
            clipped = whole | {k: f"{k + 1:>6} | {x[: most - 3]}..." for k, x in zip(n, t, strict=True) if x is not None and len(x) > most}
            forms = whole if outer else clipped

            def block(center: int, forms: dict = forms) -> str | None:
                own = [k for k in range(max(center - 3, 0), center + 4) if k in forms]
                return "\n".join((MARK if k == center else NO_MARK) + forms[k] for k in own if forms[k] is not None) if own else None

            referred, a = {}, 0
            for p, m in zip(place, size, strict=True):
                referred[p] = ref[a : a + min(m, 3)]
                a += m
            last = {x: i for i, x in enumerate(name)}
            for i in last.values():
                found = block(line[i])
                if outer:
                    parts = [] if found is None else ["Declaration:\n" + found]
                    parts += [f"Reference {k} (line {c + 1}):\n{b}" for k, c in enumerate(referred.get(i, ()), 1) if (b := block(c)) is not None]
                    found = "\n\n".join(parts)
                snippets.append(found or "")
                at.append(line[i] + 1)
            symbols.extend(last)
            shown.append("\n".join(clipped[k] for k in sorted(context) if clipped.get(k) is not None))
            ends.append(len(symbols))
        lists = lambda values, of: pa.ListArray.from_arrays(pa.array(ends, number), pa.array(values, of))
        return pa.StructArray.from_arrays([lists(symbols, text), lists(at, number), pa.array(shown, text), lists(snippets, text)], fields=list(kind))

    return assemble


def select_round(batches: DataFrame, remaining: DataFrame, n: int) -> DataFrame:
    """The next ``n`` batches of each file in order, with the names that remain; a name goes to
    its first batch only, empty batches are left out."""
    ids = batches.select("path", "batch_id", "batch_seq", F.posexplode("identifiers").alias("place", "i")).withColumn("name", F.col("i.name"))
    ids = ids.join(remaining.select("path", "name").distinct(), ["path", "name"], "left_semi")
    first = W.partitionBy("path", "name").orderBy("batch_seq")
    ids = ids.withColumn("turn", F.dense_rank().over(first)).where("turn = 1")
    kept = ids.groupBy("path", "batch_id", "batch_seq").agg(F.array_sort(F.collect_list(F.struct("place", "i"))).alias("r"))
    kept = kept.withColumn("round_place", F.row_number().over(W.partitionBy("path").orderBy("batch_seq"))).where(F.col("round_place") <= n)
    kept = kept.select("path", "batch_id", F.transform("r", lambda x: x["i"]).alias("identifiers"), "round_place")
    return batches.drop("identifiers").join(kept, ["path", "batch_id"]).withColumn("n_identifiers", F.size("identifiers"))


def token_renames(tokens: DataFrame, renames: DataFrame) -> DataFrame:
    """``path, line, column, name, new_name, role`` of the tokens that renames change.

    ``tokens`` as ``extract.tokens`` gives them; ``renames(path, symbol, line, new_name)`` with the
    line from 1, or null for the whole file. A declaration takes its line's entry, else the
    file's. A reference takes what the declarations of its scope were given (the last one's, where
    a scope declares a name more than once); an undeclared one takes the file's entry.
    """
    named = renames.where("line is not null").select("path", F.col("symbol").alias("name"), (F.col("line") - 1).cast("int").alias("line"), F.col("new_name").alias("by_line"))
    general = renames.where("line is null").select("path", F.col("symbol").alias("name"), F.col("new_name").alias("by_name"))
    own = tokens.where("is_declaration").join(named, ["path", "name", "line"], "left").join(general, ["path", "name"], "left")
    own = own.withColumn("new_name", F.coalesce("by_line", "by_name")).where("new_name is not null")
    given = own.groupBy("path", "scope_id", "name").agg(F.max_by("new_name", F.struct("line", "column")).alias("new_name"))
    columns = ["path", "line", "column", "name", "new_name", "role"]
    bound = tokens.where("not is_declaration and scope_id is not null").join(given, ["path", "scope_id", "name"])
    loose = tokens.where("not is_declaration and scope_id is null").join(general.withColumnRenamed("by_name", "new_name"), ["path", "name"])
    return own.select(*columns).unionByName(bound.select(*columns)).unionByName(loose.select(*columns))


def spelled(name: Column, new_name: Column, role: Column) -> Column:
    """What stands for a renamed token: names that are written short keep what they are called
    outside (``{a}`` becomes ``{a: b}``, an import ``a as b``, an export ``b as a``)."""
    longer = F.when(role == SHORT, F.concat(name, F.lit(": "), new_name)).when(role == IMPORTED, F.concat(name, F.lit(" as "), new_name)).when(role == EXPORTED, F.concat(new_name, F.lit(" as "), name))
    return F.when(name == new_name, name).otherwise(F.coalesce(longer, new_name))


def rewrite_lines(lines: DataFrame, hits: DataFrame) -> DataFrame:
    """Lines with the tokens of ``hits(path, line, column, name, new_name, role)`` replaced; lines
    without a hit pass untouched."""
    text = spelled(F.col("name"), F.col("new_name"), F.col("role")).alias("new_name")
    own = hits.select("path", "line", F.struct("column", F.length("name").alias("n"), text).alias("h")).distinct()
    changed = own.groupBy("path", "line").agg(F.array_sort(F.collect_list("h")).alias("h"))
    text, n = F.col("text"), F.size("h")
    start = lambda i: F.when(i > 0, F.get(F.col("h"), i - 1)["column"] + F.get(F.col("h"), i - 1)["n"]).otherwise(0)
    piece = lambda x, i: F.concat(F.substr(text, start(i) + 1, x["column"] - start(i)), x["new_name"])
    rebuilt = F.concat(F.array_join(F.transform("h", piece), ""), F.substr(text, start(n) + 1, F.length(text)))
    return lines.join(changed, ["path", "line"], "left").select("path", "line", F.when(F.col("h").isNull(), text).otherwise(rebuilt).alias("text"))


def changed_lines(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """``path, line`` of the lines that other hits rewrite than before, or rewrite otherwise."""
    columns = ["path", "line", "column", "new_name"]
    now = after.select(*columns).distinct()
    if before is None:
        return now.select("path", "line").distinct()
    old = before.select(*columns).distinct()
    return now.join(old, columns, "left_anti").unionByName(old.join(now, columns, "left_anti")).select("path", "line").distinct()


def apply_renames(lines: DataFrame, tokens: DataFrame, renames: DataFrame) -> DataFrame:
    """Lines with their identifiers renamed; see ``token_renames`` for who takes which name."""
    return rewrite_lines(lines, token_renames(tokens, renames))
