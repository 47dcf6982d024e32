"""Column functions about text: clipping, numbering, limits, keys, errors, answers, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "\n... [truncated] ...\n"
LINE_CHARS = 500

# Phrases of error messages, in the order in which they are looked for.
TOO_LONG = ["range of input length", "input length", "context length", "maximum context length", "token limit"]
FATAL = ["openai-compatible api returned no usable content", "openai-compatible api returned unexpected response"]
RETRYABLE = [
    "error code: 429", "status code: 429", "too many requests", "throttling", "rate limit", "tpm", "rpm", "timeout", "timed out",
    "connection error", "temporarily unavailable", "service unavailable", "try again later",
]


def _column(x: Column | int | float | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clip_line(text: Column, max_chars: int = LINE_CHARS) -> Column:
    """At most ``max_chars`` characters, the last three as dots where cut; 0 or less: no limit."""
    if max_chars <= 0:
        return text
    cut = F.concat(F.substring(text, 1, max_chars - 3), F.lit("...")) if max_chars > 3 else F.lit("...")
    return F.when(F.length(text) > max_chars, cut).otherwise(text)


def numbered_line(line: Column, text: Column, max_chars: int = LINE_CHARS) -> Column:
    """``    12 | text`` for line 11 counted from 0; wider numbers are not cut."""
    number = (line + 1).cast("string")
    return F.concat(F.lpad(number, F.greatest(F.length(number), F.lit(6)), F.lit(" ")), F.lit(" | "), clip_line(text, max_chars))


def truncate_middle(text: Column, max_chars: Column | int) -> Column:
    """Keep 70 % of what fits at the head and the rest at the tail, around a marker."""
    most = _column(max_chars)
    keep = most - len(MARKER)
    head = F.floor(keep * F.lit(0.7)).cast("int")
    cut = F.concat(F.substr(text, F.lit(1), head), F.lit(MARKER), F.right(text, keep - head))
    return F.when((most <= 0) | (F.length(text) <= most), text).when(keep <= 32, F.substr(text, F.lit(1), most)).otherwise(cut)


def limit_prompt(context: Column, snippets: Column, max_context: Column | int) -> Column:
    """Struct (context, snippets) within the limits that follow from the size of the context."""
    size = _column(max_context)
    own = F.greatest(size, F.lit(2048))
    one = F.greatest(F.least(F.floor(size / 2).cast("int"), F.lit(12000)), F.lit(1024))
    return F.struct(truncate_middle(context, own).alias("context"), F.transform_values(snippets, lambda _, v: truncate_middle(v, one)).alias("snippets"))


def compact_prompt(context: Column, snippets: Column, max_context: Column | int) -> Column:
    """The limits of the second try: at most 8000 and 2000 characters."""
    size = _column(max_context)
    own = F.least(F.greatest(size, F.lit(2048)), F.lit(8000))
    one = F.least(F.greatest(F.least(F.floor(size / 2).cast("int"), F.lit(12000)), F.lit(1024)), F.lit(2000))
    return F.struct(truncate_middle(context, own).alias("context"), F.transform_values(snippets, lambda _, v: truncate_middle(v, one)).alias("snippets"))


def classify_error(message: Column) -> Column:
    """``too_long``, ``fatal``, ``retryable`` or ``skip``; null has no class."""
    lower = F.lower(message)
    has = lambda phrases: F.forall(F.array(*map(F.lit, phrases)), lambda p: ~F.contains(lower, p))
    return F.when(message.isNull(), None).when(~has(TOO_LONG), "too_long").when(~has(FATAL), "fatal").when(~has(RETRYABLE), "retryable").otherwise("skip")


# Seconds before the second attempt, at most, of jitter, and the bounds of a provider's hint.
FIRST_DELAY, MOST_DELAY, JITTER, HINTS = 1.5, 60.0, 0.8, (1.0, 120.0)


def request_delay(attempt: Column, hint: Column | None = None, jitter: bool = True) -> Column:
    """Seconds before a request is tried again; a provider's hint is clamped to 1 to 120."""
    own = F.least(F.lit(MOST_DELAY), F.lit(FIRST_DELAY) * F.pow(F.lit(2.0), attempt - 1))
    if jitter:
        own = own + F.rand() * JITTER
    return own if hint is None else F.when(hint.isNotNull(), F.least(F.lit(HINTS[1]), F.greatest(F.lit(HINTS[0]), hint.cast("double")))).otherwise(own)


def round_delay(streak: Column) -> Column:
    """Seconds after so many rounds in a row that could only be tried again."""
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), F.least(streak, F.lit(6))))


def fingerprint(source: Column) -> Column:
    return F.sha2(source, 256)


def path_hash(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 12)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot begins no extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def cache_key(path: Column, source: Column, uniquify: Column) -> Column:
    """Key of a preprocessed artifact."""
    return F.concat_ws("_", stem(path), path_hash(path), F.substring(fingerprint(source), 1, 16), F.when(uniquify, "uniq").otherwise("raw"))


def state_key(path: Column) -> Column:
    return F.concat(stem(path), F.lit("_"), path_hash(path), F.lit("_state.json"))


def json_text(body: Column) -> Column:
    """The first candidate that is JSON, if it is an object; else null.

    Candidates are the fenced blocks, the whole text, then what stands in braces; each kind is
    looked for only where the ones before gave nothing.
    """
    space = F.lit(" \t\n\r\f\x0b")
    good = lambda x: (x != "") & F.try_parse_json(x).isNotNull()
    first = lambda found: F.get(F.filter(found, good), F.lit(0))
    whole = F.btrim(body, space)
    fenced = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)```(?:json)?\s*\n?(.*?)\n?```"), F.lit(1)), lambda x: F.btrim(x, space))
    braces = F.regexp_extract_all(body, F.lit(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"), F.lit(0))
    found = F.coalesce(F.when(F.contains(body, F.lit("```")), first(fenced)), F.when(good(whole), whole), F.when(F.contains(body, F.lit("{")), first(braces)))
    # named once: a lambda's argument is computed once, however often its body speaks of it
    return F.transform(F.array(found), lambda x: F.when(F.startswith(F.ltrim(x), F.lit("{")), x))[0]


def extract_json(body: Column) -> Column:
    """An answer's object as map<string,string>, nested values as JSON text; null without one."""
    return F.from_json(json_text(body), "map<string,string>")


def answer_keys(body: Column) -> Column:
    """Keys of an answer's object in their order."""
    return F.json_object_keys(json_text(body))


def blocks_text(blocks: Column) -> Column:
    """Text of an array of structs (text, content): each block's text, else its content."""
    parts = F.transform(blocks, lambda b: F.coalesce(F.nullif(b["text"], F.lit("")), F.nullif(b["content"], F.lit(""))))
    parts = F.filter(parts, lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(parts, ""))


def message_text(content: Column, blocks: Column, choice_text: Column, output_text: Column) -> Column:
    """Text of an answer: its message (string or blocks), else the first of the others not blank."""
    shown = lambda c: F.when(F.btrim(c, F.lit(" \t\n\r\f\x0b")) != "", c)
    return F.coalesce(F.nullif(content, F.lit("")), blocks_text(blocks), shown(choice_text), shown(output_text))


def error_detail(status: Column, msg: Column, body: Column) -> Column:
    """What an unusable answer says about itself."""
    text = F.btrim(msg)  # the words below are fixed values
    parts = F.concat_ws(", ", F.concat(F.lit("status="), status.cast("string")), F.when(text != "", F.concat(F.lit("msg="), text)), F.concat(F.lit("body="), body))
    return F.when(parts != "", F.concat(F.lit("provider_details: "), parts)).otherwise("provider did not include parseable error details")


ONE = "Name one symbol of this code.\n\n{context}\n\nSymbol: {symbol}\nWhere it stands:\n{snippet}\n\nAnswer with a JSON object whose only key is \"{key}\"."
MANY = "Name these symbols of this code.\n\n{context}\n\nSymbols:\n{symbols}\n\nAnswer with a JSON object from old to new names; use name:line as a key where a name stands twice."


def render_prompt(context: Column, symbols: Column, lines: Column, snippets: Column, one: str = ONE, many: str = MANY) -> Column:
    """A request's prompt, from the template for one symbol or for many."""

    def fill(template: str, **values: Column) -> Column:
        # one pass over the template, so that braces in the values stay
        parts, rest = [], template
        while rest:
            names = [n for n in values if "{" + n + "}" in rest]
            if not names:
                parts.append(F.lit(rest))
                break
            first = min(names, key=lambda n: rest.index("{" + n + "}"))
            before, _, rest = rest.partition("{" + first + "}")
            parts += [F.lit(before), values[first]]
        return F.concat(*parts)

    symbol = F.get(symbols, F.lit(0))
    line = F.try_element_at(lines, symbol)
    single = fill(one, context=context, symbol=F.concat(symbol, F.coalesce(F.concat(F.lit(" (defined at line "), line.cast("string"), F.lit(")")), F.lit(""))), snippet=F.coalesce(F.try_element_at(snippets, symbol), F.lit("")), key=symbol)
    listed = F.transform(symbols, lambda s: F.concat(F.lit("- "), s, F.coalesce(F.concat(F.lit(" (line "), F.try_element_at(lines, s).cast("string"), F.lit(")")), F.lit(""))))
    return F.when(F.size(symbols) == 1, single).otherwise(fill(many, context=context, symbols=F.array_join(listed, "\n")))


def position(row: Column, column: Column) -> Column:
    return F.struct(row.alias("row"), column.alias("column"))


def position_lt(a: Column, b: Column) -> Column:
    return a < b


def position_le(a: Column, b: Column) -> Column:
    return a <= b


def range_contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether the range a holds the range b."""
    return (a_start <= b_start) & (a_end >= b_end)


def range_overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two ranges share a position, ends included."""
    return ~((a_end < b_start) | (b_end < a_start))
