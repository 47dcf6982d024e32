"""Column functions about names: which look machine-made, which are keys, which are valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the two name rules and of the language.
KEPT = ["i", "j", "k", "x", "y", "z", "id", "db", "io", "ui", "os", "fs", "ls", "rm", "cp", "up", "on", "in", "to"]
ABBREVIATIONS = ["id", "io", "ui", "db", "fn", "cb", "ev", "el", "tx", "rx"]
SHORT_WORDS = ["set", "get", "map", "key", "val", "arr", "obj", "str", "num", "err", "req", "res"]
PARSER_KEPT = [*KEPT, "fn", "cb", "ev", "el", "tx", "rx", "req", "res", "err", "ctx", "app", "set", "get", "map", "key", "val", "arr", "obj", "str", "num"]
PARSER_ABBREVIATIONS = [*ABBREVIATIONS, "if", "do", "of"]
PARSER_SHORT_WORDS = ["set", "get", "map", "key", "val", "arr", "obj", "str", "num", "err", "log", "run", "add", "sub", "mul", "div", "new", "old", "src", "dst"]
RESERVED = [
    "await", "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends",
    "false", "finally", "for", "function", "if", "import", "in", "instanceof", "new", "null", "return", "super", "switch", "this", "throw", "true",
    "try", "typeof", "var", "void", "while", "with", "yield", "implements", "interface", "let", "package", "private", "protected", "public", "static",
]
NOT_A_NAME = [*RESERVED, "constructor"]
IDENTIFIER = r"^[A-Za-z_$][A-Za-z0-9_$]*$"
UNIQUE_SUFFIX = r"(?s)^(.+)__u[0-9]+$"


def uniquify_base(name: Column) -> Column:
    """Struct (base, was_uniquified): the name before ``__u<digits>``."""
    stripped = F.regexp_extract(name, UNIQUE_SUFFIX, 1)
    return F.when(name.isNotNull(), F.struct(F.when(stripped != "", stripped).otherwise(name).alias("base"), (stripped != "").alias("was_uniquified")))


def _distinct_letters(name: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(F.lower(name), ""), lambda c: c != "")))


def _short_rules(name: Column, abbreviations: list[str], words: list[str], hexadecimal: bool) -> Column:
    lower, size = F.lower(name), F.length(name)
    out = (
        F.when(size == 1, True)
        .when(size == 2, ~lower.isin(abbreviations))
        .when(name.rlike(r"^[a-zA-Z][0-9]+$"), True)
        .when((size <= 3) & name.rlike(r"^[a-zA-Z]+$") & lower.isin(words), False)
        .when((size <= 3) & name.rlike(r"^[a-zA-Z]+$") & (_distinct_letters(name) <= 2), True)
        .when(F.contains(name, F.lit("_")) & (size <= 5), True)
    )
    if hexadecimal:
        out = out.when((size >= 4) & lower.rlike(r"^[a-f0-9]+$"), True)
    return out.otherwise(False)


def is_obfuscated(name: Column) -> Column:
    """Whether a name looks machine-made, its unique suffix apart; null and empty are not."""
    # every rule reads the base, so the pattern is kept from names that cannot match; no kept name can
    stripped = F.when(F.contains(name, F.lit("__u")), F.nullif(F.regexp_extract(name, UNIQUE_SUFFIX, 1), F.lit("")))
    rules = _short_rules(F.coalesce(stripped, name), ABBREVIATIONS, SHORT_WORDS, hexadecimal=True)
    return F.when(name.isNull() | (name == "") | F.lower(name).isin(KEPT), False).otherwise(rules)


def is_obfuscated_parser(name: Column) -> Column:
    """The parser's own rule: more kept words, no suffix, no hexadecimal names."""
    rules = _short_rules(name, PARSER_ABBREVIATIONS, PARSER_SHORT_WORDS, hexadecimal=False)
    return F.when(name.isNull() | (name == "") | F.lower(name).isin(PARSER_KEPT), False).otherwise(rules)


def parse_rename_key(key: Column) -> Column:
    """Struct (name, line) of ``name:line``, split at the last colon; null for other keys."""
    pattern = r"(?s)^(.+):([0-9]+)$"
    return F.when(key.rlike(pattern), F.struct(F.regexp_extract(key, pattern, 1).alias("name"), F.regexp_extract(key, pattern, 2).cast("long").alias("line")))


def format_rename_key(name: Column, line: Column) -> Column:
    """``name:line`` with the line counted from 1; ``line`` counts from 0."""
    return F.concat(name, F.lit(":"), (line + 1).cast("string"))


def is_valid_identifier(name: Column) -> Column:
    """Whether a name, trimmed, may be given to a variable; null may not."""
    own = F.btrim(name, F.lit(" \t\n\r\f\x0b"))
    return F.coalesce(own.rlike(IDENTIFIER) & ~own.isin(NOT_A_NAME), F.lit(False))
