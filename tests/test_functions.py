from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from symloom.functions import names as N
from symloom.functions import text as X


def one(spark, column, **values):
    fields = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], fields).select(column.alias("v")).first()["v"]


FLAGGED = "a b A m aa xy a1 b2 x9 a2__u1 h__u1 i__u6 j__u2 face a_b".split()
NOT_FLAGGED = "z i j k id io ui set get map key val processData__u2 userName processData handleClick fetchUserData abc id__u3".split()


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in [*FLAGGED, *NOT_FLAGGED, "", None]], "n string")
    got = {r["n"]: r["f"] for r in df.select("n", N.is_obfuscated(F.col("n")).alias("f")).collect()}
    assert {n for n, f in got.items() if f} == set(FLAGGED)
    assert got[None] is False and got[""] is False


def test_parser_rule_differs(spark):
    df = spark.createDataFrame([(n,) for n in ["if", "face", "ctx", "a__u1", "aab", "log", "q"]], "n string")
    got = {r["n"]: r["f"] for r in df.select("n", N.is_obfuscated_parser(F.col("n")).alias("f")).collect()}
    assert got == {"if": False, "face": False, "ctx": False, "a__u1": True, "aab": True, "log": False, "q": True}


@pytest.mark.parametrize(("key", "want"), [("a__u1:42", ("a__u1", 42)), ("a__u1", None), ("a__u1:x", None), (":3", None), ("a:b:7", ("a:b", 7)), ("", None), (None, None)])
def test_keys(spark, key, want):
    got = one(spark, N.parse_rename_key(F.col("k")), k=key)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("name", "want"), [("value", True), (" v ", True), ("class", False), ("constructor", False), ("9a", False), ("$_", True), ("", False), (None, False), ("a-b", False)])
def test_valid(spark, name, want):
    assert one(spark, N.is_valid_identifier(F.col("n")), n=name) is want


def test_clip_and_number(spark):
    assert one(spark, X.clip_line(F.lit("abcdefgh"), 6)) == "abc..."
    assert one(spark, X.clip_line(F.lit("abcdefgh"), 2)) == "..." and one(spark, X.clip_line(F.lit("abc"), 0)) == "abc"
    assert one(spark, X.numbered_line(F.lit(20), F.lit("var di = create();"))) == "    21 | var di = create();"
    assert one(spark, X.numbered_line(F.lit(12345678), F.lit("x"))) == "12345679 | x"


def middle(text, most):
    if most <= 0 or len(text) <= most:
        return text
    keep = most - len(X.MARKER)
    return text[:most] if keep <= 32 else text[: int(keep * 0.7)] + X.MARKER + text[-(keep - int(keep * 0.7)) :]


@pytest.mark.parametrize("most", [0, 1, 20, 53, 54, 90, 111, 120, 399, 400, 500])
def test_middle(spark, most):
    text = "A" * 200 + "B" * 200
    assert one(spark, X.truncate_middle(F.col("t"), most), t=text) == middle(text, most)


def test_limits(spark):
    got = one(spark, X.limit_prompt(F.col("t"), F.create_map(F.lit("s"), F.col("t")), 100), t="x" * 5000)
    assert (len(got["context"]), len(got["snippets"]["s"])) == (2048, 1024)
    got = one(spark, X.compact_prompt(F.col("t"), F.create_map(F.lit("s"), F.col("t")), 32000), t="x" * 50000)
    assert (len(got["context"]), len(got["snippets"]["s"])) == (8000, 2000)


@pytest.mark.parametrize(("message", "want"), [("Range of input length should be [1, 131072]", "too_long"), ("Error code: 429 - {'message': 'Throttling: TPM'}", "retryable"), ("boom", "skip"), (None, None)])
def test_errors(spark, message, want):
    assert one(spark, X.classify_error(F.col("m")), m=message) == want


JSON = [
    ('Here:\n```json\n{"a": "first", "b": "second"}\n```', {"a": "first", "b": "second"}),
    ('```\n{"a": "first"}\n```', {"a": "first"}),
    (' {"a:3": "first"} ', {"a:3": "first"}),
    ('the answer {"a": "first"} is', {"a": "first"}),
    ('{"a":{"nested":"value"}}', {"a": '{"nested":"value"}'}),
    ("```json\nnot json\n```\n{\"a\": \"x\"}", {"a": "x"}),
    ("no object", None),
    ("[1, 2]", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize(("body", "want"), JSON)
def test_json(spark, body, want):
    assert one(spark, X.extract_json(F.col("b")), b=body) == want


def test_message_text(spark):
    none = F.lit(None).cast("string")
    block = lambda a, b: F.struct(F.lit(a).cast("string").alias("text"), F.lit(b).cast("string").alias("content"))
    nothing = F.lit(None).cast("array<struct<text:string,content:string>>")
    assert one(spark, X.message_text(none, F.array(block('{"a":"', None), block('name"}', None), block("", "!")), none, none)) == '{"a":"name"}!'
    assert one(spark, X.message_text(none, nothing, F.lit("  "), F.lit("out"))) == "out"
    assert one(spark, X.error_detail(F.lit("435"), F.lit(" busy "), none)) == "provider_details: status=435, msg=busy"


def test_prompts_keep_braces(spark):
    got = one(spark, X.render_prompt(F.lit("{symbol}"), F.array(F.lit("a")), F.create_map(F.lit("a"), F.lit(3)), F.create_map(F.lit("a"), F.lit("{key}"))))
    assert "{symbol}" in got and "{key}" in got and "a (defined at line 3)" in got
    got = one(spark, X.render_prompt(F.lit("c"), F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit(3)), F.create_map(F.lit("a"), F.lit("s"))))
    assert "- a (line 3)\n- b" in got


def test_positions_and_ranges(spark):
    p = lambda r, c: X.position(F.lit(r), F.lit(c))
    assert one(spark, X.position_lt(p(1, 5), p(1, 10)) & X.position_lt(p(1, 10), p(2, 0)))
    assert one(spark, X.range_contains(p(0, 0), p(10, 0), p(2, 0), p(5, 0)))
    assert one(spark, X.range_overlaps(p(0, 0), p(10, 0), p(5, 0), p(15, 0)) & ~X.range_overlaps(p(0, 0), p(10, 0), p(20, 0), p(30, 0)))
