from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, c string, r string, before long, fp long, _k_digest string"


def prose(rnd: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, repeated rows and odd characters."""
    rnd = random.Random(5)
    en = ["the", "and", "of", "thing", "water", "house", "It's", "running", "blue,", "they're", "end."]
    de = ["der", "und", "die", "größe", "häuser", "nicht", "über", "zeit,", "möglich", "straße."]
    out = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        out.append((i, prose(rnd, rnd.randint(1, 90), en if lang == "en" else de), lang, f"src{i % 3}"))
    out.append((60, out[3][1], "en", "src0"))
    out += [(61 + i, "same text in a large group of copies", "en", "src0") for i in range(25)]
    out += [(90, None, None, None), (None, "no id here at all", "en", "src1"), (91, "", "de", "src2"), (92, " \t\n ", None, "src1")]
    out += [(93, "é" * 300 + " 😀 <|endoftext|> 日本語 ﬁ Σς İ x\x1cy", "de", None), (94, prose(rnd, 9000, en), "en", "src2"), (95, "123 456 !!! ###", "en", "src1")]
    out += [(96, "### !!! $$$ %%% " * 12, "en", "src0"), out[5], out[5], (None, None, None, None), (5, "another text under id five", "en", "src1")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c", "r", 3, 4, "k") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
