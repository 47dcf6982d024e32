from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from symloom.llm.quotes import link_quotes, passages

ROWS = [
    (1, 0, "user", "How do I open it?\nThe lid is stuck."),
    (1, 1, "assistant", "> how do I  OPEN it?\nTurn it left."),
    (1, 2, "user", "> > How do I open it?\n>Turn it left.\n\nThat worked.\n"),
    (1, 3, "user", "Another thing.\n> never said by anyone"),
    (1, 4, "assistant", "> Another thing.\nYes?"),
    (1, 5, "user", "> Another thing.\n> Turn it left.\n> That worked.\nsame length decides"),
    (2, 0, "user", "> Turn it left.\nquotes another conversation"),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (None, 0, "user", "> How do I open it?\nno conversation"),
    (3, None, "user", "> x"),
    (3, 1, "user", "twin"),
    (3, 1, "user", "> later"),
    (3, 2, "user", "later"),
    (3, 4, "user", "> twin\n> later"),
]


def test_passages(spark):
    df = spark.createDataFrame([("a\n> b\n>> c\n> > d\ne",), ("",), (None,), (">",)], "text string")
    got = df.select("text", passages(F.col("text")).alias("p")).collect()
    assert [(x["level"], x["body"]) for x in got[0]["p"]] == [(0, "a"), (1, "b"), (2, "c\nd"), (0, "e")]
    assert [(x["level"], x["body"]) for x in got[1]["p"]] == [(0, "")] and got[2]["p"] is None
    assert [(x["level"], x["body"]) for x in got[3]["p"]] == [(1, "")]


def test_links(spark):
    messages = spark.createDataFrame([(*r, 0, "x") for r in ROWS], "conv_id long, turn long, role string, text string, level int, hash string").repartition(3)
    got = {(r["conv_id"], r["turn"], r["clean_text"]): r for r in link_quotes(messages).collect()}
    assert len(got) == len(ROWS)
    tree = {k: (r["reply_to"], r["thread"], r["depth"]) for k, r in got.items()}
    assert tree[1, 0, ROWS[0][3]] == (None, 0, 0)
    assert tree[1, 1, "Turn it left."] == (0, 0, 1)
    assert tree[1, 2, "That worked."] == (1, 0, 2)
    assert tree[1, 3, "Another thing."] == (None, 3, 0)
    assert tree[1, 4, "Yes?"] == (3, 3, 1)
    assert tree[1, 5, "same length decides"] == (3, 3, 1)
    assert tree[2, 0, "quotes another conversation"] == (None, 0, 0)
    assert tree[2, 1, None] == (None, 1, 0) and tree[2, 2, ""] == (None, 2, 0)
    assert tree[None, 0, "no conversation"] == (None, 0, 0)
    assert tree[3, None, ""] == (None, None, 0)
    assert tree[3, 1, "twin"] == tree[3, 1, ""] == (None, 1, 0)
    assert tree[3, 4, ""] == (2, 2, 1)
    assert got[1, 5, "same length decides"]["n_linked"] == 3 and got[1, 2, "That worked."]["n_quotes"] == 2
    assert link_quotes(messages.where("false")).collect() == []


MARKS = re.compile(r"(?:[ \t]*>)+[ \t]?")


def runs_of(text):
    out = []
    for line in (text or "").split("\n") if text is not None else []:
        m = MARKS.match(line)
        level, body = (m[0].count(">"), line[m.end() :]) if m else (0, line)
        if out and out[-1][0] == level:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
    return [(level, "\n".join(lines)) for level, lines in out]


def normal(body):
    return re.sub(r"[ \t\r\n\x0b\f]+", " ", body.lower()).strip(" ")


def brute(messages):
    """Links, replies, threads and clean texts by comparing every passage to every earlier message."""
    out = {}
    for conv, turn, text in messages:
        own = []
        for c, t, other in messages:
            if c == conv:
                mine = [b for level, b in runs_of(other) if level == 0]
                lines = [x for b in mine for x in b.split("\n")]
                own.append((t, {normal(x) for x in ["\n".join(mine), *mine, *lines]} - {""}))
        found: dict = {}
        for level, body in runs_of(text):
            for part, b in enumerate([body, *body.split("\n")] if level else []):
                sources = [t for t, said in own if normal(b) in said]
                if sources and min(sources) < turn:
                    x = found.setdefault((level, min(sources)), [0, 0])
                    x[0] += part > 0
                    x[1] += len(b) if part else 0
        best = max(((-level, n[1], t) for (level, t), n in found.items()), default=None)
        mine = "\n".join(b for level, b in runs_of(text) if level == 0)
        out[conv, turn] = [best[2] if best else None, sum(n[0] for n in found.values()), mine.strip("\n"), sum(level > 0 for level, _ in runs_of(text))]
    for (conv, turn), row in out.items():
        root, depth = turn, 0
        while out[conv, root][0] is not None:
            root, depth = out[conv, root][0], depth + 1
        row += [root, depth]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    """Threads that quote whole messages, parts and quotes, in other case and spacing, or nobody."""
    rnd = random.Random(seed)
    words = ["a", "lid", "turn", "left", "Open", "it", "why", "x > y", "so"]
    messages = []
    for conv in range(30):
        texts: list[str] = []
        for turn in range(rnd.randint(1, 9)):
            lines = []
            for _ in range(rnd.randint(0, 3)):
                if texts and rnd.random() < 0.7:
                    said = rnd.choice(texts).split("\n")
                    at = rnd.randrange(len(said))
                    for line in said[at : at + rnd.randint(1, 3)]:
                        line = line.upper() if rnd.random() < 0.2 else line.replace(" ", "  ") if rnd.random() < 0.2 else line
                        lines.append(rnd.choice(["> ", ">", " > ", ">> ", "> >"]) + line)
                lines += [" ".join(rnd.choices(words, k=rnd.randint(0, 4))) for _ in range(rnd.randint(0, 2))]
            texts.append("\n".join(lines))
            messages.append((conv, turn, texts[-1]))
    want = brute(messages)
    assert sum(r[0] is not None for r in want.values()) > 10 and max(r[5] for r in want.values()) > 1
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in messages], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): [r["reply_to"], r["n_linked"], r["clean_text"], r["n_quotes"], r["thread"], r["depth"]] for r in link_quotes(df).collect()}
    assert got == want


def test_long_threads(spark):
    rows = [(1, t, "u", f"> say {t - 1}\nsay {t}") for t in range(40)]
    got = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["turn"], r["thread"], r["depth"]) for r in got} == {(t, 0, t) for t in range(40)}


def test_a_conversation_with_one_common_message(spark):
    rows = [(1, t, "u", "yes" if t % 2 else f"> yes\nmore {t}") for t in range(400)]
    got = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r["reply_to"] == (1 if r["turn"] % 2 == 0 and r["turn"] > 1 else None) for r in got)
