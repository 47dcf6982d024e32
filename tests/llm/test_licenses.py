from __future__ import annotations

import hashlib
import os
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from symloom.llm import licenses
from symloom.llm.licenses import KNOWN, canonical, canonical_of, scan_licenses


def test_known_texts_are_found_however_written(spark):
    rows, want = [], {}
    for i, (name, _, text) in enumerate(KNOWN):
        rows += [(3 * i, text), (3 * i + 1, "Copyright (c) 2020 Some One\n\n" + text.upper().replace("\n", "\r\n  ")), (3 * i + 2, text.replace("license", "licence") + "\n(C) 1999, Others. All rights reserved.")]
        want |= {3 * i + k: name for k in range(3)}
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["license"] for r in got} == want


def wrapped(text, width):
    return "\n".join("\n".join(textwrap.wrap(line, width)) for line in text.split("\n"))


def test_wrapping_does_not_matter():
    for width in range(60, 101):
        for _, _, text in KNOWN:
            assert canonical_of(wrapped(text, width)) == canonical_of(text)


LONG = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
FOLDER = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs a folder of licence texts")
def test_long_texts_at_every_width(spark):
    rows = []
    for name in LONG:
        with open(f"{FOLDER}/{name}", encoding="utf-8") as f:
            text = f.read()
        flat = re.sub(r"(?<=[^\n])\n(?=[^\n])", " ", text) if name != "CC0-1.0" else text
        # lines of a paragraph that name holders have to stay lines
        rows += [(name, canonical_of(text))] + ([(name, canonical_of(wrapped(flat, w))) for w in (60, 72, 80, 100)] if name == "Apache-2.0" else [])
    known = {d: x[0] for d, x in licenses.known_rows().items()}
    assert [known.get(hashlib.sha256(c.encode()).hexdigest()) for _, c in rows] == [LONG[n] for n, _ in rows]
    texts = [(i, open(f"{FOLDER}/{n}", encoding="utf-8").read()) for i, n in enumerate(LONG)]
    got = scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert [r["license"] for r in sorted(got, key=lambda r: r["doc_id"])] == list(LONG.values())


def test_holders(spark):
    text = KNOWN[0][2]
    heads = ["Copyright (c) 2020 A B", "Copyright 1999, 2001 Some Body <x@y.z>", "© Some One", "(c) 2011 Me", "Copyright Joe Smith and Others", "Copyright The Contributors", "Copyright by the authors", "All rights reserved.", "* Copyright (C) 2014 X. All rights reserved."]
    assert all(canonical_of(h + "\n" + text) == canonical_of(text) for h in heads)
    one_line = "Copyright (c) 2020 A B. " + text.replace("\n", " ")
    assert canonical_of(one_line) == canonical_of(text)
    kept = ["copyright holders be liable", "Copyright notice and this", "(c) You must retain", "Copyright License. Subject to", "copyrighted material"]
    assert all(canonical_of("a\n" + k + "\nb") == canonical_of("a " + k + " b") for k in kept)
    rows = [(i, x) for i, x in enumerate([*[h + "\n" + text for h in heads], one_line, *kept, *[wrapped(text, w) for w in (60, 72, 80)]])]
    got = {r["doc_id"]: r["c"] for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", canonical(F.col("text")).alias("c")).collect()}
    assert got == {i: canonical_of(x) for i, x in rows}


def test_a_folder_of_licences(spark, tmp_path):
    (tmp_path / "House-1.0.txt").write_text("Do as you like, but say who wrote it.\n")
    rows = [(1, "Copyright (c) 2020 X\nDo as you like,\nbut say who WROTE it"), (2, KNOWN[0][2]), (3, None)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.folder_digests(spark, str(tmp_path))).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {1: "House-1.0", 2: None, 3: None}


def test_whole_texts_only(docs, rows, empty):
    got = scan_licenses(docs).collect()
    assert len(got) == len(rows) and all(r["license"] is None for r in got)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 5}
    for doc_id, text, *_ in rows:
        if doc_id is not None and doc_id != 5:
            want = None if text is None else canonical_of(text)
            assert by[doc_id]["n_canonical"] == (None if want is None else len(want))
            assert by[doc_id]["digest"] == (None if want is None else hashlib.sha256(want.encode()).hexdigest())
    assert scan_licenses(empty).collect() == []


def test_more_than_the_licence_is_no_match(spark):
    rows = [(1, KNOWN[0][2] + "\nand more"), (2, "..."), (3, "Released under the MIT License!")]
    got = {r["doc_id"]: (r["license"], r["kind"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: ("MIT", "notice")}


def test_spark_and_plain_form_agree(docs, rows):
    got = docs.select("text", canonical(F.col("text")).alias("c")).where("text is not null").collect()
    assert all(r["c"] == canonical_of(r["text"]) for r in got)
    assert "documents" in licenses.oracle_sql()


def test_titles_are_an_optional_line(spark):
    """A licence's own titles above its text, in any dress; another licence's title is no match."""
    mit = next(t for k, kind, t in licenses.KNOWN if (k, kind) == ("MIT", "text"))
    bsd = next(t for k, kind, t in licenses.KNOWN if (k, kind) == ("BSD-3-Clause", "text"))
    texts = {
        "plain": mit, "a": "The MIT License\n\n" + mit, "b": "(The MIT License)\n\nCopyright (c) 2020 Jane Doe\n\n" + mit, "c": "MIT LICENCE\r\n" + mit, "d": "# The MIT License (MIT)\n" + mit,
        "e": "New BSD License\n" + bsd, "f": 'BSD 3-Clause "New" or "Revised" License\n' + bsd, "wrong": "ISC License\n" + mit, "more": "The MIT License\nand a word more " + mit, "alone": "The MIT License",
    }
    rows = scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")).orderBy("doc_id").collect()
    got = dict(zip(texts, ((r["license"], r["kind"]) for r in rows), strict=True))
    assert got["plain"] == ("MIT", "text") and all(got[k] == ("MIT", "titled") for k in "abcd") and all(got[k] == ("BSD-3-Clause", "titled") for k in "ef")
    assert all(got[k] == (None, None) for k in ("wrong", "more", "alone"))
    assert all(title == canonical_of(title) for own in licenses.TITLES.values() for title in own)
