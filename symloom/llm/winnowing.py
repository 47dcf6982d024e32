"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive hashes of ``K`` words the least one is kept, by what stands in the
window alone. So a span of ``K + WINDOW - 1`` words that two texts share gives both the same
fingerprint, and no shared span of that length can be missed. Documents' and items' fingerprints
are joined; around each hit the words of both texts are compared along the hit's diagonal, and what
agrees over a whole window of words is marked. Items that are shorter than a window of words are
looked up whole: their only fingerprint is the hash of all their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.llm.common import materialize

#: Words of a window: what has to be shared.
SPAN = 10
#: Words of a hash, and consecutive hashes of which the least is kept.
K = 8
WINDOW = SPAN - K + 1
#: Words are runs of characters other than ASCII ones that are no letters or digits.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
_UPPER = {c: c + 32 for c in range(65, 91)}
#: Bits of the filter of item fingerprints that documents are held against before the join.
FILTER_BITS = 20
#: Bytes of text that are hashed at once.
CHUNK = 1 << 21
_IS_WORD = np.array([chr(b).isascii() and chr(b).isalnum() or b >= 0x80 for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1


def words_of(text: str | None) -> list[str]:
    """Words of a text, ASCII letters in lower case; null has none."""
    return _WORD.findall((text or "").translate(_UPPER))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _letters() -> np.ndarray:
    """A random number for each byte; a capital's is that of its small letter."""
    own = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    own[65:91] = own[97:123]
    return own


_LETTERS = _letters()
_powers: list[np.ndarray] = []


def _inverse_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2 ** 64; kept for the next call."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[:] = both
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, and how many words each text has.

    ``data``: UTF-8 bytes, ``cuts``: where texts begin, and the end. A word's hash is that of its
    bytes as a polynomial, read off the running sum of the whole.
    """
    n = len(data)
    inside = _IS_WORD[data]
    edge = np.empty(n + 1, bool)
    edge[0] = False
    edge[1:] = inside
    before = edge[:-1].copy()  # whether the byte before is in a word of the same text
    before[cuts[:-1][cuts[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:] & before[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = _inverse_powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * power[:n], out=sums[1:])
    hashes = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, cuts))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each ``k`` consecutive words; texts may run on into each other."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), 1
    for i in range(k):
        out += words[i : i + n] * np.uint64(factor)
        factor = factor * _WORD_BASE % (1 << 64)
    return _mixed(out + np.uint64(k))


def winnowed(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the last least hash of every ``window`` consecutive ones, ascending."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for i in range(1, window):
        less = grams[i : i + n] <= best
        best[less] = grams[i : i + n][less]
        at[less] = np.flatnonzero(less) + i
    return np.unique(at)


def fingerprints_of(words: np.ndarray, ends: np.ndarray, short: tuple[int, ...], bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, the text each is of, and its place there, of texts whose words end at ``ends``.

    Those of ``K`` words are winnowed, those of the lengths in ``short`` are kept all. ``bits``
    has a bit for each fingerprint that is wanted; without it all are.
    """
    begins = np.concatenate([[0], ends[:-1]])
    found = []
    for k in (*short, K):
        grams = gram_hashes(words, k)
        if not len(grams):
            continue
        if k == K and k not in short:
            at = []
            # winnowed text by text: a window does not reach into the next one
            if bits is None or wanted(bits, grams).any():
                for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                    if b - a >= SPAN:
                        own = grams[a : b - K + 1]
                        if bits is None or wanted(bits, own).any():
                            at.append(a + winnowed(own))
            at = np.concatenate(at) if at else np.empty(0, np.int64)
        else:
            at = np.arange(len(grams))
            at = at[ends[np.searchsorted(ends, at, side="right")] - at >= k]
        if bits is not None:
            at = at[wanted(bits, grams[at])]
        found.append((grams[at], at))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams, at = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.searchsorted(ends, at, side="right")
    order = np.argsort(text, kind="stable")
    return grams[order], text[order], at[order] - begins[text[order]]


def wanted(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether the filter has each fingerprint's bit."""
    low = grams & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and cuts of consecutive texts of about ``CHUNK`` bytes together; null has no bytes."""
    whole = texts.fill_null("").cast(pa.large_string())
    cuts = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(whole):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + CHUNK, side="right")) - 1)
        yield data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i]
        i = j


_PRINTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("fps", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType()))])


def fingerprints(text: Column, short: tuple[int, ...] = (), bits: bytes | None = None) -> Column:
    """Struct (n_words, fps, places) of whole texts: words, fingerprints and the word each begins at.

    ``short`` lists the lengths below ``SPAN`` that are looked up whole. ``bits``, a filter of the
    fingerprints that are looked for, only leaves out what cannot be joined.
    """
    lengths, small = tuple(sorted({k for k in short if 0 < k < SPAN})), None if bits is None else np.frombuffer(bits, np.uint8)

    @F.arrow_udf(_PRINTS)
    def prints(texts: pa.Array) -> pa.Array:
        counts, sizes, fps, places = [], [], [], []
        for data, cuts in _chunks(texts):
            words, n = word_hashes(data, cuts)
            grams, text, place = fingerprints_of(words, np.cumsum(n), lengths, small) if len(words) else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
            counts.append(n)
            sizes.append(np.bincount(text, minlength=len(n)))
            fps.append(grams)
            places.append(place)
        if not counts:
            return pa.array([], _ARROW)
        ends = pa.array(np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32))
        flat = np.concatenate(fps).view(np.int64), np.concatenate(places).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts).astype(np.int64)), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat)], names=["n_words", "fps", "places"])

    return prints(text)


_ARROW = pa.struct([("n_words", pa.int64()), ("fps", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])


@F.arrow_udf(T.ArrayType(T.StringType()))
def _words(texts: pa.Array) -> pa.Array:
    return pa.array([words_of(t.as_py()) for t in texts], pa.list_(pa.string()))


def item_texts(items: DataFrame, name: str = "winnow") -> tuple[DataFrame, DataFrame]:
    """Members ``item_id, class`` of items that have words, and their distinct word sequences
    ``class, words, n``: copies are compared once."""
    rows = items.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = rows.select("item_id", F.sha2(F.array_join("words", " ").cast("binary"), 256).alias("class"), "words")
    rows = materialize(rows, name)
    classes = rows.groupBy("class").agg(F.first("words").alias("words")).select("class", "words", F.size("words").alias("n"))
    return rows.select("item_id", "class").distinct(), materialize(classes, name)


def item_fingerprints(classes: DataFrame, name: str = "winnow") -> DataFrame:
    """``fp, class, at``: fingerprints of word sequences, and the word each begins at."""
    line = F.array_join("words", " ")
    rows = []
    for k in range(1, SPAN + 1):  # one length at a time is looked up whole, from SPAN on winnowed
        own = classes.where(F.col("n") == k) if k < SPAN else classes.where(F.col("n") >= SPAN)
        rows.append((k, own))
    short = [r["n"] for r in classes.where(F.col("n") < SPAN).select("n").distinct().collect()]  # nine at most
    out = None
    for k, own in rows:
        if k < SPAN and k not in short:
            continue
        p = own.select("class", fingerprints(line, (k,) if k < SPAN else ()).alias("p")).select("class", F.explode(F.arrays_zip("p.fps", "p.places")).alias("x"))
        p = p.select(F.col("x.fps").alias("fp"), "class", F.col("x.places").alias("at")).where("at = 0" if k < SPAN else "true")
        out = p if out is None else out.unionByName(p)
    return materialize(out.distinct(), name)


def filter_bits(prints: DataFrame) -> bytes:
    """The filter of fingerprints: 2 ** FILTER_BITS bits, made by Spark in pieces of 4096 bytes."""
    low = F.col("fp").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    pieces = prints.select(low.alias("low")).groupBy(F.floor(F.col("low") / 32768).alias("piece")).agg(F.bitmap_construct_agg((F.col("low") % 32768).cast("long")).alias("bits"))
    out = bytearray(1 << (FILTER_BITS - 3))
    for r in pieces.collect():  # 32 rows at most
        out[r["piece"] * 4096 : (r["piece"] + 1) * 4096] = r["bits"]
    return bytes(out)


_HITS = "array<struct<class:string,words:array<string>,shifts:array<int>>>"
_MARKS = T.StructType([T.StructField("n_hit", T.LongType()), T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))])


def marked(words: list[str], hits: list[dict]) -> tuple[np.ndarray, list[str]]:
    """Which words stand in an occurrence of an item's window, and the items that have one.

    ``hits``: item texts and the diagonals (place in the text less place in the item) along which
    they are held against the text.
    """
    own, hit, found = np.array(words, object), np.zeros(len(words), bool), []
    for item in hits:
        theirs, some = np.array(item["words"], object), False
        need = min(SPAN, len(theirs))
        for shift in item["shifts"]:
            a, b = max(0, shift), min(len(own), shift + len(theirs))
            if b - a < need:
                continue
            # runs of equal words along the diagonal
            same = np.concatenate([[False], own[a:b] == theirs[a - shift : b - shift], [False]])
            turns = np.flatnonzero(same[1:] != same[:-1])
            for i, j in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
                if j - i >= need:
                    hit[a + i : a + j] = some = True
        if some:
            found.append(item["class"])
    return hit, found


@F.arrow_udf(_MARKS)
def _extended(texts: pa.Array, hits: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts, hits, strict=True):
        hit, classes = marked(words_of(text.as_py()), own.as_py())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        out.append({"n_hit": int(hit.sum()), "classes": classes, "spans": [{"start": a, "stop": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]})
    kind = pa.struct([("n_hit", pa.int64()), ("classes", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
    return pa.array(out, kind)


def contamination(docs: DataFrame, items: DataFrame, name: str = "winnow") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans`` of every document.

    A window is ``SPAN`` consecutive words of an item, or all of a shorter one. ``n_hit`` counts
    words of a document that stand in an occurrence of any window, ``spans`` has the runs of them
    (``start`` and ``stop``, words from 0); ``n_items`` counts items with an occurring window, and
    ``items_sha256`` is the digest of their item_ids as strings, sorted, comma-joined.

    Null and wordless texts have no words and no hits, null and wordless items no window. Repeated
    documents have a row each, repeated items count once, items without an id are one whose name is
    the empty string. An empty table of documents gives an empty result, without items no document
    is hit. Further columns are left out. Each distinct text is compared once, wherever it stands;
    Spark sends the items' fingerprints to the documents where their written table is small, and
    else deals both by fingerprint.
    """
    members, classes = item_texts(items, name)
    index = item_fingerprints(classes, name)
    short = tuple(sorted(r["n"] for r in classes.where(F.col("n") < SPAN).select("n").distinct().collect()))
    text = F.col("text")
    rows = docs.select("doc_id", F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"), fingerprints(text, short, filter_bits(index)).alias("p"))
    rows = materialize(rows.select("doc_id", "d1", "d2", "p.*"), name)
    # one row of each distinct text that may have a hit
    some = rows.where(F.size("fps") > 0).groupBy("d1", "d2").agg(F.min("doc_id").alias("_doc"), F.first(F.arrays_zip("fps", "places")).alias("x"))
    hits = some.select("d1", "d2", "_doc", F.explode("x").alias("x")).select("d1", "d2", "_doc", F.col("x.fps").alias("fp"), F.col("x.places").alias("place"))
    hits = hits.join(index, "fp").select("d1", "d2", "_doc", "class", (F.col("place") - F.col("at")).alias("shift"))
    hits = hits.groupBy("d1", "d2", "_doc", "class").agg(F.collect_set("shift").alias("shifts")).join(classes.select("class", "words"), "class")
    hits = hits.groupBy(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("_doc")).agg(F.collect_list(F.struct("class", "words", "shifts")).alias("hits"))
    hits = materialize(hits, name)
    keyed = docs.select("doc_id", "text", F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"))
    on = (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    # their keys are a table of its own, which is small enough to be sent where few texts are hit:
    # then only these texts are shuffled
    found = keyed.join(materialize(hits.select("_d1", "_d2", "_doc"), name), on, "left_semi").join(hits, on)
    marks = found.select("d1", "d2", _extended("text", "hits").alias("m")).select("d1", "d2", "m.*").where("n_hit > 0")
    marks = materialize(marks.groupBy("d1", "d2").agg(*[F.first(c).alias(c) for c in ("n_hit", "classes", "spans")]), name)
    # the same items occur in many texts: their list is made once for each set of word sequences
    sets = marks.select(F.array_sort("classes").alias("set")).distinct().select("set", F.xxhash64("set").alias("key"), F.explode("set").alias("class"))
    named = sets.join(members, "class").groupBy("set").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("ids"))
    named = named.select("set", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("ids"), ",").cast("binary"), 256).alias("items_sha256"))
    marks = materialize(marks.withColumn("set", F.array_sort("classes")).join(named, "set").select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "n_hit", "n_items", "items_sha256", "spans"), name)
    out = rows.select("doc_id", "d1", "d2", "n_words").join(marks, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "spans")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no window of an item occurs.

    A document goes with all rows of its doc_id and text. Null doc_ids are values like others.
    """
    gone = contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("_g_doc")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_g_doc")), "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])


def oracle_sql() -> str:
    """The digest columns as DuckDB SQL: all windows of all documents against all windows of items."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '{WORD}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS (SELECT item_id, {words} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least({SPAN}, len(w)) AS m, array_to_string(w[s : s + least({SPAN}, len(w)) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {SPAN - 1}) + 1)) AS s FROM i WHERE len(w) > 0)),
x AS (SELECT r, s, m, array_to_string(w[s : s + m - 1], ' ') AS win
    FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d JOIN (SELECT DISTINCT m FROM v) ON len(w) >= m)),
h AS (SELECT DISTINCT r, s, m, item_id FROM x JOIN v USING (m, win)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM h) GROUP BY 1),
k AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(ids, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""
