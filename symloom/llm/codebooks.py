"""Vector code compression: product codebooks by Lloyd's rounds with group bounds (Yinyang).

A vector's components become integers and are cut into parts; each part is coded by its nearest
codebook entry. The entries of a codebook are clustered into groups, and each part of a vector keeps
one lower bound for each group: no entry of the group, but its own, is nearer. When entries have
moved, a bound falls by the largest drift of its group, and a group is scanned only where its bound
no longer exceeds the distance to the part's own entry. Distances that decide are integers, so ties
go to the lower index exactly; bounds are rounded down, never up.

Vectors never leave their row: a round is one pass that writes codes and bounds beside the vector,
and one that sums the parts of each entry. The driver holds the codebooks, a number of integers that
does not depend on the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import materialize

PARTS = 4
#: Entries of a codebook; a code is a byte.
ENTRIES = 256
ROUNDS = 4
#: Components are multiples of one part of this many.
SCALE = 1024
#: Groups of the entries of a codebook, about ten entries each, and the rounds that cluster them.
GROUPS, GROUP_ROUNDS = 25, 5
#: Components of this size or more are refused: sums of squares must stay exact.
LIMIT = 1 << 26
#: The largest bound; higher ones are stored as this one.
MOST = (1 << 16) - 1
#: Numbers of a block of distances that a task holds at once.
HELD = 1 << 21

Books = np.ndarray  # parts x entries x width, integers


def integer_vectors(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """``vec_id, label, x, whole``: vectors as integers ``floor(scale * component)``.

    Left out are null vectors and those with null or non-finite components. ``whole`` is false for
    vectors that cannot be cut into parts.
    """
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda v: F.coalesce(good(v), F.lit(False))))
    return rows.select("vec_id", "label", F.transform("embedding", lambda v: F.floor(v * float(scale))).alias("x"), (F.size("embedding") % parts == 0).alias("whole"))


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Books:
    """The codebooks before the first round: the parts of the vectors with the smallest vec_ids.

    As many rows as a codebook has entries come to the driver; null vec_ids are last, ties by the
    vector. All have the length of the first one.
    """
    order = [F.col("vec_id").asc_nulls_last(), F.col("x").asc()]
    head = vectors.where("whole").select("vec_id", "x").orderBy(*order).limit(1).collect()
    if not head:
        return np.zeros((parts, 0, 0), np.int64)
    n = len(head[0]["x"])
    rows = vectors.where(F.col("whole") & (F.size("x") == n)).select("vec_id", "x").orderBy(*order).limit(entries).collect()
    x = np.array([r["x"] for r in rows], np.int64).reshape(len(rows), parts, n // parts)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries as exact integers."""
    if not x.size or not entries.size:
        return np.zeros((len(x), len(entries)), np.int64)
    most = max(int(np.abs(x).max()), int(np.abs(entries).max()))
    if 4 * most * most * x.shape[1] < 1 << 53:  # whole numbers of this size are exact as floats
        a, b = x.astype(np.float64), entries.astype(np.float64)
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        return d.astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for j, e in enumerate(entries):
        out[:, j] = ((x - e) ** 2).sum(1)
    return out


def own_squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distance of each row to its own entry."""
    return ((x - entries) ** 2).sum(1)


def floor_root(d: np.ndarray) -> np.ndarray:
    """Square roots, rounded down to what a bound holds."""
    r = np.floor(np.sqrt(d.astype(np.float64))).astype(np.int64)
    r -= r * r > d
    return np.minimum(r, MOST)


def entry_groups(book: np.ndarray, groups: int = GROUPS, rounds: int = GROUP_ROUNDS) -> np.ndarray:
    """The group of each entry of a codebook: a few Lloyd rounds from evenly spread entries.

    Any grouping gives the same codes; near entries in one group give tight bounds.
    """
    k = len(book)
    groups = max(1, min(groups, k))
    centers, own = book[np.linspace(0, k - 1, groups).astype(int)].astype(np.float64), np.zeros(k, np.int64)
    for _ in range(rounds if k else 0):
        own = ((book[:, None, :] - centers[None, :, :]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (own == g).any():
                centers[g] = book[own == g].mean(0)
    return own


def scan_all(x: np.ndarray, book: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries of rows, and the bounds of every group, from all distances."""
    n = len(x)
    code, bounds = np.zeros(n, np.int64), np.full((n, n_groups), MOST, np.int64)
    step = max(1, HELD // max(1, len(book)))
    members = [np.flatnonzero(group == g) for g in range(n_groups)]
    for i in range(0, n, step):
        d = squares(x[i : i + step], book)
        best = d.argmin(1)  # the first of equal ones
        code[i : i + step] = best
        d[np.arange(len(d)), best] = np.iinfo(np.int64).max
        for g, m in enumerate(members):
            if len(m):
                bounds[i : i + step, g] = floor_root(d[:, m].min(1))
    return code, bounds


def scan_failed(x: np.ndarray, code: np.ndarray, bounds: np.ndarray, book: np.ndarray, drift: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entries after the entries have moved by ``drift``; only groups whose bound, less the
    group's largest drift, does not exceed the distance to the row's entry are scanned.

    Also the bounds, and how many distances were computed.
    """
    largest = np.zeros(n_groups, np.int64)
    np.maximum.at(largest, group, drift)
    # a bound that was cut off at MOST is still a lower bound
    bounds = np.maximum(bounds - largest[None, :], 0)
    mine = own_squares(x, book[code])
    best, at, computed = mine.copy(), code.copy(), len(x)
    # a bound that equals the distance may hide a tie with a lower index
    fails = bounds * bounds <= mine[:, None]
    far = np.iinfo(np.int64).max
    for g in range(n_groups):
        m = np.flatnonzero(group == g)
        rows = np.flatnonzero(fails[:, g]) if len(m) else []
        step = max(1, HELD // max(1, len(m)))
        for i in range(0, len(rows), step):
            r = rows[i : i + step]
            d = squares(x[r], book[m])
            computed += d.size
            # bounds leave out the entry that each row has for now; see below
            near, first = d.min(1), m[d.argmin(1)]
            better = (near < best[r]) | (near == best[r]) & (first < at[r])
            here = group[at[r]] == g
            # the old best entry goes back among those that bound its group
            old_group, old = group[at[r]], best[r]
            rest = d.copy()
            now = np.where(better, first, at[r])
            place = np.searchsorted(m, now)
            hit = (place < len(m)) & (m[np.minimum(place, len(m) - 1)] == now)
            rest[np.flatnonzero(hit), place[hit]] = far
            bounds[r, g] = floor_root(rest.min(1))
            elsewhere = better & ~here
            bounds[r[elsewhere], old_group[elsewhere]] = np.minimum(bounds[r[elsewhere], old_group[elsewhere]], floor_root(old[elsewhere]))
            best[r], at[r] = np.where(better, near, best[r]), now
    return at, bounds, computed


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and max(int(flat.max()), -int(flat.min())) >= LIMIT:
        raise ValueError(f"components of {LIMIT // SCALE} or more are not supported")
    return flat.reshape(len(column), parts, len(flat) // max(1, len(column) * parts))


def assign(state: DataFrame, books: Books, groups: list[np.ndarray], before: Books | None = None, name: str = "codes") -> DataFrame:
    """``vec_id, label, x, codes, bounds`` after one round's assignment, written.

    ``books`` are the entries now, ``groups`` the group of each, the same in every round;
    ``before`` are the entries of the assignment that ``codes`` and ``bounds`` come from; without
    it all entries are scanned.
    """
    parts, n_groups = len(books), [int(g.max()) + 1 for g in groups]
    # how far each entry has moved, rounded up
    drift = None if before is None else [np.floor(np.sqrt(((a - b) ** 2).sum(1).astype(np.float64))).astype(np.int64) + (a != b).any(1) for a, b in zip(books, before, strict=True)]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(batch.column(2), parts)
            codes, bounds = np.zeros((len(x), parts), np.uint8), []
            if drift is not None:
                old = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(x), parts)
                kept = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u2").reshape(len(x), -1).astype(np.int64)
            begin = 0
            for p in range(parts):
                if drift is None:
                    at, own = scan_all(x[:, p], books[p], groups[p], n_groups[p])
                else:
                    at, own, _ = scan_failed(x[:, p], old[:, p].astype(np.int64), kept[:, begin : begin + n_groups[p]], books[p], drift[p], groups[p], n_groups[p])
                begin += n_groups[p]
                codes[:, p] = at
                bounds.append(own.astype("<u2"))
            rows = np.concatenate(bounds, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([b.tobytes() for b in rows], pa.binary())], names=["vec_id", "label", "x", "codes", "bounds"])

    own = state.select("vec_id", "label", "x", *([] if before is None else ["codes", "bounds"]))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return materialize(own.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<bigint>, codes binary, bounds binary"), name)


def moved_books(state: DataFrame, books: Books) -> Books:
    """Each entry's mean of its parts, rounded down; unused entries stay.

    Tasks add up what they read, a row for each entry; the sums of them all, at most one row for
    each entry, come to the driver.
    """
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(batch.column(0), parts)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(x), parts)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                own = codes[order, p]
                cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                sums[p, own[cuts]] += np.add.reduceat(x[order, p], cuts, axis=0)
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        used = np.flatnonzero(counts.ravel())
        if len(used):
            flat = pa.array(sums.reshape(parts * entries, width)[used].ravel())
            ends = pa.array(np.arange(len(used) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts.ravel()[used]), pa.ListArray.from_arrays(ends, flat)], names=["entry", "n", "s"])

    added = state.select("x", "codes").mapInArrow(add, "entry int, n long, s array<bigint>")
    # whole numbers of any size: the rows of one entry may be many
    totals = added.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")) for i in range(width)]).alias("s"))
    out = books.copy()
    for r in totals.collect():
        out[r["entry"] // entries, r["entry"] % entries] = [int(s) // r["n"] for s in r["s"]]
    return out


def train_codes(vectors: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, name: str = "codes") -> tuple[DataFrame, Books]:
    """Written rows ``vec_id, label, x, codes, bounds`` of ``integer_vectors`` that have the length
    of the first one, and the final codebooks."""
    books = first_books(vectors, parts, entries)
    if not books.shape[1]:
        empty = vectors.where("false").select("vec_id", "label", "x", F.lit(b"").alias("codes"), F.lit(b"").alias("bounds"))
        return empty, books
    own = vectors.where(F.col("whole") & (F.size("x") == books.shape[2] * parts))
    groups = [entry_groups(b) for b in books]
    state = assign(own, books, groups, None, name)
    for _ in range(rounds):
        now = moved_books(state, books)
        state, books = assign(state, now, groups, books, name), now
    return state, books


def books_digest(books: Books) -> str:
    """SHA-256 of all components by part, entry and position, decimal, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_errors(state: DataFrame, books: Books) -> DataFrame:
    """``vec_id, label, code, error``: codes as two hex digits a part, squared distances summed."""
    parts = len(books)

    @F.arrow_udf("long")
    def error(x: pa.Array, codes: pa.Array) -> pa.Array:
        rows = _parts(x, parts)
        own = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(rows), parts)
        return pa.array(sum((own_squares(rows[:, p], books[p][own[:, p]]) for p in range(parts)), np.zeros(len(rows), np.int64)))

    return state.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), error("x", "codes").alias("error"))


def compress(vectors: DataFrame, name: str = "codes") -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of the vectors that are kept.

    ``vectors(vec_id, embedding, label)``. Left out are rows whose vector is null or has a null or
    non-finite component. ``code`` has the index of each part's entry, ``error`` the squared
    distances to these entries, summed; ``label_error`` the errors of all rows of one label, null
    labels together; the digest is that of the final codebooks.

    Repeated rows are vectors of their own; null vec_ids come last where the smallest are asked
    for, ties go by the vector. With fewer than ``ENTRIES`` vectors the codebooks have fewer
    entries. Vectors that cannot be cut into parts, or whose length is not that of the vector with
    the smallest vec_id, are no code's: their code and error are null. Empty vectors are all
    coded alike, with no error. Components of ``LIMIT / SCALE`` (65,536) or more are an error, as
    sums of their squares would not be exact. An empty table gives an empty result; further columns
    are left out.
    """
    own = materialize(integer_vectors(vectors), name)
    state, books = train_codes(own, name=name)
    rows = materialize(code_errors(state, books), name) if books.shape[1] else None
    width = books.shape[2] * PARTS
    odd = own.where(~F.col("whole") | (F.size("x") != width)).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = odd if rows is None else rows.unionByName(odd)
    # a row a label; a label may hold most rows: its sum is sent to them where the table is small,
    # and else Spark splits the label's rows
    sums = materialize(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), name)
    joined = rows.join(sums, rows["label"].eqNullSafe(sums["_label"]))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same rows as DuckDB SQL: every round by all distances."""
    dist = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    rounds = []
    for i in range(ROUNDS + 1):
        rounds.append(f"a{i} AS MATERIALIZED (SELECT v.r, v.p, min({dist} * {ENTRIES} + c.e) AS best FROM v JOIN c{i} AS c USING (p) GROUP BY ALL)")
        if i < ROUNDS:
            rounds.append(f"""m{i} AS MATERIALIZED (SELECT p, e, list(m ORDER BY k) AS x FROM (
    SELECT p, (best % {ENTRIES})::BIGINT AS e, k, floor_div AS m FROM (SELECT a.p, a.best % {ENTRIES} AS best, k, (sum(v.x[k]) - ((sum(v.x[k]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
    FROM a{i} AS a JOIN v USING (r, p), range(1, len(v.x) + 1) AS g(k) GROUP BY a.p, a.best % {ENTRIES}, k)) GROUP BY p, e),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{i} AS c LEFT JOIN m{i} AS m USING (p, e))""")
    return f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda z: floor(z::DOUBLE * {SCALE})::BIGINT) AS x
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
v AS MATERIALIZED (SELECT r, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] AS x FROM w, range({PARTS}) AS g(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM v WHERE r <= {ENTRIES}),
{", ".join(rounds)},
e AS (SELECT r, string_agg(format('{{:02x}}', (best % {ENTRIES})::BIGINT), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
s AS (SELECT sha256(string_agg(list_aggregate(x, 'string_agg', ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS})
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM w JOIN e USING (r), s
"""
