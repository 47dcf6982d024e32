"""Near-duplicates by SimHash and exact similarity of word shingles, for corpus stages.

Two texts are near if the sets of their five-word shingles have a Jaccard similarity of 0.8 or
more. That is about 38 of 256 differing bits of a SimHash, more than keys of equal bits can search.
So sets meet in blocks if they share two anchors, the least shingles in two of eight orders: near
sets share two with a chance of 1 - 9e-5 at least, while texts around a common passage, which has a
tenth of their words, share a given two with a chance of a hundredth. A block is compared
bit-sliced over 256-bit fingerprints within a wide radius (a near pair passes it but for a chance
below 1e-4), and what passes is compared exactly, within blocks of the same kind: whole sets meet
by three disjoint pairs of anchors first, and by the others only where a block still holds sets of
different groups. Near sets have sizes of 4 to 5 at least, so a block lies by size and its sets are
held against their neighbours only. Blocks of any size are treated alike; those that are too large for a task are
cut into parts, so that every two of their sets meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.llm.common import holds, materialize
from symloom.llm.simhash import PART, BitPlanes, connected_components, deal, keep_one, linked

WIDTH = 5
#: The least similarity of near texts, as a fraction: 4 of 5.
SHARED, OF = 4, 5
#: Words of 64 bits of a fingerprint, and the distance up to which pairs are compared exactly.
LONGS, RADIUS = 4, 72
#: Orders of shingles whose least ones are anchors.
ANCHORS = 8
#: Pairs of anchors that are keys; the first four share none.
PAIRS = [(0, 1), (2, 3), (4, 5), (6, 7)]
PAIRS += [p for p in combinations(range(ANCHORS), 2) if p not in PAIRS]
#: The pairs by which whole sets meet first: 19 of 20 near pairs share one of three.
EARLY = 3
#: Whole sets that are compared in one block, and bytes of sets that a task holds at once.
SETS, HELD = 512, 1 << 26
ROWS = 1 << 16


def mixed_hashes(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Other hashes of the same things, by a seeded finalizer."""
    h = hashes + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) % (1 << 64))
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingles_of(text: str | None, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; a short or empty text is one shingle.

    ASCII letters are lower-cased, words cut at ASCII white space, as for fingerprints.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    line = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64))


def fingerprint_of(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of a set: a bit is set if it is in over half of the shingles' hashes."""
    out, counts = np.zeros(LONGS, np.uint64), np.zeros(64, np.int64)
    for k in range(LONGS):
        rows = mixed_hashes(shingles, k).astype(">u8").view(np.uint8).reshape(-1, 8)
        counts[:] = 0
        for i in range(0, len(rows), 1 << 14):
            counts += np.unpackbits(rows[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
        out[k] = int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big")
    return out


def anchors_of(shingles: np.ndarray) -> np.ndarray:
    """The least shingle of each order, told apart by the order."""
    return np.array([mixed_hashes(shingles, LONGS + k).min() for k in range(ANCHORS)], np.uint64)


def is_near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets have the similarity, without rounding."""
    if OF * min(len(a), len(b)) < SHARED * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return (OF + SHARED) * both >= SHARED * (len(a) + len(b))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _shingles(texts: pa.Array) -> pa.Array:
    return _lists([shingles_of(t.as_py()) for t in texts])


@F.arrow_udf(T.StructType([T.StructField("sig", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.ArrayType(T.LongType())), T.StructField("anchors", T.ArrayType(T.LongType()))]))
def _prints(texts: pa.Array) -> pa.Array:
    holds("similar")
    sets = [shingles_of(t.as_py()) for t in texts]
    sig = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets), np.uint64, len(sets)).view(np.int64)
    sizes = pa.array([len(s) for s in sets], pa.int32())
    return pa.StructArray.from_arrays([pa.array(sig), sizes, _lists([fingerprint_of(s) for s in sets]), _lists([anchors_of(s) for s in sets])], ["sig", "n", "fp", "anchors"])


def prints(text: Column) -> Column:
    """Struct (sig, n, fp, anchors) of whole texts: a hash of the set, its size, its fingerprint, its
    anchors."""
    return _prints(text)


def pair_keys(anchors: Column, first: int = 0, last: int = len(PAIRS)) -> Column:
    """Array of the keys of anchors: a hash of each pair from number ``first`` to before ``last``."""
    return F.array(*[F.xxhash64(F.get(anchors, F.lit(a)), F.get(anchors, F.lit(b))) for a, b in PAIRS[first:last]])


def block_keys(one: DataFrame, name: str = "similar") -> DataFrame:
    """``sig, n, fp, t, key``: the blocks of distinct sets ``(sig, n, fp, anchors)``, one for each pair of
    anchors that several sets share. Most sets share none: keys are counted before fingerprints
    are put to them."""
    keys = one.select("sig", F.posexplode(pair_keys(F.col("anchors"))).alias("t", "key"))
    shared = keys.groupBy("t", "key").count().where(F.col("count") > 1).select(F.col("t").alias("_t"), F.col("key").alias("_key"))
    kept = materialize(keys.join(shared, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key")), "left_semi"), name)
    return kept.join(one.select(F.col("sig").alias("_sig"), "n", "fp"), F.col("sig") == F.col("_sig")).select("sig", "n", "fp", "t", "key")


def whole_blocks(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, held: int) -> Iterator[pa.Table]:
    """Tables of whole blocks (rows of equal ``keys``, which are sorted), gathered to about so many
    rows or bytes."""
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        parts.append(batch)
        if sum(p.num_rows for p in parts) < rows and sum(p.nbytes for p in parts) < held:
            continue
        table = pa.Table.from_batches(parts)
        last = np.ones(table.num_rows, bool)
        for k in keys:
            x = table.column(k).to_numpy()
            last &= x == x[-1]
        cut = int(np.argmax(last))
        if cut:
            yield table.slice(0, cut)
        parts = pa.Table.from_batches(table.slice(cut).to_batches()).combine_chunks().to_batches()
    if parts and sum(p.num_rows for p in parts):
        yield pa.Table.from_batches(parts)


def _buckets(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _columns(table: pa.Table, name: str) -> np.ndarray:
    """A column of fingerprints as rows of numbers."""
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.view(np.uint64).reshape(table.num_rows, LONGS)


_BLOCK = ["t", "key", "lo", "hi"]


def close_links(keys: DataFrame, part: int = PART) -> DataFrame:
    """Links ``(a, b)``, a > b, that join what fingerprints of one block within the radius join."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches, _BLOCK, ROWS, HELD):
            bucket = _buckets(table, _BLOCK)
            sizes = np.bincount(bucket)
            small = np.flatnonzero((sizes[bucket] > 1) & (sizes[bucket] <= 64))
            sig, fp, c, n = table.column("sig").to_numpy(), _columns(table, "fp"), table.column("c").to_numpy(), table.column("n").to_numpy().astype(np.int64)
            cross = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            for at in [small, *(np.flatnonzero(bucket == b) for b in np.flatnonzero(sizes > 64))]:
                if len(at) < 2:
                    continue
                side = c[at] if at is not small and cross[at[0]] else None
                root = linked(fp[at], bucket[at], side, RADIUS, n[at], (SHARED, OF))
                moved = np.flatnonzero(root != np.arange(len(at)))
                a, b = sig[at][moved], sig[at][root[moved]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return deal(keys, "sig", part, "n").mapInArrow(compare, "a long, b long").distinct()


def near_links(blocks: DataFrame, part: int = SETS) -> DataFrame:
    """Links ``(a, b)``, a > b, that join what near sets of one block ``(sig, n, t, key, fp, g, s)`` join.

    Pairs of one group ``g``, or joined already in their block, are passed over, as are those beyond
    the radius and those of too different sizes; rows of a block lie by size.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("similar")
        for table in whole_blocks(batches, _BLOCK, ROWS, HELD):
            bucket, lists = _buckets(table, _BLOCK), table.column("s").combine_chunks()
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum([0, *lists.value_lengths().to_pylist()])
            sets = [flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            sig, c, g, root = table.column("sig").to_numpy(), table.column("c").to_numpy(), table.column("g").to_numpy(), np.arange(table.num_rows)
            cross = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            planes = BitPlanes(_columns(table, "fp"))

            def find(i: int, root: np.ndarray = root) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            n = np.array([len(x) for x in sets], np.int64)
            for lag in range(1, len(sets)):
                same = (bucket[:-lag] == bucket[lag:]) & (OF * n[:-lag] >= SHARED * n[lag:])
                if not same.any():
                    break
                same &= (~cross[:-lag] | (c[:-lag] != c[lag:])) & (g[:-lag] != g[lag:]) & (root[:-lag] != root[lag:])
                if not same.any():
                    continue
                for i in planes.within(lag, same, RADIUS).tolist():
                    a, b = find(i), find(i + lag)
                    if a != b and is_near(sets[i], sets[i + lag]):
                        root[max(a, b)] = min(a, b)
            up = np.array([find(i) for i in range(len(root))], np.int64)
            moved = np.flatnonzero(up != np.arange(len(up)))
            a, b = sig[moved], sig[up[moved]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return deal(blocks, "sig", part, "n").mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def shared_blocks(wanted: DataFrame, groups: DataFrame | None, first: int, last: int, name: str) -> DataFrame:
    """``sig, t, key, g``: sets of ``wanted(sig, root, anchors)`` in the blocks of pairs ``first`` to
    ``last`` in which sets of different groups meet; written.

    A block is one pair of anchors within what the radius has joined; ``groups(node, root)`` are the
    groups so far, without it each set is its own.
    """
    own = wanted.select("sig", F.col("root").alias("_root"), F.posexplode(pair_keys(F.col("anchors"), first, last)).alias("t", "pair"))
    own = own.select("sig", "t", F.xxhash64("_root", "pair").alias("key"))
    if groups is None:
        own = own.withColumn("g", F.col("sig"))
    else:
        own = own.join(groups.select("node", "root"), F.col("sig") == F.col("node"), "left").select("sig", "t", "key", F.coalesce("root", "sig").alias("g"))
    own = materialize(own, name)
    mixed = own.groupBy("t", "key").agg(F.min("g").alias("_a"), F.max("g").alias("_b")).where("_a <> _b").select(F.col("t").alias("_t"), F.col("key").alias("_key"))
    return materialize(own.join(mixed, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key")), "left_semi"), name)


def joined_groups(groups: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``node, root`` of groups that further links ``(a, b)`` join, and of what these join to them."""
    of = lambda c: groups.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"_r{c}"))
    ends = links.join(of("a"), F.col("a") == F.col("_a"), "left").join(of("b"), F.col("b") == F.col("_b"), "left")
    ends = ends.select(F.coalesce("_ra", "a").alias("x"), F.coalesce("_rb", "b").alias("y")).where("x <> y").distinct()
    more = materialize(connected_components(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")), name), name)
    new = more.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    moved = groups.join(new, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root"))
    # nodes that had no group so far
    return moved.unionByName(more.join(groups.select("node"), "node", "left_anti"))


def similar_groups(docs: DataFrame, name: str = "similar", part: int = PART, sets: int = SETS) -> DataFrame:
    """``doc_id, digest, group`` of every document; ``digest`` is a hash of the text.

    A group is what links of near texts reach. Texts without words (null, empty, white space) are
    one group. One row per row, repeated rows too; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), prints(F.col("text")).alias("p"))
    rows = materialize(rows.select("doc_id", "digest", "p.*"), name)
    # one text of each set, named by doc_id and digest: of a text that stands there a thousand times one row
    some = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc"), "digest")).alias("d")
    one = materialize(rows.groupBy("sig").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("anchors").alias("anchors"), some), name)
    close = materialize(connected_components(close_links(block_keys(one, name), part), name), name)
    wanted = materialize(one.join(close, F.col("sig") == F.col("node")).select("sig", "fp", "anchors", "root", F.col("d.doc").alias("_doc"), F.col("d.digest").alias("_digest")), name)
    # whole sets of those that have a close one, made anew from one of their texts
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    names = wanted.select(F.col("sig").alias("_sig"), F.col("fp").alias("_fp"), "_doc", "_digest")
    texts = keyed.join(names, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    whole = materialize(texts.select("_sig", "_fp", _shingles("text").alias("s")).withColumn("n", F.size("s")), name)
    meet = lambda groups, first, last: near_links(shared_blocks(wanted, groups, first, last, name).join(whole, F.col("sig") == F.col("_sig")).select("sig", "n", "t", "key", "g", F.col("_fp").alias("fp"), "s"), sets)
    groups = materialize(connected_components(meet(None, 0, EARLY), name), name)
    late = materialize(meet(groups, EARLY, len(PAIRS)), name)
    if not late.isEmpty():  # few: they join groups, so only groups are walked again
        groups = materialize(joined_groups(groups, late, name), name)
    return rows.join(groups, F.col("sig") == F.col("node"), "left").select("doc_id", "digest", F.coalesce("root", "sig").alias("group"))


def drop_similar(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, one of each group of near texts: its least doc_id.

    Null doc_ids come last; of rows that share doc_id and text one stays. Further columns may have
    any names. An empty table stays empty.
    """
    return keep_one(docs, similar_groups(docs))
