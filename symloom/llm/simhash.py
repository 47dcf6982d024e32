"""Near-duplicates by SimHash: fingerprints, bit-sliced comparison, connected components.

Fingerprints at most three bits apart agree on two of five blocks of bits, so each fingerprint is
dealt to ten keys, one for each pair of blocks. The fingerprints of a key are stored as bit
planes; one comparison handles all pairs at one distance in the block at once, counts differing
bits with carry-save counters, a bit operation each for 64 pairs, and stops when every pair of
the block has passed the radius. Only links that join different groups leave a block, so what is
written is linear in the fingerprints.
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

from symloom.llm.common import has_name, materialize

RADIUS = 3
BLOCKS = 5
SHINGLE = 3
#: Fingerprints of one key that are compared in one task; a key with more is cut into parts of
#: about this size, and each pair of parts becomes a block of its own.
PART = 4096
#: Rows that are compared together, if their keys are small.
BATCH = 1 << 16


def simhash_of(text: str | None, width: int = SHINGLE, seed: int = 42) -> int:
    """The fingerprint of a text as an unsigned number.

    ASCII letters are lower-cased, words cut at ASCII white space; a bit is set if it is set in
    over half of the shingles' hashes. Texts without words have fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - width + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])
    counts = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for i in range(0, len(rows), 1 << 14):
        counts += np.unpackbits(rows[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big")


@F.arrow_udf(T.LongType())
def _simhash(texts: pa.Array) -> pa.Array:
    own = np.fromiter((simhash_of(t.as_py()) for t in texts), np.uint64, len(texts))
    return pa.array(own.view(np.int64))


def simhash(text: Column) -> Column:
    """The fingerprint of whole texts as a long (its 64 bits, signed)."""
    return _simhash(text)


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks of all choices of ``blocks - radius`` blocks of bits, as signed longs."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class BitPlanes:
    """Fingerprints stored vertically: plane ``k`` holds bit ``k`` of all of them, 64 to a word."""

    def __init__(self, fingerprints: np.ndarray):
        """``fingerprints``: numbers of 64 bits, one or several (columns) each."""
        self.n = len(fingerprints)
        rows = fingerprints.astype(np.uint64).reshape(self.n, -1)
        bits = np.unpackbits(rows.astype(">u8").view(np.uint8).reshape(self.n, -1), axis=1)
        self.planes = self.packed(bits.T)

    @staticmethod
    def packed(bits: np.ndarray) -> np.ndarray:
        """Rows of bits as rows of words, with a word of zeros behind."""
        n = bits.shape[-1]
        out = np.zeros((*bits.shape[:-1], (n + 63) // 64 * 8 + 8), np.uint8)
        out[..., : (n + 7) // 8] = np.packbits(bits, axis=-1, bitorder="little")
        return out.view("<u8")

    def within(self, lag: int, wanted: np.ndarray, radius: int) -> np.ndarray:
        """The ``i`` with ``wanted[i]`` whose distance to ``i + lag`` is at most ``radius``."""
        m = self.n - lag
        words = (m + 63) // 64
        alive = self.packed(wanted[:m])[:words]
        count = self._few if radius <= 3 else self._many
        alive = count(lag, words, alive, radius)
        return np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little")[:m])

    def _differ(self, k: int, lag: int, words: int) -> np.ndarray:
        """Eight planes from ``k`` on, compared to themselves ``lag`` bits further."""
        skip, shift = divmod(lag, 64)
        own = self.planes[k : k + 8]
        other = own[:, skip : skip + words] >> np.uint64(shift)
        if shift:
            high = own[:, skip + 1 : skip + 1 + words]
            other[:, : high.shape[1]] |= high << np.uint64(64 - shift)
        return own[:, :words] ^ other

    def _few(self, lag: int, words: int, alive: np.ndarray, radius: int) -> np.ndarray:
        """Two counting planes: a pair that would count to four is out."""
        ones, twos = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for k in range(0, len(self.planes), 8):
            for x in self._differ(k, lag, words):
                carry = ones & x
                ones ^= x
                over = twos & carry
                twos ^= carry
                alive &= ~over
            if not alive.any():
                return alive
        if radius < 3:
            alive &= ~(ones & twos) if radius == 2 else ~twos if radius == 1 else ~(ones | twos)
        return alive

    def _many(self, lag: int, words: int, alive: np.ndarray, radius: int) -> np.ndarray:
        """Counting planes up to the number of planes; eight planes are added by carry-save steps."""
        zero = np.zeros(words, np.uint64)
        ones, twos, fours = zero, zero, zero
        high = [zero] * (len(self.planes) // 8).bit_length()  # counts of eight

        def add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            u = a ^ b
            return u ^ c, a & b | u & c

        def above(counter: list[np.ndarray], limit: int) -> np.ndarray:
            more, equal = zero, ~zero
            for k in range(len(counter) - 1, -1, -1):
                if limit >> k & 1:
                    equal = equal & counter[k]
                else:
                    more, equal = more | equal & counter[k], equal & ~counter[k]
            return more

        for k in range(0, len(self.planes), 8):
            d = self._differ(k, lag, words)
            ones, a = add(ones, d[0], d[1])
            ones, b = add(ones, d[2], d[3])
            twos, e = add(twos, a, b)
            ones, a = add(ones, d[4], d[5])
            ones, b = add(ones, d[6], d[7])
            twos, f = add(twos, a, b)
            fours, carry = add(fours, e, f)
            for i in range(len(high)):
                high[i], carry = high[i] ^ carry, high[i] & carry
            if 8 * (k // 8 + 1) > radius and k // 8 % 4 == 3:
                alive = alive & ~above(high, radius // 8)
                if not alive.any():
                    return alive
        return alive & ~above([ones, twos, fours, *high], radius)


def linked(fingerprints: np.ndarray, bucket: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS, sizes: np.ndarray | None = None, share: tuple[int, int] = (0, 1)) -> np.ndarray:
    """For each row the first row of its group: linked rows of one bucket, buckets contiguous.

    ``side``: where given, only rows of different sides are compared. ``sizes``, ascending in each
    bucket: only rows whose sizes are at least as ``share`` (a fraction) are compared, so rows are
    held against their neighbours in size and no others.
    """
    n = len(fingerprints)
    root = np.arange(n)
    planes = BitPlanes(fingerprints)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for lag in range(1, n):
        same = bucket[:-lag] == bucket[lag:]
        if sizes is not None:
            same &= share[1] * sizes[:-lag] >= share[0] * sizes[lag:]
        if not same.any():
            break
        if side is not None:
            same &= side[:-lag] != side[lag:]
        same &= root[:-lag] != root[lag:]  # what is joined already is not compared
        if not same.any():
            continue
        near = planes.within(lag, same, radius)
        near = near[root[near] != root[near + lag]]
        if len(near):
            for i in near.tolist():
                a, b = find(i), find(i + lag)
                if a != b:
                    root[max(a, b)] = min(a, b)
            while (up := root[root]).tolist() != root.tolist():
                root = up
    return root


def deal(keys: DataFrame, ident: str, part: int, order: str | None = None) -> DataFrame:
    """Rows ``(ident, ..., t, key)`` dealt to blocks ``(t, key, lo, hi)``, sorted by them, then by
    ``order`` (else ``ident``).

    A key with more than ``part`` rows is cut into parts by a hash of ``ident``, ``c`` is a row's
    own, and each pair of parts is a block: every two rows of a key meet in one.
    """
    large = keys.groupBy("t", "key").count().where(F.col("count") > part).select(F.col("t").alias("_t"), F.col("key").alias("_key"), F.ceil(F.col("count") / part).cast("int").alias("m"))
    dealt = keys.join(large, (keys["t"] == large["_t"]) & (keys["key"] == large["_key"]), "left")
    parts, own = F.coalesce("m", F.lit(1)), keys.columns
    dealt = dealt.select(*own, F.pmod(F.xxhash64(F.lit(7), ident), parts).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("o"))
    dealt = dealt.select(*own, "c", F.least("c", "o").cast("int").alias("lo"), F.greatest("c", "o").cast("int").alias("hi"))
    # a number of partitions is named, as their rows are small but their work is not: Spark would
    # join small partitions to a few tasks
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi", order or ident)


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """Links ``(a, b)``, a > b, between distinct fingerprints ``fp`` that connect all near ones.

    Every pair within the radius is compared, in some block; the links that are returned join the
    same groups as all of them. Keys with more than ``part`` fingerprints are cut into parts, and
    rows go to each pair of parts of their key.
    """
    if not 0 <= radius < min(4, blocks):
        raise ValueError("the keys of near links cover distances of 0 to 3")
    masks = block_masks(blocks, radius)
    keys = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    dealt = deal(keys, "fp", part)

    def block(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fp, t, key, c, lo, hi = rows  # the order of the columns
        new = np.zeros(len(fp), bool)
        for x in (t, key, lo, hi):
            new[1:] |= x[1:] != x[:-1]
        bucket = np.cumsum(new)
        sizes = np.bincount(bucket)
        pairs = {True: sizes[bucket] > 64, False: (sizes[bucket] > 1) & (sizes[bucket] <= 64)}
        groups = [np.flatnonzero(pairs[False])] + [np.flatnonzero(bucket == b) for b in np.flatnonzero(sizes > 64)]
        for at in groups:
            if len(at) < 2:
                continue
            cross = lo[at[0]] != hi[at[0]] and len(np.unique(bucket[at])) == 1
            side = c[at] if cross else None
            unsigned = fp[at].view(np.uint64)
            root = linked(unsigned, bucket[at], side, radius)
            moved = np.flatnonzero(root != np.arange(len(at)))
            if len(moved):
                a, b = fp[at][moved], fp[at][root[moved]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            rows = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            if not len(rows[0]):
                continue
            held.append(rows)
            size += len(rows[0])
            if size < BATCH:
                continue
            # all but the last key are whole
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = np.ones(len(rows[0]), bool)
            for x in (rows[1], rows[2], rows[4], rows[5]):
                last &= x == x[-1]
            cut = int(np.argmax(last))
            if cut:
                yield from block([x[:cut] for x in rows])
            held, size = [[x[cut:] for x in rows]], len(rows[0]) - cut
        if size:
            yield from block([np.concatenate(x) for x in zip(*held, strict=True)])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` of all nodes of links ``(a, b)``, a > b; the root is a group's least node.

    Rounds of large-star and small-star: each node hands its larger neighbours, then its smaller
    ones, to the least node it knows. A round is joins and partial aggregates over links only,
    written to the shared folder; no group is gathered anywhere.
    """
    edges, before = materialize(links, name), None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before or not state["n"]:
            break
        before = (state["n"], state["h"])
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "_u")
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
        small = large.join(least, F.col("a") == F.col("_a"))
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("_a", "m").toDF("a", "b"))
        edges = materialize(small.distinct(), name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, name: str = "simhash") -> DataFrame:
    """``doc_id, fingerprint, component_id, digest, group`` of every document.

    ``component_id`` is the smallest doc_id that links of at most ``radius`` bits reach, itself
    included. Texts that are null, empty or without words have fingerprint zero and are linked
    like any other. One row per row, repeated rows too; a null doc_id is in its component but
    never names it; without any other, component_id is null. ``digest`` is a hash of the text,
    ``group`` the least fingerprint of the component. An empty table gives an empty result; further columns are left out.
    """
    prints = materialize(docs.select("doc_id", simhash(F.col("text")).alias("fp"), F.xxhash64("text").alias("digest")), name)
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = connected_components(near_links(distinct.select("fp"), radius), name)
    known = distinct.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    known = materialize(known, name)
    roots = known.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "_root")
    placed = known.join(roots, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id", F.col("root").alias("group"))
    return prints.join(placed, F.col("fp") == F.col("_fp")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "digest", "group")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents, with all their columns, one of each group: the one that names it.

    Of rows that share the naming doc_id in one group one stays, of groups without any doc_id one
    row. Two rows are told apart by doc_id and text.
    """
    return keep_one(docs, near_duplicates(docs, radius))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents that stay, by ``doc_id, digest, group`` of all of them.

    Those that go are joined away: they are fewer than those that stay, and where their keys are a
    small table, Spark sends it to all tasks and shuffles no text.
    """
    found = groups.groupBy("group", "doc_id", "digest").count()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc"), "digest")).alias("s")
    stays = found.groupBy("group").agg(least).select(F.col("group").alias("_group"), F.col("s.doc").alias("_doc"), F.col("s.digest").alias("_digest"))
    placed = found.join(stays, F.col("group") == F.col("_group"))
    first = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest"))
    gone = placed.where(~first | (F.col("count") > 1)).select(F.col("doc_id").alias("_n_doc"), F.col("digest").alias("_n_digest"), first.alias("_n_first"))
    gone = materialize(gone, "kept-one")
    key = has_name(docs, "_k_digest")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    on = keyed["doc_id"].eqNullSafe(gone["_n_doc"]) & (keyed[key] == gone["_n_digest"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = keyed.join(gone, on, "left_anti").select(*columns)
    repeated = gone.where("_n_first")
    if repeated.isEmpty():
        return rest
    # rows that stand there more than once: one of them, by a digest of all columns
    digest = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    one = keyed.join(repeated, on, "left_semi").groupBy("doc_id", key).agg(F.min_by(F.struct(*columns), digest).alias("_whole"))
    return rest.unionByName(one.select("_whole.*"))
