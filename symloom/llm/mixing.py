"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's documents, put in a seeded order, are a line of words that is cut into equal blocks of
at most ``BLOCK`` words: as few as that takes, so blocks of a source differ by one word at most, and
a source of a few words is one small block. Sources take blocks in the order of the quotients
``(target / words of a block) / (2 k + 1)``; as this order does not depend on the number of seats, the
mix is cut into shards along it, and every shard has an integer quota of every source. A source's
seats, shard after shard, take blocks in a seeded permutation, again and again until the quotas are
used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.llm.common import has_name, holds, materialize, n_words, running

#: Words of a block at most.
BLOCK = 256
#: No source, and so no document, is taken more often than this.
MOST = 3
#: The weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
SEED = 42
#: Shards of the mix.
SHARDS = 16


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Words to take of each source: shares of all words by weight, at most ``most`` sizes.

    Sources in code point order, null last. What a source cannot give is shared anew by weight
    among those below their limit.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * share > most * sizes[s]]
        if not full:
            return out | {s: weight[s] * share for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def apportion(wanted: list[float], seats: int, limits: list[int]) -> list[int]:
    """Sainte-Lague: ``seats`` seats by highest quotients ``wanted / (2 k + 1)``, within limits.

    Ties go to the earlier party. Found from a common divisor by bisection, so the work does not
    grow with the seats.
    """
    seats = min(seats, sum(n for n, w in zip(limits, wanted, strict=True) if w > 0))

    def at(divisor: float) -> list[int]:
        # the number of quotients w / (2 k + 1) that are at least 2 / divisor
        return [min(n, math.floor(w * divisor / 4 + 0.5)) if w > 0 else 0 for w, n in zip(wanted, limits, strict=True)]

    low, high = 0.0, 1.0
    while sum(at(high)) < seats and high < 1e300:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if sum(at(middle)) < seats:
            low = middle
        else:
            high = middle
    got = at(low)
    for _ in range(seats - sum(got)):  # ties of the last quotient
        quotients = [(w / (2 * k + 1) if k < n and w > 0 else -1.0) for w, k, n in zip(wanted, got, limits, strict=True)]
        got[quotients.index(max(quotients))] += 1
    return got


@dataclass(frozen=True)
class Quota:
    """What the mix takes of a source: ``upto[m]`` of its seats lie in shards before ``m``."""

    source: str | None
    size: int
    target: float
    upto: tuple[int, ...]
    blocks: int
    step: int
    shift: int

    @property
    def seats(self) -> int:
        return self.upto[-1]


def n_blocks(size: int, block: int = BLOCK) -> int:
    """Blocks that a source of so many words is cut into."""
    return -(-size // block)


def shard_quotas(sizes: dict[str | None, int], shards: int = SHARDS, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[dict[str | None, int]]:
    """Integer quotas of each shard of the mix; seats are cut in the order of their quotients."""
    goal = targets(sizes, weights, most)
    sources, limits = list(goal), [most * n_blocks(sizes[s], block) for s in goal]
    # seats that a source wants: its target by the words of its blocks
    wanted = [goal[s] * n_blocks(sizes[s], block) / max(1, sizes[s]) for s in sources]
    total, before, out = round(sum(wanted)), [0] * len(goal), []
    for m in range(1, shards + 1):
        upto = apportion(wanted, total * m // shards, limits)
        out.append({s: b - a for s, a, b in zip(sources, before, upto, strict=True)})
        before = upto
    return out


def plan(sizes: dict[str | None, int], block: int = BLOCK, seed: int = SEED, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[Quota]:
    """The quotas of all sources, and each source's permutation ``j -> step * j + shift``."""
    goal, quotas = targets(sizes, weights, most), shard_quotas(sizes, shards, block, weights, most)
    out = []
    for i, s in enumerate(goal):
        blocks = n_blocks(sizes[s], block)
        m = max(1, blocks)
        step = (seed * 2654435761 + i * 40503 + 12345) % m or 1
        while math.gcd(step, m) > 1:
            step += 1
        out.append(Quota(s, sizes[s], goal[s], tuple(accumulate((q[s] for q in quotas), initial=0)), blocks, step % m, (seed * 97 + i * 31) % m))
    return out


def source_sizes(docs: DataFrame) -> dict[str | None, int]:
    """Words of each source. Sources are labels, one row each comes to the driver."""
    rows = docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("n")).collect()
    return {r["source"]: int(r["n"] or 0) for r in rows}


def quota_table(spark: SparkSession, quotas: list[Quota]) -> DataFrame:
    rows = [(q.source, q.size, q.target, list(q.upto), max(1, q.blocks), q.step, q.shift) for q in quotas]
    return spark.createDataFrame(rows, "q_source string, source_size long, target double, upto array<long>, blocks long, step long, shift long")


def times_modulo(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``a * b % m`` of numbers below 2 ** 40, whose product need not fit a long."""
    high = a % m * (b >> 20) % m
    return ((high << 20) % m + a % m * (b & 0xFFFFF)) % m


def words_of_shards(start: np.ndarray, size: np.ndarray, source_size: np.ndarray, blocks: np.ndarray, step: np.ndarray, shift: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Words that each shard (columns) takes of each document (rows)."""
    out = np.zeros((len(start), upto.shape[1] - 1), np.int64)
    some = np.flatnonzero(size > 0)
    start, size, source_size, blocks, step, shift, upto = (x[some] for x in (start, size, source_size, blocks, step, shift, upto))
    # the first ``longer`` blocks of a source have one word more than the others
    words, longer = source_size // np.maximum(blocks, 1), source_size % np.maximum(blocks, 1)
    split = longer * (words + 1)
    at = lambda x: np.where(x < split, x // (words + 1), longer + (x - split) // np.maximum(words, 1))
    first = at(start)
    n = at(start + size - 1) - first + 1
    row = np.repeat(np.arange(len(some)), n)
    begins = np.cumsum(n) - n
    j = first[row] + np.arange(len(row)) - begins[row]
    edge = lambda k: k * words[row] + np.minimum(k, longer[row])
    inside = np.minimum(start[row] + size[row], edge(j + 1)) - np.maximum(start[row], edge(j))
    # block j's turn in the permutation: the seats turn, turn + blocks, ... take it
    turn = (times_modulo(j, step[row], blocks[row]) + shift[row]) % blocks[row]
    for m in range(out.shape[1] if len(some) else 0):
        # of the first x seats as many as there are numbers p with p * blocks + turn < x
        upper, lower = (np.maximum((upto[row, k] - turn + blocks[row] - 1) // blocks[row], 0) for k in (m + 1, m))
        out[some, m] = np.add.reduceat(inside * (upper - lower), begins)
    return out


def shard_words(start: Column, size: Column) -> Column:
    """Words that each shard takes of a document that stands at ``start`` of its source's line.

    Reads the columns ``source_size, blocks, step, shift, upto`` of its source's quota.
    """

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def words(start: pa.Array, size: pa.Array, source_size: pa.Array, blocks: pa.Array, step: pa.Array, shift: pa.Array, upto: pa.Array) -> pa.Array:
        holds("mixing")
        own = [x.to_numpy(zero_copy_only=False) for x in (start, size, source_size, blocks, step, shift)]
        table = upto.flatten().to_numpy(zero_copy_only=False).reshape(len(upto), -1)
        out = words_of_shards(*own, table)
        ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return words(start, size, *[F.col(c) for c in ("source_size", "blocks", "step", "shift", "upto")])


def mix_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED, shards: int = SHARDS, name: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, shard_taken, digest`` of every document.

    Sizes are words; null texts have none. A null source is a source of its own, last in order.
    ``taken`` counts words, repeats too, ``shard_taken`` those of each shard of the mix; no document
    gives more than three times its size. Reruns agree, as the order of a source's line comes from
    seeded hashes of doc_id; rows that are repeated are told apart by no column and may swap
    places. An empty table gives an empty result; further columns are left out. The driver holds
    one row a source. No source is gathered in one task.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("turn"), F.xxhash64("text").alias("digest"))
    lines = running(sized, ["source"], ["turn", "doc_id", "digest", "size"], "size", name)
    sizes = {r["source"]: int(r["n"]) for r in lines.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    quotas = quota_table(spark, plan(sizes, block, seed, shards))
    joined = lines.join(quotas, lines["source"].eqNullSafe(quotas["q_source"]))
    rows = joined.withColumn("shard_taken", shard_words(F.col("before"), F.col("size")))
    taken = F.aggregate("shard_taken", F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "shard_taken", "digest")


def mixed(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as the mix takes its words, with all its columns.

    ``taken / size`` copies, the fraction rounded up with that chance by a seeded hash, so that
    whole texts come near the targets; documents without words are left out. Rows that share
    doc_id, source and text have the copies of all of them together: each as many, and what is
    left over goes to one of them, by a digest of all columns. Null doc_ids and sources are values
    like others. An empty table gives an empty mix.
    """
    n, key = has_name(docs, "_copies"), has_name(docs, "_digest")
    share = F.col("taken") / F.col("size")
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "digest"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = mix_documents(docs, block, seed).where("size > 0").select("doc_id", "source", "digest", F.floor(share + chance).cast("int").alias("k"))
    counts = counts.groupBy("doc_id", "source", "digest").agg(F.sum("k").alias("k"), F.count("*").alias("n")).where("k > 0")
    counts = counts.select(F.col("doc_id").alias("_c_doc"), F.col("source").alias("_c_source"), F.col("digest").alias("_c_digest"), F.floor(F.col("k") / F.col("n")).cast("int").alias("_c_each"), (F.col("k") % F.col("n")).cast("int").alias("_c_more"))
    counts = materialize(counts, "mix-copies")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    on = keyed["doc_id"].eqNullSafe(counts["_c_doc"]) & keyed["source"].eqNullSafe(counts["_c_source"]) & (keyed[key] == counts["_c_digest"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = keyed.join(counts.where("_c_each > 0"), on).withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col("_c_each")))).select(*columns)
    if counts.where("_c_more > 0").isEmpty():
        return rows
    digest = F.xxhash64(*[x.cast("string") for x in columns])
    one = keyed.join(counts.where("_c_more > 0"), on).groupBy("_c_doc", "_c_source", "_c_digest", "_c_more").agg(F.min_by(F.struct(*columns), digest).alias("_whole"))
    return rows.unionByName(one.select("_whole", F.explode(F.array_repeat(F.lit(1), F.col("_c_more")))).select("_whole.*"))
