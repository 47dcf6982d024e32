"""Sharding by a hierarchical weighted hash tree.

Shards are leaves of a tree of regions and racks, and a subtree weighs what its shards weigh. A
shard's draw for a key is an exponential number with its weight as rate, from a hash of key and
shard; a rack's draw is the least of its shards', a region's the least of its racks'. The least of
exponential numbers is one whose rate is the sum of theirs, so every level draws by weight, and the
draws of all levels belong together. A key descends from level to level to the child with the
least draw.

Because a node's draw is that of its subtree, nothing moves but what a change concerns: a weight
that grows takes keys only to its shard, one that falls lets them go only from it, and a tree with
one more shard, wherever it hangs, differs from the one without it by the keys that the new shard
draws. Levels that draw by themselves, by hashes of racks and regions, need fewer draws a key, but
cannot keep that: a key that a heavier region draws may land in any of its shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import running

Tree = dict[str, dict[str, dict[int, float]]]


def shard_tree(n: int, per_rack: int = 4, racks: int = 2, weights: Sequence[float] | None = None) -> Tree:
    """The tree of shards 0 to n-1: ``per_rack`` shards a rack, ``racks`` racks a region."""
    tree: Tree = {}
    for s in range(n):
        rack = s // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[s] = 1.0 if weights is None else float(weights[s])
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, the next number, as a region and a rack of its own."""
    shard = 1 + max((s for racks in tree.values() for shards in racks.values() for s in shards), default=-1)
    return tree | {f"grown{shard}": {f"grown{shard}": {shard: float(weight)}}}


def shard_draw(key: Column, shard: Column, weight: Column) -> Column:
    """A shard's draw for a key: exponential with the weight as rate; infinite without weight."""
    # 53 bits of the hash as a number within (0, 1); a null key has a hash of its own
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(3), shard, key.isNull(), key), 11).cast("double")
    return F.when(weight > 0, -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / weight).otherwise(F.lit(float("inf")))


def least(draws: Column) -> Column:
    """Of structs (draw, name, ...) the one with the least draw, of several the least name."""
    return F.array_min(draws)


def descent(key: Column, tree: Tree) -> Column:
    """Struct (draw, region, rack, shard): where a key's descent ends.

    Each rack offers its shard of least draw, each region its rack's offer of least draw, and the
    root takes the region of least draw: the way down, told from its end.
    """
    regions = []
    for g, racks in sorted(tree.items()):
        offers = []
        for r, shards in sorted(racks.items()):
            own = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(shards.items())])
            own = F.transform(own, lambda x: F.struct(shard_draw(key, x["shard"], x["weight"]).alias("draw"), x["shard"].alias("shard")))
            best = least(own)
            offers.append(F.struct(best["draw"].alias("draw"), F.lit(r).alias("rack"), best["shard"].alias("shard")))
        best = least(F.array(*offers))
        regions.append(F.struct(best["draw"].alias("draw"), F.lit(g).alias("region"), best["rack"].alias("rack"), best["shard"].alias("shard")))
    return least(F.array(*regions))


def place(df: DataFrame, key: str, tree: Tree) -> DataFrame:
    """``df`` with ``region``, ``rack`` and ``shard`` of its key.

    A rack's name has to be the only one of its name in its region, a shard's number in the tree.
    """
    columns = [c for c in df.columns if c not in ("region", "rack", "shard")]
    return df.withColumn("_way", descent(F.col(key), tree)).select(*columns, "_way.region", "_way.rack", "_way.shard")


def shard_documents(docs: DataFrame, n_shards: int, name: str = "shards") -> DataFrame:
    """``doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard`` of every document.

    doc_id and the number of shards decide the shard; ``grown_shard`` is the shard among one more:
    what ``shard_documents`` of ``n_shards + 1`` gives. ``size`` is the text's UTF-8 bytes (null: none) plus 1. Slots count from 0 in
    each shard, in doc_id order (null last), without gaps; no shard is gathered in one task. Rows
    of one doc_id, repeated ones too, share a shard and take consecutive slots. Null doc_ids are
    one key. An empty table gives an empty result; further columns are left out.
    """
    rows = docs.select("doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = place(rows, "doc_id", shard_tree(n_shards + 1)).withColumn("grown_shard", F.col("shard").cast("int"))
    rows = place(rows, "doc_id", shard_tree(n_shards)).select("doc_id", "size", "text_crc32", "region", "rack", F.col("shard").cast("int").alias("shard"), "grown_shard", F.lit(1).cast("long").alias("one"))
    slots = running(rows, ["shard"], ["doc_id", "text_crc32", "size"], "one", name)
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", F.col("before").alias("slot"), "grown_shard")
