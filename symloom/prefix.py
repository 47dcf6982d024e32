"""Running sums and ranks of groups of any size, and sums over numbered rows by blocks.

A window over a group reads the whole group in one task. What stands here never does: rows are cut
into ranges or blocks, each is summed by itself, and the sums of the earlier ones are added.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.storage import materialize

#: Numbered rows of a block.
BLOCK = 4096


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str], name: str = "running") -> DataFrame:
    """Add ``before_<value>``: the sum of each value over the earlier rows of the same group.

    Rows are dealt by ranges of (group, order), summed within each partition, and the sums of the
    earlier partitions of a group, of which there are about as many as partitions, are added.
    Values are longs without nulls; null groups are a group, nulls in ``order`` come last; ties are
    put in any order, which is then kept, as the numbered rows are written to the shared folder.
    Columns must not be named ``_part``, ``_local_*``; an empty frame stays empty. The frame, which
    should be narrow, is written first, as dealing by ranges reads it twice.
    """
    keys, df = list(group), materialize(df, name)
    dealt = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in [*keys, *order]])
    dealt = dealt.sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in [*keys, *order]])
    local = [f"_local_{v}" for v in values]
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), *[T.StructField(x, T.LongType()) for x in local]])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, totals = None, dict.fromkeys(values, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            change = np.zeros(n, bool)
            for c in columns:
                codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            change[0] = tuple(c[0].as_py() for c in columns) != last
            at = np.maximum.accumulate(np.where(change, np.arange(n), -1))
            sums = []
            for v in values:
                own = batch.column(batch.schema.get_field_index(v)).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.cumsum(own) - own + totals[v]
                sums.append(np.where(at >= 0, before - before[np.maximum(at, 0)], before))
                totals[v] = int(sums[-1][-1] + own[-1])
            last = tuple(c[n - 1].as_py() for c in columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), *map(pa.array, sums)], names=[*batch.schema.names, "_part", *local])

    numbered = materialize(dealt.mapInArrow(number, schema), name)
    sums = numbered.groupBy("_part", *keys).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = [F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_base_{v}") for v in values]
    # a row for each partition and each group that begins or ends in it: partitions + groups. Only a
    # group that goes on from the partition before adds something, at most one a partition; the
    # others are left out, so what is sent to all tasks is no longer than the partitions are many
    right = sums.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *bases)
    right = materialize(right.where(" or ".join(f"`_base_{v}` <> 0" for v in values)), name)
    on = numbered["_part"] == right["_p"]
    for i, k in enumerate(keys):
        on = on & numbered[k].eqNullSafe(right[f"_k{i}"])
    joined = numbered.join(F.broadcast(right), on, "left")
    return joined.select(*[numbered[c] for c in df.columns], *[(F.col(f"_local_{v}") + F.coalesce(f"_base_{v}", F.lit(0))).alias(f"before_{v}") for v in values])


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], column: str, name: str = "ranked") -> DataFrame:
    """Add ``column``: the place, from 1, of each row in its group; see ``running_sums``."""
    rows = running_sums(df.withColumn("_one", F.lit(1).cast("long")), group, order, ["_one"], name)
    return rows.select(*df.columns, (F.col("before__one") + 1).cast("int").alias(column))


def block_sums(rows: DataFrame, group: str, number: str, value: Column, column: str, block: int = BLOCK) -> DataFrame:
    """``group, number, column``: the sum of ``value`` over the rows of a group up to each number.

    Rows are numbered without regard to gaps, as lines are; numbers that repeat have one sum. Blocks of
    ``block`` numbers are summed; a group's window reads a row a block, a block's window its rows.
    Both sides of the join that follows are dealt by (group, block), so rows are shuffled once.
    """
    own = rows.select(group, number, F.floor(F.col(number) / block).alias("_block"), value.cast("long").alias("_v"))
    sums = own.groupBy(group, "_block").agg(F.sum("_v").alias("_sum"))
    earlier = W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = W.partitionBy(group, "_block").orderBy(number).rangeBetween(W.unboundedPreceding, W.currentRow)
    local = own.select(group, number, "_block", F.sum("_v").over(within).alias("_local"))
    joined = local.join(bases, local[group].eqNullSafe(F.col("_g")) & (local["_block"] == F.col("_b")))
    return joined.select(group, number, (F.col("_local") + F.col("_base")).alias(column))
