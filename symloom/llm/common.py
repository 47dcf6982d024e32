"""What several operators share: words, written tables, distributed running sums."""

from __future__ import annotations

import gc
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.prefix import running_sums
from symloom.storage import materialize, shared_dir

__all__ = ["WORD", "has_name", "holds", "materialize", "n_words", "running", "shared_dir"]

#: Words are runs of characters other than the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


_kept: list[tuple[str, Callable[[], None] | None]] = [("", None)]


def holds(operator: str, drop: Callable[[], None] | None = None) -> None:
    """Say, within a task, that this process now works for an operator; ``drop`` frees its caches.

    Spark's workers go from stage to stage. Without this, a worker would keep the caches of every
    operator that it has ever worked for, each bounded, but not their sum.
    """
    if _kept[0][0] != operator:
        if _kept[0][1] is not None:
            _kept[0][1]()
            gc.collect()
        _kept[0] = (operator, drop)


def has_name(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` does not have, whatever its columns."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Number of words of a text as a long; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str = "running") -> DataFrame:
    """Add ``before``: the sum of ``value`` over the earlier rows of the same group; no group has to
    fit into one task. See ``running_sums``."""
    return running_sums(df, group, order, [value], name).withColumnRenamed(f"before_{value}", "before")
