"""Aggregates over bindings: counts, indexes, repeated names and their unique suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.functions.names import is_obfuscated


def name_counts(bindings: DataFrame) -> DataFrame:
    """Declarations of each name in each file."""
    return bindings.groupBy("path", "name").agg(F.count("*").alias("n"))


def renamable_symbols(bindings: DataFrame) -> DataFrame:
    """Distinct machine-made names of each file."""
    return bindings.where(is_obfuscated(F.col("name"))).select("path", "name").distinct()


def scope_of_line(bindings: DataFrame) -> DataFrame:
    """Scope of each ``(path, name, line)``: the last declaration's; null scopes are ``''``."""
    return bindings.groupBy("path", "name", "line").agg(F.max_by(F.coalesce("scope_id", F.lit("")), "binding_seq").alias("scope_id"))


def names_of_scope(bindings: DataFrame) -> DataFrame:
    """Sorted distinct names of each scope."""
    return bindings.groupBy("path", "scope_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def lines_index(bindings: DataFrame) -> DataFrame:
    """Declaration lines of each name, in binding order."""
    rows = F.array_sort(F.collect_list(F.struct("binding_seq", "line")))
    return bindings.groupBy("path", "name").agg(F.transform(rows, lambda x: x["line"]).alias("lines"))


def duplicate_groups(bindings: DataFrame) -> DataFrame:
    """Names declared more than once: groups and bindings to rename in each file."""
    once = bindings.select("path", "name", "line", "column").distinct()
    groups = once.groupBy("path", "name").agg(F.count("*").alias("n")).where("n > 1")
    return groups.groupBy("path").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_bindings"))


def uniquify(bindings: DataFrame) -> DataFrame:
    """``path, name, line, column, new_name``: members of repeated names get ``name__u<k>``.

    The i-th member in text order takes the i-th positive number whose name no binding has. Free
    numbers are found without trying them in turn: the i-th free number is i plus the number of
    used ones below it, which one sort of both together tells. Names fall into (path, name)
    groups; nothing but keys is sorted.
    """
    once = bindings.select("path", "name", "line", "column").distinct()
    by_name = W.partitionBy("path", "name")
    members = once.withColumn("n", F.count("*").over(by_name)).where("n > 1")
    members = members.withColumn("i", F.row_number().over(by_name.orderBy("line", "column"))).withColumn("i", F.col("i").cast("long"))
    # a used number k blocks the members from the (k - number of used ones up to k) -th free on
    pattern = r"(?s)^(.+)__u([1-9][0-9]{0,17})$"
    used = once.select("path", F.regexp_extract("name", pattern, 1).alias("name"), F.regexp_extract("name", pattern, 2).cast("long").alias("k")).where("name <> ''").distinct()
    used = used.withColumn("i", F.col("k") - F.row_number().over(by_name.orderBy("k")) + 1)
    both = members.select("path", "name", "line", "column", "i", F.lit(1).alias("kind")).unionByName(used.select("path", "name", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), "i", F.lit(0).alias("kind")))
    skipped = F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(by_name.orderBy("i", "kind").rowsBetween(W.unboundedPreceding, 0))
    placed = both.withColumn("k", F.col("i") + skipped).where("kind = 1")
    return placed.select("path", "name", "line", "column", F.concat("name", F.lit("__u"), F.col("k").cast("string")).alias("new_name"))


def file_stats(batches: DataFrame, renames: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Symbols found, scopes processed and symbols renamed of each file, and its error."""
    found = batches.groupBy("path").agg(F.sum("n_identifiers").alias("symbols_found"), F.count("*").alias("scopes_processed"))
    renamed = renames.groupBy("path").agg(F.count("*").alias("symbols_renamed"))
    out = found.join(renamed, "path", "full_outer")
    out = out.join(errors, "path", "full_outer") if errors is not None else out.withColumn("error", F.lit(None).cast("string"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("path", zero("symbols_found"), zero("scopes_processed"), zero("symbols_renamed"), "error")


def run_summary(stats: DataFrame) -> DataFrame:
    """One row a file with its status; failed files stay."""
    return stats.select("path", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "symbols_found", "symbols_renamed", "scopes_processed", "error")
