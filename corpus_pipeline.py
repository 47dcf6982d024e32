"""The corpus pipeline: documents to token digests of a cleaned, deduplicated, mixed corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from symloom.llm import queries
from symloom.llm.common import shared_dir
from symloom.storage import passing_tables, remove

STAGES = [
    ("language_id", queries.keep_known_languages),
    ("quality_rules", queries.keep_good_quality),
    ("simhash_near_dedup", queries.keep_one_of_near_duplicates),
    ("source_mix", queries.mix_sources),
    ("bpe_encode", queries.encode_words),
]

#: No SQL: two stages are learned models, one compares fingerprints, one draws by seeded hashes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next one.

    What a stage wrote on its way goes once its result is written, and so does what it read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with passing_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
