"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import codebooks, langid, licenses, media, mixing, quality, quotes, sharding, simhash, similar, token_files, trie, winnowing
from symloom.llm.bpe_automaton import bpe_round_trip

#: The token that ends a document in token files.
END_ID = 2
SHARDS = 16


def vocabulary() -> str:
    """Path of the public vocabulary file that queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_offsets(_table(spark, sf_dir, "documents"), vocabulary(), END_ID)


def op2_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op3_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), SHARDS)


def op4_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(_table(spark, sf_dir, "conversations"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(langid.sample(docs)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.learn_rules(docs, _table(spark, sf_dir, "labels")))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard_taken")


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), vocabulary())


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(_table(spark, sf_dir, "embeddings"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_files, op2_avi_clips, op3_hash_tree_shards, op4_quote_links, op5_simhash_components, op6_language, op7_quality_rules, op8_source_mix, op9_bpe_automaton, op10_license_scan, op11_yinyang_codes, op12_winnowing, op13_prefix_trie]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op10_license_scan": licenses.oracle_sql(), "op11_yinyang_codes": codebooks.oracle_sql(), "op12_winnowing": winnowing.oracle_sql(), "op13_prefix_trie": trie.oracle_sql()}


# The stages of the corpus pipeline: each takes documents and returns documents with the same
# columns, whatever further ones there are, the last one digests. Any column may be null: null and
# wordless texts leave with the first stages, null sources, languages and doc_ids are values like
# others. Repeated rows are kept or dropped alike by the filters; one of them stays as a
# near-duplicate. An empty table gives an empty one. Very long texts are read whole.


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_unknown(docs, langid.train(langid.sample(docs)))


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_bad(docs, quality.learn_rules(docs, _table(spark, sf_dir, "labels")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: a row a document with its ids' digests, its source and language.

    Its workers' caches are a quarter of those of ``op9``: an executor keeps all the workers that the
    stages before have used, and each fills its own.
    """
    from symloom.llm.bpe_automaton import bpe_digests

    rows = docs.select("doc_id", "source", "lang", bpe_digests(F.col("text"), vocabulary(), 1 << 16).alias("r"))
    return rows.select("doc_id", "source", "lang", "r.*")
