"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (bpe_replay, collocations, fingerprints, hnsw_dedup, jaccard_join, langid_ecoc, mixing, quality_gam,
               secret_ledger, sharding, token_align, token_counts, toxicity)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_hnsw_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_replay.digests(_table(spark, sf_dir, "documents"),
                              public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid_ecoc.identify(docs, langid_ecoc.train(docs))


def op4_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op5_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op7_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_table(spark, sf_dir, "documents"))


def op8_longest_first_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, _table(spark, sf_dir, "labels")))


def op11_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.fresh_report(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                    public_tokenizers.path("piece_bpe_32k.model"), pattern=public_tokenizers.PATTERN)


def op13_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_hnsw_duplicates, op2_bpe_replay, op3_ecoc_language, op4_fair_mixing, op5_segment_toxicity, op6_jaccard_join,
    op7_weighted_sampling, op8_longest_first_shards, op9_token_counts, op10_quality_gam,
    op11_secret_ledger, op12_token_alignment, op13_phrase_index)}

#: DuckDB SQL of the queries that SQL can express over whole tables.
ORACLE: dict[str, str] = {
    "op11_secret_ledger": secret_ledger.report_sql(),
    "op13_phrase_index": collocations.collocations_sql(),
}
