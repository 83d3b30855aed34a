"""Corpus pipeline: stages over ``documents``, each reading what the one before wrote.

The stages keep the columns of documents, but for the last: it encodes what is left.  SQL cannot
express them (trained classifiers, byte-pair merges), so the tests hold them against brute force.

Every stage takes null ids, texts, languages and sources, empty and very long texts, repeated rows
and further columns of any name: quality and near copies judge a null text as an empty one, which
quality decides by its features and near copies leaves alone; language drops texts without a
letter; the mix takes no text without words; a null id is kept as it is.  An empty table stays
empty at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from churnlens.llm import bpe_replay, jaccard_join, langid_ecoc, mixing, quality_gam
from churnlens.llm.frames import release, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality_gam.accepted(docs, quality_gam.train(docs, labels))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one language without doubt."""
    return langid_ecoc.accepted(docs, langid_ecoc.train(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded bytes of each document."""
    return bpe_replay.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near copies", without_near_copies),
    ("mix", mixed_sources),
    ("encode", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result is stored as Parquet and reread.

    Folders that this process wrote before are deleted on the way, so write the results of other
    operators first."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        release(spark, kept=docs)  # what the stage wrote for itself, and the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
