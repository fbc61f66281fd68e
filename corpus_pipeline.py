"""The corpus pipeline: documents in, sharded training documents out, five stages each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkspark.llm import decontaminate, language_id, minhash_dedup, mixing, sharding
from inkspark.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or foreign to every language learned from the labelled documents, go."""
    return language_id.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal or near-equal texts stays."""
    return minhash_dedup.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a shorter item whole, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their target weights: every document is used once, those of small sources again."""
    return mixing.reweighted(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its shard and its slot there."""
    return sharding.sharded(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: language ID learns from the data and near-duplicate classes follow from alignments: no SQL for either
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
