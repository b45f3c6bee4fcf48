"""Training-data pipeline over ``documents``: every stage works on all its predecessor kept.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet in the shared folder and read again as the next stage's documents.
All stages but the last return the columns of documents. Null texts and empty texts go with
the quality rules; null columns otherwise pass through. Repeated rows are judged alike.
An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpus_engine.llm import decontaminate, jaccard_join, mixing, quality, secrets
from corpus_engine.llm.common import shipped, written
from corpus_engine.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_quality(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redact(docs, secrets.fresh_ledger(docs, "pipeline-ledger"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of every document by the mix."""
    return mixing.mix_sources(docs).select("doc_id", "size", "source", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
]

#: The near-duplicate and secret stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents`` of ``sf_dir``; returns the last stage's rows."""
    shipped(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
