"""Uploading files: skip those in the ledger, chunk, embed, insert, then record the names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.operators import ingest as I
from corpus_engine.operators.embed import HashEmbedder
from corpus_engine.plans.index_build import stamp_embedder
from corpus_engine.sources.collection import BucketedCollection
from corpus_engine.sources.files import COLLECTION_SCHEMA
from corpus_engine.sources.sinks import append_ledger, read_ledger


@dataclass(frozen=True)
class Uploaded:
    new_files: int
    total_chunks: int
    skipped_files: int


def upload(spark: SparkSession, units: DataFrame, collection_path: str, ledger_path: str, embedder=None) -> Uploaded:
    """Add the files of ``units`` (filename, page_id, text; one row per page) that the ledger lacks.

    The ledger check comes before extraction, so pages of known files are not chunked. Chunks
    are embedded as they are inserted, and names are recorded after the chunks: a run that is
    lost in between inserts nothing twice when it is repeated."""
    embedder = embedder or HashEmbedder()
    stamp_embedder(spark, collection_path, embedder)
    ledger = read_ledger(spark, ledger_path)
    names = units.select("filename").distinct()
    skipped = names.join(ledger, "filename", "left_semi").count()
    fresh = units.join(ledger, "filename", "left_anti")
    chunks = I.upload_chunks(fresh).select(
        "id", F.col("filename").alias("doc_id"), "chunk_index", "text")
    collection = BucketedCollection(spark, collection_path, schema=COLLECTION_SCHEMA)
    added = collection.insert_if_absent(embedder.embed(chunks))
    new = append_ledger(spark, ledger_path, fresh.select("filename"))
    return Uploaded(new, added, skipped)
