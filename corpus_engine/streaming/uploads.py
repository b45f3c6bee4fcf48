"""I1 within I2: files are skipped by a ledger that belongs to the stream.

A stream of page rows (filename, page_id, text) adds the files whose names no earlier micro-batch has brought. The ledger is a table bucketed by
name that holds the epoch in which each name came first. An epoch compares its names with those of earlier epochs only, so an epoch
that is replayed after a failure decides as it did the first time: its chunks are inserted if absent, its
names too, and its status row is written over. Pages of one file may be in several files of a micro-batch.

The anti-joins read ledger and collection bucket by bucket; only the batch is shuffled. Rows without a file name are one file, named ''.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.operators import ingest as I
from corpus_engine.operators.embed import HashEmbedder
from corpus_engine.plans.index_build import stamp_embedder
from corpus_engine.sources.collection import BucketedCollection
from corpus_engine.sources.files import COLLECTION_SCHEMA

LEDGER = "filename string, epoch bigint"
UNITS = "filename string, page_id bigint, text string"


class UploadStream:
    """A collection, its ledger and the status of every epoch, under ``path``."""

    def __init__(self, spark: SparkSession, path: str, embedder=None):
        self.spark, self.path = spark, path.rstrip("/")
        self.embedder = embedder or HashEmbedder()
        stamp_embedder(spark, f"{self.path}/collection", self.embedder)
        self.collection = BucketedCollection(spark, f"{self.path}/collection", schema=COLLECTION_SCHEMA)
        self.ledger = BucketedCollection(spark, f"{self.path}/ledger", schema=LEDGER, key="filename")

    def add(self, batch: DataFrame, epoch: int) -> None:
        """Take in one epoch; taking it in again changes nothing."""
        units = batch.select(F.coalesce("filename", F.lit("")).alias("filename"), "page_id", "text")
        earlier = self.ledger.read().where(F.col("epoch") < epoch).select("filename")
        fresh = units.join(earlier, "filename", "left_anti")
        chunks = I.upload_chunks(fresh).select("id", F.col("filename").alias("doc_id"), "chunk_index", "text")
        self.collection.insert_if_absent(self.embedder.embed(chunks))
        names = fresh.select("filename").distinct().withColumn("epoch", F.lit(epoch).cast("bigint"))
        self.ledger.insert_if_absent(names)
        brought = units.select("filename").distinct()
        skipped = brought.join(earlier, "filename", "left_semi").agg(F.count(F.lit(1)).alias("skipped_files"))
        new = self.ledger.read().where(F.col("epoch") == epoch).agg(F.count(F.lit(1)).alias("new_files"))
        row = (epoch, new.first()[0], skipped.first()[0])
        self.spark.createDataFrame([row], "epoch bigint, new_files bigint, skipped_files bigint").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/status/{epoch}")

    def run(self, source: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> None:
        """Take in what is new in the folder ``source``."""
        reader = self.spark.readStream.schema(UNITS).format(fmt)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        reader.load(source).writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.path}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()

    def status(self) -> DataFrame:
        """epoch, new_files and skipped_files of every epoch."""
        return self.spark.read.schema("epoch bigint, new_files bigint, skipped_files bigint").parquet(f"{self.path}/status/*")
