"""R6 with a stored key index: a new batch is de-duplicated without reading the corpus again.

The index is a table bucketed by the key of the normalised text, with the id that keeps it and the batch that brought it. A batch is
reduced to (key, smallest id) map-side, held against the index bucket by bucket (the index is not shuffled), and what is new is appended.
Rows stay if their key is new and their id is the smallest of the batch; texts travel once, in a semi-join on the id.

A batch is named by a number. Keys are compared with those of other batches, so a batch that is repeated after a failure keeps the same
rows. Batches in order of ids give the result of one batch over all rows. Null texts have the key of no text: all
of them are copies of each other. Ids are unique and not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.functions import text as T
from corpus_engine.sources.collection import BucketedCollection


class DedupIndex:
    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.table = BucketedCollection(spark, path, schema=f"key string, id {id_type}, batch bigint", key="key")

    def add(self, rows: DataFrame, batch: int, id_col: str = "id", text: str = "text") -> DataFrame:
        """The rows of the batch that stay; their keys are in the index when this returns."""
        keys = rows.select(T.normalized_key(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(id_col).alias("id")) \
            .groupBy("key").agg(F.min("id").alias("id"))
        others = self.table.read().where(F.col("batch") != batch).select("key")
        self.table.insert_if_absent(keys.join(others, "key", "left_anti").withColumn("batch", F.lit(batch).cast("bigint")))
        kept = self.table.read().where(F.col("batch") == batch).select(F.col("id").alias(id_col))
        return rows.join(kept, id_col, "left_semi")
