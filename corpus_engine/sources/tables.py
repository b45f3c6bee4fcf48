"""Loading the driver tables (one parquet file per table) with column pruning left to Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes scaled by the projected columns)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def balance(df: DataFrame, max_bytes: int = 1 << 30, per_core: int = 2,
            min_task_bytes: int = 1 << 18) -> DataFrame:
    """Spread a small input over the cores before CPU-heavy per-row work.

    A file with a single row group is read by one task however many splits it is cut
    into, so text processing on it would run on one core. Inputs up to ``max_bytes`` (by
    Catalyst's estimate) are round-robin repartitioned into at most ``per_core`` tasks per
    core and at least ``min_task_bytes`` per task, a cheap shuffle; an input that fits one
    task is left alone, and larger inputs keep their file splits (one task per row group)
    and are never shuffled here."""
    size = estimated_bytes(df)
    if size > max_bytes:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    target = min(per_core * cores, -(-size // min_task_bytes))
    return df if target <= 1 else df.repartition(int(target))
