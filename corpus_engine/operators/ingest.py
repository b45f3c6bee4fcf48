"""Collection writes and incremental ingestion: insert-if-absent, ledger, upload chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULTS
from corpus_engine.operators.chunk import word_chunks
from corpus_engine.session import scratch_path


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", salts: int = 32,
                 salt_by: str | None = None) -> DataFrame:
    """Join where ``small`` has at most one row per key and ``big`` may hold a third of
    its rows under one key: ``big`` gets a salt in [0, salts) (from ``salt_by``, default
    the key and the row's other columns) and ``small`` is replicated once per salt, so a
    hot key is spread over ``salts`` tasks instead of one."""
    salt_cols = [F.col(salt_by)] if salt_by else [F.col(c) for c in big.columns]
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*salt_cols), F.lit(salts)))
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [key, "__salt"], how).drop("__salt")


def first_per_key(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key, the smallest ``order`` (default: the whole row) wins.

    A hash aggregate with ``min(struct)``: partial aggregation merges duplicates before the
    shuffle, so a key repeated in a third of all rows still ships one row per partition."""
    others = [c for c in df.columns if c != key]
    lead = [F.col(order).alias("__o")] if order else []
    packed = F.struct(*lead, *[F.col(c) for c in others])
    agg = df.groupBy(key).agg(F.min(packed).alias("__w"))
    return agg.select(key, *[F.col(f"__w.{c}").alias(c) for c in others])


def absent_rows(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """The rows of ``incoming`` whose key the collection does not hold yet (one per key).

    The anti-join comes first: a replayed batch is dropped before anything is sorted."""
    fresh = incoming.select(*existing.columns).join(existing.select(key), key, "left_anti")
    return first_per_key(fresh, key).select(*existing.columns)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """K5: the collection after adding ``incoming``; ids already present keep their old row
    (add ignores existing ids: insert-if-absent, not upsert). Duplicate ids within the batch
    are reduced to one row first."""
    return existing.unionByName(absent_rows(existing, incoming, key))


def new_files(batch: DataFrame, ledger: DataFrame, name: str = "filename") -> DataFrame:
    """Files of the batch whose name is not in the ledger, one row per name."""
    return first_per_key(batch, name).join(ledger.select(name), name, "left_anti")


def skipped_count(batch: DataFrame, ledger: DataFrame, name: str = "filename") -> DataFrame:
    """Number of batch rows (not names) already in the ledger. The batch is counted per name
    map-side, so a name repeated in a third of it is one row per task at the join."""
    per_name = batch.groupBy(name).agg(F.count(F.lit(1)).alias("__n"))
    return per_name.join(ledger.select(name), name, "left_semi").agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("skipped_files"))


def ledger_additions(ledger: DataFrame, processed: DataFrame, name: str = "filename") -> DataFrame:
    """Names of the batch that the ledger lacks, once each."""
    return processed.select(name).distinct().join(ledger.select(name), name, "left_anti")


def ledger_merge(ledger: DataFrame, processed: DataFrame, name: str = "filename") -> DataFrame:
    """K9: the ledger after a batch: what it holds and the names it lacks (the ledger itself is
    not sorted or aggregated again)."""
    return ledger.select(name).unionByName(ledger_additions(ledger, processed, name))


#: Units of one file, and rows of one unit, in one group of the numbering.
UNIT_GROUP = 4096


def running_base(counts: DataFrame, file_col: str, unit: str, key: str, n: str) -> DataFrame:
    """``base``: the sum of ``n`` over the earlier rows of the same file, by (unit, key); null units come first.

    Sums descend from groups of ``UNIT_GROUP`` unit numbers to groups of ``UNIT_GROUP`` keys of a unit, and to keys. So a
    file name that a third of all rows share is many small windows, and so is one page number that they share. Files
    and units may be null."""
    first = Window.unboundedPreceding
    out = counts.withColumns({"__g": F.floor(F.col(unit) / UNIT_GROUP), "__h": F.floor(F.col(key) / UNIT_GROUP), "base": F.lit(0).cast("bigint")})
    within = [file_col]
    for level in (["__g"], [unit, "__h"]):
        totals = out.groupBy(*within, *level).agg(F.sum(n).alias("__t"))
        before = Window.partitionBy(*within).orderBy(*(F.col(c).asc_nulls_first() for c in level)).rowsBetween(first, -1)
        within = [*within, *level]
        starts = totals.select(*(F.col(c).alias(f"__s{i}") for i, c in enumerate(within)),
                               F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__start"))
        same = [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(within)]
        out = out.join(starts, same).withColumn("base", F.col("base") + F.col("__start")).select(*out.columns)
    inside = Window.partitionBy(*within).orderBy(key).rowsBetween(first, -1)
    return out.select(file_col, unit, key, (F.col("base") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias("base"))


def upload_chunks(units: DataFrame, unit: str = "page_id", text: str = "text", file_col: str = "filename",
                  size: int = DEFAULTS.word_chunk_size) -> DataFrame:
    """X2 + K7: each unit (page row) of a file is chunked with the word packer, so chunks never
    cross a page; the index runs on across the pages of one file in page order, so ids are
    unique. Rows are chunked once, into a table of the shared folder; only (file, page, row, number of chunks) takes part in
    the numbering. Equal rows of a page are numbered one after the other; rows without a page number come first in their
    file, and rows without a file name are one file, named ''."""
    spark = units.sparkSession
    path = scratch_path(spark, "upload-chunks")
    units.select(F.coalesce(F.col(file_col), F.lit("")).alias(file_col), F.col(unit).alias("__unit"),
                 F.monotonically_increasing_id().alias("__row"),
                 word_chunks(F.col(text), size).alias("__chunks")).write.parquet(path)
    chunked = spark.read.parquet(path)
    counts = chunked.select(file_col, "__unit", "__row", F.size("__chunks").cast("bigint").alias("__n")).where("__n > 0")
    bases = running_base(counts, file_col, "__unit", "__row", "__n").select("__row", "base")
    out = chunked.select(file_col, "__row", F.posexplode("__chunks").alias("__pos", "text")).join(bases, "__row")
    out = out.withColumn("chunk_index", (F.col("base") + F.col("__pos")).cast("int"))
    idx = F.col("chunk_index").cast("string")
    return out.select(file_col, "chunk_index", "text", F.concat(F.lit("pdf_chunk_"), F.col(file_col), F.lit("_"), idx).alias("id"),
                      F.create_map(F.lit("source"), F.concat(F.col(file_col), F.lit("_chunk_"), idx)).alias("metadata"))
