"""Corpus statistics, stage counters and the upload status message.

All are single global aggregates: partial aggregation per task, one tiny final merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions import text as T


def corpus_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """G1: total papers and mean/min/max whitespace word counts; zeros for an empty corpus."""
    wc = T.word_count(F.col(text))
    return df.agg(
        F.count(F.lit(1)).alias("total_papers"),
        F.coalesce(F.avg(wc), F.lit(0.0)).alias("average_word_count"),
        F.coalesce(F.min(wc), F.lit(0).cast("bigint")).alias("min_word_count"),
        F.coalesce(F.max(wc), F.lit(0).cast("bigint")).alias("max_word_count"),
    )


def stage_stats(stages: dict) -> DataFrame:
    """The same four numbers for several stages, one row per stage."""
    out = None
    for name, df in stages.items():
        row = corpus_stats(df).select(F.lit(name).alias("stage"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def stage_counts(processed: DataFrame, cleaned: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows per stage as one row: a union of stage tags and one conditional aggregate
    (no join between the one-row results)."""
    tagged = (processed.select(F.lit(0).alias("__s"))
              .unionAll(cleaned.select(F.lit(1).alias("__s")))
              .unionAll(saved.select(F.lit(2).alias("__s"))))
    names = ("num_processed_papers", "num_cleaned_papers", "num_saved_papers")
    return tagged.agg(*[F.count(F.when(F.col("__s") == i, F.lit(1))).alias(n)
                        for i, n in enumerate(names)])


def upload_status(new_files, total_chunks, skipped_files) -> "F.Column":
    """The status message from three counts."""
    ok = F.concat(F.lit("Successfully processed "), new_files.cast("string"),
                  F.lit(" new PDF(s). Added "), total_chunks.cast("string"),
                  F.lit(" text chunks to the database."))
    skip = F.concat(F.lit("Skipped "), skipped_files.cast("string"),
                    F.lit(" previously processed file(s)."))
    parts = F.concat_ws(" ", F.when(new_files != 0, ok), F.when(skipped_files > 0, skip))
    return F.when(parts == "", F.lit("No new files to process.")).otherwise(parts)
