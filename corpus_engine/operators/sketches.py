"""G1/G2 kept up batch by batch: mergeable sketches of a corpus.

Each batch of documents leaves one row: counts, sums and extremes of the word counts (exact), a KLL sketch of the word counts and a HyperLogLog
sketch of the words. Merging rows gives the statistics of all batches without reading a document again: quantiles
within about 1.33 % of rank at the library's default size, distinct words within about 1.6 % (one standard
deviation, 2^12 registers). Sketches are built map-side, so a word that is a third of all words costs one register.

Null texts count as documents of no words. An empty batch leaves a row of zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions import text as T

#: log2 of the registers of the distinct count.
REGISTERS = 12


def batch_sketch(docs: DataFrame, batch: str, text: str = "text") -> DataFrame:
    """One row: batch, n_docs, n_words, min_words, max_words, lengths (KLL) and words (HyperLogLog)."""
    counts = docs.select(F.coalesce(T.word_count(F.col(text)), F.lit(0).cast("bigint")).alias("n"))
    lengths = counts.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_words"), F.coalesce(F.min("n"), F.lit(0)).alias("min_words"),
                         F.coalesce(F.max("n"), F.lit(0)).alias("max_words"), F.kll_sketch_agg_bigint("n").alias("lengths"))
    words = docs.select(F.explode(T.words(F.col(text))).alias("w")).agg(F.hll_sketch_agg("w", REGISTERS).alias("words"))
    # one row each: the two aggregates meet by a constant
    return lengths.withColumn("__k", F.lit(1)).join(words.withColumn("__k", F.lit(1)), "__k").drop("__k").select(F.lit(batch).alias("batch"), "*")


def merged(sketches: DataFrame) -> DataFrame:
    """One row for all the batches: the exact numbers and the merged sketches; a batch stored twice counts once."""
    once = sketches.dropDuplicates(["batch"])
    return once.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"),
                    F.min(F.when(F.col("n_docs") > 0, F.col("min_words"))).alias("min_words"), F.max("max_words").alias("max_words"),
                    F.kll_merge_agg_bigint("lengths").alias("lengths"), F.hll_union_agg("words").alias("words"))


def statistics(sketch: DataFrame, quantiles=(0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """n_docs, average, least and most words, quantiles of the word counts (q25, ...) and distinct words, of a merged row."""
    names = [F.when(F.col("n_docs") > 0, F.kll_sketch_get_quantile_bigint("lengths", F.lit(float(q)))).alias(f"q{round(100 * q)}") for q in quantiles]
    return sketch.select("n_docs", F.coalesce(F.try_divide("n_words", "n_docs"), F.lit(0.0)).alias("average_words"),
                         F.coalesce("min_words", F.lit(0)).alias("min_words"), F.coalesce("max_words", F.lit(0)).alias("max_words"),
                         *names, F.hll_sketch_estimate("words").alias("distinct_words"))
