"""Cleaning operators over a documents DataFrame (all narrow projections, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULTS
from corpus_engine.functions import text as T


def clean_text(df: DataFrame, text: str = "text", out: str = "text", with_isbn: bool = True,
               min_line_length: int = DEFAULTS.min_line_length) -> DataFrame:
    """Lower, the pattern rules in order, ellipses, line filter.

    Same result as ``functions.text.clean_chain``; each step is its own projection so a
    step with a literal guard (``STEP_GUARDS``) can skip its regex pass on texts that
    cannot match without recomputing the steps before it."""
    tmp = "__clean"
    cur = F.col(tmp)
    df = df.withColumn(tmp, F.lower(F.col(text)))
    for name, pattern in T.CLEAN_STEPS:
        if name == "isbn" and not with_isbn:
            continue
        step = T.remove(cur, pattern)
        if name in T.STEP_GUARDS:
            hit = F.lit(False)
            for literal in T.STEP_GUARDS[name]:
                hit = hit | (F.instr(cur, literal) > 0)
            step = F.when(hit, step).otherwise(cur)
        df = df.withColumn(tmp, step)
    return df.withColumn(out, T.filter_lines(cur, min_line_length)).drop(tmp)


def clean_trace(df: DataFrame, text: str = "text", with_isbn: bool = True) -> DataFrame:
    """Characters removed by each step, summed over the corpus (one row per step).

    Every step's output is a column of one projection; the sums are one global aggregate."""
    steps = [("lower", None)] + [(n, p) for n, p in T.CLEAN_STEPS if with_isbn or n != "isbn"]
    stage = df.select(F.col(text).alias("__s0"))
    for i, (name, pattern) in enumerate(steps):
        prev = F.col(f"__s{i}")
        nxt = F.lower(prev) if pattern is None else T.remove(prev, pattern)
        stage = stage.withColumn(f"__s{i + 1}", nxt)
    n = len(steps)
    stage = stage.withColumn(f"__s{n + 1}", T.filter_lines(F.col(f"__s{n}")))
    names = [s for s, _ in steps] + ["line_filter"]
    removed = [F.sum(F.length(F.col(f"__s{i}")) - F.length(F.col(f"__s{i + 1}"))).alias(f"__r{i}")
               for i in range(len(names))]
    agg = stage.agg(*removed)
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step_order"), F.lit(nm).alias("step"),
                              F.coalesce(F.col(f"__r{i}"), F.lit(0)).cast("bigint").alias("removed_chars"))
                     for i, nm in enumerate(names)])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def debug_sample(df: DataFrame, order_by: str = "doc_id", n: int = DEFAULTS.debug_sample) -> DataFrame:
    """The first n documents in a fixed order (the limit is the feature)."""
    return df.orderBy(order_by).limit(n)
