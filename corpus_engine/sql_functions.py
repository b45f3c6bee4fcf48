"""SQL surface: the lambda-free column functions as temporary SQL functions.

Each is registered with ``CREATE TEMPORARY FUNCTION ... RETURN <expression>``, where the
expression is the SQL text of the very Column expression the DataFrame API uses, so SQL
and DataFrame users get the same JVM-side evaluation (no Python).

    register_sql_functions(spark)
    spark.sql("SELECT doc_id, ce_normalize(text), ce_word_count(text) FROM documents")
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpus_engine.functions import files as FI
from corpus_engine.functions import html as H
from corpus_engine.functions import text as T



def _without_lambdas(steps) -> list:
    """SQL functions take no lambdas, so numeric character references stay as they are there."""
    return [s for s in steps if s[0] != "num"]


# name -> (argument list, return type, builder over the argument columns)
SQL_FUNCTIONS = {
    "ce_normalize": ("t STRING", "STRING", lambda: T.normalize_for_comparison(F.col("t"))),
    "ce_word_count": ("t STRING", "BIGINT", lambda: T.word_count(F.col("t"))),
    "ce_strip": ("t STRING", "STRING", lambda: T.strip_ws(F.col("t"))),
    "ce_safe_filename": ("t STRING", "STRING", lambda: T.safe_filename(F.col("t"))),
    "ce_preview": ("t STRING", "STRING", lambda: T.preview(F.col("t"))),
    "ce_relevance": ("d DOUBLE", "DOUBLE", lambda: T.relevance(F.col("d"))),
    "ce_html_to_text": ("t STRING", "STRING", lambda: H.apply_steps("t", _without_lambdas(H.TEXT_STEPS))),
    "ce_html_to_markdown": ("t STRING", "STRING", lambda: H.apply_steps("t", _without_lambdas(H.MARKDOWN_STEPS))),
    "ce_base_name": ("t STRING", "STRING", lambda: FI.base_name(F.col("t"))),
    "ce_extension": ("t STRING", "STRING", lambda: FI.extension(F.col("t"))),
}


def _sql_text(spark: SparkSession, args: str, build) -> str:
    probe = spark.createDataFrame([], args)  # the argument list doubles as a DDL schema
    analyzed = probe.select(build().alias("__o"))._jdf.queryExecution().analyzed()
    return analyzed.expressions().apply(0).child().sql()


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary SQL functions; returns their names."""
    for name, (args, ret, build) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} "
                  f"RETURN {_sql_text(spark, args, build)}")
    return list(SQL_FUNCTIONS)
