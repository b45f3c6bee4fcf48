"""End-to-end plans: prepare -> index (twice, idempotent) -> answer."""

import tempfile

from pyspark.sql import functions as F

from helpers import SF001
from corpus_engine.plans.corpus_prep import prepare_corpus
from corpus_engine.plans.index_build import build_index
from corpus_engine.plans.qa import answer_questions, compare
from corpus_engine.sources.tables import table


def test_prepare_index_answer(spark):
    base = tempfile.mkdtemp(prefix="plans-", dir="/tmp")
    papers = table(spark, SF001, "documents").select(F.col("doc_id").alias("id"), "text")
    prep = prepare_corpus(papers, f"{base}/prep")
    counts = prep.counts.first()
    assert counts["num_processed_papers"] == counts["num_cleaned_papers"] == counts["num_saved_papers"] > 0
    assert prep.process_stats.first()["total_papers"] == counts["num_processed_papers"]
    added = build_index(spark, prep.cleaned, f"{base}/collection")
    again = build_index(spark, prep.cleaned, f"{base}/collection")
    collection = spark.read.parquet(f"{base}/collection")
    assert added > 0 and again == 0 and collection.count() == added
    questions = table(spark, SF001, "benchmark").select(F.col("item_id").alias("query_id"),
                                                       F.col("text").alias("question"))
    out = answer_questions(collection, questions, collection_path=f"{base}/collection")
    import pytest
    from corpus_engine.operators.embed import HashEmbedder
    with pytest.raises(ValueError):
        answer_questions(collection, questions, HashEmbedder(32), collection_path=f"{base}/collection")
    n_q = questions.count()
    assert out.contexts.count() == n_q
    assert out.prompts.count() == 4 * n_q
    assert out.hits.groupBy("query_id").count().filter("count > 3").count() == 0
    answers = out.hits.filter("rank = 1").select("query_id", F.lit("rag").alias("model"),
                                                 F.col("text").alias("answer"), F.lit(None).cast("string").alias("error"))
    wide = compare(answers, out.contexts)
    assert wide.count() == n_q and "rag" in wide.columns
