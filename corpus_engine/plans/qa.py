"""Question answering over a stored collection: retrieve, assemble, prompt, compare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULTS
from corpus_engine.functions import prompts as P
from corpus_engine.operators import answer as A
from corpus_engine.operators import retrieve as R
from corpus_engine.operators.embed import HashEmbedder


@dataclass
class Answered:
    hits: DataFrame
    contexts: DataFrame
    prompts: DataFrame
    bodies: DataFrame


def answer_questions(collection: DataFrame, questions: DataFrame, embedder=None,
                     k: int = DEFAULTS.top_k_app, factor: int = DEFAULTS.overfetch_factor,
                     models=("rag", "gpt", "claude", "mistral"), expanded: bool = False,
                     collection_path: str | None = None) -> Answered:
    """``questions(query_id, question)`` -> top-k distinct hits, one context per question,
    one prompt per (question, model) and the JSON request bodies for an offline batch call.
    With ``expanded`` the retrieval uses a hypothetical answer (R5). With
    ``collection_path`` the collection's embedder stamp is checked first (E2)."""
    embedder = embedder or HashEmbedder()
    if collection_path is not None:
        from corpus_engine.plans.index_build import check_embedder
        check_embedder(questions.sparkSession, collection_path, embedder)
    q = embedder.embed(questions, "question", "embedding")
    if expanded:
        hits = R.retrieve_expanded(collection, q, embedder, k, factor, query_text="question").drop("question")
    else:
        hits = R.retrieve_dedup(collection, q.select("query_id", "embedding"), k, factor)
    contexts = A.assemble_context(hits)
    qc = questions.join(contexts, "query_id", "left")
    prompts = A.fanout_prompts(qc, models)
    return Answered(hits, contexts, prompts, A.request_bodies(prompts))


def compare(answers: DataFrame, contexts: DataFrame, models=DEFAULTS.models) -> DataFrame:
    """Answers ``(query_id, model, answer, error)`` cleaned and pivoted next to the context."""
    cleaned = answers.withColumn("answer", F.when(F.col("answer").isNotNull(), P.clean_answer("answer")))
    return A.compare_answers(cleaned, contexts, models)
