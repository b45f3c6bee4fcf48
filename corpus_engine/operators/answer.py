"""Context assembly, prompts, request/response tables, answer cleanup and comparison.

Remote model calls are not made here: prompts and request bodies are produced as tables
for an offline batch call, and answers come back as a table ``(query_id, model, answer,
error)`` (or the JSON bodies) that these operators clean and compare."""

from __future__ import annotations

import uuid
from typing import Callable, Iterator, Sequence

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULTS
from corpus_engine.functions import prompts as P
from corpus_engine.operators.embed import worker_model


def assemble_context(hits: DataFrame, query_id: str = "query_id", rank: str = "rank",
                     text: str = "text") -> DataFrame:
    """``"1. <text>\\n\\n2. <text>"`` per query, numbered by rank.

    The group per query is at most k rows (the retrieval's limit), so the ordered
    collect_list is bounded."""
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    ctx = F.array_join(F.transform(items, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["t"])),
                       "\n\n")
    return hits.groupBy(query_id).agg(ctx.alias("context"))


def render_prompt(df: DataFrame, template: str = P.STANDARD_TEMPLATE, query: str = "question",
                  context: str = "context", out: str = "prompt") -> DataFrame:
    """Literal template filling."""
    return df.withColumn(out, P.fill(template, query=F.col(query), context=F.col(context)))


def fanout_prompts(df: DataFrame, models: Sequence[str] = ("rag", "gpt", "claude", "mistral"),
                   query_id: str = "query_id", query: str = "question",
                   context: str = "context") -> DataFrame:
    """One prompt per (query, model), each model with its own template.

    A generator (explode of a per-row array) rather than a join with a model table, so the
    fan-out is a narrow projection. Models that do not take context get none."""
    entries = []
    for m in models:
        template, uses_context, _ = P.MODEL_PROMPTS[m]
        ctx = F.col(context) if uses_context else F.lit("")
        entries.append(F.struct(F.lit(m).alias("model"),
                                P.fill(template, query=F.col(query), context=ctx).alias("prompt")))
    return df.select(query_id, F.explode(F.array(*entries)).alias("__p")).select(query_id, "__p.*")


def request_bodies(prompts: DataFrame, query_id: str = "query_id") -> DataFrame:
    """P5: JSON request bodies, one builder per model. A prompt of a model without a builder
    fails the query with the model's name."""
    body = F.raise_error(F.concat(F.lit("no request body for model "), F.coalesce("model", F.lit("null"))))
    for model, build in P.REQUEST_BODIES.items():
        body = F.when(F.col("model") == model, build("prompt")).otherwise(body)
    return prompts.select(query_id, "model", body.alias("body"))


def parse_responses(bodies: DataFrame, fmt_col: str = "fmt", body: str = "body") -> DataFrame:
    """Extract the generated text from each response body by its format."""
    text = F.when(F.col(fmt_col) == "messages", P.response_text(body, "messages")) \
        .when(F.col(fmt_col) == "completion", P.response_text(body, "completion")) \
        .when(F.col(fmt_col) == "chat", P.response_text(body, "chat"))
    return bodies.withColumn("answer", text)


def clean_answers(df: DataFrame, answer: str = "answer", out: str = "answer") -> DataFrame:
    """P7."""
    return df.withColumn(out, P.clean_answer(F.col(answer)))


def compare_answers(answers: DataFrame, contexts: DataFrame | None = None,
                    models: Sequence[str] = DEFAULTS.models, query_id: str = "query_id") -> DataFrame:
    """One row per query with the context and one column per model.

    A failed call shows ``<error prefix><message>`` in its own cell; the pivot uses a fixed
    model list, so no extra pass discovers the values, and models without an answer stay
    null (left join semantics); if a model answered a query with several texts, the smallest is
    shown and ``other_answers`` counts the others of the row. Rows with ``uncaught = true`` (an exception that escaped the
    caller) show ``Error: <message>`` instead. ``contexts`` (query_id, context, and ``error`` where
    retrieval failed) come first; a failed query shows its message in all its cells."""
    prefix = F.lit("An error occurred: ")
    for m, (_, _, p) in P.MODEL_PROMPTS.items():
        prefix = F.when(F.col("model") == m, F.lit(p)).otherwise(prefix)
    if "uncaught" in answers.columns:
        prefix = F.when(F.col("uncaught"), F.lit(P.UNCAUGHT_PREFIX)).otherwise(prefix)
    cell = F.coalesce(F.col("answer"), F.concat(prefix, F.col("error")))
    known = answers.where(F.col("model").isin(list(models))).withColumn("__cell", cell)
    shown = [F.min(F.when(F.col("model") == m, F.col("__cell"))).alias(m) for m in models]
    # a query has few answers, so the sets are small
    held = F.count_distinct("model", "__cell") - F.count_distinct(F.when(F.col("__cell").isNotNull(), F.col("model")))
    wide = known.groupBy(query_id).agg(*shown, held.alias("other_answers"))
    if contexts is not None:
        wide = contexts.join(wide, query_id, "left")
        if "error" in contexts.columns:
            # retrieval failed: the message fills the context and every answer of the row
            told = F.concat(F.lit("An error occurred: "), F.col("error"))
            for c in ("context", *models):
                wide = wide.withColumn(c, F.coalesce(told, F.col(c)))
            wide = wide.drop("error")
    return wide


def extractive_answers(hits: DataFrame, model: str = "extractive", query_id: str = "query_id") -> DataFrame:
    """U5 offline stand-in: the answer is the top-ranked retrieved text."""
    return hits.filter(F.col("rank") == 1).select(
        query_id, F.lit(model).alias("model"), F.col("text").alias("answer"),
        F.lit(None).cast("string").alias("error"))


def answer_with_model(prompts: DataFrame, factory: Callable, query_id: str = "query_id") -> DataFrame:
    """U5 hook: ``factory()`` returns ``generate(list[str]) -> list[str]``, built once per
    Python worker and applied to Arrow batches of prompts. A failing batch is retried row
    by row so one failure only fills its own ``error`` cell."""
    schema = f"{query_id} {dict(prompts.dtypes)[query_id]}, model string, answer string, error string"
    mark = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = worker_model(factory, mark)
        for pdf in batches:
            prompts_ = pdf["prompt"].fillna("").tolist()
            try:
                answers, errors = list(generate(prompts_)), [None] * len(prompts_)
            except Exception:  # noqa: BLE001  (isolate per row)
                answers, errors = [], []
                for p in prompts_:
                    try:
                        answers.append(generate([p])[0])
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        answers.append(None)
                        errors.append(str(e))
            yield pd.DataFrame({query_id: pdf[query_id], "model": pdf["model"],
                                "answer": answers, "error": errors})

    return prompts.select(query_id, "model", "prompt").mapInPandas(run, schema)
