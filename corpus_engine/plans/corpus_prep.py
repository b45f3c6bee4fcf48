"""Corpus preparation: documents -> statistics -> cleaned documents -> statistics -> texts.

The Spark form of the reference's preparation script: every step is a projection over
the documents, the statistics are global aggregates, and the outputs are written as
datasets (never gathered on the driver)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.operators import clean as CL
from corpus_engine.operators import entities as EN
from corpus_engine.operators import stats as S
from corpus_engine.sources import sinks


@dataclass
class Prepared:
    cleaned: DataFrame
    process_stats: DataFrame
    clean_stats: DataFrame
    counts: DataFrame


def prepare_corpus(papers: DataFrame, out_dir: str | None = None, gazetteer: DataFrame | None = None,
                   entities: DataFrame | None = None, id_col: str = "id", text: str = "text") -> Prepared:
    """``papers(id, text)`` -> cleaned papers, with the before/after statistics and the
    stage counters. Empty extractions are dropped first. Entities come from a gazetteer
    (fused, no join) or from an entity table ``(id, word, entity)`` of a NER model. With
    ``out_dir`` the cleaned stage, the report and the texts are written there."""
    papers = papers.filter(F.col(text) != "")
    cleaned = CL.clean_text(papers, text)
    if gazetteer is not None:
        cleaned = EN.remove_gazetteer_entities(cleaned, gazetteer, id_col, text)
    elif entities is not None:
        cleaned = EN.remove_entities(cleaned, entities, id_col, text)
    named = cleaned.withColumn("safe_name", F.regexp_replace(F.col(id_col).cast("string"), "[^a-zA-Z0-9]", "_"))
    saved = named.filter(F.col("safe_name") != "")
    out = Prepared(cleaned, S.corpus_stats(papers, text), S.corpus_stats(cleaned, text),
                   S.stage_counts(papers, cleaned, saved))
    if out_dir:
        sinks.write_stage(cleaned, f"{out_dir}/cleaned")
        cleaned = cleaned.sparkSession.read.parquet(f"{out_dir}/cleaned")  # cut the lineage
        sinks.write_report(cleaned, out.clean_stats, f"{out_dir}/report")
        sinks.write_texts(cleaned.withColumnRenamed(id_col, "id"), f"{out_dir}/texts", "id", text)
        out.cleaned = cleaned
    return out
