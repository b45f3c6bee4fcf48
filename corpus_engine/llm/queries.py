"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpus_engine.llm import (
    decontaminate,
    extract,
    jaccard_join,
    mixing,
    orchard,
    pii,
    quality,
    secrets,
    span_dedup,
    stream_dedup,
    token_align,
    token_counts,
    warc,
)
from corpus_engine.llm.common import shipped
from corpus_engine.llm.oracles import LLM_ORACLES
from corpus_engine.sources.tables import table


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC records, converted to WARC and read back."""
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (doc_id, item_id) where a document holds a benchmark item, verbatim or re-parameterised."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose repeated sentence spans, with the text left and who keeps the spans."""
    return span_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op4_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of the threshold table for every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by the low-discrepancy mix."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and what fits the limit."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every document."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, through a new ledger."""
    docs = table(spark, sf_dir, "documents")
    return secrets.report(secrets.scan(docs, secrets.fresh_ledger(docs, "ledger")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of two tokenizers in every document, with corpus-wide pair counts."""
    return token_align.align(table(spark, sf_dir, "documents"))


def op12_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every kept vector after three rounds."""
    return orchard.cluster(table(spark, sf_dir, "embeddings"))


def op13_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays, group size and digest of every document, through a stream with keyed state."""
    return stream_dedup.deduplicate(spark, f"{sf_dir.rstrip('/')}/documents.parquet").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _run(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(shipped(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


LLM_QUERIES = {f.__name__: _run(f) for f in (
    op1_arc_to_warc, op2_template_decontamination, op3_span_dedup, op4_extract_text, op5_quality_rules, op6_mix_sources,
    op7_token_counts, op8_jaccard_join, op9_personal_data, op10_secret_ledger,
    op11_token_alignment, op12_orchard_clusters, op13_stream_dedup)}

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]
