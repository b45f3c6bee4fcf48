"""Survey test strategy, remaining items: collision flags, whitelist property, and no
Python node in the plans of the operators that are meant to be pure SQL."""

import re

import pytest

from helpers import SF001
from corpus_engine.plans.queries import QUERIES
from corpus_engine.sources.sinks import with_safe_names

PURE_SQL = ["clean_steps", "clean_text", "clean_isbn", "word_count", "normalize_text", "annotate_entities",
            "remove_entities", "split_sentences", "chunk_fixed", "chunk_sentence", "chunk_words",
            "embed_hash", "cosine_pairs", "vector_distance", "dedup_normalized", "html_to_text",
            "html_to_markdown", "clean_answer", "parse_responses", "compare_answers", "corpus_stats",
            "stage_stats", "stage_counts", "file_info", "validate_extension", "safe_filename",
            "ingest_new_files", "ledger_merge", "upload_chunks", "insert_if_absent",
            "markdown_files", "debug_sample"]
PYTHON_NODES = ("MapInPandas", "MapInArrow", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas",
                "PythonUDF", "pythonUDF")


def test_safe_name_collisions_flagged(spark):
    df = spark.createDataFrame([("a-b.pdf",), ("a_b.pdf",), ("c.pdf",)], "id string")
    got = {r["id"]: (r["safe_name"], r["collision"]) for r in with_safe_names(df).collect()}
    assert got == {"a-b.pdf": ("a_b_pdf.txt", True), "a_b.pdf": ("a_b_pdf.txt", True),
                   "c.pdf": ("c_pdf.txt", False)}


def test_cleaned_text_only_whitelisted_characters(spark):
    allowed = set("abcdefghijklmnopqrstuvwxyz0123456789.,?!:;\"(){}[]<>@#$%^&*_+=/\\|~\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f")
    for r in QUERIES["clean_text"](spark, SF001).collect():
        assert set(r["text"]) <= allowed, r["doc_id"]


@pytest.mark.parametrize("name", PURE_SQL)
def test_pure_sql_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in PYTHON_NODES), name
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_query_has_a_cross_join(spark):
    for name in ("knn_exact", "knn_lsh", "upload_retrieve", "retrieve_dedup", "assemble_context", "fanout_prompts",
                 "retrieve_expanded", "lsh_recall"):
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan), name


def test_scans_are_pruned(spark):
    plan = QUERIES["corpus_stats"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan
    plan = QUERIES["compare_answers"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,assistant)" in plan


def test_dedup_aggregates_ids_not_texts(spark):
    """Texts are neither sorted nor aggregated, and no name is replicated for a join it does not need."""
    plan = QUERIES["dedup_normalized"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_bucketed_collection_is_not_reshuffled(spark):
    import tempfile

    from corpus_engine.operators.ingest import absent_rows
    from corpus_engine.sources.collection import BucketedCollection

    schema = "id string, doc_id string, chunk_index int, text string"
    coll = BucketedCollection(spark, tempfile.mkdtemp(prefix="bucketed-", dir="/tmp") + "/c", 8, schema=schema)
    rows = spark.createDataFrame([(f"d{i}_chunk_0", f"d{i}", 0, "t") for i in range(50)], schema)
    coll.insert_if_absent(rows)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = absent_rows(coll.read(), rows, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    lines = plan.splitlines()
    scan = next(i for i, ln in enumerate(lines) if "Bucketed: true" in ln)
    depth = lambda ln: len(ln) - len(ln.lstrip(" :+-"))
    ancestors, level = [], depth(lines[scan])
    for ln in reversed(lines[:scan]):  # the nearest shallower line is the parent
        if depth(ln) < level:
            ancestors.append(ln)
            level = depth(ln)
            if "SortMergeJoin" in ln:
                break
    assert "SortMergeJoin" in ancestors[-1]
    assert not any("Exchange" in a for a in ancestors)  # only the incoming batch is shuffled


def test_knn_limits_before_its_shuffle(spark):
    plan = QUERIES["knn_exact"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    lines = [ln.strip() for ln in plan.splitlines()]
    exchange = next(i for i, ln in enumerate(lines) if "Exchange hashpartitioning" in ln)
    assert any("WindowGroupLimit" in ln for ln in lines[exchange + 1:])  # partial top-k below it
    assert any("WindowGroupLimit" in ln for ln in lines[:exchange])      # final top-k above it


@pytest.mark.parametrize("name", ["retrieve_dedup", "retrieve_preview", "render_prompt", "fanout_prompts", "request_bodies"])
def test_retrieval_embeds_once(spark, name):
    """The chunks are embedded once and searched once, for the hits and for the fetch of their texts."""
    df = QUERIES[name](spark, SF001)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("MapInArrow", plan)) == 1 and plan.count("md5(") == 1, name


def test_abbreviations_are_learnt_in_one_pass(spark):
    df = QUERIES["learn_abbreviations"](spark, SF001)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1
    # a spelling is counted before it is typed
    lines = plan.splitlines()
    typed = max(i for i, ln in enumerate(lines) if "regexp_extract" in ln)
    assert any("HashAggregate(keys=[w" in ln for ln in lines[typed + 1:])

WRITES_FIRST = {"stream_ingest", "scan_text_files", "scan_binary_files", "stage_reload", "write_report",
                "collection_write", "insert_if_absent", "answer_from_collection", "upload_status", "upload_retrieve",
                "retrieve_expanded", "retrieve_feedback", "collection_compacted", "stream_uploads", "scan_convertible_files", "knn_ivf",
                "ivf_recall", "upload_chunks"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES_FIRST))
def test_query_reads_the_given_tables(spark, name):
    """Every registered query scans the given parquet tables (the ones that write first read
    back data Spark derived from them)."""
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and SF001 in plan, name
    assert "LocalTableScan" not in plan, name
