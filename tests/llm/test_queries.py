"""Registered queries: their columns and types, and DuckDB oracles where SQL can state them."""

import duckdb
import pytest
from corpus_engine.llm.queries import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_arc_to_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op2_template_decontamination": "doc_id bigint, item_id bigint, covered_words bigint, item_words bigint, reworded boolean",
    "op3_span_dedup": "doc_id bigint, n_units int, n_removed int, text_kept string, first_doc_ids array<bigint>",
    "op4_extract_text": "page_id bigint, url string, text string, n_chars bigint",
    "op5_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                         "n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint",
    "op8_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op9_personal_data": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op10_secret_ledger": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op11_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
                            "groups_sha256 string",
    "op12_orchard_clusters": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op13_stream_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
}


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_columns(spark, name):
    df = LLM_QUERIES[name](spark, SF)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(LLM_ORACLES[name])
    want = cursor.fetchall()
    names = [c[0] for c in cursor.description]
    got = LLM_QUERIES[name](spark, SF).select(*names).collect()

    def plain(rows):
        return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)

    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["op5_quality_rules", "op9_personal_data", "op10_secret_ledger", "op13_stream_dedup"])
def test_native_plans_run_no_python(spark, name):
    plan = LLM_QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("MapInPandas", "MapInArrow", "ArrowEvalPython", "BatchEvalPython"))
