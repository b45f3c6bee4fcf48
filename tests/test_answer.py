"""Context, prompts, answer cleanup, error cells, status message."""

import pytest
from pyspark.sql import functions as F

from corpus_engine.functions import prompts as P
from corpus_engine.operators import answer as A
from corpus_engine.operators import stats as S


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first()["o"]


def test_clean_answer_edges(spark):
    assert one(spark, P.clean_answer, "a The question is = b The question is = c") == "b"
    echo = ("prompt The question is = users of the system\nCutting Knowledge Date: Dec\n"
            "Today Date: x\nYour Answer = ok  ")
    assert one(spark, P.clean_answer, echo) == "s of the \n ok"
    assert one(spark, P.clean_answer, "User") == "User"


def test_clean_answer_rows(spark):
    cases = {"<|begin_of_text|>system\nhello user\n  today is\nThe question is = x": "x", "nothing to do": "nothing to do",
             "    pad \u3000": "pad", "assistant: Date: none\nkeep me": "keep me"}
    for given, expected in cases.items():
        assert one(spark, P.clean_answer, given) == expected


def test_clean_answer_changes_echoed_prompts(spark):
    """Over prompts that answers repeat, markers, the split and the date lines all take effect."""
    from helpers import SF001
    from corpus_engine.plans.queries import QUERIES
    rows = QUERIES["clean_answer"](spark, SF001).collect()
    assert rows and not any(m in r["answer"] for r in rows for m in P.ANSWER_MARKERS if m.startswith("<|"))
    assert not any(P.QUESTION_SPLIT in r["answer"] or "Today Date" in r["answer"] for r in rows)


def test_context_format(spark):
    hits = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "z")], "query_id int, rank int, text string")
    got = dict(map(tuple, A.assemble_context(hits).collect()))
    assert got == {1: "1. a\n\n2. b", 2: "1. z"}


def test_prompt_is_literal(spark):
    df = spark.createDataFrame([(1, "q $1 \\", "ctx $0")], "query_id int, question string, context string")
    p = A.render_prompt(df).first()["prompt"]
    assert p == P.STANDARD_TEMPLATE.replace("{context}", "ctx $0").replace("{query}", "q $1 \\")


def test_error_cells_and_pivot(spark):
    ans = spark.createDataFrame(
        [(1, "rag", "a", None), (1, "gpt", None, "boom")], "query_id int, model string, answer string, error string")
    row = A.compare_answers(ans).first()
    assert row["rag"] == "a" and row["gpt"] == "An error occurred: boom" and row["claude"] is None
    unc = ans.withColumn("uncaught", F.lit(True))
    assert A.compare_answers(unc).first()["gpt"] == "Error: boom"
    v1 = spark.createDataFrame([(1, "gpt_v1", None, "x")], "query_id int, model string, answer string, error string")
    assert A.compare_answers(v1, models=("gpt_v1",)).first()["gpt_v1"] == "An error occurred while calling GPT API: x"


def test_repeated_answers_are_counted(spark):
    ans = spark.createDataFrame([(1, "rag", "b", None), (1, "rag", "a", None), (1, "gpt", "x", None)],
                                "query_id int, model string, answer string, error string")
    row = A.compare_answers(ans).first()
    assert (row["rag"], row["gpt"], row["other_answers"]) == ("a", "x", 1)


def test_failed_retrieval_fills_the_row(spark):
    ans = spark.createDataFrame([(1, "rag", "a", None), (2, "rag", "b", None)],
                                "query_id int, model string, answer string, error string")
    ctx = spark.createDataFrame([(1, "c1", None), (2, None, "gone")], "query_id int, context string, error string")
    got = {r["query_id"]: r for r in A.compare_answers(ans, ctx).collect()}
    assert (got[1]["context"], got[1]["rag"], got[1]["gpt"]) == ("c1", "a", None)
    assert {got[2][c] for c in ("context", "rag", "enhanced", "gpt", "claude")} == {"An error occurred: gone"}


def test_each_model_has_its_own_body(spark):
    import json

    prompts = spark.createDataFrame([(1, m, "p") for m in P.REQUEST_BODIES], "query_id int, model string, prompt string")
    got = {r["model"]: json.loads(r["body"]) for r in A.request_bodies(prompts).collect()}
    assert got["rag"] == {"inputs": "p"} and got["mistral"]["prompt"] == "p" and got["claude"]["max_tokens"] == 1000
    assert got["gpt"]["messages"][0] == {"role": "system", "content": P.CONTEXT_SYSTEM_PROMPT} and got["gpt"]["max_tokens"] == 500
    with pytest.raises(Exception, match="no request body for model other"):
        A.request_bodies(spark.createDataFrame([(1, "other", "p")], "query_id int, model string, prompt string")).collect()


def test_upload_status(spark):
    df = spark.createDataFrame([(0, 0, 0), (2, 7, 0), (0, 0, 3), (1, 2, 1)], "n long, c long, s long")
    got = [r[0] for r in df.select(S.upload_status(F.col("n"), F.col("c"), F.col("s"))).collect()]
    assert got == ["No new files to process.",
                   "Successfully processed 2 new PDF(s). Added 7 text chunks to the database.",
                   "Skipped 3 previously processed file(s).",
                   "Successfully processed 1 new PDF(s). Added 2 text chunks to the database. "
                   "Skipped 1 previously processed file(s)."]


def test_corpus_stats_empty(spark):
    empty = spark.createDataFrame([], "text string")
    assert tuple(S.corpus_stats(empty).first()) == (0, 0.0, 0, 0)


def test_response_paths(spark):
    df = spark.createDataFrame([('{"choices": []}',), ('{"choices": [{"message": {"content": "hi"}}]}',)], "b string")
    assert [r[0] for r in df.select(P.response_text("b", "chat")).collect()] == ["No content generated.", "hi"]


def test_answer_with_model_isolates_errors(spark):
    def _failing_model():  # defined here so it is pickled by value for the workers
        def generate(prompts):
            if any("boom" in p for p in prompts):
                raise RuntimeError("model failed")
            return [p.upper() for p in prompts]
        return generate

    prompts = spark.createDataFrame([(1, "gpt", "hello"), (2, "gpt", "boom"), (3, "gpt", "ok")],
                                    "query_id int, model string, prompt string").coalesce(1)
    got = sorted(map(tuple, A.answer_with_model(prompts, _failing_model).collect()))
    assert got == [(1, "gpt", "HELLO", None), (2, "gpt", None, "model failed"), (3, "gpt", "OK", None)]


def test_recursive_length_function():
    from corpus_engine.operators.chunk import recursive_split
    by_bytes = recursive_split("éé éé éé", 5, 0, length=lambda s: len(s.encode()))
    assert by_bytes == ["éé", "éé", "éé"]
    assert recursive_split("éé éé éé", 5, 0) == ["éé éé", "éé"]
