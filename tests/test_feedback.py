"""The feedback model against plain Python, and its retrieval."""

import math
from collections import defaultdict

import pytest

from helpers import SF001
from corpus_engine.operators import feedback as FB
from corpus_engine.operators.embed import HashEmbedder

HITS = [(1, 0.1, "solar panel power, solar"), (1, 0.5, "panel of judges"), (1, 2.0, ""), (2, 0.0, "Wind")]
QUERIES = [(1, "Solar power?"), (2, "wind"), (3, "no hits"), (4, "...")]


def tokens(text):
    return [w for w in "".join(c.lower() if c.isalnum() else " " for c in text).split()]


def models(terms, weight):
    out = {}
    for q, question in QUERIES:
        rm = defaultdict(float)
        for query, d, text in HITS:
            w = tokens(text)
            if query == q:
                for t in w:
                    rm[t] += math.exp(-d) / len(w)
        best = sorted(rm, key=lambda t: (-round(rm[t], 12), t))[:terms]
        total = sum(rm[t] for t in best)
        model = defaultdict(float)
        for t in best:
            model[t] += (1 - weight) * rm[t] / total
        own = tokens(question)
        for t in own:
            model[t] += weight / len(own)
        if model:
            out[q] = dict(model)
    return out


@pytest.mark.parametrize("terms,weight", [(20, 0.5), (2, 0.3), (1, 1.0)])
def test_models(spark, terms, weight):
    hits = spark.createDataFrame(HITS, "query_id long, distance double, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, question string")
    model = FB.expanded_model(queries, FB.relevance_model(hits, terms=terms), weight=weight)
    got = defaultdict(dict)
    for r in model.collect():
        got[r["query_id"]][r["term"]] = r["w"]
    want = models(terms, weight)
    assert got.keys() == want.keys()
    for q in want:
        assert got[q].keys() == want[q].keys()
        assert all(abs(got[q][t] - want[q][t]) < 1e-12 for t in want[q])


def test_vectors_have_length_one_and_any_embedder(spark):
    model = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0), (3, "c", 0.0)], "query_id long, term string, w double")
    e = HashEmbedder(8)
    got = {r["query_id"]: r["embedding"] for r in FB.model_vectors(model, e).collect()}
    one = {r["t"]: r["v"] for r in e.embed(spark.createDataFrame([("a",), ("b",)], "t string"), "t", "v").collect()}
    assert got.keys() == {1, 2} and got[2] == one["a"]
    both = [x + y for x, y in zip(one["a"], one["b"])]
    length = math.sqrt(sum(x * x for x in both))
    assert all(abs(x - y / length) < 1e-6 for x, y in zip(got[1], both))


def test_retrieval_keeps_question_and_answers_every_query(spark):
    e = HashEmbedder(32)
    corpus = e.embed(spark.createDataFrame([(i, t) for i, t in enumerate(["solar panel power", "panel inverter grid", "grid inverter cost", "cat dog"])],
                                           "id long, text string"))
    queries = e.embed(spark.createDataFrame([(1, "solar"), (2, "..."), (3, "cat")], "query_id long, question string"), "question", "embedding")
    got = defaultdict(list)
    for r in FB.retrieve_feedback(corpus, queries, e, k=2, feedback=2).collect():
        got[r["query_id"], r["question"]].append((r["rank"], r["id"]))
    assert set(got) == {(1, "solar"), (2, "..."), (3, "cat")}
    assert sorted(got[1, "solar"]) == [(1, 0), (2, 1)]


def test_expansion_finds_what_the_question_does_not_name(spark):
    """A chunk that shares terms only with the question's first chunk moves up."""
    e = HashEmbedder(64)
    texts = ["solar panel inverter", "inverter panel", "tea cup", "solar solar"] + [f"noise{i} filler{i}" for i in range(20)]
    corpus = e.embed(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    q = e.embed(spark.createDataFrame([(1, "solar")], "query_id long, question string"), "question", "embedding")
    ranks = [r["id"] for r in FB.retrieve_feedback(corpus, q, e, k=3, feedback=2).orderBy("rank").collect()]
    assert set(ranks) == {0, 1, 3}


def test_registered(spark):
    from corpus_engine.plans.queries import QUERIES as Q

    rows = Q["retrieve_feedback"](spark, SF001).collect()
    assert {r["rank"] for r in rows} == {1, 2, 3} and all(r["question"] for r in rows)
