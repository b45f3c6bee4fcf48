"""The pipeline's stages one after another, against brute force."""

import brute
import corpus_pipeline
from corpus_engine.llm import quality

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        stages.append(docs)
    for d in stages[:-1]:
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"] for r in stages[0].collect()}
    assert kept == {r["doc_id"] for r in quality.quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    comps = brute.components([(i, given[i]) for i in kept])
    single = {r["doc_id"] for r in stages[1].collect()}
    assert single == {c for _, c in comps.values()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in stages[2].collect()}
    assert clean <= single and not any(b in given[i] for i in clean for b in bench)
    assert len(single - clean) <= sum(any(b[:80] in given[i] for b in bench) for i in single) + 2
    safe = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    assert set(safe) == clean and not any(brute.secrets(t)[4] for t in safe.values())
    assert all(t == given[i] for i, t in safe.items() if not brute.secrets(given[i])[4])
    assert {r["doc_id"]: r["size"] for r in stages[4].collect()} == {i: len(brute.words(t)) for i, t in safe.items()}
