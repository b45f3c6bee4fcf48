"""User model hooks: batch embedder (U2) and NER annotator (U3) run on Arrow batches."""

import numpy as np
import pytest

from corpus_engine.operators import embed as E
from corpus_engine.operators import entities as EN
from corpus_engine.operators import retrieve as R


def test_pandas_embedder(spark):
    def factory():  # built once per worker; pickled by value from here
        import numpy as np

        def encode(texts):
            return np.array([[len(t), t.count("a"), t.count(" "), 1.0] for t in texts], dtype=np.float32)
        return encode

    emb = E.PandasEmbedder(factory, dim=4, name="counts")
    df = spark.createDataFrame([(1, "a banana"), (2, "xyz"), (3, None)], "id long, text string")
    got = {r["id"]: list(r["embedding"]) for r in emb.embed(df).collect()}
    assert got == {1: [8.0, 4.0, 1.0, 1.0], 2: [3.0, 0.0, 0.0, 1.0], 3: [0.0, 0.0, 0.0, 1.0]}
    # the vectors feed retrieval like any other embedding column
    q = spark.createDataFrame([(9, [8.0, 4.0, 1.0, 1.0])], "query_id long, embedding array<float>")
    top = R.knn_exact(emb.embed(df), q, 1, carry=()).first()
    assert top["id"] == 1 and top["distance"] == 0.0


def test_pandas_embedder_checks_dimension(spark):
    def factory():
        import numpy as np
        return lambda texts: np.zeros((len(texts), 3), dtype=np.float32)

    df = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(Exception):
        E.PandasEmbedder(factory, dim=4).embed(df).collect()


def test_annotate_with_model_then_remove(spark):
    def factory():
        def ner(texts):
            return [[{"word": w, "entity": "B-LOC"} for w in t.split() if w.startswith("loc")] for t in texts]
        return ner

    docs = spark.createDataFrame([("k1", "in locparis and locrome"), ("k2", "nothing")], "doc_id string, text string")
    ents = EN.annotate_with_model(docs, factory)
    assert sorted(map(tuple, ents.collect())) == [("k1", "locparis", "B-LOC"), ("k1", "locrome", "B-LOC")]
    cleaned = dict(map(tuple, EN.remove_entities(docs, ents).collect()))
    assert cleaned == {"k1": "in  and ", "k2": "nothing"}


def test_semantic_chunking_with_a_model(spark):
    from corpus_engine.operators import chunk as C

    def factory():
        import numpy as np

        def encode(texts):  # a non-linear toy model: letter presence, normalised
            out = np.array([[1.0 if ch in t.lower() else 0.0 for ch in "abcdefghij"] for t in texts])
            n = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return np.where(n > 0, out / np.where(n > 0, n, 1), 0.0)
        return encode

    emb = E.PandasEmbedder(factory, dim=10)
    text = "Abc abc. Abd cab! Hij ghi. Jig hig. Abc."
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    got = [r["text"] for r in C.chunk_semantic(df, embedder=emb, threshold=0.6).orderBy("chunk_index").collect()]
    enc = factory()

    def brute(sentences, thr):
        groups = [[sentences[0]]]
        for s in sentences[1:]:
            a, b = enc([" ".join(groups[-1])])[0], enc([s])[0]
            den = np.sqrt(a @ a) * np.sqrt(b @ b)
            if den > 0 and a @ b / den > thr:
                groups[-1].append(s)
            else:
                groups.append([s])
        return [" ".join(g) for g in groups]

    assert got == brute(["Abc abc.", "Abd cab!", "Hij ghi.", "Jig hig.", "Abc."], 0.6)
