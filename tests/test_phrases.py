"""Multi-word names: leftmost-longest matches against a brute-force matcher, blocks, tags and removal."""

import random
import re

import pytest

from corpus_engine.operators import phrases as PH

NAMES = [("New York", "LOC"), ("York", "LOC"), ("New York City Hall", "ORG"), ("city hall", "ORG"), ("Hall of Fame", "MISC"), ("fame", "MISC"),
         ("New York", "ORG"), ("", "LOC"), ("--", "LOC"), (None, "LOC"), ("L'Aquila", "LOC"), ("Łódź", "LOC")]


def table(spark, names=NAMES):
    return PH.phrase_table(spark.createDataFrame(names, "name string, label string"), "name")


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(text, names):
    """Try every place, longest phrase first."""
    known = {}
    for name, label in names:
        w = tuple(words(name))
        if w:
            known[w] = min(label, known.get(w, label))
    w, at, out = words(text), 0, []
    while at < len(w):
        for n in range(len(w) - at, 0, -1):
            if tuple(w[at:at + n]) in known:
                out.append((at, n, " ".join(w[at:at + n]), known[tuple(w[at:at + n])]))
                at += n
                break
        else:
            at += 1
    return out


def found(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["n_words"], r["phrase"], r["label"]) for r in df.collect())


def expected(docs, names):
    return sorted((i is None, i or 0, *m) for i, t in docs for m in brute(t, names))


DOCS = [(1, "In New York City Hall of Fame"), (2, "new-york, YORK! New York City"), (3, None), (4, ""), (5, "fame fame"), (5, "fame fame"),
        (None, "L'Aquila and łódź"), (7, "New"), (8, "city hall " * 2000)]


@pytest.mark.parametrize("max_bytes", [PH.MAX_BYTES, 600, 250])
def test_matches(spark, max_bytes):
    """Also where the gazetteer is cut into blocks."""
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert found(PH.match_phrases(df, table(spark), max_bytes=max_bytes)) == expected(DOCS, NAMES)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    names = [(" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))), rng.choice(["X", "Y"])) for _ in range(12)]
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 30)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for max_bytes in (PH.MAX_BYTES, 600):
        assert found(PH.match_phrases(df, table(spark, names), max_bytes=max_bytes)) == expected(docs, names)


def test_no_phrases_and_no_documents(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert PH.match_phrases(df, table(spark, [("", "X")])).collect() == []
    assert PH.match_phrases(df.where("false"), table(spark)).collect() == []


def test_tags_and_removal(spark):
    df = spark.createDataFrame([(1, "In New York City Hall. Newyork, new  york"), (2, "nothing")], "doc_id long, text string")
    matches = PH.match_phrases(df, table(spark))
    tags = sorted((r["word"], r["entity"]) for r in PH.phrase_entities(matches).collect())
    assert tags == [("city", "I-ORG"), ("hall", "I-ORG"), ("new", "B-LOC"), ("new", "B-ORG"), ("york", "I-LOC"), ("york", "I-ORG")]
    left = {r["doc_id"]: r["text"] for r in PH.remove_phrases(df, matches).collect()}
    assert left == {1: "in  city hall. newyork, ", 2: "nothing"}
