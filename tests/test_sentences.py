"""Learned abbreviations and the sentences they leave whole, against plain Python."""

import math
import re
from collections import Counter

from corpus_engine.operators import sentences as SE

TEXT = ("Dr. Smith met Mr. Jones, e.g. at noon. They met Dr. Brown and Mr. White. He said e.g. this. The noon was late. They left at noon. "
        "We met at noon, at home. Dr. Green left home. Mr. Black left home. It was late. It was e.g. noon. The home was late and noon came at noon.")


def learned(texts):
    counts = {}
    for t in texts:
        for w in (t or "").split():
            m = re.fullmatch(r"[\"'(\[{]*([^\W\d_]+(?:\.[^\W\d_]+)*)(\.?)[\"')\]},;:!?]*", w)
            if m:
                counts.setdefault(m[1].lower(), Counter())[m[2] == "."] += 1
    hits = sum(c[True] for c in counts.values())
    share = hits / sum(sum(c.values()) for c in counts.values())
    out = {}
    for word, c in counts.items():
        k, n = c[True], c[False]
        letters = len(word.replace(".", ""))

        def like(p, k=k, n=n):
            return k * math.log(p) + n * math.log(1 - p)

        s = -2 * (like(share) - like(0.99)) * math.exp(-letters) * (word.count(".") + 1) * letters ** -n
        if s >= SE.THRESHOLD and k >= SE.MIN_COUNT:
            out[word] = (k, n, round(s, 6))
    return out


def cut(text, known):
    out, held = [], ""
    for piece in re.split(r"(?<=\ue000)", re.sub(r"([.!?]+[\"')\]]*\s+)", "\\1\ue000", text)):
        piece = piece.replace("\ue000", "")
        held += piece
        m = re.search(r"(?:^|\s)[\"'(\[{]*([^\W\d_]+(?:\.[^\W\d_]+)*)\.[\"')\]]*\s*$", piece)
        last = m[1].lower() if m else ""
        if (last in known or len(last) == 1) and not re.search(r"\n[\t \x0b\f\r]*$", piece):
            continue
        out.append(held.strip())
        held = ""
    return [s for s in [*out, held.strip()] if s]


def test_learned(spark):
    texts = [TEXT, None, "", TEXT]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["word"]: (r["n_period"], r["n_plain"], r["score"]) for r in SE.learn_abbreviations(df).collect()}
    want = learned(texts)
    assert {"dr", "mr", "e.g"} <= set(got) and not {"noon", "late", "home"} & set(got)
    assert got.keys() == want.keys()
    for word, (k, n, s) in want.items():
        assert got[word][:2] == (k, n) and abs(got[word][2] - s) < 1e-5


def test_sentences(spark):
    rows = [(1, TEXT), (2, None), (3, ""), (4, "No end"), (5, "  By J. Doe. (Dr. Who!) Ends in Dr.\nNext line. "), (6, "a. B. c. d."), (7, "x! " * 3000),
            (8, "Dr. " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = SE.learn_abbreviations(spark.createDataFrame([(1, TEXT)] * 2, "doc_id long, text string"))
    got = {}
    for r in sorted(SE.split_sentences(df, known).collect(), key=lambda r: (r["doc_id"], r["sentence_index"])):
        got.setdefault(r["doc_id"], []).append(r["sentence"])
    words = {r["word"] for r in known.collect()}
    assert got == {i: cut(t, words) for i, t in rows if t}
    assert got[1][0] == "Dr. Smith met Mr. Jones, e.g. at noon."
    assert got[5] == ["By J. Doe.", "(Dr. Who!)", "Ends in Dr.", "Next line."]


def test_corpus_without_periods(spark):
    df = spark.createDataFrame([(1, "no period here"), (2, None)], "doc_id long, text string")
    known = SE.learn_abbreviations(df)
    assert known.collect() == []
    assert [r["sentence"] for r in SE.split_sentences(df, known).collect()] == ["no period here"]
    assert SE.learn_abbreviations(df.where("false")).collect() == []


def test_texts_are_split_once(spark):
    df = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    plan = SE.split_sentences(df, SE.learn_abbreviations(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
