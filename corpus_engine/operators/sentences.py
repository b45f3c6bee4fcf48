"""C6 with learned abbreviations: periods that belong to a word do not end a sentence.

One aggregate over the corpus counts every word type with and without a period after it. A type is an abbreviation if its
period is a collocation (Kiss and Strunk 2006): the log-likelihood ratio of "the period nearly always follows" against "as often as
any word", times a factor for short types, one for inner periods, and a penalty for uses without the period. The learned
types are compiled into the split as a hash set.

A type is letters, with inner single periods ("e.g"); case does not count. Null texts have no words and no sentences. The corpus
must hold ``MIN_COUNT`` uses of a type. A hot type (a third of all words) is counted map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions import text as T

#: Least score of an abbreviation, and least number of uses with a period.
THRESHOLD, MIN_COUNT = 0.3, 2
#: Chance of a period after an abbreviation.
SURE = 0.99
_TYPE = r"^[\"'(\[{\p{Pi}]*(\p{L}+(?:\.\p{L}+)*)(\.?)[\"')\]}\p{Pf},;:!?]*$"
#: Sentence end like functions.text.SENTENCE_END; the white space stays before the mark.
_MARK = "\ue000"  # private-use code point
_BREAK = r"([.!?]+[\"')\]]*" + T.WS + "+)"
#: The last word of a piece that ends in a single period.
_LAST = r"(?:^|" + T.WS + r")[\"'(\[{\p{Pi}]*(\p{L}+(?:\.\p{L}+)*)\.[\"')\]]*" + T.WS + "*$"


def period_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n_period and n_plain: uses of every type with and without a period after it.

    Words are counted as they stand before they are typed, so the patterns run once a spelling and not once a use."""
    words = docs.select(F.explode(T.words(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    typed = words.select(F.lower(F.regexp_extract("w", _TYPE, 1)).alias("word"), (F.regexp_extract("w", _TYPE, 2) == ".").alias("p"), "n").where("word <> ''")
    return typed.groupBy("word").agg(F.sum(F.when(F.col("p"), F.col("n")).otherwise(0)).alias("n_period"),
                                     F.sum(F.when(~F.col("p"), F.col("n")).otherwise(0)).alias("n_plain"))


def _likelihood(hits: Column, misses: Column, p: Column) -> Column:
    return hits * F.log(p) + misses * F.log(F.lit(1.0) - p)


def score(n_period: Column, n_plain: Column, share: Column, word: Column) -> Column:
    """The abbreviation score of a type, where ``share`` is the share of uses of all types with a period."""
    ratio = F.lit(-2.0) * (_likelihood(n_period, n_plain, share) - _likelihood(n_period, n_plain, F.lit(SURE)))
    inner = F.length(word) - F.length(F.replace(word, F.lit("."), F.lit("")))
    letters = (F.length(word) - inner).cast("double")
    return ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -n_plain.cast("double"))


def learn_abbreviations(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n_period, n_plain and score (rounded to 6 decimals) of the corpus's abbreviations.

    The share of periods is one row over the same counts, whose shuffle both read: the corpus is read once."""
    counts = period_counts(docs, text)
    total = counts.agg((F.sum("n_period") / F.sum(F.col("n_period") + F.col("n_plain"))).alias("share"))
    some = counts.crossJoin(F.broadcast(total.where("share > 0 AND share < 1")))  # no row if there is no period at all, or nothing else
    s = F.round(score(F.col("n_period"), F.col("n_plain"), F.col("share"), F.col("word")), 6)
    return some.withColumn("score", s).drop("share").where((F.col("score") >= threshold) & (F.col("n_period") >= min_count))


def sentences(text: str | Column, abbreviations: list[str]) -> Column:
    """Sentences of a text, stripped, no empty ones. A period after one of the ``abbreviations`` (lower-cased types) or a single
    letter ends none, unless a line ends there too."""
    c = F.col(text) if isinstance(text, str) else text
    pieces = F.split(F.regexp_replace(c, _BREAK, "$1" + _MARK), _MARK, -1)

    def goes_on(piece):
        last = F.lower(F.regexp_extract(piece, _LAST, 1))
        known = last.isin(sorted(abbreviations)) if abbreviations else F.lit(False)
        return (known | last.rlike(r"^\p{L}$")) & ~piece.rlike(r"\n[\t \x0b\f\r]*$")

    def bound(value, use):
        """``use`` of a value that is computed once, as a lambda's variable."""
        return F.transform(F.array(value), use)[0]

    def starts(flags):
        return F.filter(F.sequence(F.lit(0), F.size(flags) - 1), lambda i: (i == 0) | ~F.get(flags, i - 1))

    def joined(x):
        return F.transform(x["s"], lambda s, k: T.strip_ws(F.array_join(
            F.slice(x["p"], s + 1, F.coalesce(F.get(x["s"], k + 1), F.size(x["p"])) - s), "")))

    flagged = bound(pieces, lambda p: F.struct(p.alias("p"), F.transform(p, goes_on).alias("f")))
    whole = bound(bound(flagged, lambda x: F.struct(x["p"].alias("p"), starts(x["f"]).alias("s"))), joined)
    return F.filter(whole, lambda s: s != "")


def split_sentences(docs: DataFrame, abbreviations: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, sentence_index and sentence; ``abbreviations`` is what :func:`learn_abbreviations` gave.

    The learned words come to the driver, since they become part of the expression: types pass the score, not documents."""
    known = [r["word"] for r in abbreviations.select("word").collect()]
    # outer: a plain explode infers a filter on the array, which would split every text twice
    return docs.select(key, F.posexplode_outer(sentences(text, known)).alias("sentence_index", "sentence")).where("sentence IS NOT NULL")
