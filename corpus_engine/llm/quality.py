"""Quality rules: a threshold table compiled into one projection of native expressions.

Every statistic is a built-in expression over one row, so the whole operator is a narrow
projection: no shuffle, no user function, linear in the length of each text.

Null text counts as no text (all statistics 0, rejected by ``n_words``); an empty text the
same. Repeated rows are judged one by one. An empty table gives an empty result. Columns of
the input that are not named here pass through :func:`filter_quality` untouched; the
statistics of :func:`quality_stats` carry their own names and replace nothing in the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "be", "by", "on", "are",
    "this", "at", "from", "a", "an", "or", "not", "have",
    "der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "auf", "ist", "im", "ein", "eine", "nicht",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "qui", "dans", "pour", "par", "sur", "est",
    "el", "los", "las", "y", "una", "por", "con", "para", "se", "del", "al", "su", "no", "lo",
)


@dataclass(frozen=True)
class Rule:
    """Keep a row while ``low <= numerator / denominator <= high`` (a zero denominator passes)."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are per word, per line or per character as named.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.25),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.02, None),
    Rule("upper_per_char", "n_upper", "word_chars", None, 0.5),
    Rule("dup_lines_per_line", "n_dup_lines", "n_lines", None, 0.4),
    Rule("adjacent_repeats_per_word", "n_adjacent_repeats", "n_words", None, 0.3),
    Rule("bullet_lines_per_line", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines_per_line", "n_ellipsis_lines", "n_lines", None, 0.3),
)


#: White space between words, as a regular expression class.
SPACE = r"[ \t\n\x0B\f\r]"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def with_window_hashes(df: DataFrame) -> DataFrame:
    """``df`` with ``hs``, the 64-bit hashes of the 8-word windows of its word array ``ws``.

    Windows grow by doubling: 1, 2, 4, then 8 words. Each step is a projection of its own, so that
    the array of the step before is made once and not repeated where it is used."""
    df = df.withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w)))
    width = 1
    while width < WINDOW:
        left = F.greatest(F.size("hs") - width, F.lit(0))
        df = df.withColumn("hs", F.zip_with(F.slice("hs", 1, left), F.slice("hs", width + 1, left),
                                           lambda a, b: F.xxhash64(a, b)))
        width *= 2
    return df


def covered_words(hs: Column, n: int = WINDOW) -> Column:
    """Words inside the ``n``-word windows whose hash occurs twice or more in ``hs``.

    Sorting (hash, position) pairs puts equal windows side by side; the covered words are summed
    over the sorted positions of repeated windows, so the work is n log n in the number of words."""
    none = F.lit(None).cast("int")
    pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(p: Column) -> Column:
        blank = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), none.alias("i")))
        left = F.concat(blank, F.slice(p, 1, F.size(p) - 1))
        right = F.concat(F.slice(p, 2, F.size(p) - 1), blank)
        seen = F.zip_with(p, left, lambda a, b: F.struct(
            a["h"].alias("h"), a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("d")))
        hit = F.zip_with(seen, right, lambda a, b: F.when(
            a["d"] | F.coalesce(a["h"] == b["h"], F.lit(False)), a["i"]))
        return F.array_sort(F.array_compact(hit))

    def total(pos: Column) -> Column:
        nxt = F.concat(F.slice(pos, 2, F.size(pos)), F.array(none))
        steps = F.zip_with(pos, nxt, lambda a, b: F.least(F.coalesce(b - a, F.lit(n)), F.lit(n)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    return _let(_let(pairs, positions), total)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _left(text: Column, keep: str) -> Column:
    """How many characters of the class ``keep`` a text has."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def quality_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` reduced to doc_id and the statistics of the whole text."""
    size = lambda c: F.size(c).cast("long")
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select("doc_id", t.alias("t"), word_list(t).alias("ws"),
                       F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias("ls"))
    base = with_window_hashes(base)
    stop = sorted({v for w in STOP_WORDS for v in (w, w.capitalize(), w.upper())})
    stats = F.struct(
        size("ws").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        _left(F.col("t"), "#*$%&|<>").alias("n_symbols"),
        (size("ls") - size(F.array_distinct("ls"))).alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hs")) < F.size("hs"), covered_words(F.col("hs"))).otherwise(
            F.lit(0)).cast("long").alias("n_repeat_words"),
        size("ls").alias("n_lines"),
        _left(F.col("t"), "A-Z").alias("n_upper"),
        size(F.filter("ws", lambda w: w.isin(*stop))).alias("n_stop_words"),
        size(F.filter(F.zip_with(F.slice("ws", 2, F.greatest(F.size("ws"), F.lit(1))), F.col("ws"), lambda b, a: b == a),
                      lambda same: same)).alias("n_adjacent_repeats"),
        size(F.filter("ls", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).alias("n_bullet_lines"),
        size(F.filter("ls", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_ellipsis_lines"),
    )
    # one generated row each: filters on the statistics stay above it instead of repeating them
    return base.select("doc_id", F.explode(F.array(stats)).alias("s")).select("doc_id", "s.*")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over the statistics' columns."""
    ok = F.lit(True)
    for r in rules:
        num = F.col(r.numerator).cast("double")
        ratio = num if r.denominator is None else num / F.nullif(F.col(r.denominator).cast("double"), F.lit(0.0))
        if r.low is not None:
            ok = ok & F.coalesce(ratio >= r.low, F.lit(True))
        if r.high is not None:
            ok = ok & F.coalesce(ratio <= r.high, F.lit(True))
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` per row of ``docs``."""
    stats = quality_stats(docs)
    return stats.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules))


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns (repeated names included).

    The row rides along as one struct, so no column of ``docs`` can clash with a statistic."""
    names = docs.columns
    packed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: f"c{i}" for i, n in reversed(list(enumerate(names)))}
    rows = packed.select(F.struct(*packed.columns).alias("doc_id"), F.col(at["text"]).alias("text"))
    kept = quality_rules(rows, rules).where("kept").select("doc_id.*")
    return kept.toDF(*names)
