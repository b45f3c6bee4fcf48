"""Column expressions for text: whitespace, the cleaning rules, normalisation, tokens.

Every function maps Column -> Column and stays inside Spark's JVM expressions
(regexp_replace, btrim, filter/transform), so whole-stage codegen and predicate
pushdown are untouched; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Whitespace -------------------------------------------------------------
# Python's str.split()/str.strip()/\s treat \x1c-\x1f (and, for Unicode text, the
# characters below) as whitespace; Java's and RE2's \s do not. These classes restate
# Python's set in a form legal in both Java and RE2 regexes.
ASCII_WS_CLASS = r"\t\n\x0b\f\r \x1c-\x1f"
UNICODE_WS_CLASS = (ASCII_WS_CLASS
                    + r"\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS = f"[{UNICODE_WS_CLASS}]"
NON_WS = f"[^{UNICODE_WS_CLASS}]"
ASCII_S = f"[{ASCII_WS_CLASS}]"
ASCII_NON_S = f"[^{ASCII_WS_CLASS}]"

# The same sets as plain characters, for btrim (which strips any character of the set).
ASCII_WS_CHARS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f"
UNICODE_WS_CHARS = (ASCII_WS_CHARS + "\x85\xa0\u1680"
                    + "".join(chr(c) for c in range(0x2000, 0x200B))
                    + "\u2028\u2029\u202f\u205f\u3000")

# --- Cleaning rules -----------------------------------------------------------
# The cleaning patterns, in the order they are applied (after lower-casing).
# They are the reference's patterns; the only changes are for the Java dialect:
# \s / \S are spelled as the ASCII whitespace class above (the text is ASCII after the
# first rule, and Java's \s lacks \x1c-\x1f), \d as [0-9], and ^ is escaped inside the
# whitelist class.
NON_ASCII = r"[^\x00-\x7F]+"
ISBN = (r"\b(?:isbn(?:-1[03])?:? )?(?=[-0-9xX ]{13,17})(97[89][- ]?)?"
        r"[0-9]{1,5}[- ]?[0-9]+[- ]?[0-9]+[- ]?[0-9xX]\b")
URL = f"http{ASCII_NON_S}+|www{ASCII_NON_S}+|https{ASCII_NON_S}+"
EMAIL = f"{ASCII_NON_S}+@{ASCII_NON_S}+"
REFERENCE = r"\[[0-9]+\]"
DISALLOWED = r'[^A-Za-z0-9.,?!:;"(){}\[\]<>@#$%\^&*_+=/\\|~' + ASCII_WS_CLASS + "]"
ANCHORS = r"\b(?:vol\.|no\.|fig\.|pp\.|p\.|pg\.|table)" + ASCII_S + r"[0-9]+\b"
ELLIPSIS = r"\.\.\.+"



def _ascii_class(pattern: str) -> str:
    """The ASCII characters a single-character class matches, as a positive class of runs."""
    import re

    chars = [chr(c) for c in range(128) if re.fullmatch(pattern, chr(c))]
    return "[" + "".join(re.escape(ch) if ch.isprintable() else f"\\x{ord(ch):02x}" for ch in chars) + "]+"


# Speed-up with identical output: by the time the whitelist rule runs, the first rule has
# removed every non-ASCII character, so deleting runs of the ASCII characters the
# whitelist rejects (derived from the pattern above) equals deleting each rejected
# character; Java evaluates this small positive class far faster than the negated one.
DISALLOWED_ASCII_RUNS = _ascii_class(DISALLOWED)

# (step name, pattern) in application order; "isbn" has a lookahead that RE2 lacks.
CLEAN_STEPS = (
    ("non_ascii", NON_ASCII),
    ("isbn", ISBN),
    ("url", URL),
    ("email", EMAIL),
    ("reference", REFERENCE),
    ("allowed_chars", DISALLOWED_ASCII_RUNS),
    ("anchors", ANCHORS),
    ("ellipsis", ELLIPSIS),
)
LETTER = "[a-zA-Z]"

# A literal every match of the step contains: when a text holds none of them the regex pass
# is skipped (exact, and several times cheaper than scanning with the regex).
STEP_GUARDS = {
    "url": ("http", "www"),
    "email": ("@",),
    "reference": ("[",),
    "ellipsis": ("...",),
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c, chars: str = UNICODE_WS_CHARS) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of Python's set."""
    return F.btrim(_col(c), F.lit(chars))


def remove(c, pattern: str) -> Column:
    return F.regexp_replace(_col(c), pattern, "")


def filter_lines(c, min_length: int = 5) -> Column:
    """Keep lines (split on \\n only) whose stripped length >= min_length and that hold a
    letter; kept lines are not stripped. (Non-empty and not-all-digits follow from these.)"""
    lines = F.split(_col(c), "\n", -1)
    kept = F.filter(lines, lambda l: (F.length(F.btrim(l, F.lit(ASCII_WS_CHARS))) >= min_length)
                    & l.rlike(LETTER))
    return F.array_join(kept, "\n")


def clean_chain(c, steps=None, min_line_length: int = 5, with_isbn: bool = True) -> Column:
    """lower -> the pattern rules in order -> ellipsis -> line filter."""
    out = F.lower(_col(c))
    for name, pattern in (steps or CLEAN_STEPS):
        if name == "isbn" and not with_isbn:
            continue
        out = remove(out, pattern)
    return filter_lines(out, min_line_length)


def word_count(c) -> Column:
    """``len(text.split())`` with Python's whitespace set: pieces of a split on whitespace
    runs, minus the empty piece a leading and a trailing run leave (a split on the
    positive class is several times faster in Java than matching the negated class)."""
    parts = F.split(_col(c), WS + "+", -1)
    n = F.size(parts)
    lead = F.when(F.element_at(parts, 1) == F.lit(""), 1).otherwise(0)
    trail = F.when((n > 1) & (F.element_at(parts, -1) == F.lit("")), 1).otherwise(0)
    return (n - lead - trail).cast("bigint")


def words(c) -> Column:
    """``text.split()``: whitespace tokens, no empty strings."""
    return F.filter(F.split(_col(c), WS + "+", -1), lambda w: w != F.lit(""))


def normalize_for_comparison(c) -> Column:
    """Keep Unicode letters and numbers only, lower-cased per character.

    The capital sigma is mapped first because whole-string lower-casing is
    context-sensitive for it while per-character lower-casing is not."""
    kept = F.regexp_replace(_col(c), r"[^\p{L}\p{N}]+", "")
    return F.lower(F.translate(kept, "Σ", "σ"))


def normalized_key(c) -> Column:
    """A fixed-size key for the normalised text (SHA-256), cheap to shuffle."""
    return F.sha2(normalize_for_comparison(c), 256)


def preview(c, n: int = 200) -> Column:
    return F.concat(F.substring(_col(c), 1, n), F.lit("..."))


def relevance(distance) -> Column:
    return F.round(F.lit(1.0) - _col(distance), 4)


def safe_filename(c) -> Column:
    """Every character outside [a-zA-Z0-9] becomes '_'; empty names give null."""
    base = F.regexp_replace(_col(c), "[^a-zA-Z0-9]", "_")
    return F.when(base != F.lit(""), F.concat(base, F.lit(".txt")))


def tokens(c) -> Column:
    """Lower-cased runs of letters/numbers (the hash embedder's tokens)."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}]+"), 0)


# Sentence boundary: after [.!?] (plus closing quotes/brackets) followed by whitespace.
_SENT_MARK = "\ue000"  # private-use code point used as a split marker
SENTENCE_END = r"([.!?]+[\"')\]]*)" + WS + "+"


def sentences(c) -> Column:
    """Rule-based sentence split (stand-in for a trained tokenizer); stripped, no empties."""
    marked = F.regexp_replace(_col(c), SENTENCE_END, "$1" + _SENT_MARK)
    parts = F.split(marked, _SENT_MARK, -1)
    stripped = F.transform(parts, lambda s: strip_ws(s))
    return F.filter(stripped, lambda s: s != F.lit(""))
