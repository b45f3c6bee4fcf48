"""HTML -> text and HTML -> Markdown as chains of regexp_replace (JVM side).

Extraction of binary document formats is out of scope; raw web pages stand in for
documents. Each conversion is a list of rewrite steps ``(kind, pattern, replacement)``
with kind ``re`` (regex, ``$1`` group references), ``lit`` (literal replace) or ``num`` (numeric
character references, the replacement names the base). Patterns use only constructs shared by Java and RE2 (no lookaround), so the same list also
generates the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose content is never text.
DROP_BLOCKS = (
    ("re", r"(?is)<script[^>]*>.*?</script\s*>", ""),
    ("re", r"(?is)<style[^>]*>.*?</style\s*>", ""),
    ("re", r"(?s)<!--.*?-->", ""),
)
# Numeric references to any code point, then the named ones; &amp; last so "&amp;lt;" stays "&lt;".
DECIMAL, HEXADECIMAL = r"&#[0-9]{1,6};", r"&#[xX][0-9a-fA-F]{1,5};"
ENTITIES = (("num", DECIMAL, "dec"), ("num", HEXADECIMAL, "hex")) + tuple(("lit", e, c) for e, c in (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
))
TIDY = (
    ("re", r"[ \t\r\f]+", " "),
    ("re", r" ?\n ?", "\n"),
)
TRIM = (("re", r"^[ \n]+|[ \n]+$", ""),)

TEXT_STEPS = DROP_BLOCKS + (
    ("re", r"(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|tr|title|article|section|header|footer|nav|ul|ol|table)\s*>", "\n"),
    ("re", r"<[^>]*>", ""),
) + ENTITIES + TIDY + (("re", r"\n{2,}", "\n"),) + TRIM

MARKDOWN_STEPS = DROP_BLOCKS + (("re", r"(?is)<head[^>]*>.*?</head\s*>", ""),) + tuple(
    ("re", rf"(?is)<h{n}[^>]*>(.*?)</h{n}\s*>", "\n\n" + "#" * n + " $1\n\n") for n in range(1, 7)
) + (
    ("re", r"(?is)<a\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a\s*>", "[$2]($1)"),
    ("re", r"(?is)<a\s[^>]*href='([^']*)'[^>]*>(.*?)</a\s*>", "[$2]($1)"),
    ("re", r"(?is)<img\s[^>]*src=[\"']([^\"']*)[\"'][^>]*>", "![]($1)"),
    ("re", r"(?i)</?(?:b|strong)\s*>", "**"),
    ("re", r"(?i)</?(?:em|i)\s*>", "*"),
    ("re", r"(?i)</?code\s*>", "`"),
    ("re", r"(?i)</t[dh]\s*>", " | "),
    ("re", r"(?i)</tr\s*>", "\n"),
    ("re", r"(?i)<li[^>]*>", "\n- "),
    ("re", r"(?i)<br\s*/?>", "\n"),
    ("re", r"(?i)</(?:p|div|ul|ol|nav|article|section|footer|header)\s*>", "\n\n"),
    ("re", r"<[^>]*>", ""),
) + ENTITIES + TIDY + (("re", r"\n{3,}", "\n\n"),) + TRIM


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def apply_steps(c, steps) -> Column:
    out = _col(c)
    for kind, pattern, repl in steps:
        if kind == "re":
            out = F.regexp_replace(out, pattern, repl)
        elif kind == "num":
            out = _decoded(out, pattern, repl)
        else:
            out = F.replace(out, F.lit(pattern), F.lit(repl))
    return out


def _decoded(c: Column, pattern: str, base: str) -> Column:
    """Numeric character references replaced by their characters; impossible ones stay.

    ``c`` is a long chain of steps, so it is bound once as a lambda's variable: each mention of the column
    itself would be one more copy of the chain in the plan."""
    def char(ref):
        digits = F.regexp_extract(ref, r"([0-9a-fA-F]+);", 1)
        point = (F.conv(digits, 16, 10) if base == "hex" else digits).cast("int")
        known = point.between(1, 0xD7FF) | point.between(0xE000, 0xFFFF) | point.between(0x10000, 0xFFFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(ref)

    def decoded(t):
        refs = F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
        return F.when(F.contains(t, F.lit("&#")), F.aggregate(refs, t, lambda x, r: F.replace(x, r, char(r)))).otherwise(t)

    return F.transform(F.array(c), decoded)[0]


def with_text(pages, html: str = "html", out: str = "text"):
    """``pages`` with the column ``out``, the text of each page that has any. A generator makes the text once; a filter
    on a projected column would be pushed below the projection and run the chain again."""
    text = F.filter(F.array(html_to_text(html)), lambda t: t != "")
    return pages.select(*(c for c in pages.columns if c not in (html, out)), F.explode_outer(text).alias(out)).where(F.col(out).isNotNull())


def html_to_text(c) -> Column:
    """Visible text of a page, one line per block element; '' when nothing is left."""
    return apply_steps(c, TEXT_STEPS)


def html_to_markdown(c) -> Column:
    """Structure-keeping conversion: headings, list items, links, bold, paragraphs."""
    return apply_steps(c, MARKDOWN_STEPS)
