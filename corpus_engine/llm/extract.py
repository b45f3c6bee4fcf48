"""Main text of web pages as the maximum-scoring contiguous run of tokens.

A page is a run of tokens: words score positive, tags negative. The weights are log-odds
counted on labelled pages, those that mark their content with an ``article`` or ``main`` element:
how much likelier a token class is inside the marked content than outside it. A linear scan
(the running sum restarts below zero) finds the best contiguous run. Blocks that the run touches
give the text; subtrees that are never content (menus, forms, notices, adverts, comments, by
element, role, class or id) score nothing and are left out inside the run too. What holds the content is not dropped for
its class, id or role: ``main``, an ``article`` that is not inside another, what holds a ``main``, and what holds most of
the page's words outside links, unless an article apart from it holds a tenth of them.

Every page is one row of a narrow kernel; weights are fitted on a sample of at most about
``SAMPLE`` labelled pages (a documented bound), one number per token class, sent with the tasks.

Null or empty html, and pages without words, give an empty text. Very long pages are read whole, in
linear time. Repeated rows are extracted one by one. An empty table gives an empty result. Only
page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import shipped

#: Labelled pages that the weights are fitted on, about.
SAMPLE = 2000
#: Least and largest size of a weight: words stay positive, tags negative, no class outweighs all others.
LEAST, MOST = 0.01, 3.0

#: Element names by role (fixed values).
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot
thead tr ul""".split())
CELL = frozenset(("td", "th", "br", "wbr"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("""aside button canvas dialog footer form head iframe input menu nav noscript object script select style
svg template textarea title video audio""".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
MARKED = frozenset(("article", "main"))
#: Words in class, id or role that name what is not content.
HINTS = frozenset("""ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist
complementary consent contentinfo cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation
newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended related replies reply
respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets
discussion feedback""".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: A class of these says what a page has or is about, not what the element is.
_STATE = re.compile(r"(?:has|have|no|not|non|with|without|category|tag|format)[-_]")
_HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}


def _dropped(name: str, attrs: str, marked: bool) -> str:
    """Why an element is never content: ``never`` by its kind, ``hint`` by its class, id or role, else empty.
    ``header`` is content inside marked content."""
    if name in NEVER or (name == "header" and not marked):
        return "never"
    if not attrs.strip() or name in ("body", "html"):
        return ""
    why = ""
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return "never"
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return "never"
        if key in ("class", "id", "role") and any(w.lower() in HINTS for token in value.split() if not _STATE.match(token.lower())
                                                  for w in _HINT_WORD.findall(token)):
            why = "hint"
    return why


class _Census:
    """Words outside links of a page, of its hinted elements (by their place), and of articles outside those."""

    def __init__(self):
        self.words = self.clear = 0
        self.held: dict[int, int] = {}
        self.mains: set[int] = set()

    def spared(self) -> frozenset[int]:
        """Places of the hinted elements that hold the content."""
        most = {at for at, n in self.held.items() if n * 2 > self.words and self.clear * 10 < self.words}
        return frozenset(most | self.mains)


def _spared(page: str) -> frozenset[int]:
    """Places of the hinted elements that are not dropped."""
    census = _Census()
    for _ in tokens(page, frozenset(), census):
        pass
    return census.spared() if census.held else frozenset()


def tokens(page: str, spared: frozenset[int] = frozenset(), census: _Census | None = None) -> Iterator[tuple[str, str, int, bool, bool]]:
    """(kind, value, block, marked, linked) in page order; kind is ``tag`` or ``text``.

    ``block`` numbers the block the token lies in. Tags and texts of subtrees that are never
    content come with kind ``drop``. Open elements are kept on a stack; an end tag closes up to its
    start tag, and a new block closes an open paragraph. ``spared`` are places of elements that are not
dropped for a hint; with a ``census`` none is, and words are counted there."""
    stack: list[tuple[str, bool, bool]] = []  # name, dropped here or above, marked here or above
    hinted: list[tuple[int, int, int]] = []  # place, depth on the stack, words before; with a census only
    at = block = links = 0
    end = len(page)

    def state():
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def close(i: int) -> None:
        nonlocal links
        links -= sum(1 for n, _, _ in stack[i:] if n == "a")
        del stack[i:]
        while hinted and hinted[-1][1] >= i:
            place, _, before = hinted.pop()
            census.held[place] = census.words - before

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        m = _TOKEN.match(page, lt) if lt < end else None
        stop = lt if m or lt == end else lt + 1  # a lone < is text
        if stop > at:
            drop, marked = state()
            if census is not None and not drop and not links:
                n = len(page[at:stop].split())
                census.words += n
                if not hinted and any(e == "article" for e, _, _ in stack):
                    census.clear += n
            yield ("drop" if drop else "text"), page[at:stop], block, marked, links > 0
        if m is None:
            at = stop if stop > at else at + 1
            continue
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            drop, marked = state()
            yield ("drop" if drop else "tag"), "/" + name, block, marked, False
            if i >= 0:
                close(i)
            block += name in BLOCK
            if name in CELL:
                yield "text", " ", block, marked, False
            continue
        if name in BLOCK:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), -1)
            if i >= 0:
                close(i)
            block += 1
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            peers = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in peers:
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "tbody", "div") or (name in ("td", "th") and stack[i][0] == "tr"):
                    break
        drop, marked = state()
        why = "" if drop else _dropped(name, m["attrs"], marked)
        if why == "hint" and (name == "main" or lt in spared or (
                name == "article" and not any(e == "article" for e, _, _ in stack))):
            why = ""
        here = drop or why == "never" or (why == "hint" and census is None)
        if census is not None and not here:
            if why == "hint" and name not in VOID and name not in _END and not m["attrs"].endswith("/"):
                hinted.append((lt, len(stack), census.words))
            if name == "main":
                census.mains.update(place for place, _, _ in hinted)
        yield ("drop" if here else "tag"), name, block, marked, False
        if name in CELL:
            yield "text", " ", block, marked, False
        if name in VOID or m["attrs"].endswith("/"):
            continue
        if name in _END:
            e = _END[name].search(page, at)
            at = e.end() if e else end
            continue
        if name == "a":
            links += 1
        stack.append((name, here, marked or (name in MARKED and not here)))
    close(0)


def _classes(page: str):
    """(class, words or 1, block, text or None) per token; classes carry what the weights depend on."""
    run = list(tokens(page, _spared(page)))
    has = any(marked and kind == "text" and value.strip() for kind, value, _, marked, _ in run)
    for kind, value, block, marked, linked in run:
        if kind == "text":
            n = len(value.split())
            where = "in" if marked else "out" if has else "any"
            yield f"word {where}{' link' if linked else ''}", n, block, value, marked
        elif kind == "drop":
            yield ("drop in" if marked else "drop"), 1, block, None, marked
        else:
            yield f"tag {value.lstrip('/')}", 1, block, None, marked


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: Counter = Counter()
        for page in b.column(0).to_pylist():
            rows = list(_classes(page or ""))
            if not any(c == "word in" and n for c, n, *_ in rows):
                continue  # not a labelled page
            for c, n, _, _, marked in rows:
                if c.startswith("drop"):
                    continue  # scores nothing
                name = c.split()[1] if c.startswith("tag") else ""
                counts[(c if not name or name in BLOCK or len(name) <= 10 else "tag other", marked)] += n
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
                                          pa.array([counts[k] for k in keys], pa.int64())], ["class", "inside", "n"])


def fit_weights(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weight per token class from about ``sample`` labelled pages, chosen by a hash of page_id.

    A class that is never seen has its kind's default. At most 512 classes, the most frequent, are kept."""
    shipped(pages.sparkSession)
    every = max(1, pages.count() // sample)
    chosen = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).select("html")
    rows = chosen.mapInArrow(_count, "class string, inside boolean, n long").groupBy("class").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"),
        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outside")).orderBy(
        (F.col("inside") + F.col("outside")).desc(), "class").limit(512).collect()
    total_in = sum(r["inside"] for r in rows) + 1.0
    total_out = sum(r["outside"] for r in rows) + 1.0
    weights = {}
    for r in rows:
        odds = math.log((r["inside"] + 0.5) / total_in) - math.log((r["outside"] + 0.5) / total_out)
        if r["class"] in ("word in", "word in link"):
            weights[r["class"]] = min(MOST, max(LEAST, odds))
        else:
            weights[r["class"]] = max(-MOST, min(-LEAST, odds))
    return weights


#: Weights of classes that no labelled page shows.
DEFAULTS = {"word in": 1.0, "word any": 1.0, "word in link": 0.5, "word any link": -0.5, "word out": -1.0,
            "word out link": -2.0}


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum; (0, 0) if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best run, joined by blank lines."""
    rows = list(_classes(page or ""))
    scores = []
    for c, n, _, _, _ in rows:
        if c.startswith("drop"):
            scores.append(0.0)  # left out anyway: a long menu does not split the run
            continue
        w = weights.get(c)
        if w is None:
            w = DEFAULTS.get(c, -LEAST)
        scores.append(w * n)
    start, end = best_run(scores)
    if start == end:
        return ""
    low, high = rows[start][2], rows[end - 1][2]
    blocks: dict[int, list[str]] = {}
    for c, _, block, value, marked in rows:
        if value is not None and low <= block <= high and not c.startswith("word out"):
            blocks.setdefault(block, []).append(value)
    texts = (" ".join(entities.unescape("".join(parts)).split()) for _, parts in sorted(blocks.items()))
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every page."""
    shipped(pages.sparkSession)
    weights = fit_weights(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page, weights) for page in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(
                [len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
