"""Web pages to text and Markdown by one pass over the tags.

A tokeniser walks the page once: each character is looked at a bounded number of times, also where quotes, comments
or tags never end. A stack of open elements, with a count for every name, tells in constant time whether an end tag
closes anything. The renderer keeps what rules on the page as a string cannot: nested and numbered lists, quotes,
tables, preformatted text, and where bold text, links and items without an end tag end.

Follows browsers where pages are broken: a tag or comment cut off by the end of the page is dropped, attribute values in
quotes may hold ``>``, ``<li>``, ``<tr>`` and ``<td>`` end their open siblings, stray end tags are ignored. White space
is one space outside ``<pre>``. Containers nested deeper than ``DEPTH`` keep the marks of the first ``DEPTH``.
Null pages give ''.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Nested lists and quotes whose marks are written, and nested inline marks.
DEPTH, INLINE_DEPTH = 32, 8
#: Elements whose content is not text of the page, up to their end tag.
RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "iframe", "noembed", "noframes", "xmp")}
#: Elements that begin and end a line.
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul"
).split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~", "code": "`", "kbd": "`", "samp": "`", "tt": "`"}
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*+)")
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+|[=/\"']")
_WHITE = re.compile(r"[ \t\n\r\f\v ]+")
_TICKS = re.compile(r"`+")
TEXT, OPEN, CLOSE = 0, 1, 2


def tokens(html: str) -> Iterator[tuple[int, str, str]]:
    """(TEXT, text, ''), (OPEN, name, attributes) and (CLOSE, name, '') in page order."""
    at, n = 0, len(html)
    while at < n:
        tag = html.find("<", at)
        if tag < 0:
            yield TEXT, unescape(html[at:]), ""
            return
        if tag > at:
            yield TEXT, unescape(html[at:tag]), ""
        if html.startswith("<!--", tag):
            end = html.find("-->", tag + 4)
            if end < 0:
                return
            at = end + 3
            continue
        if html.startswith(("<!", "<?"), tag):
            end = html.find(">", tag)
            if end < 0:
                return
            at = end + 1
            continue
        m = _NAME.match(html, tag)
        if m is None:
            yield TEXT, "<", ""
            at = tag + 1
            continue
        end = _REST.match(html, m.end()).end()
        if end >= n:
            return
        name, at = m[1].lower(), end + 1
        if html[tag + 1] == "/":
            yield CLOSE, name, ""
            continue
        yield OPEN, name, html[m.end():end]
        if name in RAW:
            over = RAW[name].search(html, at)
            if over is None:
                return
            at = over.start()


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name, the first of each."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        if m[1]:
            out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def text_of(html: str | None) -> str:
    """Visible text, one line per block element; preformatted text keeps its lines."""
    out, pre = [], 0
    for kind, what, _ in tokens(html or ""):
        if kind == TEXT:
            out.append(what.replace("\r\n", "\n") if pre else _WHITE.sub(" ", what))
        elif what in BLOCKS or what == "br":
            out.append("\n")
            if what == "pre":
                pre = pre + 1 if kind == OPEN else max(0, pre - 1)
    lines = (_WHITE.sub(" ", x).strip(" ") for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def _ticked(text: str) -> str:
    """Inline code between more backticks than the code has in a row."""
    ticks = "`" * (1 + max((len(m) for m in _TICKS.findall(text)), default=0))
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{ticks}{pad}{text}{pad}{ticks}"


def _target(url: str) -> str:
    url = _WHITE.sub("%20", url.strip())
    return f"<{url}>" if "(" in url or ")" in url else url


class _Container:
    """An open list item or quote: its mark on the first line, and what stands under the mark on later lines."""

    def __init__(self, first: str, rest: str):
        self.first, self.rest, self.used = first, rest, False


class Markdown:
    """Renders the tokens of one page."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[tuple[str, str, list[str]]] = [("", "", [])]  # (element, target, pieces)
        self.open: list[str] = []  # lists, items, quotes, tables, rows, cells
        self.count: Counter[str] = Counter()
        self.boxes: list[_Container] = []
        self.lists: list[tuple[int, int | None]] = []  # (place in open, next number or None)
        self.items: list[int] = []  # places of open items
        self.heading = 0
        self.skip = 0  # inside head
        self.pre = 0
        self.language = ""
        self.tables = 0
        self.rows: list[list[str]] = []
        self.cell = False
        self.last_list = False  # the last line written was in a list

    # inline text

    def say(self, text: str) -> None:
        self.inline[-1][2].append(text if self.pre else _WHITE.sub(" ", text))

    def mark(self, name: str, target: str = "") -> None:
        if len(self.inline) <= INLINE_DEPTH and not self.pre and not any(e == name for e, _, _ in self.inline):
            self.inline.append((name, target, []))

    def unmark(self, name: str) -> None:
        if any(e == name for e, _, _ in self.inline):
            while self._fold() != name:
                pass

    def _fold(self) -> str:
        name, target, pieces = self.inline.pop()
        text = "".join(pieces)
        core = text.strip(" \n")
        if core:
            left, right = text[:len(text) - len(text.lstrip(" \n"))], text[len(text.rstrip(" \n")):]
            if name == "a":
                core = f"[{core}]({_target(target)})" if target else core
            else:
                core = _ticked(core) if MARKS[name] == "`" else MARKS[name] + core + MARKS[name]
            text = left + core + right
        self.inline[-1][2].append(text)
        return name

    def taken(self) -> str:
        """The inline text so far, all marks closed."""
        while len(self.inline) > 1:
            self._fold()
        text = "".join(self.inline[0][2])
        self.inline[0][2].clear()
        return text

    # blocks

    def flush(self) -> None:
        if self.pre:
            return
        text = self.taken()
        if self.cell:
            if text.strip():
                self.rows[-1][-1] += " " + text.strip(" ")
            return
        lines = [re.sub(" +", " ", x).strip(" ") for x in text.split("\n")]
        lines = [x for x in lines if x]
        if lines:
            mark = "#" * self.heading + " " if self.heading else ""
            self.write([mark + " ".join(lines)] if mark else [x + "  " for x in lines[:-1]] + lines[-1:])

    def write(self, lines: list[str]) -> None:
        boxes = self.boxes[:DEPTH]
        fresh = any(not b.used for b in boxes if b.first != b.rest)
        if self.lines and not (fresh and self.last_list and self.lists):
            self.lines.append("".join(b.rest for b in boxes if b.used).rstrip())
        for i, line in enumerate(lines):
            self.lines.append(("".join(b.rest if i or b.used else b.first for b in boxes) + line).rstrip(" ") + ("  " if line.endswith("  ") else ""))
        for b in boxes:
            b.used = True
        self.last_list = bool(self.lists)

    def _closed(self, name: str) -> None:
        """Close the innermost open element, which is a ``name``."""
        self.open.pop()
        self.count[name] -= 1
        if name in ("td", "th"):
            self.flush()
            self.cell = False
        elif name in ("ul", "ol"):
            self.flush()
            self.lists.pop()
        elif name == "li":
            self.flush()
            self.items.pop()
            self.boxes.pop()
        elif name == "blockquote":
            self.flush()
            self.boxes.pop()
        elif name == "table":
            self._table()

    def close(self, name: str) -> None:
        if self.count[name]:
            while True:
                top = self.open[-1]
                self._closed(top)
                if top == name:
                    return

    def push(self, name: str) -> None:
        self.open.append(name)
        self.count[name] += 1

    def _table(self) -> None:
        self.taken()
        rows = [[re.sub(r"\s+", " ", c).strip().replace("|", "\\|") for c in r] for r in self.rows if any(c.strip() for c in r)]
        self.rows, self.cell = [], False
        if rows:
            wide = max(map(len, rows))
            head = rows[0] + [""] * (wide - len(rows[0]))
            self.write(["| " + " | ".join(r) + " |" for r in [head, ["---"] * wide, *rows[1:]]])

    # tags

    def start(self, name: str, attrs: str) -> None:
        if name == "head":
            self.skip = 1
        elif name == "body":
            self.skip = 0
        if self.skip:
            return
        if name == "pre" and not self.cell:
            self.flush()
            self.pre += 1
            self.language = ""
        elif self.pre:
            if name == "br":
                self.say("\n")
            elif name == "code" and not self.language:
                found = re.search(r"\blang(?:uage)?-([\w+#.-]+)", attributes(attrs).get("class", ""))
                self.language = found[1] if found else ""
        elif self.tables:
            self._in_table(name, attrs)
        elif name in ("ul", "ol", "menu", "dir"):
            self.flush()
            start = attributes(attrs).get("start", "") if name == "ol" else ""
            number = (int(start) if re.fullmatch(r"[0-9]{1,9}", start) else 1) if name == "ol" else None
            self.push("ol" if name == "ol" else "ul")
            self.lists.append((len(self.open), number))
        elif name == "li":
            if self.items and self.items[-1] > (self.lists[-1][0] if self.lists else 0):
                self.close("li")
            self.flush()
            number = self.lists[-1][1] if self.lists else None
            mark = "- " if number is None else f"{number}. "
            if number is not None:
                self.lists[-1] = self.lists[-1][0], number + 1
            self.push("li")
            self.items.append(len(self.open))
            self.boxes.append(_Container(mark, " " * len(mark)))
        elif name == "blockquote":
            self.flush()
            self.push("blockquote")
            self.boxes.append(_Container("> ", "> "))
        elif name == "table":
            self.flush()
            self.push("table")
            self.tables = 1
        elif name == "hr":
            self.flush()
            self.write(["---"])
        elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
            self.flush()
            self.heading = int(name[1])
        elif name in BLOCKS:
            self.flush()
        else:
            self._inline_start(name, attrs)

    def _inline_start(self, name: str, attrs: str) -> None:
        if name == "br":
            self.inline[-1][2].append(" " if self.tables or self.heading else "\n")
        elif name == "img":
            a = attributes(attrs)
            if a.get("src"):
                self.say(f"![{_WHITE.sub(' ', a.get('alt', '')).strip()}]({_target(a['src'])})")
        elif name == "a":
            self.unmark("a")
            self.mark("a", attributes(attrs).get("href", ""))
        elif name in MARKS:
            self.mark(name)

    def _in_table(self, name: str, attrs: str) -> None:
        if name == "table":
            self.tables += 1
            self.flush()
        elif self.tables > 1 and name in BLOCKS:
            self.flush()
        elif name == "tr":
            self._end_cell()
            self.rows.append([])
        elif name in ("td", "th"):
            self._end_cell()
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
            self.push("td")
            self.cell = True
        elif name in BLOCKS:
            self.flush()
        else:
            self._inline_start(name, attrs)

    def _end_cell(self) -> None:
        if self.count["td"]:
            self.close("td")
        else:
            self.taken()

    def end(self, name: str) -> None:
        if name == "head":
            self.skip = 0
        if self.skip:
            return
        if self.pre:
            if name == "pre":
                self.pre -= 1
                if not self.pre:
                    self._fence()
        elif self.tables > 1 and (name == "table" or name in BLOCKS):
            self.flush()
            self.tables -= name == "table"
        elif self.tables:
            if name == "table":
                self.tables = 0
                self.close("table")
            elif name in ("td", "th", "tr"):
                self._end_cell()
            elif name in BLOCKS:
                self.flush()
            else:
                self.unmark(name)
        elif name in ("ul", "ol", "menu", "dir", "li", "blockquote"):
            self.flush()
            self.close("ul" if name in ("menu", "dir") else name)
        elif name in BLOCKS:
            self.flush()
            if name[0] == "h" and name[1:].isdigit():
                self.heading = 0
        else:
            self.unmark(name)

    def _fence(self) -> None:
        text = "".join(self.inline[0][2])
        self.inline[0][2].clear()
        lines = text.replace("\r\n", "\n").removeprefix("\n").rstrip().split("\n")
        if any(x.strip() for x in lines):
            ticks = "`" * max(3, 1 + max((len(m) for x in lines for m in _TICKS.findall(x)), default=0))
            self.write([ticks + self.language, *lines, ticks])

    def page(self, html: str) -> str:
        for kind, what, attrs in tokens(html):
            if kind == OPEN:
                self.start(what, attrs)
            elif kind == CLOSE:
                self.end(what)
            elif not self.skip and not (self.tables and not self.cell):
                self.say(what)
        if self.pre:
            self.pre = 0
            self._fence()
        while self.open:
            self._closed(self.open[-1])
        self.flush()
        return "\n".join(self.lines).strip("\n")


def markdown_of(html: str | None) -> str:
    """The page as Markdown."""
    return Markdown().page(html or "")


def page_text(html: str | Column) -> Column:
    """Text of a page by the tag tokeniser."""
    return _text(html if isinstance(html, Column) else F.col(html))


def page_markdown(html: str | Column) -> Column:
    """Markdown of a page by the tag tokeniser."""
    return _markdown(html if isinstance(html, Column) else F.col(html))


@F.pandas_udf(StringType())
def _text(html: pd.Series) -> pd.Series:
    return html.map(text_of, na_action=None).astype(object)


@F.pandas_udf(StringType())
def _markdown(html: pd.Series) -> pd.Series:
    return html.map(markdown_of, na_action=None).astype(object)
