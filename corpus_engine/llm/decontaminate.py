"""Benchmark decontamination by template windows.

Texts are canonicalised to templates: numbers, names (capitalised words inside a sentence) and
units become the typed placeholders below, other words are lower-cased and lose their outer
punctuation; scripts written without spaces are cut into characters. Windows of ``WINDOW`` template words
are hash-joined between the benchmark and all documents. Windows of fewer than ``LITERALS`` literal words
meet by their values instead, verbatim. A hit's slots (the values behind placeholders) go along; on one
alignment of a document with an item, the share ``CONSISTENT`` of the slots in a run of windows must follow a one-to-one
map, else the run's clashing windows do not count. So a question asked again with other numbers or names is
caught, while windows that only share a frame with clashing values are not.

Work per document is linear in its words. Benchmark windows are sent to the tasks in blocks of
a fixed number of windows, whatever the size of the benchmark, and filter the windows there;
only hits are shuffled, keyed by window hash and then by (document, item, alignment), which
spreads a document or an item that a third of all rows share.

A document is contaminated by an item when the union of aligned windows covers ``COVERAGE`` of the
item's words, or ``LONG_RUN`` words of it. An item of fewer than ``WINDOW`` words is one window, which
documents meet verbatim: they send windows of the lengths that such items have, too.

Null or empty texts, of documents or items, have no windows and never match. Rows that share a
doc_id are one document, whose windows are taken together; rows that share an item_id are
items of their own, reported under that item_id once. Empty tables give an empty result.
Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import UNSEGMENTED, UNSEGMENTED_MARKS, in_blocks, shipped, written

WINDOW = 8
COVERAGE = 0.6
LONG_RUN = 24
#: Benchmark windows sent to the tasks at once (16 bytes each).
BLOCK = 1 << 20
#: A window of fewer literal words meets by its values, verbatim.
LITERALS = 4
#: Share of a run's slots that must follow the one-to-one map.
CONSISTENT = 0.5

#: Placeholders and units (fixed values).
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
UNITS = frozenset((
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "ton", "tons", "ounce", "ounces", "pound", "pounds", "ml", "l", "liter", "liters", "litre",
    "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month",
    "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "%", "km/h", "mph",
))
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,/:]*%?$")
_EDGE = ".,;:!?\"'()[]{}<>*#&|$"
_UNSEGMENTED = re.compile(f"[{UNSEGMENTED}]")
_PIECES = re.compile(f"[{UNSEGMENTED}]|[^{UNSEGMENTED}{UNSEGMENTED_MARKS}]+")


def _split(text: str) -> Iterator[str]:
    """The words between ASCII white space; scripts written without spaces are cut into characters."""
    whole = _UNSEGMENTED.search(text) is None
    for raw in text.encode().split():
        raw = raw.decode("utf-8")
        if whole or _UNSEGMENTED.search(raw) is None:
            yield raw
        else:
            yield from _PIECES.findall(raw)


def template(text: str) -> tuple[list[str], list[str]]:
    """Template words of a text and the value behind each (its lower-cased word)."""
    out, values = [], []
    start = True
    for raw in _split(text):
        word = raw.strip(_EDGE)
        low = word.lower()
        if not word:
            start = start or raw[-1] in ".!?"
            continue
        if word[0].isdigit() or (len(word) > 1 and word[0] in "+-$€£" and word[1].isdigit()):
            out.append(NUMBER if _NUMBER.match(word) else low)
        elif low in UNITS and out and out[-1] == NUMBER:
            out.append(UNIT)
        elif not start and word[0].isupper() and not word.isupper():
            out.append(NAME)
        else:
            out.append(low)
        values.append(low)
        start = raw[-1] in ".!?:"
    return out, values


_SLOTS = frozenset((NUMBER, NAME, UNIT))
#: Set into the hashes of verbatim windows, which never meet template windows.
_VERBATIM = np.uint64(0xA5A5F00DC0FFEE11)


def _word_hashes(words: list[str]) -> np.ndarray:
    cache: dict[str, int] = {}
    for w in words:
        if w not in cache:
            cache[w] = xxhash.xxh64_intdigest(w)
    return np.array([cache[w] for w in words], np.uint64)


def windows(hashes: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """64-bit hashes of the windows of ``size`` words, given the words' hashes (none for a shorter text)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size)


def _full(words: list[str], values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``WINDOW`` words, and which of them are verbatim ones: those with
    fewer than ``LITERALS`` literal words meet by their values."""
    hs = windows(_word_hashes(words))
    if not len(hs):
        return hs, np.zeros(0, bool)
    literal = np.concatenate(([0], np.cumsum([w not in _SLOTS for w in words])))
    exact = literal[WINDOW:] - literal[:-WINDOW] < LITERALS
    if exact.any():
        hs = np.where(exact, windows(_word_hashes(values)) ^ _VERBATIM, hs)
    return hs, exact


_HITS = pa.schema([("key", pa.int64()), ("hash", pa.int64()), ("pos", pa.int32()), ("words", pa.int32()),
                   ("exact", pa.bool_()), ("slots", pa.list_(pa.string())), ("places", pa.list_(pa.int32()))])


def _emit(wanted: np.ndarray | None, shorts: tuple[int, ...] = ()):
    """Batches of (key, text) to window rows. Without ``wanted`` the texts are items, and one of fewer
    than ``WINDOW`` words is one verbatim window; otherwise they are documents, whose windows in sorted
    ``wanted`` are given, those of the lengths ``shorts`` at their first place only."""
    def found(hs):
        at = np.searchsorted(wanted, hs)
        at[at == len(wanted)] = 0
        return np.flatnonzero(wanted[at] == hs) if len(hs) else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in _HITS]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws, values = template(text or "")
                hs, exact = _full(ws, values)
                signed = hs.view(np.int64)
                for p in range(len(hs)) if wanted is None else found(hs):
                    places = [] if exact[p] else [i for i in range(p, p + WINDOW) if ws[i] in _SLOTS]
                    for col, v in zip(cols, (key, int(signed[p]), int(p), len(ws), bool(exact[p]), [values[i] for i in places],
                                             [i - p for i in places]), strict=True):
                        col.append(v)
                lengths = shorts if wanted is not None else (len(ws),) if 0 < len(ws) < WINDOW else ()
                hv = _word_hashes(values) if lengths else None
                for n in lengths:
                    hs = windows(hv, n) ^ _VERBATIM
                    signed = hs.view(np.int64)
                    seen = set()
                    for p in range(len(hs)) if wanted is None else found(hs):
                        if signed[p] in seen:
                            continue
                        seen.add(signed[p])
                        for col, v in zip(cols, (key, int(signed[p]), int(p), len(ws), True, [], []), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _HITS, strict=True)], schema=_HITS)
    return run


_TYPES = "key long, hash long, pos int, words int, exact boolean, slots array<string>, places array<int>"


def template_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item, dpos, ipos, n_item (words of the item), the item's slot places in the window and
    the slot values of both sides for every shared window."""
    spark = shipped(docs.sparkSession)
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    # rows that share an item_id stay items of their own: an item is its id and its text
    items = items.select(F.xxhash64("item_id", "text").alias("key"), "text", "item_id").dropDuplicates(["key"])
    items = written(items, "bench-items")
    bench = written(items.select("key", "text").mapInArrow(_emit(None), _TYPES), "bench-windows")
    shorts = tuple(sorted(n for (n,) in bench.where(F.col("words") < WINDOW).select("words").distinct().collect()))
    sides = []
    for block in in_blocks(bench.select("hash").distinct(), ["hash"], BLOCK):
        wanted = np.sort(np.array([h for (h,) in block], np.int64).view(np.uint64))
        sides.append(docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(_emit(wanted, shorts), _TYPES))
    if not sides:
        sides.append(spark.createDataFrame([], _TYPES))
    hits = sides[0]
    for s in sides[1:]:
        hits = hits.unionByName(s)
    b = bench.select("hash", F.col("key").alias("item"), F.col("pos").alias("ipos"), F.col("words").alias("n_item"),
                     "places", F.col("slots").alias("islots"))
    d = hits.select("hash", F.col("key").alias("doc_id"), F.col("pos").alias("dpos"), F.col("slots").alias("dslots"))
    return d.join(b, "hash").join(items.select(F.col("key").alias("item"), "item_id"), "item")


def _one_to_one(pairs: set[tuple[int, str, str]]) -> set[tuple[str, str]]:
    """The (item value, document value) pairs of a one-to-one map, the most frequent first."""
    counts = Counter((i, d) for _, i, d in pairs)
    left, right, out = set(), set(), set()
    for i, d in sorted(counts, key=lambda p: (-counts[p], p[0] != p[1], p)):
        if i not in left and d not in right:
            left.add(i)
            right.add(d)
            out.add((i, d))
    return out


def consistent(hits: list[dict]) -> tuple[list[int], bool]:
    """The item positions of one alignment's windows that count, and whether their slot values differ.

    A run of overlapping or adjoining windows counts whole if the share ``CONSISTENT`` of its slots follow the
    alignment's one-to-one map; of other runs, the windows that hold a clashing slot are dropped."""
    slots = [(h["ipos"], {(h["ipos"] + p, i, d) for p, i, d in zip(h["places"], h["islots"], h["dslots"], strict=True)}) for h in hits]
    slots.sort(key=lambda s: s[0])
    held = _one_to_one(set().union(*(s for _, s in slots)))
    at, reworded, run = [], False, []
    for k, (pos, own) in enumerate(slots):
        run.append((pos, own))
        if k + 1 < len(slots) and slots[k + 1][0] <= pos + WINDOW:
            continue
        every = set().union(*(s for _, s in run))
        whole = sum((i, d) in held for _, i, d in every) >= CONSISTENT * len(every)
        for p, s in run:
            if whole or all((i, d) in held for _, i, d in s):
                at.append(p)
                reworded = reworded or any(i != d for _, i, d in s)
        run = []
    return sorted(set(at)), reworded


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE,
                 long_run: int = LONG_RUN) -> DataFrame:
    """One row per contaminated (doc_id, item_id): the covered words of the item, its words, and
    ``reworded``, whether slot values differ from the benchmark's."""
    hits = template_hits(docs, benchmark).withColumn("shift", F.col("dpos") - F.col("ipos"))
    kinds = dict(hits.dtypes)
    keys = ["doc_id", "item_id", "item", "n_item"]
    # an alignment holds at most one window per item position, so these sets are bounded by the item
    lines = hits.groupBy(*keys, "shift").agg(F.collect_set(F.struct("ipos", "places", "islots", "dslots")).alias("hits"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [consistent(h) for h in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], pa.array([a for a, _ in out], pa.list_(pa.int32())),
                                              pa.array([r for _, r in out], pa.bool_())], [*keys, "at", "reworded"])

    lines = lines.select(*keys, "hits").mapInArrow(
        judge, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", at array<int>, reworded boolean")
    # the alignments of one document and item cover the union of their positions: an insertion
    # splits an alignment in two, and a window that the document repeats covers its words once
    whole = lines.select(*keys, F.explode("at").alias("ipos"), "reworded").groupBy(*keys).agg(
        F.collect_set("ipos").alias("at"), F.max("reworded").alias("reworded"))
    steps = F.array_sort("at")
    nxt = F.concat(F.slice(steps, 2, F.size(steps)), F.array(F.lit(None).cast("int")))
    span = F.least(F.lit(WINDOW), F.col("n_item"))
    covered = F.aggregate(F.zip_with(steps, nxt, lambda a, b: F.least(F.coalesce(b - a, span), span)),
                          F.lit(0), lambda s, x: s + x)
    whole = whole.select(*keys, covered.alias("covered"), "reworded")
    bad = whole.where((F.col("covered") >= F.lit(coverage) * F.col("n_item")) | (F.col("covered") >= long_run))
    return bad.groupBy("doc_id", "item_id").agg(
        F.max("covered").cast("long").alias("covered_words"),
        F.max("n_item").cast("long").alias("item_words"), F.max("reworded").alias("reworded"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept.

    Rows are judged by their text: a null doc_id saves no copy, and a clean text stays under an id that a
    contaminated one shares. Rows of one text are judged alike."""
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    bad = written(contaminated(by_text, benchmark, **options).select(F.col("doc_id").alias("_bad_text")).distinct(), "contaminated")
    return docs.join(bad, F.xxhash64(docs["text"]) == bad["_bad_text"], "left_anti")
