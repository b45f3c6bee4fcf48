"""Substring de-duplication by sliding spans of sentences.

A text is cut into units: sentences, and pieces of at most ``PIECE`` words of longer sentences, cut
before the word of least hash in every ``PIECE`` words, so a passage gets the same cuts wherever it stands
and every passage of 50 words that occurs twice holds a whole span. Scripts written without spaces count characters. From every unit a span runs
over ``SPAN_UNITS`` units, further to the first that makes ``SPAN_WORDS`` words. Spans are hashed and
joined globally; the first document (smallest doc_id) that holds a span keeps it, and the first place in
it. Units covered by any non-first span are removed.

Texts are read three times. The first pass counts the bare hashes of all spans, map-side first. The hashes met again set bits in a
bitmap of fixed size, which goes to the tasks; the second pass sends places and owners of the spans whose bit is set
(the repeated ones and a few others), and these are counted and joined exactly. The third pass
rewrites the documents that lose units; only their texts are shuffled. A span that a third of all documents share is counted
map-side and its join is split by Spark's skew join.

Null and empty texts have no spans. Rows with a null doc_id come first in nothing and lose only
what repeats within their own text. Rows that share a doc_id are one document: they do not
count as repeats of each other, and each of their texts loses its own units only. Empty tables give an empty result. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import SPACE_BYTES, UNSEGMENTED, mixed, powers, shipped, word_hashes, word_starts, written_and_released

SPAN_UNITS = 3
SPAN_WORDS = 20
#: Most words of a piece. 4 * PIECE + SPAN_WORDS - 3 words in a row always hold a whole span: up to 2 * PIECE - 2 to the
#: first cut that both copies have, SPAN_WORDS + PIECE - 1 to the end of its span, PIECE to the passage's end.
PIECE = 8
_END = re.compile(rf"[.!?…]+[\"')\]]*(?=\s|$)\s*|[。！？｡؟۔।॥]+[\"')\]”’」』）]*\s*|\n\s*")
#: Words; scripts written without spaces count characters.
_WORD = re.compile(rf"(?:[{UNSEGMENTED}]|[^\s{UNSEGMENTED}]+)\s*")
_UNSEGMENTED = re.compile(f"[{UNSEGMENTED}]")
#: Texts with such characters (scripts without spaces, sentence ends inside a word, white space beyond ASCII's) are cut letter by
#: letter; all others by passes over their bytes.
_SLOW = re.compile(f"[{UNSEGMENTED}。！？｡؟۔।॥\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CLOSERS = np.isin(np.arange(256), list(b"\"')]"))
_STOPS = np.isin(np.arange(256), list(b".!?"))
#: Bits of the bitmap of repeated hashes: 16 MB, whatever their number.
BITMAP_BITS = 27
_PER_BUCKET = 32768


def words(text: str) -> list[str]:
    if _UNSEGMENTED.search(text) is None:
        return text.split()
    return [w.rstrip() for w in _WORD.findall(text)]


def _least(h: np.ndarray) -> np.ndarray:
    """For every ``PIECE`` values in a row the place of the least, the last of equals."""
    rows = np.lib.stride_tricks.sliding_window_view(h, PIECE)[:, ::-1]
    return np.arange(len(rows)) + PIECE - 1 - rows.argmin(axis=1)


def _starts(sentence: list[str]) -> list[int]:
    """Words of a long sentence that start a piece: the least (last of equals) of every ``PIECE`` words after the first."""
    return np.unique(_least(word_hashes(" ".join(sentence).encode())[1:]) + 1).tolist()


def units(text: str) -> list[str]:
    """The pieces of a text, which joined give the text."""
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    out, start = [], 0
    for end in ends:
        sentence = text[start:end]
        start = end
        if not sentence:
            continue
        ws = words(sentence.lower())
        if len(ws) <= PIECE:
            out.append(sentence)
            continue
        places = [m.start() for m in _WORD.finditer(sentence)]
        at = 0
        for k in _starts(ws):
            out.append(sentence[at:places[k]])
            at = places[k]
        out.append(sentence[at:])
    return out


def _cut(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text, and the words at which its units start (units without a word do not count)."""
    lower = text.lower()
    if _SLOW.search(text) is not None:
        of = [w for w in (words(p.lower()) for p in units(text)) if w]
        sizes = np.array([len(w) for w in of], np.int64)
        return word_hashes(" ".join(x for w in of for x in w).encode()), np.cumsum(sizes) - sizes
    raw = lower.encode()
    b = np.frombuffer(raw, np.uint8)
    start = word_starts(b)
    if not len(start):
        return np.zeros(0, np.uint64), start
    h = word_hashes(raw)
    line = np.concatenate([[0], np.cumsum(b == 10)])
    breaks = line[np.append(start[1:], len(b))] > line[start]
    space = SPACE_BYTES[b]
    # the last letter of each word, but for closing brackets and quotes
    last = np.flatnonzero(~space & np.append(space[1:], True))
    while (closing := _CLOSERS[b[last]] & (last > start)).any():
        last = last - closing
    stop = _STOPS[b[last]]
    wide = np.flatnonzero((b[last] == 0xA6) & (last >= start + 2))  # the three bytes of an ellipsis
    stop[wide] |= (b[last[wide] - 1] == 0x80) & (b[last[wide] - 2] == 0xE2)
    opens = np.concatenate([[True], (stop | breaks)[:-1]])
    if len(h) > PIECE:
        # windows that lie in one sentence, behind its first word
        sentence = np.cumsum(opens)
        inside = sentence[PIECE:] == sentence[:-PIECE]
        opens[_least(h[1:])[inside] + 1] = True
    return h, np.flatnonzero(opens)


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First unit, end unit and hash of the spans of a text; units without a word, white space and case do not count."""
    h, starts = _cut(text)
    n = len(starts)
    bounds = np.append(starts, len(h))
    end = np.maximum(np.arange(n) + SPAN_UNITS, np.searchsorted(bounds, starts + SPAN_WORDS))
    first = np.flatnonzero(end <= n)
    end = end[first]
    up, down = powers(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:len(h)], dtype=np.uint64)])
    low, high = bounds[first], bounds[end]
    return first, end, mixed((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64)).view(np.int64)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [spans(t)[2] for t in b.column(0).to_pylist() if t]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["hash"])


def _places(sent):
    """The spans whose hash has its bit set: owner, place, and whether an earlier span of the text has the same hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            rows, cols = [], ([], [], [])
            for i, text in enumerate(b.column(2).to_pylist()):
                if not text:
                    continue
                found = spans(text)
                at = found[2] & ((1 << BITMAP_BITS) - 1)
                keep = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                if len(keep):
                    rows.append(np.full(len(keep), i))
                    for col, x in zip(cols, found, strict=True):
                        col.append(x[keep])
            if rows:
                row, (first, end, h) = np.concatenate(rows), (np.concatenate(c) for c in cols)
                order = np.lexsort((first, h, row))
                same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
                again = np.zeros(len(row), bool)
                again[order[1:][same]] = True
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(h), pa.array(first, pa.int32()),
                                                  pa.array(end, pa.int32()), pa.array(again)], ["doc_id", "body", "hash", "start", "end", "again"])

    return run


def _bitmap(hashes: DataFrame) -> bytes:
    """The bitmap of the low bits of the hashes, at most 2^BITMAP_BITS bits however many hashes there are."""
    at = F.col("hash").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    rows = hashes.groupBy(F.floor(at / _PER_BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(at % _PER_BUCKET).alias("bits")).collect()
    out = bytearray(1 << (BITMAP_BITS - 3))
    for r in rows:
        out[r["bucket"] * (_PER_BUCKET // 8):(r["bucket"] + 1) * (_PER_BUCKET // 8)] = r["bits"]
    return bytes(out)


def _without(text: str, cuts: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the units of the cuts (white space before the first word stays), its units and how many went."""
    if _SLOW.search(text) is not None:
        lead = len(text) - len(text.lstrip())
        pieces = [p.encode() for p in units(text[lead:])]
        head = text[:lead].encode()
    else:
        raw = text.encode()
        at = np.append(word_starts(np.frombuffer(raw, np.uint8))[_cut(text)[1]], len(raw)).tolist()
        pieces = [raw[i:j] for i, j in zip(at, at[1:], strict=False)]
        head = raw[:at[0]]
    dead = {i for start, end in cuts for i in range(start, end)}
    kept = b"".join(p for i, p in enumerate(pieces) if i not in dead)
    return (head + kept).decode(), len(pieces), len(dead)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [_without(text, [(c["start"], c["end"]) for c in cuts])
               for text, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n, _ in out], pa.int32()), pa.array([n for _, _, n in out], pa.int32()),
                                          pa.array([t for t, _, _ in out], pa.string()), b.column(3)],
                                         ["doc_id", "n_units", "n_removed", "text_kept", "first_doc_ids"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, units, removed units, the text left and the documents that keep the removed
    spans, for every document that loses a unit."""
    shipped(docs.sparkSession)
    # unit numbers mean something in one text only: cuts are kept by document and text
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), "text")
    again = docs.select("text").mapInArrow(_hashes, "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(again))
    # written once: both the count of spans and the join back read them
    rows = written_and_released(docs.mapInArrow(_places(sent), "doc_id long, body long, hash long, start int, end int, again boolean"), "spans")
    firsts = rows.groupBy(F.col("hash").alias("h")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                                       F.max("again").alias("inside")).where("first < last OR inside")
    # a table of its own: the join's sides are then plain shuffles, which the skew join splits, or a small side is broadcast
    firsts = written_and_released(firsts, "span-owners")
    cuts = rows.join(firsts, F.col("hash") == F.col("h")).where("again OR doc_id <> first").select(
        "doc_id", "body", "start", "end", "first")
    # spans of one text: bounded by it
    cuts = written_and_released(cuts.groupBy("doc_id", "body").agg(F.collect_set(F.struct("start", "end")).alias("cuts"),
                                                      F.array_sort(F.collect_set("first")).alias("first_doc_ids")), "span-cuts")
    cuts = cuts.select(F.col("doc_id").alias("_doc"), F.col("body").alias("_body"), "cuts", "first_doc_ids")
    hit = docs.join(cuts, (docs["body"] == cuts["_body"]) & docs["doc_id"].eqNullSafe(cuts["_doc"])).select(
        "doc_id", "text", "cuts", "first_doc_ids")
    return hit.mapInArrow(_strip, "doc_id long, n_units int, n_removed int, text_kept string, first_doc_ids array<long>")
