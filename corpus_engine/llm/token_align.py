"""Alignment of two tokenizers: which tokens of A and B cover the same bytes, and in how many documents.

Both tokenizers cut the same bytes (a space and the text). Where tokens of both end, the text falls into groups; tokens
whose byte ranges overlap are linked. A pair (A id, B id) counts the documents that hold it linked.

1. Every text is encoded once; token ids are written as two binary columns. Texts are cut at single spaces between
   non-spaces, where neither tokenizer joins anything; each piece's tokens are kept for the worker's later texts.
2. The links of all documents give the distinct pairs, a shuffle of at most one row a pair and task. Pairs of neighbouring A ids
   form shards; each shard gets a minimal perfect hash: bit levels, a key sits at the first level where it is
   alone, and its index is the number of set bits before it.
3. Documents are aligned again from the stored ids: tasks add their documents into dense count vectors indexed by hash, which are
   summed in a tree of bounded fan-in, shard by shard.
4. A second pass aligns the documents once more and looks up the counts. At each index the stored key is held
   against the pair asked for; another key is an error.

The functions, keys and counts of a block of shards go to the tasks: at most ``BLOCK_PAIRS`` pairs (17 bytes each), whatever
the corpus; further blocks are further passes over the stored ids, summed by row. An A id's pairs never
leave their shard (no more than B has ids), so its highest count is known there.

Texts null, empty, or whose joined token bytes differ from space and text (U+2581 in a text reads as a space) have no tokens: zeros,
an empty groups column, and no part in the counts. Very long texts are encoded piece by piece and aligned whole. Rows are
documents: repeated rows and ids count one by one. An empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.llm.common import shipped, written

#: Letters beyond those on whose classes the libraries' Unicode tables cannot differ.
_BEYOND = re.compile("[^\x00-\u024f]")
#: Most pairs of a shard (an A id with more is a shard of its own).
SHARD_PAIRS = 1 << 17
#: Most pairs whose functions, keys and counts the tasks hold at once: about 70 MB.
BLOCK_PAIRS = 1 << 22
#: Count vectors that one task of the tree sums.
FAN_IN = 32
#: Pieces whose tokens a worker keeps from step to step, and their letters in all.
CACHE, CACHE_LETTERS = 1_000_000, 1 << 25
#: Longest piece that is encoded together with others.
LONG = 64
#: Longest piece that goes to the faster encoder.
PLAIN = 4096
#: Letters of the pieces that are encoded in one call.
TOGETHER = 8192
#: Letters of the texts encoded, and tokens aligned, in one step.
LETTERS, STEP = 1 << 20, 1 << 19
#: Distinct pairs that a task gathers before it sends them.
GATHER = 1 << 21
#: Places of a task's table of the pairs it met last.
RECENT = 18


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letter_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return {chr(b) if b in shown else chr(next(hidden)): b for b in range(256)}


class Pair:
    """Both tokenizers, and the tokens of pieces of texts."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letter = _letter_bytes()
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(letter[c] for c in token)
        self.bytes_b = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.most = max(len(self.bytes_a), len(self.bytes_b))
        self.kind = np.uint16 if self.most <= 1 << 16 else np.uint32
        self.plain = _rank_encoder(byte_level, self.bytes_a)
        # a piece that goes on after its first other letter with a space would join what is cut apart here
        self.cuts = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self._forget()
        # decimal numbers before a comma, a bar and a semicolon
        numbers = np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(self.most)], "S8")
        self.numbers, self.digits = numbers.view(np.uint64), np.char.str_len(numbers).astype(np.int64)

    def pieces(self, text: str) -> list[str]:
        """Parts of a text, each without the space before it, that both tokenizers treat apart."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if "" not in parts and list(map(str.strip, parts)) == parts:
            return parts
        out = [parts[0]]
        for before, part in zip(parts, parts[1:], strict=False):
            if before and part and not before[-1].isspace() and not part[0].isspace():
                out.append(part)
            else:
                out[-1] += " " + part
        return out

    def _forget(self) -> None:
        self.known, self.letters = _Numbers(), 0
        self.table_a, self.table_b = _Table(self.kind), _Table(self.kind)
        self.spelled = np.empty(0, bool)

    def _alone(self, part: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """A and B ids of a piece, and whether they spell its bytes."""
        text = " " + part
        if self.plain is not None and len(part) <= PLAIN and max(part, default="") < "ɐ":
            a = self.plain.encode_ordinary(text)
        else:
            a = self.a.encode(text, add_special_tokens=False).ids
        b, raw = self.b.encode(part), text.encode()
        spelled = b"".join([self.bytes_a[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw
        return np.array(a, self.kind), np.array(b, self.kind), spelled

    def _together(self, parts: list[str]) -> bool:
        """Learn pieces without white space at their ends: joined by spaces they are encoded in one call, and their tokens cut
        apart by bytes. False, and nothing learnt, where that is not possible."""
        text = " " + " ".join(parts)
        if not text.isascii() and _BEYOND.search(text):
            return False
        raw = text.encode()
        a = np.array(self.plain.encode_ordinary(text), self.kind)
        b = np.array(self.b.encode(text[1:]), self.kind)
        if b"".join([self.bytes_b[i] for i in b.tolist()]) != raw:
            return False
        letters = np.frombuffer(raw, np.uint8)
        spaces = np.flatnonzero(letters == 32) if text.count(" ") == len(parts) else None
        ends = np.append(spaces[1:], len(raw)) if spaces is not None else np.cumsum([1 + len(p.encode()) for p in parts])
        for ids, size, table in ((a, self.size_a, self.table_a), (b, self.size_b, self.table_b)):
            table.add(ids, np.searchsorted(np.cumsum(size[ids]), ends) + 1)
        return True

    def _learn(self, parts: list[str]) -> None:
        """Add the pieces' tokens to the tables, in order."""
        fine, held, letters = [], [], 0

        def together():
            if held and self._together(held):
                fine.extend([True] * len(held))
            else:
                one_by_one(held)

        def one_by_one(some):
            for p in some:
                a, b, spelled = self._alone(p)
                self.table_a.add(a, np.array([len(a)]))
                self.table_b.add(b, np.array([len(b)]))
                fine.append(spelled)

        for p in parts:
            self.letters += len(p)
            if self.plain is None or not self.cuts or not p or len(p) > LONG or p != p.strip():
                together()
                held, letters = [], 0
                one_by_one([p])
                continue
            held.append(p)
            letters += len(p)
            if letters > TOGETHER:
                together()
                held, letters = [], 0
        together()
        self.table_a.close()
        self.table_b.close()
        self.spelled = np.concatenate([self.spelled, np.array(fine, bool)])

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A and B ids of all texts, one after the other, and how many each has; none where there is no text or the ids do not
        spell it."""
        if len(self.known) > CACHE or self.letters > CACHE_LETTERS:
            self._forget()
        numbers, ends = [], []
        number = self.known.__getitem__
        for t in texts:
            if t:
                numbers.extend(map(number, self.pieces(t)))
            ends.append(len(numbers))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        at, ends = np.array(numbers, np.int64), np.array(ends, np.int64)
        wrong = np.diff(np.concatenate([[0], np.cumsum(~self.spelled[at])])[ends], prepend=0) > 0
        if wrong.any():
            keep = ~np.repeat(wrong, np.diff(ends, prepend=0))
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            at = at[keep]
        (a, n_a), (b, n_b) = self.table_a.rows(at, ends), self.table_b.rows(at, ends)
        return a, b, n_a, n_b

    def groups(self, a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> tuple[list[int], list[str]]:
        """Numbers of groups and SHA-256 of the groups of documents whose tokens follow one another, up to the given ends."""
        end_a, end_b, mark = _marks(a, b, self.size_a, self.size_b)
        last_a, last_b = mark[end_a] == 3, mark[end_b] == 3
        # a group's A tokens stand before its B tokens
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        first_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])
        behind_a = np.flatnonzero(last_a) + 1
        what = np.empty(len(a) + len(b), np.int64)
        what[np.arange(len(a)) + first_b[of_a]] = a + np.where(last_a, self.most, 0)
        what[np.arange(len(b)) + behind_a[of_b]] = b + np.where(last_b, 2 * self.most, 0)
        letters = self.numbers[what].view(np.uint8)
        text = letters[letters != 0].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.digits[what])])[upto_a + upto_b].tolist()
        groups = np.concatenate([[0], np.cumsum(last_a)])[upto_a]
        shas, start = [], 0
        for end in ends:
            shas.append(hashlib.sha256(text[start:end - 1]).hexdigest() if end > start else "")
            start = end
        return np.diff(groups, prepend=0).tolist(), shas


class _Numbers(dict):
    """Numbers of pieces in the order in which they are first asked for; ``new`` lists those not learnt yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        n = self[piece] = len(self)
        return n


class _Table:
    """Rows of ids, one after the other."""

    def __init__(self, kind):
        self.ids, self.starts = np.empty(0, kind), np.zeros(1, np.int64)
        self._ids, self._ends, self._n = [], [], 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Rows that end at ``ends`` of ``ids``; they show after :meth:`close`."""
        self._ids.append(ids)
        self._ends.append(ends + self._n)
        self._n += len(ids)

    def close(self) -> None:
        self.ids = np.concatenate([self.ids, *self._ids])
        self.starts = np.concatenate([self.starts, *self._ends])
        self._ids, self._ends = [], []

    def rows(self, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows ``at``, one after the other, and the number of ids up to each of ``ends``, as differences."""
        first, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        upto = np.cumsum(n)
        place = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(first - (upto - n), n)
        return self.ids[place], np.diff(np.concatenate([[0], upto])[ends], prepend=0)


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def _rank_encoder(path: str, token_bytes: list[bytes]):
    """The faster library for the same vocabulary, where ids are merge ranks; it encodes letters below U+0250, on
    whose classes the libraries' Unicode tables cannot differ."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"].get("merges", [])]
    vocab = model["model"]["vocab"]
    cut = model.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    if not plain or model.get("normalizer") or any(vocab.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)):
        return None
    ranks = {token_bytes[i]: i for i in vocab.values() if i < 256 + len(merges)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a: str, b: str) -> Pair:
    """The worker's tokenizers, with the pieces they know."""
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(tokenizer_file(a), tokenizer_file(b))
    return _PAIRS[a, b]


def encoded(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, the token ids of every document (``a``, ``b``: binary) and ``row``, a number."""
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a, b)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for at, end in _ranges(sizes, LETTERS):
                part = batch.slice(at, end - at)
                ids_a, ids_b, n_a, n_b = both.documents(part.column(1).to_pylist())
                n_groups, shas = both.groups(ids_a, ids_b, np.cumsum(n_a), np.cumsum(n_b))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()),
                     pa.array(shas, pa.string()), _binary(ids_a, n_a), _binary(ids_b, n_b)],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, a binary, b binary").withColumn(
        "row", F.monotonically_increasing_id())


def _ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` in all, one row at least."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield at, end
        at = end


def _marks(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ends of the tokens of both sequences, and for every byte 1 (A ends), 2 (B ends), 3 or 0."""
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    mark = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, np.uint8)
    mark[end_a] = 1
    mark[end_b] |= 2
    return end_a, end_b, mark


def links(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Codes (A id * 2^32 + B id) of all links of two token sequences over the same bytes, in byte order.

    Every stretch between neighbouring token ends belongs to one token of each, and two tokens overlap in one
    stretch: the stretches are the links."""
    _, _, mark = _marks(a, b, size_a, size_b)
    kind = mark[mark != 0]
    in_a, in_b = kind & 1, kind >> 1
    at_a, at_b = np.cumsum(in_a, dtype=np.int32) - in_a, np.cumsum(in_b, dtype=np.int32) - in_b
    return a[at_a].astype(np.int64) << 32 | b[at_b].astype(np.int64)


def _binary(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """A binary column of the ids, ``n`` of them in each row."""
    ends = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(
        pa.binary())


def _ids(column: pa.Array, kind) -> np.ndarray:
    """The ids of all rows of a binary column, one after the other."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(kind) if offsets[-1] > offsets[0] else np.empty(0, kind)


def _steps(batches: Iterator[pa.RecordBatch], both: Pair):
    """(rows, link codes, number of links of each row) in steps of about ``STEP`` tokens; the columns are a, b, n_a, n_b, n_groups
    and others."""
    for batch in batches:
        n_a, n_b, n_groups = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        n = n_a + n_b - n_groups
        for at, end in _ranges(n_a, STEP):
            part = batch.slice(at, end - at)
            yield part, links(_ids(part.column(0), both.kind), _ids(part.column(1), both.kind), both.size_a, both.size_b), n[at:end]


STEP_COLUMNS = ("a", "b", "n_a", "n_b", "n_groups")


class Recent:
    """A table of the pairs met last, by a hash of theirs, with a number for each."""

    def __init__(self):
        self.codes = np.full(1 << RECENT, -1, np.int64)
        self.numbers = np.zeros(1 << RECENT, np.int64)

    def places(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - RECENT)).astype(np.int64)


def distinct_pairs(tokens: DataFrame, a: str, b: str) -> DataFrame:
    """code: the distinct linked pairs of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, held, recent = pair(a, b), np.empty(0, np.int64), Recent()
        for _, codes, _ in _steps(batches, both):
            at = recent.places(codes)
            new = recent.codes[at] != codes
            recent.codes[at[new]] = codes[new]
            held = np.union1d(held, codes[new])
            if len(held) > GATHER:
                yield pa.RecordBatch.from_arrays([pa.array(held)], ["code"])
                held = np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held)], ["code"])

    return tokens.select(*STEP_COLUMNS).mapInArrow(run, "code long").distinct()


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each key, another at each level (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct keys: levels of bits, twice as many as keys left; a key's bit is set where it is alone."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = []
        total = 0
        for bits in levels:
            count = np.cumsum(bits, dtype=np.int64)
            self.before.append(count - bits + total)
            total += int(count[-1]) if len(count) else 0
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            width = 2 * len(left) + 1
            at = (_mixed(left, len(levels)) % np.uint64(width)).astype(np.int64)
            bits = np.bincount(at, minlength=width) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """0..n-1 for known keys; -1 or any index for others."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(todo):
                break
            at = (_mixed(keys[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.before[level][at[hit]]
            todo = todo[~hit]
        return out

    def packed(self) -> list[bytes]:
        return [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def unpacked(cls, levels: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b[8:], np.uint8), count=int.from_bytes(b[:8], "little")).astype(bool)
                    for b in levels])


def shards(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """(first A id, pairs) of ranges of neighbouring A ids of at most ``most`` pairs each, from (A id, pairs) in order."""
    out: list[tuple[int, int]] = []
    for i, n in sizes:
        if out and out[-1][1] + n <= most:
            out[-1] = out[-1][0], out[-1][1] + n
        else:
            out.append((i, n))
    return out


class Block:
    """Functions and keys of consecutive shards, and their counts once known. Index: a shard's offset and the index within."""

    def __init__(self, low: int, high: int, parts: list[tuple[int, list[bytes], bytes]]):
        self.low, self.high = low, high  # A ids from low on, below high
        self.parts = parts  # (first A id, packed function, keys by index)
        self._ready = None
        self._recent = None

    def __getstate__(self):
        return self.low, self.high, self.parts

    def __setstate__(self, state):
        self.low, self.high, self.parts = state
        self._ready = None
        self._recent = None

    def ready(self):
        if self._ready is None:
            starts = np.array([p[0] for p in self.parts], np.int64)
            functions = [PerfectHash.unpacked(p[1]) for p in self.parts]
            keys = np.concatenate([np.frombuffer(p[2], np.int64) for p in self.parts])
            offsets = np.concatenate([[0], np.cumsum([f.size for f in functions])])
            self._ready = starts, functions, keys, offsets
        return self._ready

    def index(self, codes: np.ndarray) -> np.ndarray:
        """Index of each code of this block, verified by its key. Pairs met lately are found in a table."""
        if self._recent is None:
            self._recent = Recent()
        recent = self._recent
        at = recent.places(codes)
        out = recent.numbers[at]
        todo = np.flatnonzero(recent.codes[at] != codes)
        if len(todo):
            out[todo] = self._hashed(codes[todo])
            recent.codes[at[todo]], recent.numbers[at[todo]] = codes[todo], out[todo]
        return out

    def _hashed(self, codes: np.ndarray) -> np.ndarray:
        starts, functions, keys, offsets = self.ready()
        shard = np.searchsorted(starts, codes >> 32, side="right") - 1
        out = np.empty(len(codes), np.int64)
        for s in np.unique(shard):
            here = np.flatnonzero(shard == s)
            out[here] = functions[s].index(codes[here]) + offsets[s]
        if not np.array_equal(keys[out], codes):
            raise ValueError("a pair of tokens is not among those counted")
        return out

    def inside(self, codes: np.ndarray) -> np.ndarray:
        return (codes >> 32 >= self.low) & (codes >> 32 < self.high)


def _functions(pairs: DataFrame, starts: list[int]) -> DataFrame:
    """shard, levels and keys (by index) of every shard."""

    def build(table: pa.Table) -> pa.Table:
        keys = np.sort(table.column("code").to_numpy())
        f = PerfectHash.build(keys)
        by_index = np.empty(len(keys), np.int64)
        by_index[f.index(keys)] = keys
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                         "levels": pa.array([f.packed()], pa.list_(pa.binary())), "keys": pa.array([by_index.tobytes()], pa.binary())})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array(starts, np.int64)
        for b in batches:
            codes = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(first, codes >> 32, side="right") - 1, pa.int32()), b.column(0)], ["shard", "code"])

    return pairs.mapInArrow(number, "shard int, code long").groupBy("shard").applyInArrow(
        build, "shard int, levels array<binary>, keys binary")


def _add_up(table: pa.Table) -> pa.Table:
    """One count vector of those of a shard and branch."""
    total = None
    for v in table.column("counts"):
        x = np.frombuffer(v.as_buffer(), np.int64)
        total = x.copy() if total is None else total + x
    return pa.table({"shard": table.column("shard").slice(0, 1), "branch": table.column("branch").slice(0, 1),
                     "counts": pa.array([total.tobytes()], pa.binary())})


def _counts(tokens: DataFrame, block: Block, a: str, b: str) -> list[bytes]:
    """The dense count vector of each shard of the block, summed over all tasks in a tree."""
    spark = tokens.sparkSession
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, here = pair(a, b), sent.value
        offsets = here.ready()[3]
        total = np.zeros(int(offsets[-1]), np.int64)
        for _, codes, sizes in _steps(batches, both):
            mine = here.inside(codes)
            at = here.index(codes[mine])
            upto = np.concatenate([[0], np.cumsum(mine)])[np.cumsum(sizes)].tolist()
            start = 0
            for end in upto:
                # adds one to each place named, however often it is named: a pair counts once a document
                total[at[start:end]] += 1
                start = end
        branch = TaskContext.get().partitionId()
        for s in range(len(offsets) - 1):
            part = total[offsets[s]:offsets[s + 1]]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([branch], pa.int64()),
                                                  pa.array([part.tobytes()], pa.binary())], ["shard", "branch", "counts"])

    schema = "shard int, branch long, counts binary"
    sums = written(tokens.select(*STEP_COLUMNS).mapInArrow(run, schema), "align-counts")
    top = sums.agg(F.max("branch")).first()[0] or 0
    while True:
        up = sums.select("shard", F.floor(F.col("branch") / FAN_IN).alias("branch"), "counts")
        sums = up.groupBy("shard", "branch").applyInArrow(_add_up, schema)
        top //= FAN_IN
        if not top:
            break
    found = {r["shard"]: bytes(r["counts"]) for r in sums.collect()}
    sent.unpersist()
    return [found[s] for s in range(len(block.parts))]


def _best(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its A id."""
    ids = keys >> 32
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    highest = np.maximum.reduceat(counts[order], first)
    out = np.empty(len(keys), bool)
    out[order] = counts[order] == np.repeat(highest, np.diff(first, append=len(order)))
    return out


def _looked_up(tokens: DataFrame, block: Block, counts: list[bytes], a: str, b: str) -> DataFrame:
    """row, n_best and count_sum of every document over the pairs of the block."""
    sent = tokens.sparkSession.sparkContext.broadcast((block, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, (here, vectors) = pair(a, b), sent.value
        count = np.concatenate([np.frombuffer(v, np.int64) for v in vectors])
        best = _best(here.ready()[2], count).astype(np.int64)
        for rows, codes, sizes in _steps(batches, both):
            mine = here.inside(codes)
            at = here.index(codes[mine])
            upto = np.concatenate([[0], np.cumsum(mine)])[np.cumsum(sizes)]
            # sums of integers, as differences of running sums
            n_best, count_sum = (np.diff(np.concatenate([[0], np.cumsum(v[at])])[upto], prepend=0) for v in (best, count))
            yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(2, rows.num_columns)]
                                             + [pa.array(n_best), pa.array(count_sum)],
                                             [*rows.schema.names[2:], "n_best", "count_sum"])

    carry = [*STEP_COLUMNS[2:], *(c for c in tokens.columns if c not in STEP_COLUMNS)]
    kinds = dict(tokens.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in carry)
    return tokens.select("a", "b", *carry).mapInArrow(run, f"{schema}, n_best long, count_sum long")


def blocks_of(spark: SparkSession, pairs: DataFrame, shard_pairs: int, block_pairs: int) -> Iterator[Block]:
    """The pairs' functions, a block at a time."""
    sizes = pairs.groupBy(F.shiftright("code", 32).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    parts = shards(sorted((r["a"], r["n"]) for r in sizes.collect()), shard_pairs)  # at most one row an A id
    if not parts:
        return
    starts = [p[0] for p in parts]
    functions = written(_functions(pairs, starts), "align-functions")
    at = 0
    while at < len(parts):
        end, n = at, 0
        while end < len(parts) and (end == at or n + parts[end][1] <= block_pairs):
            n += parts[end][1]
            end += 1
        rows = functions.where(F.col("shard").between(at, end - 1)).collect()
        high = starts[end] if end < len(parts) else 1 << 31
        yield Block(starts[at], high, [(starts[r["shard"]], [bytes(x) for x in r["levels"]], bytes(r["keys"]))
                                       for r in sorted(rows, key=lambda r: r["shard"])])
        at = end


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model",
          shard_pairs: int = SHARD_PAIRS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    ``a`` names a byte-level BPE file of the tokenizers library, ``b`` a sentencepiece model."""
    spark = shipped(docs.sparkSession)
    tokens = written(encoded(docs, a, b), "align-tokens")
    pairs = written(distinct_pairs(tokens, a, b), "align-pairs")
    found = [_looked_up(tokens, block, _counts(tokens, block, a, b), a, b)
             for block in blocks_of(spark, pairs, shard_pairs, block_pairs)]
    if not found:
        out = tokens.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    elif len(found) == 1:
        out = found[0]
    else:
        sums = found[0].select("row", "n_best", "count_sum")
        for more in found[1:]:
            sums = sums.unionByName(more.select("row", "n_best", "count_sum"))
        sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        out = tokens.drop("a", "b").join(sums, "row")
    return out.select("doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"),
                      "n_best", "count_sum", "groups_sha256")
