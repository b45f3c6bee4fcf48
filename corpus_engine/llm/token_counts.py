"""Token counts at every prefix of a text, for byte-level BPE tokenizers.

The tokenizer cuts a text into pretokens and merges within each. For one pretoken, dynamic
programming over its byte prefixes finds the exact number of tokens of every prefix: the encoding of a prefix
ends in exactly one token ``t``, namely the one for which the encoding of what stands before
``t``, followed by ``t``, is what the merges make; so ``count[i] = count[i - len(t)] + 1``. A
candidate ``t`` is a vocabulary entry that ends at ``i``; it fits if its bytes encode to itself
and it does not merge with the last token before it. Pretokens repeat, so tables are kept per distinct pretoken.

The counts of a text are the sums over its pretokens plus the table of the one a prefix ends
in. Where a prefix ends inside a run of white space or a contraction, the pretokens of the
prefix differ from those of the text; that short tail is cut anew.

From these tables truncation ("how much text fits n tokens") and budget ("how many tokens has
this prefix") need no re-encoding of the text.

Null and empty texts have 0 tokens. Very long texts and pretokens are counted whole, in time
linear in their length for each longest vocabulary entry. Special strings in texts count as the library's default does. Repeated
rows are counted one by one; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from corpus_engine.llm.common import shipped

#: Distinct pretokens kept per worker.
CACHE = 200_000
#: Pretokens up to this many bytes have their tables kept.
SHORT = 64


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the letters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PrefixCounter:
    """Exact token counts of the prefixes of texts under one byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        import public_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.table = str.maketrans({chr(b): c for b, c in enumerate(self.letters)})
        self.vocab = {k: v for k, v in self.tok.get_vocab(with_added_tokens=False).items()}
        self.longest = max(map(len, self.vocab))
        self.cut = regex.compile(public_tokenizers.PATTERN)
        special = [str(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.marks = frozenset(special)
        self.whole: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.sizes: dict[str, int] = {}
        self.states: dict[str, tuple[int, str]] = {"": (0, "")}
        self.tables: dict[str, list[int]] = {}

    def encoded(self, text: str) -> list[str]:
        """Tokens that the merges make of byte letters."""
        return [t.value for t in self.tok.model.tokenize(text)]

    def _stands(self, t: str) -> bool:
        ok = self.whole.get(t)
        if ok is None:
            ok = self.whole[t] = self.encoded(t) == [t]
        return ok

    def _follows(self, a: str, b: str) -> bool:
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 4 * CACHE:
                self.pairs.clear()
            ok = self.pairs[key] = self.encoded(a + b) == [a, b]
        return ok

    def _states(self, s: str) -> dict[str, tuple[int, str]]:
        """Table of (tokens, last token) by prefix, with all prefixes of the byte letters ``s``.

        Pretokens share prefixes, whose states are found once and kept."""
        if len(self.states) > 5 * CACHE:
            self.states = {"": (0, "")}
        states = self.states
        known = len(s)
        while s[:known] not in states:
            known -= 1
        vocab, longest = self.vocab, self.longest
        for i in range(known + 1, len(s) + 1):
            for j in range(max(0, i - longest), i):
                t = s[j:i]
                if t in vocab and self._stands(t):
                    n, before = states[s[:j]]
                    if not j or self._follows(before, t):
                        states[s[:i]] = n + 1, t
                        break
            else:
                raise ValueError(f"no token of the vocabulary ends {s[:i]!r}")
        return states

    def _long(self, s: str) -> list[int]:
        """Tokens of every prefix of byte letters too long to keep (index 0: the empty prefix)."""
        counts, last = [0], [""]
        for i in range(1, len(s) + 1):
            for j in range(max(0, i - self.longest), i):
                t = s[j:i]
                if t in self.vocab and self._stands(t) and (not j or self._follows(last[j], t)):
                    counts.append(counts[j] + 1)
                    last.append(t)
                    break
            else:
                raise ValueError("no token of the vocabulary ends a prefix")
        return counts

    def _byte_table(self, s: str) -> list[int]:
        """Tokens of every prefix of byte letters."""
        if len(s) > SHORT:
            return self._long(s)
        states = self._states(s)
        return [states[s[:i]][0] for i in range(len(s) + 1)]

    def letters_of(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.table)

    def table_of(self, pretoken: str) -> list[int]:
        """Tokens of every code-point prefix of a pretoken."""
        found = self.tables.get(pretoken)
        if found is None:
            letters = self.letters_of(pretoken)
            by_byte, found, at = self._byte_table(letters), [0], 0
            for c in pretoken:
                at += len(c.encode())
                found.append(by_byte[at])
            if len(pretoken) <= SHORT:
                if len(self.tables) > CACHE:
                    self.tables.clear()
                self.tables[pretoken] = found
        return found

    def size_of(self, pretoken: str) -> int:
        n = self.sizes.get(pretoken)
        if n is None:
            letters = self.letters_of(pretoken)
            n = self._long(letters)[-1] if len(letters) > SHORT else self._states(letters)[letters][0]
            if len(pretoken) <= SHORT:
                if len(self.sizes) > 5 * CACHE:
                    self.sizes.clear()
                self.sizes[pretoken] = n
        return n

    def pretokens(self, text: str) -> list[str]:
        """The pretokens of a text; a special string is one of them."""
        if self.special is None or not self.special.search(text):
            return self.cut.findall(text)
        out = []
        for part in self.special.split(text):
            out += [part] if part in self.marks else self.cut.findall(part)
        return out

    def sizes_of(self, parts: list[str]) -> list[int]:
        """Tokens of each pretoken."""
        out = list(map(self.sizes.get, parts))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    out[i] = 1 if parts[i] in self.marks else self.size_of(parts[i])
        return out

    def marked_counts(self, text: str) -> tuple[list[str], list[int]]:
        """Pretokens and the tokens up to the end of each."""
        parts = self.pretokens(text)
        return parts, list(accumulate(self.sizes_of(parts)))

    def count(self, text: str) -> int:
        return sum(self.sizes_of(self.pretokens(text)))

    def prefix_count(self, parts: list[str], ends: list[int], totals: list[int], k: int) -> int:
        """Tokens of the first ``k`` code points of the text with these pretokens, ends and totals."""
        i = bisect_right(ends, k)
        # white space, contractions and special strings are cut differently when they are the end:
        # go back to the last pretoken that surely stands, and cut the short rest anew
        back = i
        while back and (i - back < 3 or parts[back - 1].isspace()) and parts[back - 1] not in self.marks:
            back -= 1
        start = ends[back - 1] if back else 0
        tail = "".join(parts[back:i + 1])[:k - start]
        rest = self.cut.findall(tail)
        n = totals[back - 1] if back else 0
        for p in rest[:-1]:
            n += self.size_of(p)
        if rest:
            whole = parts[i] if i < len(parts) else ""
            n += self.table_of(whole)[len(rest[-1])] if whole.startswith(rest[-1]) and whole not in self.marks else self.size_of(rest[-1])
        return n

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of every prefix of a text, by code points (index 0: the empty prefix)."""
        parts, totals = self.marked_counts(text)
        ends = _ends(parts)
        return [self.prefix_count(parts, ends, totals, k) for k in range(len(text) + 1)]

    def fit(self, parts: list[str], totals: list[int], limit: int) -> int:
        """Code points of the longest whole-pretoken prefix of at most ``limit`` tokens."""
        i = bisect_right(totals, limit)
        return sum(map(len, parts[:i]))


def _ends(parts: list[str]) -> list[int]:
    ends, at = [], 0
    for p in parts:
        at += len(p)
        ends.append(at)
    return ends


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The worker's counter for a tokenizer file, with its kept tables."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars, the code points of the longest prefix of
    whole pretokens within ``limit`` tokens, per row of ``docs``."""
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path(tokenizer))
        for b in batches:
            sizes, counts, fits = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                parts, totals = c.marked_counts(text)
                sizes.append(len(text.encode()))
                counts.append(totals[-1] if totals else 0)
                fits.append(len(text) if counts[-1] <= limit else c.fit(parts, totals, limit))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                pa.array([n > limit for n in counts], pa.bool_()), pa.array(fits, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_table(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id and ``counts``, the tokens of every prefix of the text (element k: first k code points)."""
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path(tokenizer))
        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array(
                    [c.prefix_counts(text or "")], pa.list_(pa.int32()))], ["doc_id", "counts"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, counts array<int>")
