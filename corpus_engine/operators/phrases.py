"""T11 for names of several words: a phrase gazetteer matched leftmost-longest.

Texts and phrases are sequences of lower-cased letter/number runs. A match starts at the leftmost place where a phrase
starts, takes the longest phrase there, and the next match starts after it. The gazetteer goes to the tasks as sets of phrases by
first word and length, so a text is matched in time linear in its words and the number of phrase lengths.

A gazetteer larger than ``MAX_BYTES`` (its size is summed before anything is sent) is cut into blocks by first word: every block finds
its longest phrase at each place, and the places of a document are then resolved together, a group no larger than the document.

Null texts and null phrases match nothing; of a phrase's labels the smallest counts; every row of the documents is annotated,
equal rows alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from corpus_engine.functions import text as T
from corpus_engine.operators.entities import entities_to_remove
from corpus_engine.session import scratch_path

#: Most bytes of phrases that tasks hold at once.
MAX_BYTES = 64 << 20
#: Bytes of a phrase in a worker beside its letters.
OVERHEAD = 150


def phrase_table(names: DataFrame, column: str, label: str | None = None) -> DataFrame:
    """phrase (its words joined by one space), n_words, first and label of every name that has a word; ``label`` or the column of that name."""
    words = T.tokens(F.col(column))
    rows = names.select(words.alias("w"), (F.lit(label) if label else F.col("label")).alias("label")).where(F.size("w") > 0)
    return rows.groupBy(F.array_join("w", " ").alias("phrase")).agg(
        F.min("label").alias("label"), F.first(F.size("w")).alias("n_words"), F.first(F.col("w")[0]).alias("first"))


class Matcher:
    """Phrases by first word: their lengths, longest first, and their labels."""

    def __init__(self, phrases: list[tuple[str, int, str, str]]):
        lengths: dict[str, set[int]] = {}
        self.labels: dict[str, str] = {}
        for phrase, n, first, label in phrases:
            lengths.setdefault(first, set()).add(n)
            self.labels[phrase] = label
        self.lengths = {w: sorted(ns, reverse=True) for w, ns in lengths.items()}

    def longest(self, words: list[str], at: int) -> tuple[int, str] | None:
        for n in self.lengths.get(words[at], ()):
            label = self.labels.get(" ".join(words[at:at + n]))
            if label is not None and at + n <= len(words):
                return n, label
        return None

    def places(self, words: list[str]) -> list[tuple[int, int, str]]:
        """(start, words, label) of the longest phrase at every place."""
        known = self.lengths
        found = ((i, self.longest(words, i)) for i, w in enumerate(words) if w in known)
        return [(i, *f) for i, f in found if f is not None]


def leftmost(places: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of the longest phrases at places in order, those that do not overlap one taken before."""
    out, free = [], 0
    for start, n, label in places:
        if start >= free:
            out.append((start, n, label))
            free = start + n
    return out


def _blocks(gazetteer: DataFrame, max_bytes: int):
    """Lists of (phrase, n_words, first, label), each of at most about ``max_bytes``."""
    size = gazetteer.agg(F.sum(F.length("phrase") + F.length("label") + OVERHEAD)).first()[0] or 0
    blocks = max(1, -(-size // max_bytes))
    block = F.pmod(F.xxhash64("first"), F.lit(blocks))
    for b in range(blocks):
        yield [tuple(r) for r in gazetteer.where(block == b).select("phrase", "n_words", "first", "label").collect()]


def _matched(docs: DataFrame, phrases: list[tuple], key: str, resolve: bool) -> DataFrame:
    """``key``, start, n_words, phrase, label of the matches, or of the longest phrase at every place."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for b in batches:
            rows, starts, ns, found, labels = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = text.split(" ") if text else []
                places = matcher.places(words)
                for start, n, label in leftmost(places) if resolve else places:
                    rows.append(i)
                    starts.append(start)
                    ns.append(n)
                    found.append(" ".join(words[start:start + n]))
                    labels.append(label)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ns, pa.int32()),
                                              pa.array(found, pa.string()), pa.array(labels, pa.string())],
                                             [key, "start", "n_words", "phrase", "label"])

    words = F.array_join(T.tokens(F.col("__text")), " ")
    return docs.select(key, words.alias("__words")).mapInArrow(run, _schema(docs, key))


def _schema(docs: DataFrame, key: str) -> T_.StructType:
    return T_.StructType([docs.schema[key], T_.StructField("start", T_.IntegerType()), T_.StructField("n_words", T_.IntegerType()),
                          T_.StructField("phrase", T_.StringType()), T_.StructField("label", T_.StringType())])


def match_phrases(docs: DataFrame, gazetteer: DataFrame, key: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``key``, start (number of the first word, from 0), n_words, phrase and label of every match.

    ``gazetteer`` is a :func:`phrase_table`."""
    rows = docs.select(F.col(key), F.col(text).alias("__text"))
    blocks = _blocks(gazetteer, max_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _matched(rows, first, key, True)
    # each row gets a number that all blocks share
    path = scratch_path(docs.sparkSession, "phrase-rows")
    rows.withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    places = _matched(rows, first, "__row", False).unionByName(_matched(rows, second, "__row", False))
    for more in blocks:
        places = places.unionByName(_matched(rows, more, "__row", False))

    def resolve(table: pa.Table) -> pa.Table:
        order = table.sort_by("start")
        kept = leftmost([(s, n, i) for i, (s, n) in enumerate(zip(order.column("start").to_pylist(), order.column("n_words").to_pylist(),
                                                                 strict=True))])
        return order.take(pa.array([i for _, _, i in kept], pa.int64()))

    found = places.groupBy("__row").applyInArrow(resolve, places.schema)
    return rows.select("__row", key).join(found, "__row").select(key, "start", "n_words", "phrase", "label")


def phrase_entities(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entity rows (``key``, word, entity) of the matches, once each: B-<label> for a phrase's first word, I-<label> for the others."""
    words = F.posexplode(F.split("phrase", " "))
    tagged = matches.select(key, "label", words.alias("pos", "word")).select(
        key, "word", F.concat(F.when(F.col("pos") == 0, F.lit("B-")).otherwise(F.lit("I-")), F.col("label")).alias("entity"))
    return tagged.distinct()


def remove_phrases(docs: DataFrame, matches: DataFrame, key: str = "doc_id", text: str = "text", labels=("LOC",), min_length: int = 3) -> DataFrame:
    """T12 for phrases: delete every occurrence of the phrases with these labels, longest first, words set apart by white space.

    Deletes in the lower-cased text, like the single-word removal does in the cleaned text."""
    wanted = matches.where(F.col("label").isin(list(labels))).select(key, F.col("phrase").alias("word"), F.lit("B-X").alias("entity"))
    words = entities_to_remove(wanted.distinct(), key, labels=("B-X",), min_length=min_length)
    joined = docs.join(words, key, "left")
    removed = F.aggregate(F.coalesce(F.col("entity_words"), F.array().cast("array<string>")), F.lower(F.col(text)),
                          lambda t, w: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.replace(w, F.lit(" "), F.lit(r"[^\p{L}\p{N}]+")),
                                                                    F.lit(r"(?![\p{L}\p{N}])")), F.lit("")))
    return joined.withColumn(text, removed).drop("entity_words")
