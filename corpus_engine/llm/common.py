"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.session import scratch_path, ship_package

#: White space between words: space and the five ASCII controls from tab to carriage return.
SPACE_CONTROLS = "\t\n\x0b\x0c\r"
#: Characters of scripts written without spaces (Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han), and
#: their punctuation, for a regular expression's class.
UNSEGMENTED = ("\u0e01-\u0e4e\u0e81-\u0ece\u0f40-\u0fbc\u1000-\u1049\u1780-\u17d3\u3005-\u3007\u3041-\u30fa\u30fc-\u30ff\u31f0-\u31ff"
               "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
UNSEGMENTED_MARKS = "\u0e2f\u0e5a\u0e5b\u104a-\u104f\u17d4-\u17da\u3001-\u3003\u3008-\u301f\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\u2026"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    The table cuts the lineage: a lost executor re-reads it instead of recomputing. It stays until
    ``corpus_engine.session.release_scratch``."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_and_released(df: DataFrame, name: str) -> DataFrame:
    """:func:`written`, in zstd; then the driver collects its garbage. The shuffle files of a plan stay on the executors' disks until
    the driver finds that the plan is gone, which long chains of written tables would otherwise wait for."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", name)
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a written table that no later plan reads."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shipped(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers."""
    ship_package(spark)
    return spark


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order (null text: no words)."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACE_CONTROLS, " " * len(SPACE_CONTROLS))
    return F.array_remove(F.split(spaced, " "), "")


def without_space(text: Column) -> Column:
    return F.translate(text, " " + SPACE_CONTROLS, "")


def in_blocks(df: DataFrame, cols: list[str], limit: int):
    """Collect a table to the driver in blocks of at most ``limit`` rows, one block at a time."""
    block = []
    for row in df.select(*cols).toLocalIterator():
        block.append(tuple(row))
        if len(block) >= limit:
            yield block
            block = []
    if block:
        yield block


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [len(t.split()) if t else 0 for t in b.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], [*b.schema.names[1:], "size"])


def word_sizes(docs: DataFrame, *carry: str) -> DataFrame:
    """``carry`` columns and ``size``, the number of words of the text (null: 0).

    Bytes split at ASCII white space, which is the same set as :func:`words` uses."""
    shipped(docs.sparkSession)
    kinds = dict(docs.select(*carry).dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", size long"
    return docs.select("text", *carry).mapInArrow(_count_words, schema)


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Which bytes are white space.
SPACE_BYTES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _byte_values() -> np.ndarray:
    """A 64-bit value for every byte (splitmix64 of its number), A-Z as a-z; white space has none."""
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    x = (lower + np.uint64(1)) * _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.where(SPACE_BYTES, np.uint64(0), x ^ (x >> np.uint64(31)))


_VALUES = _byte_values()
_P = 0xD6E8FEB86659FD93
#: They grow with the longest text met.
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2^64, at least ``n`` of them."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for i, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def word_starts(b: np.ndarray) -> np.ndarray:
    """Places of the bytes that begin a word."""
    space = SPACE_BYTES[b]
    return np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text, A-Z as a-z: the sum of its bytes' values times powers, moved to
    the word's start, mixed. All words of the text are hashed by a few passes over its bytes."""
    b = np.frombuffer(raw, np.uint8)
    starts = word_starts(b)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(b))
    return mixed(np.add.reduceat(_VALUES[b] * up[:len(b)], starts) * down[starts])
