"""Embedding: a pluggable embedder applied to a text column.

``HashEmbedder`` (the offline default) is a hashed bag of words: each lower-cased
letter/number token goes to bucket ``md5(token)[:8] as hex mod dim``; the bucket counts are
L2-normalised. It is a pure projection (md5, array_remove, transform) with no shuffle and
no Python, so it scales with the number of executors; the histogram is one sort of a row's
buckets, and the same vectors come out of the DuckDB oracle.

``PandasEmbedder`` wraps any batch encoder (e.g. a neural model) for ``mapInPandas``; the
model is built once per Python worker process and applied to Arrow batches.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from corpus_engine.config import DEFAULTS
from corpus_engine.functions import text as T


class HashEmbedder:
    name = "hash-bow-md5"

    def __init__(self, dim: int = DEFAULTS.embed_dim):
        self.dim = dim

    def bucket(self, token: Column) -> Column:
        return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(self.dim))

    def buckets(self, text: Column) -> Column:
        return F.transform(T.tokens(text), lambda t: self.bucket(t).cast("int"))

    def counts(self, buckets: Column) -> Column:
        """Histogram of a bucket array by sorting it: with every bucket added once, bucket i is the i-th run, one longer than its count.

        The sorted array and the places where runs start are bound once, as lambda variables."""
        def starts(s):
            return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def lengths(x):
            return F.transform(x["p"], lambda p, k: (F.coalesce(F.get(x["p"], k + 1), F.size(x["s"])) - p - 1).cast("double"))

        every = F.sort_array(F.concat(buckets, F.sequence(F.lit(0), F.lit(self.dim - 1))))
        runs = F.transform(F.array(every), lambda s: F.struct(s.alias("s"), starts(s).alias("p")))
        return F.transform(runs, lengths)[0]

    def embed(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        # Each step is its own projection so the md5 hashing runs once per token and the
        # histogram once per row (Catalyst does not collapse non-cheap expressions that
        # are referenced more than once).
        counts = F.col("__counts")
        vec = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x,
                          lambda ss: F.transform(counts, lambda x: F.when(ss > 0, x / F.sqrt(ss))
                                                 .otherwise(F.lit(0.0)).cast("float")))
        return (df.withColumn("__buckets", self.buckets(F.col(text)))
                .withColumn("__counts", self.counts(F.col("__buckets")))
                .withColumn(out, vec)
                .drop("__buckets", "__counts"))


class PandasEmbedder:
    """Batch embedder for user models: ``factory()`` returns ``encode(list[str]) -> ndarray``.

    The factory runs once per Python worker (cached at module level), not per batch."""

    name = "pandas"

    def __init__(self, factory: Callable[[], Callable[[list], np.ndarray]], dim: int, name: str = "pandas"):
        import uuid

        self.factory = factory
        self.dim = dim
        self.name = name
        # cache key for the worker-side model (object ids are reused inside a long-lived worker)
        self.key = uuid.uuid4().hex

    def embed(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        factory, dim, key = self.factory, self.dim, self.key
        schema = T_.StructType([f for f in df.schema.fields if f.name != out]
                               + [T_.StructField(out, T_.ArrayType(T_.FloatType()))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = worker_model(factory, key)
            for pdf in batches:
                texts = [t if isinstance(t, str) else "" for t in pdf[text].tolist()]
                vecs = np.asarray(encode(texts), dtype=np.float32).reshape(len(texts), -1)
                if vecs.ndim != 2 or vecs.shape[1] != dim:
                    raise ValueError(f"embedder returned shape {vecs.shape}, expected (n, {dim})")
                pdf[out] = list(vecs)
                yield pdf

        return df.mapInPandas(run, schema)


_MODELS: dict = {}


def worker_model(factory, key: str):
    """The model built by ``factory``, once per Python worker process and key."""
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def embed(df: DataFrame, embedder=None, text: str = "text", out: str = "embedding") -> DataFrame:
    """Add an ``embedding array<float>`` column computed from ``text``."""
    return (embedder or HashEmbedder()).embed(df, text, out)
