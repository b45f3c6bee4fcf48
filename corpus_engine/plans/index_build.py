"""Index build: papers -> chunks -> embeddings -> insert-if-absent into the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULTS
from corpus_engine.operators.chunk import chunk
from corpus_engine.operators.embed import HashEmbedder
from corpus_engine.sources.collection import BucketedCollection
from corpus_engine.sources.files import path_exists


def chunk_and_embed(papers: DataFrame, method: str = DEFAULTS.default_chunking, embedder=None,
                    id_col: str = "id", text: str = "text") -> DataFrame:
    """Rows in the collection's schema: id, doc_id, chunk_index, text, embedding."""
    embedder = embedder or HashEmbedder()
    chunks = chunk(papers.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), method)
    rows = chunks.select("id", F.col("doc_id").cast("string").alias("doc_id"), "chunk_index", "text")
    return embedder.embed(rows)


def build_index(spark: SparkSession, papers: DataFrame, collection_path: str,
                method: str = DEFAULTS.default_chunking, embedder=None, id_col: str = "id",
                text: str = "text", buckets: int | None = None) -> int:
    """Add the chunks whose id the collection lacks; returns the number added. Running it
    again with the same papers adds nothing (ids already present are ignored). The
    collection is a bucketed table at ``collection_path``, so each run shuffles only the
    new batch, never the stored collection."""
    embedder = embedder or HashEmbedder()
    stamp_embedder(spark, collection_path, embedder)
    coll = BucketedCollection(spark, collection_path, buckets)
    return coll.insert_if_absent(chunk_and_embed(papers, method, embedder, id_col, text))


def _stamp_path(collection_path: str) -> str:
    return f"{collection_path.rstrip('/')}_embedder"


def stamp_embedder(spark: SparkSession, collection_path: str, embedder) -> None:
    """The collection records which embedder made its vectors (name, dim); a later
    build or query with another embedder is refused instead of silently mixing spaces."""
    path = _stamp_path(collection_path)
    if path_exists(spark, f"{path}/_SUCCESS"):
        check_embedder(spark, collection_path, embedder)
        return
    spark.createDataFrame([(embedder.name, embedder.dim)], "embedder string, dim int") \
        .coalesce(1).write.mode("overwrite").json(path)


def check_embedder(spark: SparkSession, collection_path: str, embedder) -> None:
    path = _stamp_path(collection_path)
    if not path_exists(spark, f"{path}/_SUCCESS"):
        return
    row = spark.read.schema("embedder string, dim int").json(path).first()
    if row is not None and (row["embedder"], row["dim"]) != (embedder.name, embedder.dim):
        raise ValueError(f"collection was embedded with {row['embedder']}/{row['dim']}, "
                         f"not {embedder.name}/{embedder.dim}")
