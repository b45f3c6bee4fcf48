"""R5 by a feedback model: terms of the best chunks join the query (RM3).

A first search gives every query its ``feedback`` nearest chunks. A chunk counts by exp(-distance), and its terms by their
share of its words; the sum over the chunks is the relevance model, of which the ``terms`` strongest terms stay (ties: by the term). The
query's own terms keep the share ``weight``. The vector of the mixed model is the weighted sum of the terms' vectors, so any embedder
serves; the second search uses it, and the original question stays with the results.

All steps are joins and aggregates over queries x feedback chunks; the corpus is only read by the two searches. A query
without a neighbour or a term keeps its own vector's search, so every query that has a vector is answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULTS
from corpus_engine.functions import text as T
from corpus_engine.operators.retrieve import knn_exact, retrieve_dedup

#: Chunks of the first search, terms of the relevance model, and the share of the query's own terms.
FEEDBACK, TERMS, WEIGHT = 10, 20, 0.5


def _terms(df: DataFrame, query_id: str, text: str, weight: Column) -> DataFrame:
    """query, term and the sum of ``weight`` shared out over the words of each text."""
    words = df.select(query_id, weight.alias("w"), T.tokens(F.col(text)).alias("t"))
    return words.select(query_id, (F.col("w") / F.size("t")).alias("w"), F.explode("t").alias("term")).groupBy(query_id, "term").agg(F.sum("w").alias("w"))


def _shares(df: DataFrame, query_id: str) -> DataFrame:
    return df.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(query_id)))


def relevance_model(hits: DataFrame, query_id: str = "query_id", text: str = "text", terms: int = TERMS) -> DataFrame:
    """query, term, w: the ``terms`` strongest terms of the hits (query, distance, text), whose weights sum to 1."""
    model = _terms(hits, query_id, text, F.exp(-F.col("distance")))
    strongest = Window.partitionBy(query_id).orderBy(F.round("w", 12).desc(), "term")
    return _shares(model.withColumn("r", F.row_number().over(strongest)).where(F.col("r") <= terms).drop("r"), query_id)


def expanded_model(queries: DataFrame, relevance: DataFrame, query_id: str = "query_id", question: str = "question",
                   weight: float = WEIGHT) -> DataFrame:
    """query, term, w: the query's own terms and the relevance model, mixed."""
    own = _terms(queries, query_id, question, F.lit(1.0))
    both = own.withColumn("w", F.col("w") * weight).unionByName(relevance.withColumn("w", F.col("w") * (1.0 - weight)))
    return both.groupBy(query_id, "term").agg(F.sum("w").alias("w"))


def model_vectors(model: DataFrame, embedder, query_id: str = "query_id", out: str = "embedding") -> DataFrame:
    """query and the normalised weighted sum of the terms' vectors."""
    vectors = embedder.embed(model.select("term").distinct(), "term", "__v").select("term", F.posexplode("__v").alias("at", "x"))
    sums = model.join(vectors.where("x <> 0"), "term").groupBy(query_id, "at").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    by_place = F.map_from_entries(F.collect_list(F.struct("at", "x")))  # one entry a dimension
    sums = sums.groupBy(query_id).agg(by_place.alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).where("norm > 0")
    places = F.sequence(F.lit(0), F.lit(embedder.dim - 1))
    return sums.select(query_id, F.transform(places, lambda i: F.round(
        F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm"), 9).cast("float")).alias(out))


def retrieve_feedback(corpus: DataFrame, queries: DataFrame, embedder, k: int = DEFAULTS.top_k_app, factor: int = DEFAULTS.overfetch_factor,
                      feedback: int = FEEDBACK, terms: int = TERMS, weight: float = WEIGHT, query_id: str = "query_id",
                      question: str = "question", query_vec: str = "embedding") -> DataFrame:
    """R2 by the expanded vectors of the queries; the original ``question`` stays. Hand in a stored corpus: it is read twice."""
    hits = knn_exact(corpus, queries.select(query_id, query_vec), feedback, carry=("text",), query_id=query_id, query_vec=query_vec)
    model = expanded_model(queries, relevance_model(hits, query_id, "text", terms), query_id, question, weight)
    vectors = model_vectors(model, embedder, query_id, "__expanded")
    asked = queries.join(vectors, query_id, "left").select(query_id, F.coalesce("__expanded", F.col(query_vec)).alias(query_vec))
    found = retrieve_dedup(corpus, asked, k, factor, query_id=query_id, query_vec=query_vec)
    return found.join(queries.select(query_id, question), query_id)
