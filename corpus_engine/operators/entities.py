"""Entity annotation (T11) and entity removal.

Annotation takes either a user NER model (``mapInArrow`` hook) or a gazetteer table
``(word, entity)`` joined to the documents' tokens on the word.

Removal groups the entity rows per document (bounded by that document's distinct words)
and joins them to the documents; AQE turns the join into a broadcast when the entity side
is small at run time.
"""

from __future__ import annotations

import uuid
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULTS
from corpus_engine.operators.embed import worker_model


def gazetteer_from_names(names: DataFrame, column: str, label: str = "LOC") -> DataFrame:
    """Gazetteer rows from a table of names: first token B-<label>, following ones I-<label>."""
    toks = F.regexp_extract_all(F.lower(F.col(column)), F.lit("[a-z0-9]+"), 0)
    return (names.select(F.posexplode(toks).alias("pos", "word"))
            .select("word", F.when(F.col("pos") == 0, F.lit(f"B-{label}"))
                    .otherwise(F.lit(f"I-{label}")).alias("entity"))
            .dropDuplicates(["word", "entity"]))


def annotate_entities(docs: DataFrame, gazetteer: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Entity rows ``(doc_id, word, entity)`` for tokens of each document found in the gazetteer.

    One plan for every size: the documents' distinct tokens joined to the gazetteer on the word.
    Spark broadcasts the gazetteer when its own size check allows, and splits hot words of a
    shuffled join. Null words match nothing."""
    tokens = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("[a-z0-9]+"), 0))
    words = gazetteer.where(F.col("word").isNotNull()).select("word", "entity").distinct()
    return docs.select(key, F.explode(tokens).alias("word")).join(words, "word").select(key, "word", "entity")


def annotate_with_model(docs: DataFrame, factory: Callable, key: str = "doc_id",
                        text: str = "text") -> DataFrame:
    """U3 hook: ``factory()`` returns ``ner(list of texts) -> list of entity lists``
    (``{'word':..,'entity':..}``), built once per Python worker and called with the texts of an
    Arrow batch. The key may have any type."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, word string, entity string"
    mark = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ner = worker_model(factory, mark)
        for b in batches:
            found = ner([t or "" for t in b.column(1).to_pylist()])
            at = [i for i, entities in enumerate(found) for _ in entities]
            flat = [e for entities in found for e in entities]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(at, pa.int64())), pa.array([e["word"] for e in flat], pa.string()),
                pa.array([e["entity"] for e in flat], pa.string())], [key, "word", "entity"])

    return docs.select(key, text).mapInArrow(run, schema)


def entities_to_remove(entities: DataFrame, key: str = "doc_id",
                       labels=DEFAULTS.entity_labels, min_length: int = DEFAULTS.min_entity_length) -> DataFrame:
    """Distinct words per document with a removable label, ordered longest first, then by
    word (a fixed order: removal is order-dependent when one entity contains another)."""
    keep = (F.col("entity").isin(list(labels)) & (F.length("word") >= min_length)
            & ~F.startswith(F.col("word"), F.lit("##")))
    by_len_then_word = lambda l, r: (F.when(F.length(l) > F.length(r), -1)
                                     .when(F.length(l) < F.length(r), 1)
                                     .when(l < r, -1).when(l > r, 1).otherwise(0))
    return (entities.filter(keep).groupBy(key)
            .agg(F.array_sort(F.collect_set("word"), by_len_then_word).alias("entity_words")))


def remove_entities(docs: DataFrame, entities: DataFrame, key: str = "doc_id", text: str = "text",
                    **kw) -> DataFrame:
    """Delete every occurrence (also inside longer words, case-sensitive) of each entity."""
    words = entities_to_remove(entities, key, **kw)
    joined = docs.join(words, key, "left")
    removed = F.aggregate(F.coalesce(F.col("entity_words"), F.array().cast("array<string>")),
                          F.col(text), lambda t, w: F.replace(t, w, F.lit("")))
    return joined.withColumn(text, removed).drop("entity_words")


def remove_gazetteer_entities(docs: DataFrame, gazetteer: DataFrame, key: str = "doc_id", text: str = "text",
                              labels=DEFAULTS.entity_labels, min_length: int = DEFAULTS.min_entity_length) -> DataFrame:
    """T11 + T12: annotate with the removable part of the gazetteer, then remove."""
    wanted = gazetteer.filter(F.col("entity").isin(list(labels)))
    return remove_entities(docs, annotate_entities(docs, wanted, key, text), key, text, labels=labels, min_length=min_length)
