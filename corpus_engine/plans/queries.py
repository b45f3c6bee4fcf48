"""Registered queries: one per operator of the inventory, each over the given tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose column names match the
DuckDB oracle in ``plans/oracles.py``. Computed columns are aliased; distances and
similarities are rounded to 6 decimals; no query returns arrays or maps (they are
exploded or projected) so that values compare across engines.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULTS
from corpus_engine.functions import files as FI
from corpus_engine.functions import html as H
from corpus_engine.functions import pages as PG
from corpus_engine.functions import prompts as P
from corpus_engine.functions import text as T
from corpus_engine.functions import vectors as V
from corpus_engine.operators import answer as A
from corpus_engine.operators import chunk as C
from corpus_engine.operators import clean as CL
from corpus_engine.operators import embed as E
from corpus_engine.operators import entities as EN
from corpus_engine.operators import ingest as I
from corpus_engine.operators import feedback as FB
from corpus_engine.operators import phrases as PH
from corpus_engine.operators import retrieve as R
from corpus_engine.operators import sentences as SE
from corpus_engine.operators import stats as S
from corpus_engine.sources.tables import balance, table

EMBEDDER = E.HashEmbedder(DEFAULTS.embed_dim)


# --- shared inputs ------------------------------------------------------------------

def documents(spark, sf) -> DataFrame:
    return balance(table(spark, sf, "documents").select("doc_id", "text", "lang"))


def cleaned(spark, sf, with_isbn: bool = False) -> DataFrame:
    return CL.clean_text(documents(spark, sf), with_isbn=with_isbn).select("doc_id", "text")


def sentence_chunks(spark, sf) -> DataFrame:
    return C.chunk_sentence(documents(spark, sf))


def corpus(spark, sf) -> DataFrame:
    """Sentence chunks of every document with their hash embedding."""
    return EMBEDDER.embed(sentence_chunks(spark, sf))


def questions(spark, sf) -> DataFrame:
    """The benchmark items as a query batch (query_id, question, embedding)."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"),
                                             F.col("text").alias("question"))
    return EMBEDDER.embed(q, "question", "embedding")


def page_files(spark, sf) -> DataFrame:
    pages = balance(table(spark, sf, "pages"))
    return pages.select("page_id", "url", FI.file_name("url").alias("filename"), "html")


def gazetteer(spark, sf) -> DataFrame:
    names = (table(spark, sf, "nation").select(F.col("n_name").alias("name"))
             .unionByName(table(spark, sf, "region").select(F.col("r_name").alias("name"))))
    return EN.gazetteer_from_names(names, "name", "LOC")


def conversations(spark, sf) -> DataFrame:
    return balance(table(spark, sf, "conversations"))


def answers(spark, sf) -> DataFrame:
    """Answers table derived from every assistant turn of the conversations: each block of
    four turns is one query and turn ``t`` holds model ``t mod 4`` of the fixed model list
    (query ``<conv_id>:<turn div 4>``), so every assistant turn has its own cell. A turn
    shorter than 20 characters counts as a failed call (answer null, error set). No
    window: a very long conversation is spread over many queries and tasks."""
    conv = conversations(spark, sf).filter(F.col("role") == "assistant")
    models = F.array(*[F.lit(m) for m in DEFAULTS.models])
    n = len(DEFAULTS.models)
    failed = F.length("text") < 20
    return conv.select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.floor(F.col("turn") / n).cast("string"))
        .alias("query_id"),
        F.element_at(models, (F.pmod(F.col("turn"), F.lit(n)) + 1).cast("int")).alias("model"),
        F.when(~failed, F.col("text")).alias("answer"),
        F.when(failed, F.concat(F.lit("empty response: "), F.col("text"))).alias("error"))


def contexts(spark, sf) -> DataFrame:
    hits = R.retrieve_dedup(corpus(spark, sf), questions(spark, sf).select("query_id", "embedding"),
                            DEFAULTS.top_k_app, DEFAULTS.overfetch_factor)
    return A.assemble_context(hits)


# --- cleaning ---------------------------------------------------------------------------

def q_clean_steps(spark, sf):
    """The cleaning chain without the ISBN rule."""
    return cleaned(spark, sf, with_isbn=False)


def q_clean_isbn(spark, sf):
    """Lower, non-ASCII removal, then the ISBN rule (lookahead)."""
    d = documents(spark, sf)
    return d.select("doc_id", T.remove(T.remove(F.lower("text"), T.NON_ASCII), T.ISBN).alias("text"))


def q_clean_text(spark, sf):
    """The full cleaning chain."""
    return cleaned(spark, sf, with_isbn=True)


def q_clean_trace(spark, sf):
    """Characters removed by each cleaning step over the corpus."""
    return CL.clean_trace(documents(spark, sf), with_isbn=True)


def q_word_count(spark, sf):
    """Whitespace word count per document."""
    return documents(spark, sf).select("doc_id", T.word_count("text").alias("n_words"))


def q_normalize_text(spark, sf):
    """Comparison normaliser per document."""
    return documents(spark, sf).select("doc_id", T.normalize_for_comparison("text").alias("norm"))


def q_annotate_entities(spark, sf):
    """Entity rows from a gazetteer built from nation and region names."""
    return EN.annotate_entities(cleaned(spark, sf), gazetteer(spark, sf))


def phrase_gazetteer(spark, sf) -> DataFrame:
    """Names of several words, many of which overlap: nations, regions, parts, and the openings of the benchmark's items."""
    items = table(spark, sf, "benchmark").select(T.tokens("text").alias("w"))
    openings = [items.select(F.array_join(F.slice("w", at, n), " ").alias("name"), F.lit("ITEM").alias("label"))
                for at, n in ((1, 2), (1, 5), (2, 3), (4, 4))]
    names = [table(spark, sf, t).select(F.col(c).alias("name"), F.lit(label).alias("label"))
             for t, c, label in (("nation", "n_name", "LOC"), ("region", "r_name", "LOC"), ("part", "p_name", "PROD"))]
    rows = names[0]
    for more in [*names[1:], *openings]:
        rows = rows.unionByName(more)
    return PH.phrase_table(rows, "name")


def q_annotate_phrases(spark, sf):
    """T11 for names of several words: leftmost-longest matches in every document."""
    return PH.match_phrases(documents(spark, sf), phrase_gazetteer(spark, sf))


def q_phrase_entities(spark, sf):
    """B-/I- tagged words of the phrase matches."""
    return PH.phrase_entities(PH.match_phrases(documents(spark, sf), phrase_gazetteer(spark, sf)))


def q_remove_entities(spark, sf):
    """Removal of B-LOC entities from the cleaned documents."""
    return EN.remove_gazetteer_entities(cleaned(spark, sf), gazetteer(spark, sf)).select("doc_id", "text")


def q_debug_sample(spark, sf):
    """The first ten cleaned documents."""
    return CL.debug_sample(cleaned(spark, sf), "doc_id", DEFAULTS.debug_sample)


def q_learn_abbreviations(spark, sf):
    """Words of the corpus whose period belongs to them."""
    return SE.learn_abbreviations(documents(spark, sf))


def q_sentences_learned(spark, sf):
    """Sentences that do not end after a learned abbreviation or an initial."""
    docs = documents(spark, sf)
    return SE.split_sentences(docs, SE.learn_abbreviations(docs))


# --- chunking -----------------------------------------------------------------------------

def q_split_sentences(spark, sf):
    """Rule-based sentence split."""
    return C.split_sentences(documents(spark, sf))


def q_chunk_fixed(spark, sf):
    """C1 + C8: fixed-size chunks with overlap."""
    return C.chunk_fixed(documents(spark, sf)).select("doc_id", "chunk_index", "id", "text")


def q_chunk_sentence(spark, sf):
    """C2 + C8: sentence-packed chunks."""
    return sentence_chunks(spark, sf).select("doc_id", "chunk_index", "id", "text")


def q_chunk_words(spark, sf):
    """C5 + C8: word-packed chunks."""
    return C.chunk_words(documents(spark, sf)).select("doc_id", "chunk_index", "id", "text")


def q_chunk_semantic(spark, sf):
    """C3 + C8: semantic merge with the hash embedder."""
    return C.chunk_semantic(documents(spark, sf), embedder=EMBEDDER).select("doc_id", "chunk_index", "id", "text")


def q_chunk_recursive(spark, sf):
    """C4 + C8: recursive character split of the pages' Markdown."""
    md = page_files(spark, sf).select("page_id", H.html_to_markdown("html").alias("text"))
    return C.chunk_recursive(md, keys=("page_id",)).select("page_id", "chunk_index", "id", "text")


# --- embedding / similarity -------------------------------------------------------------------

def q_embed_hash(spark, sf):
    """Hash embedding of the sentence chunks (non-zero dimensions)."""
    emb = corpus(spark, sf)
    # posexplode_outer: a plain posexplode makes the optimizer infer size(embedding) > 0 and
    # push it below the projections, inlining (and recomputing) the whole embedding.
    return (emb.select("id", F.posexplode_outer("embedding").alias("dim", "value"))
            .filter(F.col("value") != 0)
            .select("id", "dim", F.round(F.col("value").cast("double"), 6).alias("value")))


def _vector_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1)


def q_cosine_pairs(spark, sf):
    """Cosine of consecutive vectors of the embeddings table."""
    return _vector_pairs(spark, sf).select("a_id", "b_id", F.round(V.cosine("a", "b"), 6).alias("cosine"))


def q_vector_distance(spark, sf):
    """E5: squared L2 of consecutive vectors of the embeddings table."""
    return _vector_pairs(spark, sf).select("a_id", "b_id", F.round(V.squared_l2("a", "b"), 6).alias("distance"))


# --- retrieval ------------------------------------------------------------------------------------

def q_knn_exact(spark, sf):
    """R1 + R4: top-5 chunks for every benchmark question."""
    return R.knn_exact(corpus(spark, sf), questions(spark, sf).select("query_id", "embedding"),
                       DEFAULTS.top_k_loader, carry=())


def _vectors(spark, sf):
    return balance(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


def _asked(v):
    """The stated query set of the vector searches: every row whose id is divisible by 50."""
    return v.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "embedding")


def q_knn_vectors(spark, sf):
    """Top-5 neighbours of the query vectors among all vectors of the embeddings table."""
    v = _vectors(spark, sf)
    return R.knn_exact(v, _asked(v), DEFAULTS.top_k_loader, carry=())


def q_knn_lsh(spark, sf):
    """Approximate top-5 neighbours of the query vectors among all vectors."""
    v = _vectors(spark, sf)
    return R.knn_lsh(v, _asked(v), DEFAULTS.top_k_loader)


def q_lsh_recall(spark, sf):
    """Recall of the approximate top-5 against the exact one."""
    v = _vectors(spark, sf)
    q = _asked(v)
    return R.recall(R.knn_exact(v, q, DEFAULTS.top_k_loader, carry=()), R.knn_lsh(v, q, DEFAULTS.top_k_loader))


def _ivf(spark, v):
    """A stored inverted-file index over the vectors, filled by two inserts that overlap, and calibrated."""
    from corpus_engine.operators.ivf import IvfIndex
    index = IvfIndex(spark, _scratch(spark, "ivf"))
    index.insert(v.where(F.col("id") % 3 != 0))
    index.insert(v)
    index.calibrate(DEFAULTS.top_k_loader)
    return index


def q_knn_ivf(spark, sf):
    """Approximate top-5 from the stored inverted-file index, for the query vectors among all vectors."""
    v = _vectors(spark, sf)
    return _ivf(spark, v).search(_asked(v), DEFAULTS.top_k_loader)


def q_ivf_recall(spark, sf):
    """Recall of the stored index against the exact top-5."""
    v = _vectors(spark, sf)
    q = _asked(v)
    return R.recall(R.knn_exact(v, q, DEFAULTS.top_k_loader, carry=()), _ivf(spark, v).search(q, DEFAULTS.top_k_loader))


def q_retrieve_preview(spark, sf):
    """T17 + T18: preview and relevance of the top-5 hits."""
    hits = R.knn_exact(corpus(spark, sf), questions(spark, sf).select("query_id", "embedding"),
                       DEFAULTS.top_k_loader, carry=("text",))
    return hits.select("query_id", "rank", "id", T.relevance("distance").alias("relevance"),
                       T.preview("text").alias("preview"))


def q_retrieve_dedup(spark, sf):
    """R2: over-fetch 15, normalised dedup, top-3, no refill."""
    return R.retrieve_dedup(corpus(spark, sf), questions(spark, sf).select("query_id", "embedding"),
                            DEFAULTS.top_k_app, DEFAULTS.overfetch_factor)


def q_retrieve_filtered(spark, sf):
    """R1/R2 over a metadata-filtered corpus: only documents labelled good quality and not
    toxic (a semi-join before chunking, so filtered documents are never chunked)."""
    good = (table(spark, sf, "labels").filter((F.col("quality") == 1) & (F.col("toxic") == 0))
            .select("doc_id").distinct())  # map-side dedup: a repeated label row is not a hot key
    docs = documents(spark, sf).join(good, "doc_id", "left_semi")
    chunks = EMBEDDER.embed(C.chunk_sentence(docs))
    return R.retrieve_dedup(chunks, questions(spark, sf).select("query_id", "embedding"),
                            DEFAULTS.top_k_app, DEFAULTS.overfetch_factor)


def q_retrieve_expanded(spark, sf):
    """Retrieval by a pseudo-relevance expansion, answered for the original question."""
    path = _scratch(spark, "expanded_corpus")
    corpus(spark, sf).select("id", "text", "embedding").write.parquet(path)
    out = R.retrieve_expanded(spark.read.parquet(path), questions(spark, sf), EMBEDDER,
                              DEFAULTS.top_k_app, DEFAULTS.overfetch_factor, query_text="question")
    return out.select("query_id", "rank", "id", "distance", "question")


def q_retrieve_feedback(spark, sf):
    """Retrieval by the question and the strongest terms of its first chunks."""
    path = _scratch(spark, "feedback_corpus")
    corpus(spark, sf).select("id", "text", "embedding").write.parquet(path)
    out = FB.retrieve_feedback(spark.read.parquet(path), questions(spark, sf), EMBEDDER)
    return out.select("query_id", "rank", "id", "distance", "question")


def q_dedup_normalized(spark, sf):
    """One document per normalised text."""
    return R.dedup_normalized(documents(spark, sf).select("doc_id", "text"), "doc_id", "text")


# --- prompts and answers -------------------------------------------------------------------------------

def q_assemble_context(spark, sf):
    """P1 (flagship): numbered context per question."""
    return contexts(spark, sf)


def _question_context(spark, sf):
    return questions(spark, sf).select("query_id", "question").join(contexts(spark, sf), "query_id", "left")


def q_render_prompt(spark, sf):
    """P2 + P3: standard and expansion prompts."""
    qc = _question_context(spark, sf)
    return (A.render_prompt(qc, P.STANDARD_TEMPLATE, out="prompt")
            .withColumn("expansion_prompt", P.fill(P.EXPANSION_TEMPLATE, query=F.col("question")))
            .select("query_id", "prompt", "expansion_prompt"))


def q_fanout_prompts(spark, sf):
    """One prompt per (question, model)."""
    return A.fanout_prompts(_question_context(spark, sf), ("rag", "claude_v1", "gpt_v1", "gpt", "claude", "mistral"))


def q_request_bodies(spark, sf):
    """P5: JSON request bodies, each model's own."""
    return A.request_bodies(A.fanout_prompts(_question_context(spark, sf), tuple(P.REQUEST_BODIES)))


def q_parse_responses(spark, sf):
    """Generated text from three response-body formats; every third turn's chat body has no choices."""
    conv = conversations(spark, sf)
    t = F.col("text")
    bodies = conv.select(
        "conv_id", "turn",
        F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content"))).alias("b_messages"),
        F.to_json(F.struct(F.array(F.struct(t.alias("text"))).alias("outputs"))).alias("b_completion"),
        F.to_json(F.struct(F.when(F.col("turn") % 3 != 0, F.array(F.struct(F.struct(t.alias("content")).alias("message"))))
                           .otherwise(F.array().cast("array<struct<message:struct<content:string>>>")).alias("choices"))).alias("b_chat"))
    return bodies.select("conv_id", "turn",
                         P.response_text("b_messages", "messages").alias("messages_text"),
                         P.response_text("b_completion", "completion").alias("completion_text"),
                         P.response_text("b_chat", "chat").alias("chat_text"))


def q_clean_answer(spark, sf):
    """Cleanup of answers that repeat their prompt, as the local model's do: the rendered
    prompt of each turn, a line with a date word and the turn's text."""
    conv = conversations(spark, sf)
    echo = F.concat(P.fill(P.STANDARD_TEMPLATE, query=F.col("text"), context=F.col("role")),
                    F.lit("Today Date: none\n"), F.col("text"))
    return conv.select("conv_id", "turn", P.clean_answer(echo).alias("answer"))


def q_compare_answers(spark, sf):
    """P8 + P9: one row per query with its context and a cleaned cell per model; a failed call
    shows in its own cell, a failed retrieval (queries of every seventh conversation) in all."""
    from corpus_engine.plans.qa import compare
    got = answers(spark, sf)
    conv = F.split_part("query_id", F.lit(":"), F.lit(1)).cast("bigint")
    asked = got.select("query_id").distinct().select(
        "query_id", F.concat(F.lit("context of "), F.col("query_id")).alias("context"),
        F.when(conv % 7 == 0, F.lit("no collection")).alias("error"))
    return compare(got, asked)


# --- statistics ---------------------------------------------------------------------------------------

def q_corpus_stats(spark, sf):
    """G1: corpus statistics."""
    return S.corpus_stats(documents(spark, sf))


def q_stage_stats(spark, sf):
    """Statistics before and after cleaning."""
    return S.stage_stats({"process": documents(spark, sf), "clean": cleaned(spark, sf)})


def q_stage_counts(spark, sf):
    """Rows per stage."""
    docs = documents(spark, sf).filter(F.col("text") != "")
    clean = CL.clean_text(docs, with_isbn=False)
    saved = clean.filter(T.safe_filename(F.col("doc_id").cast("string")).isNotNull())
    return S.stage_counts(docs, clean, saved)


# --- files, ingestion ------------------------------------------------------------------------------------

def q_file_info(spark, sf):
    """Base name and extension of each page URL."""
    return page_files(spark, sf).select("page_id", FI.base_name("url").alias("name"),
                                        FI.extension("url").alias("ext"))


def q_validate_extension(spark, sf):
    """Supported-type check with a reject reason, over page names given an extension by page_id."""
    from corpus_engine.sources.files import validate_extension
    kinds = F.array(*[F.lit(e) for e in (".pdf", ".docx", ".PPTX", ".txt", ".jpg")])
    path = F.concat("url", F.element_at(kinds, (F.col("page_id") % 5 + 1).cast("int")))
    info = page_files(spark, sf).select("page_id", FI.base_name(path).alias("name"), FI.extension(path).alias("ext"))
    return validate_extension(info, "ext").select("page_id", "name", "ext", "valid", "reject_reason")


def q_safe_filename(spark, sf):
    """K3: safe output names with collision flags."""
    from corpus_engine.sources.sinks import with_safe_names
    return with_safe_names(table(spark, sf, "pages").select("page_id", "url"), "url") \
        .select("page_id", "safe_name", "collision")


def q_html_to_text(spark, sf):
    """X1 (re-aimed to HTML): visible text of each page."""
    return H.with_text(balance(table(spark, sf, "pages").select("page_id", "html")))


def q_page_text(spark, sf):
    """X1 by the tag tokeniser: text of each page, one line per block element."""
    return balance(table(spark, sf, "pages")).select("page_id", PG.page_text("html").alias("text"))


def q_page_markdown(spark, sf):
    """X3 by the tag tokeniser: Markdown with nested lists, quotes, tables and preformatted text."""
    return balance(table(spark, sf, "pages")).select("page_id", PG.page_markdown("html").alias("markdown"))


def q_markdown_files(spark, sf):
    """K4: output names and per-file errors of the Markdown conversion."""
    from corpus_engine.sources.sinks import markdown_outputs
    return markdown_outputs(page_files(spark, sf), "url", "html").select("path", "md_path", "error")


def q_extractive_answers(spark, sf):
    """Offline answerer (top-ranked retrieved text)."""
    hits = R.retrieve_dedup(corpus(spark, sf), questions(spark, sf).select("query_id", "embedding"),
                            DEFAULTS.top_k_app, DEFAULTS.overfetch_factor)
    return A.extractive_answers(hits)


def q_html_to_markdown(spark, sf):
    """X3 (re-aimed to HTML): Markdown of each page."""
    return balance(table(spark, sf, "pages")).select("page_id", H.html_to_markdown("html").alias("markdown"))


def _ledger(spark, sf):
    return page_files(spark, sf).filter(F.col("url").startswith("http://")).select("filename").distinct()


def _new_files(spark, sf):
    batch = page_files(spark, sf).select("filename", "page_id")
    return I.new_files(batch, _ledger(spark, sf), "filename")


def q_ingest_new_files(spark, sf):
    """Batch files not in the ledger, one per name."""
    return _new_files(spark, sf).select("filename", "page_id")


def q_ledger_merge(spark, sf):
    """K9: the ledger after the batch."""
    return I.ledger_merge(_ledger(spark, sf), _new_files(spark, sf), "filename")


def _page_units(spark, sf):
    """Page rows as the units of files: rows that share a file name are that file's pages."""
    return page_files(spark, sf).select("filename", "page_id", H.html_to_text("html").alias("text"))


def q_upload_chunks(spark, sf):
    """X2 + K7: word-packed chunks per page with ids numbered through each file."""
    up = I.upload_chunks(_page_units(spark, sf))
    return up.select("filename", "chunk_index", "id", "text", F.col("metadata")["source"].alias("source"))


def q_upload_status(spark, sf):
    """The status of uploading all pages twice: the second run finds every file in the ledger."""
    from corpus_engine.plans.upload import upload
    base = _scratch(spark, "upload")
    runs = [upload(spark, _page_units(spark, sf), f"{base}/collection", f"{base}/ledger", EMBEDDER) for _ in range(2)]
    rows = [(i + 1, r.new_files, r.total_chunks, r.skipped_files) for i, r in enumerate(runs)]
    out = spark.createDataFrame(rows, "run int, new_files bigint, total_chunks bigint, skipped_files bigint")
    return out.withColumn("status", S.upload_status(F.col("new_files"), F.col("total_chunks"), F.col("skipped_files")))


def q_upload_retrieve(spark, sf):
    """E3 + K7 + R1: pages uploaded with their vectors, then the questions' nearest chunks."""
    from corpus_engine.plans.upload import upload
    base = _scratch(spark, "upload")
    upload(spark, _page_units(spark, sf), f"{base}/collection", f"{base}/ledger", EMBEDDER)
    stored = spark.read.parquet(f"{base}/collection")
    return R.knn_exact(stored, questions(spark, sf).select("query_id", "embedding"), DEFAULTS.top_k_loader, carry=())


def q_insert_if_absent(spark, sf):
    """K5 on the stored, bucketed collection: seed it with the fixed-size chunks of the
    English documents, then add the sentence chunks of all documents; ids already present
    keep their first text. Only the incoming batches are shuffled by the anti-join."""
    from corpus_engine.sources.collection import BucketedCollection
    schema = "id string, doc_id string, chunk_index int, text string"
    coll = BucketedCollection(spark, _scratch(spark, "collection"), schema=schema)
    docs = documents(spark, sf)
    cols = ["id", F.col("doc_id").cast("string").alias("doc_id"), "chunk_index", "text"]
    coll.insert_if_absent(C.chunk_fixed(docs.filter(F.col("lang") == "en")).select(*cols))
    coll.insert_if_absent(C.chunk_sentence(docs).select(*cols))
    return coll.read()


def q_collection_compacted(spark, sf):
    """K5/K6: four appended batches of sentence chunks, compacted to one file a bucket, and a batch that adds nothing."""
    from corpus_engine.sources.collection import BucketedCollection
    schema = "id string, doc_id string, chunk_index int, text string"
    coll = BucketedCollection(spark, _scratch(spark, "collection"), buckets=16, schema=schema)
    rows = C.chunk_sentence(documents(spark, sf)).select("id", "doc_id", "chunk_index", "text")
    for part in range(4):
        coll.insert_if_absent(rows.where(F.col("doc_id") % 4 == part).withColumn("doc_id", F.col("doc_id").cast("string")))
    coll.compact()
    coll.insert_if_absent(rows.where(F.col("doc_id") % 4 == 1).withColumn("doc_id", F.col("doc_id").cast("string")))
    return coll.read()


def q_dedup_batches(spark, sf):
    """R6 by the stored key index: the documents in two batches, in order of ids."""
    from corpus_engine.operators.dedup_index import DedupIndex
    index = DedupIndex(spark, _scratch(spark, "dedup_index"))
    docs = documents(spark, sf).select("doc_id", "text")
    half = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    kept = [index.add(docs.where(part), n, "doc_id") for n, part in enumerate((F.col("doc_id") <= half, F.col("doc_id") > half))]
    return kept[0].unionByName(kept[1])


def q_sketch_statistics(spark, sf):
    """G1/G2 from stored sketches, one batch a language: exact counts, and whether quantiles and distinct words are within their bounds."""
    from corpus_engine.operators import sketches as SK
    docs = documents(spark, sf)
    path = _scratch(spark, "sketches")
    for lang in [r[0] for r in docs.select("lang").distinct().orderBy("lang").collect()]:
        SK.batch_sketch(docs.where(F.col("lang").eqNullSafe(F.lit(lang))), str(lang)).write.mode("append").parquet(path)
    found = SK.statistics(SK.merged(spark.read.parquet(path))).first()  # one row
    n = F.coalesce(T.word_count("text"), F.lit(0).cast("bigint"))
    counts = docs.select(n.alias("n"))
    within = [((F.count(F.when(F.col("n") < found[f"q{q}"], 1)) <= (q / 100 + 0.02) * F.count("*"))
               & (F.count(F.when(F.col("n") <= found[f"q{q}"], 1)) >= (q / 100 - 0.02) * F.count("*"))).alias(f"q{q}_within") for q in (25, 50, 75, 95)]
    distinct = docs.select(F.explode(T.words("text")).alias("w")).agg(F.count_distinct("w").alias("d")).first()["d"]
    exact = [F.lit(found["n_docs"]).alias("n_docs"), F.round(F.lit(found["average_words"]), 6).alias("average_words"),
             F.lit(found["min_words"]).cast("bigint").alias("min_words"), F.lit(found["max_words"]).cast("bigint").alias("max_words")]
    return counts.agg(*within).select(*exact, "*", F.lit(abs(found["distinct_words"] - distinct) <= 0.06 * distinct).alias("distinct_within"))


def q_answer_from_collection(spark, sf):
    """End to end on the production path: documents indexed into a stored, bucketed
    collection (embedder stamped), then the benchmark questions answered from it."""
    from corpus_engine.plans.index_build import build_index
    from corpus_engine.plans.qa import answer_questions
    path = _scratch(spark, "qa_collection")
    build_index(spark, documents(spark, sf).select(F.col("doc_id").alias("id"), "text"), path, embedder=EMBEDDER)
    qs = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return answer_questions(spark.read.parquet(path), qs, EMBEDDER, collection_path=path).contexts


def q_stream_ingest(spark, sf):
    """Incremental ingestion stream, run three times (two file drops, then nothing new)."""
    from corpus_engine.streaming.ingest import ingest_documents_once
    return ingest_documents_once(spark, sf)


def q_stream_uploads(spark, sf):
    """I1 within I2: pages in three drops that repeat file names; a file counts with the pages of its first drop."""
    from corpus_engine.streaming.uploads import UploadStream
    base = _scratch(spark, "stream_uploads")
    stream = UploadStream(spark, f"{base}/state", EMBEDDER)
    pages = _page_units(spark, sf)
    for drop in range(3):
        pages.where(F.col("page_id") % 3 <= drop).write.mode("append").parquet(f"{base}/source")
        stream.run(f"{base}/source")
    first = stream.ledger.read().select(F.col("filename").alias("doc_id"), F.col("epoch").cast("int").alias("drop"))
    return stream.collection.read().select("id", "doc_id", "chunk_index", "text").join(first, "doc_id")


# --- files written under the shared folder and read back --------------------------------

def _scratch(spark, name: str) -> str:
    from corpus_engine.session import scratch_path
    return scratch_path(spark, name)


def q_scan_text_files(spark, sf):
    """K3 + S1: cleaned documents written one text file per safe name, then scanned back
    whole (the text writer ends each file with a newline)."""
    from corpus_engine.sources.files import scan_text_files
    from corpus_engine.sources.sinks import write_text_files
    base = _scratch(spark, "texts")
    named = cleaned(spark, sf).withColumn("safe_name", T.safe_filename(F.col("doc_id").cast("string")))
    write_text_files(named, base)
    scanned = scan_text_files(spark, base, glob="*.txt", recursive=True)
    return scanned.select(F.col("id").alias("safe_name"), "text")


def q_scan_binary_files(spark, sf):
    """Pages written as files, scanned back as bytes with name and extension."""
    from corpus_engine.sources.files import scan_binary_files
    from corpus_engine.sources.sinks import write_text_files
    base = _scratch(spark, "pages")
    # the operator reads whole files, so this query needs a file per page: its input is made one
    named = table(spark, sf, "pages").select(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(".txt")).alias("name"), "html")
    write_text_files(named, base, "name", "html")
    scanned = scan_binary_files(spark, base, glob="*.txt", recursive=True, extensions=(".txt",))
    return scanned.select(FI.stem("name").try_cast("bigint").alias("page_id"),
                          "ext", F.length("content").cast("bigint").alias("n_bytes"))


def q_scan_convertible_files(spark, sf):
    """S3: pages written as files with several extensions, in either case; the scan takes the convertible ones."""
    from corpus_engine.sources.files import scan_convertible_files
    base = _scratch(spark, "convertible")
    ids = table(spark, sf, "pages").select("page_id")
    for n, ext in enumerate(("pdf", "PNG", "txt", "Jpg", "csv", "pdF")):
        ids.where(F.col("page_id") % 6 == n).write.mode("append").option("extension", ext).csv(base)
    scanned = scan_convertible_files(spark, base)
    return scanned.groupBy("ext").agg(F.sum(F.length("content")).alias("n_bytes"))


def q_stage_reload(spark, sf):
    """The cleaned stage is written once and reloaded on the second call."""
    from corpus_engine.sources.files import stage_reload
    path = _scratch(spark, "stage")
    stage_reload(spark, path, lambda: cleaned(spark, sf))
    return stage_reload(spark, path, lambda: cleaned(spark, sf))


def q_write_report(spark, sf):
    """K2: papers and statistics written as JSON datasets; the statistics read back."""
    from corpus_engine.sources.sinks import write_report
    path = _scratch(spark, "report")
    clean = cleaned(spark, sf)
    write_report(clean, S.corpus_stats(clean), path)
    return spark.read.schema("total_papers bigint, average_word_count double, min_word_count bigint, "
                             "max_word_count bigint").json(f"{path}/statistics")


def q_collection_write(spark, sf):
    """K5/K6: sentence chunks appended to the collection."""
    from corpus_engine.sources.sinks import write_collection
    path = _scratch(spark, "collection")
    write_collection(sentence_chunks(spark, sf).select("id", "doc_id", "chunk_index", "text"), path, mode="overwrite")
    return spark.read.parquet(path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}
