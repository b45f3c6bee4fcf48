"""corpus_engine: corpus preparation and retrieval as Spark DataFrame operators.

Layout:
  functions/  Column -> Column expressions (text rules, vectors, HTML, prompts, file names)
  operators/  DataFrame -> DataFrame operators (clean, chunk, embed, retrieve, answer, stats, ingest)
  sources/    readers and writers (text/binary files, stage outputs, the chunk collection)
  plans/      end-to-end compositions of operators (prepare corpus, build index, answer questions)
  streaming/  incremental ingestion with Structured Streaming
"""

from corpus_engine.config import DEFAULTS, Config


def __getattr__(name):
    # end-to-end plans, imported on first use (keeps ``import corpus_engine`` light)
    if name == "prepare_corpus":
        from corpus_engine.plans.corpus_prep import prepare_corpus
        return prepare_corpus
    if name == "build_index":
        from corpus_engine.plans.index_build import build_index
        return build_index
    if name in ("answer_questions", "compare"):
        from corpus_engine.plans import qa
        return getattr(qa, name)
    raise AttributeError(name)


__all__ = ["Config", "DEFAULTS", "prepare_corpus", "build_index", "answer_questions", "compare"]
