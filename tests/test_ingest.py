"""Insert-if-absent, ledger, upload chunks, entity removal, incremental streaming ingest."""

import tempfile

import pytest
from pyspark.sql import functions as F

from corpus_engine.operators import entities as EN
from corpus_engine.operators import ingest as I
from corpus_engine.sources.files import COLLECTION_SCHEMA
from corpus_engine.streaming.ingest import run_ingest


def test_insert_if_absent_idempotent(spark):
    existing = spark.createDataFrame([("a", "old")], "id string, text string")
    incoming = spark.createDataFrame([("a", "new"), ("b", "x"), ("b", "x")], "id string, text string")
    once = I.insert_if_absent(existing, incoming)
    twice = I.insert_if_absent(once, incoming)
    assert sorted(map(tuple, once.collect())) == [("a", "old"), ("b", "x")]
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_skip_processed_files(spark):
    ledger = spark.createDataFrame([("a.pdf",)], "filename string")
    batch = spark.createDataFrame([("a.pdf", 1), ("b.pdf", 2), ("b.pdf", 3)], "filename string, n int")
    new = I.new_files(batch, ledger).collect()
    assert [(r["filename"], r["n"]) for r in new] == [("b.pdf", 2)]
    assert I.skipped_count(batch, ledger).first()[0] == 1
    merged = sorted(r[0] for r in I.ledger_merge(ledger, I.new_files(batch, ledger)).collect())
    assert merged == ["a.pdf", "b.pdf"]


def test_upload_chunks_index_runs_across_pages(spark):
    df = spark.createDataFrame([("f.pdf", 4, "aaa bb cc"), ("f.pdf", 5000, "dd ee"), ("g.pdf", 7, "x"), ("f.pdf", 5001, None),
                                ("f.pdf", 5002, "z")], "filename string, page_id long, text string")
    out = I.upload_chunks(df, size=5).orderBy("filename", "chunk_index").collect()
    assert [(r["chunk_index"], r["text"], r["id"], r["metadata"]["source"]) for r in out] == [
        (0, "aaa", "pdf_chunk_f.pdf_0", "f.pdf_chunk_0"),
        (1, "bb cc", "pdf_chunk_f.pdf_1", "f.pdf_chunk_1"),
        (2, "dd ee", "pdf_chunk_f.pdf_2", "f.pdf_chunk_2"),
        (3, "z", "pdf_chunk_f.pdf_3", "f.pdf_chunk_3"),
        (0, "x", "pdf_chunk_g.pdf_0", "g.pdf_chunk_0")]


def test_upload_chunks_of_repeated_and_null_keys(spark):
    """Every row's chunks are there, whatever its file name and page number, under ids that are unique."""
    rows = [("f", 1, "aaa bbb ccc"), ("f", 1, "aaa bbb ccc"), ("f", None, "x y z"), ("f", None, "x y z"), (None, 1, "n"), (None, None, "m"),
            ("f", 9000, "end")] + [("g", None, "one")] * 50
    out = I.upload_chunks(spark.createDataFrame(rows, "filename string, page_id long, text string").repartition(3), size=5).collect()
    of = lambda name: [r["text"] for r in sorted((r for r in out if r["filename"] == name), key=lambda r: r["chunk_index"])]
    assert of("f") == ["x y z"] * 2 + ["aaa", "bbb", "ccc"] * 2 + ["end"]
    assert of("") == ["m", "n"] and of("g") == ["one"] * 50
    assert len({r["id"] for r in out}) == len(out)
    for name in ("f", "", "g"):
        assert sorted(r["chunk_index"] for r in out if r["filename"] == name) == list(range(len(of(name))))


def test_upload_ids_are_unique(spark):
    from helpers import SF01
    from corpus_engine.plans.queries import QUERIES
    up = QUERIES["upload_chunks"](spark, SF01)
    assert up.count() == up.select("id").distinct().count() > 0


def test_new_files_by_last_segment(spark):
    from helpers import SF01
    from corpus_engine.plans.queries import QUERIES
    names = [r["filename"] for r in QUERIES["ingest_new_files"](spark, SF01).collect()]
    assert len(names) == len(set(names)) == 159 and "" not in names


def test_reopening_with_another_layout_is_refused(spark):
    from corpus_engine.sources.collection import BucketedCollection

    path = tempfile.mkdtemp(prefix="layout-", dir="/tmp") + "/c"
    schema = "id string, text string"
    rows = spark.createDataFrame([(f"i{i}", "t") for i in range(100)], schema)
    assert BucketedCollection(spark, path, 8, schema).insert_if_absent(rows) == 100
    assert BucketedCollection(spark, path, schema=schema).insert_if_absent(rows) == 0
    with pytest.raises(ValueError, match="8 buckets"):
        BucketedCollection(spark, path, 16, schema)


def test_write_texts_reports_collisions(spark):
    from corpus_engine.sources.sinks import write_texts

    path = tempfile.mkdtemp(prefix="texts-", dir="/tmp") + "/t"
    df = spark.createDataFrame([("a-b", "1"), ("a_b", "2"), ("c", "3"), ("", "4")], "id string, text string")
    assert write_texts(df, path) == 2
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a_b.txt", "1"), ("c.txt", "3")]
    assert [tuple(r) for r in spark.read.parquet(f"{path}_collisions").collect()] == [("a_b.txt", "a_b")]


def test_scanned_names_are_as_stored(spark):
    from corpus_engine.sources.files import scan_convertible_files, scan_text_files

    base = tempfile.mkdtemp(prefix="names-", dir="/tmp")
    for n in ("a b%é.txt", "plus+sign.txt", "Report.PDF", "x.Docx", "note.md"):
        with open(f"{base}/{n}", "w") as fh:
            fh.write("x")
    assert sorted(r["id"] for r in scan_text_files(spark, base).collect()) == ["a b%é.txt", "plus+sign.txt"]
    assert sorted((r["name"], r["ext"]) for r in scan_convertible_files(spark, base).collect()) == [
        ("Report.PDF", ".pdf"), ("x.Docx", ".docx")]


def _rows_dir(spark, name, rows, schema, parts=3):
    """A table folder that holds one table of the given rows."""
    base = tempfile.mkdtemp(prefix="rows-", dir="/tmp")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{base}/{name}.parquet")
    return base


def test_text_files_share_folders(spark):
    """A folder per file costs a listing task each."""
    from corpus_engine.plans.queries import QUERIES

    rows = [(i, f"the text of the document number {i}.", "en") for i in range(300)] + [(None, "It has no name.", "en")]
    out = QUERIES["scan_text_files"](spark, _rows_dir(spark, "documents", rows, "doc_id long, text string, lang string"))
    files = out.inputFiles()
    assert len(files) == 300 and len({f.rsplit("/", 1)[0] for f in files}) <= 16
    got = {r["safe_name"]: r["text"] for r in out.collect()}
    assert len(got) == 300 and all(got[f"{i}.txt"] == f"the text of the document number {i}.\n" for i in range(300))


def test_page_files_share_folders(spark):
    """Pages without a number, or with one below zero, are pages too."""
    from corpus_engine.plans.queries import QUERIES

    rows = [(i, "u", "é" * i) for i in range(200)] + [(-7, "u", "x"), (None, "u", "xyz"), (1000, "u", None)]
    out = QUERIES["scan_binary_files"](spark, _rows_dir(spark, "pages", rows, "page_id long, url string, html string"))
    assert len({f.rsplit("/", 1)[0] for f in out.inputFiles()}) <= 16
    want = [(i, ".txt", 2 * i + 1) for i in range(200)] + [(-7, ".txt", 2), (None, ".txt", 4), (1000, ".txt", 1)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_text_files_of_equal_names_and_full_folders(spark, monkeypatch):
    """Texts of one name in a task are one file; a task that fails leaves nothing to read; a space in a path stays."""
    from pyspark.errors import PySparkException

    from corpus_engine.sources import sinks
    from corpus_engine.sources.files import scan_text_files

    monkeypatch.setattr(sinks, "FOLDER_FILES", 2)
    base = tempfile.mkdtemp(prefix="files-", dir="/tmp") + "/a b"
    rows = [("b.txt", "1"), ("a.txt", "x\ny"), ("b.txt", "1"), (None, "z"), ("c.txt", None), ("d.txt", ""), ("e.txt", "é")]
    df = spark.createDataFrame(rows, "safe_name string, text string").coalesce(1)
    assert sinks.write_text_files(df, base) == 5
    got = sorted((r["id"], r["text"]) for r in scan_text_files(spark, base, recursive=True).collect())
    assert got == [("a.txt", "x\ny\n"), ("b.txt", "1\n1\n"), ("c.txt", "\n"), ("d.txt", "\n"), ("e.txt", "é\n")]
    bad = tempfile.mkdtemp(prefix="files-", dir="/tmp")
    with pytest.raises(PySparkException):
        sinks.write_text_files(spark.createDataFrame([("a.txt", "x"), ("no/where.txt", "y")], "safe_name string, text string").coalesce(1), bad)
    assert scan_text_files(spark, bad, recursive=True).count() == 0
    none = tempfile.mkdtemp(prefix="files-", dir="/tmp") + "/new"
    assert sinks.write_text_files(df.where("text = 'no such'"), none) == 0
    assert scan_text_files(spark, none, recursive=True).count() == 0


def test_scans_of_small_files_are_few_tasks(spark):
    """Spark counts a file as 4 MB at least; whatever the bytes, a .txt file's text is what the text reader gives."""
    from corpus_engine.sources import files as S

    base = tempfile.mkdtemp(prefix="small-", dir="/tmp")
    odd = [b"", b"\xef\xbb\xbfmark", b"bad \xff\xfe bytes", b"a\r\nb\rc\n\n", b"nul \x00 byte", "é".encode()]
    for i in range(500):
        with open(f"{base}/{i}.txt", "wb") as fh:
            fh.write(odd[i % len(odd)])
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))
    try:
        most = S.SCAN_TASKS * spark.sparkContext.defaultParallelism
        assert S.scan_text_files(spark, base).rdd.getNumPartitions() <= most
        assert S.scan_binary_files(spark, base, "*.txt").rdd.getNumPartitions() <= most
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    hexed = F.hex(F.col("text").cast("binary")).alias("hexed")
    plain = spark.read.text(base, wholetext=True).select(F.regexp_extract("_metadata.file_name", "(.*)", 1), F.hex(F.col("value").cast("binary")))
    scanned = sorted(map(tuple, S.scan_text_files(spark, base).select("id", hexed).collect()))
    assert scanned == sorted(map(tuple, plain.collect())) and len(scanned) >= 400  # Spark passes over empty files
    assert scanned == sorted(map(tuple, S.scan_text_files(spark, base, glob="*.t?t").select("id", hexed).collect()))


def test_document_qualified_ids_keep_both_documents(spark):
    """K8: per-document counters would give both documents the id chunk_0 and lose one."""
    from corpus_engine.plans.index_build import build_index

    path = tempfile.mkdtemp(prefix="ids-", dir="/tmp") + "/c"
    papers = spark.createDataFrame([("a", "First text."), ("b", "Second text.")], "id string, text string")
    assert build_index(spark, papers, path) == 2
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["a_chunk_0", "b_chunk_0"]


def test_entity_removal_edges(spark):
    docs = spark.createDataFrame([(1, "in paris, parisian"), (2, "nl ##ris")], "doc_id long, text string")
    ents = spark.createDataFrame([(1, "paris", "B-LOC"), (2, "nl", "B-PER"), (2, "##ris", "B-LOC"),
                                  (1, "in", "B-LOC")], "doc_id long, word string, entity string")
    got = dict(map(tuple, EN.remove_entities(docs, ents).collect()))
    assert got == {1: "in , ian", 2: "nl ##ris"}


def test_entity_order_longest_first(spark):
    docs = spark.createDataFrame([(1, "new york and york")], "doc_id long, text string")
    ents = spark.createDataFrame([(1, "york", "B-LOC"), (1, "new york", "B-LOC")], "doc_id long, word string, entity string")
    assert EN.remove_entities(docs, ents).first()["text"] == " and "


def test_gazetteer_annotation(spark):
    names = spark.createDataFrame([("UNITED STATES",), ("FRANCE",)], "name string")
    gz = EN.gazetteer_from_names(names, "name")
    docs = spark.createDataFrame([(1, "from france to united states")], "doc_id long, text string")
    got = sorted(map(tuple, EN.annotate_entities(docs, gz).collect()))
    assert got == [(1, "france", "B-LOC"), (1, "states", "I-LOC"), (1, "united", "B-LOC")]


def test_stream_ingest_runs_are_idempotent(spark):
    base = tempfile.mkdtemp(prefix="ingest-", dir="/tmp")
    src, coll, ckpt = f"{base}/src", f"{base}/coll", f"{base}/ckpt"
    mk = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    mk([(1, "File a."), (2, "File b.")]).write.mode("append").parquet(src)
    run_ingest(spark, src, coll, ckpt)
    n1 = spark.read.schema(COLLECTION_SCHEMA).parquet(coll).count()
    run_ingest(spark, src, coll, ckpt)
    n2 = spark.read.schema(COLLECTION_SCHEMA).parquet(coll).count()
    mk([(3, "File c.")]).write.mode("append").parquet(src)
    run_ingest(spark, src, coll, ckpt)
    n3 = spark.read.schema(COLLECTION_SCHEMA).parquet(coll).count()
    assert (n1, n2, n3) == (2, 2, 3)
    # a replayed batch (same files, fresh checkpoint) adds nothing
    run_ingest(spark, src, coll, f"{base}/ckpt2")
    assert spark.read.schema(COLLECTION_SCHEMA).parquet(coll).select(F.countDistinct("id")).first()[0] == 3
    assert spark.read.schema(COLLECTION_SCHEMA).parquet(coll).count() == 3


def test_salted_join_equals_plain_join_on_hot_key(spark):
    big = spark.range(0, 3000).select((F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                        .otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))).alias("k"),
                                       F.col("id").alias("v"))
    small = big.groupBy("k").count()
    plain = sorted(map(tuple, big.join(small, "k", "left").collect()))
    salted = sorted(map(tuple, I.salted_join(big, small, "k", "left", salts=8).select("k", "v", "count").collect()))
    assert plain == salted
    semi = I.salted_join(big, small.filter("k = 'hot'").select("k"), "k", "left_semi").count()
    assert semi == 1000


def test_stream_in_bounded_micro_batches(spark):
    base = tempfile.mkdtemp(prefix="ingest-mb-", dir="/tmp")
    src, coll, ckpt = f"{base}/src", f"{base}/coll", f"{base}/ckpt"
    for i in range(4):  # four files
        spark.createDataFrame([(i, f"File {i}. Second {i}.")], "doc_id long, text string") \
            .coalesce(1).write.mode("append").parquet(src)
    run_ingest(spark, src, coll, ckpt, max_files_per_trigger=1)
    assert spark.read.schema(COLLECTION_SCHEMA).parquet(coll).count() == 4


def test_annotation_takes_null_words_and_any_key(spark):
    gz = spark.createDataFrame([("france", "B-LOC"), (None, "B-LOC"), ("peru", "B-LOC"), ("peru", "B-PER")],
                               "word string, entity string")
    docs = spark.createDataFrame([("k1", "from france to peru"), ("k2", None)], "doc_id string, text string")
    got = sorted(map(tuple, EN.annotate_entities(docs, gz).collect()))
    assert got == [("k1", "france", "B-LOC"), ("k1", "peru", "B-LOC"), ("k1", "peru", "B-PER")]
    left = dict(map(tuple, EN.remove_gazetteer_entities(docs, gz).select("doc_id", "text").collect()))
    assert left == {"k1": "from  to ", "k2": None}
    assert EN.annotate_entities(docs, gz.limit(0)).dtypes[0] == ("doc_id", "string")
