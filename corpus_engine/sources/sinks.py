"""Sinks: stage outputs, the statistics report, per-document texts, the collection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpus_engine.functions.files import stem
from corpus_engine.functions.html import html_to_markdown
from corpus_engine.functions.text import safe_filename
from corpus_engine.operators.ingest import first_per_key, ledger_additions, salted_join
from corpus_engine.session import ship_package
from corpus_engine.sources.files import path_exists

#: Files of one folder that :func:`write_text_files` makes.
FOLDER_FILES = 2000


def write_stage(df: DataFrame, path: str) -> None:
    """K1: always overwrite."""
    df.write.mode("overwrite").parquet(path)


def write_report(papers: DataFrame, stats: DataFrame | None, path: str) -> None:
    """K2: papers and statistics as two JSON datasets (the papers are never gathered
    into one row)."""
    papers.write.mode("overwrite").json(f"{path}/papers")
    if stats is not None:
        stats.coalesce(1).write.mode("overwrite").json(f"{path}/statistics")


def with_safe_names(df: DataFrame, id_col: str = "id") -> DataFrame:
    """K3 naming: ``safe_name`` and a ``collision`` flag for ids that sanitise alike.

    Names are counted map-side; only names met twice or more are replicated for the salted
    join back, so unique names cost nothing and a name shared by a third of all rows is spread
    over many tasks."""
    named = df.withColumn("safe_name", safe_filename(F.col(id_col)))
    shared = named.groupBy("safe_name").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return (salted_join(named, shared, "safe_name", "left")
            .withColumn("collision", F.col("__n").isNotNull()).drop("__n"))


def write_texts(df: DataFrame, path: str, id_col: str = "id", text: str = "text") -> int:
    """K3: write one text per safe name; rows with an empty name are skipped. Returns the
    number of texts saved. Texts go to a Parquet table keyed by ``safe_name`` (one file per
    document does not scale). Of colliding names the smallest id is saved; the ids that were
    not are listed in the table ``<path>_collisions``."""
    named = with_safe_names(df, id_col).filter(F.col("safe_name").isNotNull())
    single = named.filter(~F.col("collision")).select("safe_name", text)
    shared = named.filter("collision")
    first = shared.groupBy("safe_name").agg(F.min(id_col).alias("__first"))
    kept = first_per_key(shared.select("safe_name", id_col, text), "safe_name", order=id_col)
    single.unionByName(kept.select("safe_name", text)).write.mode("overwrite").parquet(path)
    lost = salted_join(shared.select("safe_name", id_col), first, "safe_name", "inner").filter(
        F.col(id_col) != F.col("__first")).select("safe_name", id_col)
    lost.write.mode("overwrite").parquet(f"{path}_collisions")
    return df.sparkSession.read.parquet(path).count()


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a full path, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _write_files(uri: str):
    """(name, body) sorted by name to files, in folders of a task that appear when it has ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(uri)
        task = TaskContext.get()
        # scans pass over names that begin with an underscore: a task that fails leaves nothing to read
        own, final = f"{root}/_{task.taskAttemptId()}", f"{root}/{task.partitionId()}"
        files, last, out = 0, None, None
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != last:
                    if out is not None:
                        out.close()
                    folder = f"{own}/{files // FOLDER_FILES}"
                    if files % FOLDER_FILES == 0:
                        fs.create_dir(folder, recursive=True)
                    out, last = fs.open_output_stream(f"{folder}/{name}"), name
                    files += 1
                out.write((body or b"") + b"\n")
        if out is not None:
            out.close()
            if fs.get_file_info(final).type == pafs.FileType.NotFound:  # else an earlier attempt of the task has ended
                fs.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    return run


def write_text_files(df: DataFrame, path: str, name: str = "safe_name", text: str = "text") -> int:
    """K3 as the reference has it: one file ``name`` per text, each text ended by a newline; rows without a name are
    skipped. Returns the number of files. Equal names met in one task are one file, in several tasks several.

    Tasks make the files themselves, in folders of ``FOLDER_FILES``, and move them to their place as one folder a
    task. Spark's partitioned writer makes a folder per file instead, sets the rights of both by a command of their own
    on local disks, and moves every folder again from the driver."""
    spark = df.sparkSession
    ship_package(spark)
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hpath)
    full = fs.makeQualified(hpath)
    uri = full.toString() if full.toUri().getScheme() == "file" else full.toUri().toString()
    rows = df.where(F.col(name).isNotNull()).select(name, F.col(text).cast("binary")).sortWithinPartitions(name)
    return rows.mapInArrow(_write_files(uri), "files long").agg(F.sum("files")).first()[0] or 0


def write_collection(df: DataFrame, path: str, mode: str = "append") -> None:
    """K5/K6: append to the collection. File sizes follow the partitions' bytes (the reference's
    5,000 rows are a limit of one client call, not a file size)."""
    df.write.mode(mode).parquet(path)


def append_ledger(spark: SparkSession, path: str, processed: DataFrame, name: str = "filename") -> int:
    """K9 sink: add the batch's names that the stored ledger lacks, after the chunks are
    written; returns how many. A rerun adds nothing."""
    fresh = ledger_additions(read_ledger(spark, path, name), processed, name)
    seen = Observation("ledger")
    fresh.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return int(seen.get["rows"])


def read_ledger(spark: SparkSession, path: str, name: str = "filename") -> DataFrame:
    """The stored ledger; empty before its first batch."""
    if path_exists(spark, path):
        return spark.read.schema(f"{name} string").parquet(path)
    return spark.createDataFrame([], f"{name} string")


def markdown_outputs(df: DataFrame, path: str = "path", content: str = "html") -> DataFrame:
    """``(path, md_path, markdown, error)``: the output name is ``<stem>.md``; a file
    that cannot be read or converts to nothing gets an error instead of stopping the rest."""
    md = html_to_markdown(F.col(content))
    return df.select(F.col(path).alias("path"), F.concat(stem(F.col(path)), F.lit(".md")).alias("md_path"),
                     md.alias("markdown")) \
        .withColumn("error", F.when(F.col("markdown").isNull(), F.lit("unreadable file"))
                    .when(F.col("markdown") == "", F.lit("no content converted")))


def write_markdown(df: DataFrame, path: str) -> None:
    """K4 sink: converted documents keyed by md_path (failed ones are skipped)."""
    df.filter(F.col("error").isNull()).select("md_path", "markdown").write.mode("overwrite").parquet(path)
