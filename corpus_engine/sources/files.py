"""File sources: whole-text scans, binary scans, file info, extension checks, stage reload."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULTS
from corpus_engine.functions.files import base_name, extension, has_extension

#: Tasks per core of a scan, at most. Spark counts a file as 4 MB at least, so small files make a task for every few of them.
SCAN_TASKS = 32
COLLECTION_SCHEMA = "id string, doc_id string, chunk_index int, text string, embedding array<float>"


def scan_text_files(spark: SparkSession, path: str, glob: str = "*.txt",
                    recursive: bool = False) -> DataFrame:
    """One row per file ``(id = file name, text)``, read whole, UTF-8; the glob is
    case-sensitive and the listing is not recursive unless asked."""
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    if glob.endswith(".txt"):
        # the same rows: the text reader copies the session's configuration for every file, and unpacks files of other endings
        df = reader.format("binaryFile").load(path).withColumn("value", F.col("content").cast("string"))
    else:
        df = reader.text(path, wholetext=True)
    # the metadata's names are URL-encoded but for a plus sign, which stands for itself
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return _in_fewer_tasks(df.select(name.alias("id"), F.col("value").alias("text"),
                                     F.col("_metadata.file_path").alias("path")))


def _in_fewer_tasks(scan: DataFrame) -> DataFrame:
    return scan.coalesce(SCAN_TASKS * scan.sparkSession.sparkContext.defaultParallelism)


def scan_binary_files(spark: SparkSession, path: str, glob: str | None = "*.pdf",
                      recursive: bool = True, extensions: Sequence[str] | None = None) -> DataFrame:
    """``(path, name, ext, content)`` for every file; ``glob`` is case-sensitive,
    ``extensions`` (lower-cased, with dot) is a case-insensitive filter."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path).select("path", base_name("path").alias("name"), extension("path").alias("ext"), "content")
    if extensions:
        df = df.filter(F.col("ext").isin(list(extensions)))
    return _in_fewer_tasks(df)


def file_info(df: DataFrame, path: str = "path", default_name: str = "document.pdf") -> DataFrame:
    """Base name and lower-cased extension; a nameless upload is ``document.pdf``."""
    name = F.coalesce(base_name(F.col(path)), F.lit(default_name))
    return df.withColumn("name", F.when(F.col(path).isNull(), F.lit(default_name)).otherwise(name)) \
             .withColumn("ext", F.when(F.col(path).isNull(), F.lit(".pdf")).otherwise(extension(F.col(path))))


def validate_extension(df: DataFrame, ext: str = "ext",
                       supported: Sequence[str] = DEFAULTS.supported_upload_extensions) -> DataFrame:
    """A valid flag and a reason per file instead of failing the whole batch."""
    ok = has_extension(F.col(ext), supported)
    reason = F.when(~ok, F.concat(F.lit("Unsupported file type. Supported types are: "),
                                  F.lit("(" + ", ".join(f"'{e}'" for e in supported) + ")")))
    return df.withColumn("valid", ok).withColumn("reject_reason", reason)


def scan_convertible_files(spark: SparkSession, path: str) -> DataFrame:
    """S3: the files of a folder (not of its subfolders) that the Markdown conversion takes,
    whatever the case of their extension."""
    return scan_binary_files(spark, path, glob=None, recursive=False, extensions=DEFAULTS.convertible_extensions)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def stage_reload(spark: SparkSession, path: str, compute: Callable[[], DataFrame],
                 reuse: bool = True) -> DataFrame:
    """Read a saved stage output if present (and reuse is on), else compute it, write
    it (overwrite) and read it back, which also cuts the lineage."""
    if reuse and path_exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
