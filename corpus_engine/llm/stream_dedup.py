"""Exact de-duplication by a stateful stream.

Texts are equal when identical after replacing each run of ``[\\x20\\x09-\\x0D]`` by one space. Two streams,
each started with ``availableNow``, follow the folder of documents:

1. every new row goes to a ledger: doc_id, SHA-256 of the normalised text, and the locator of its content (file, row);
2. a keyed state without expiry, held on disk by RocksDB, keeps for every digest the row that stays (smallest
   doc_id, its locator) and the number of rows. Rows of a batch are aggregated before the shuffle, so a
   digest that a third of all rows share sends one row a task.

A digest seen more than once is a hit, and hits are held against full bytes: their rows are grouped by digest
and whole normalised text. Hits are picked by a bitmap of fixed size, so only their texts are
shuffled, each distinct text once a task. Digests that hold several texts are split by text.

A later run with the same ``work`` folder reads new files only and continues from the state. A lost
executor's tasks run again from the shared checkpoint.

Null texts count as empty; all empty texts are one group. Rows with a null doc_id come after all others in
a group. Of rows with equal doc_id and text the first by locator stays. Very long texts are hashed and compared whole.
An empty table gives an empty result; columns other than doc_id and text are not read. No Python code runs on rows.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.llm.common import written
from corpus_engine.session import scratch_path

#: Bytes of new files that one micro-batch takes.
BATCH_BYTES = 64 << 30
#: Bits of the bitmap of repeated digests: 2^27, 16 MB as broadcast, whatever the number of digests.
BITMAP_BITS = 27
_PER_BUCKET = 32768
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
    # a state has as many stores as shuffle partitions; allocating ahead costs each some MB of disk
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_LEDGER = "doc_id long, path string, row long, text_sha256 string, digest string"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space (null: empty). Single spaces need no match."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?:[\x09-\x0D]|\x20(?=[\x20\x09-\x0D]))[\x20\x09-\x0D]*", " ")


@contextmanager
def _settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _exactly(path: str) -> str:
    """A glob that matches the path alone: the stream source then takes a single file as well as a folder."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _first(doc_id: str = "doc_id") -> Column:
    return F.min(F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), "path", "row"))


def update_state(spark: SparkSession, path: str, work: str, digest: Callable[[Column], Column] = lambda sha: sha,
                 batch_bytes: int = BATCH_BYTES) -> DataFrame | None:
    """Bring ledger and state under ``work`` up to date with the Parquet files at ``path``.

    Returns the state: digest, first (no_id, doc_id, path, row) and n; None if no row has come yet."""
    schema = spark.read.parquet(path).select(F.col("doc_id"), F.col("text")).schema
    with _settings(spark):
        docs = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(_exactly(path))
        sha = F.sha2(normalised(F.col("text")), 256)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("path"),
                           F.col("_metadata.row_index").alias("row"), sha.alias("text_sha256"))
        rows = rows.withColumn("digest", digest(F.col("text_sha256")))
        _finish(rows.writeStream.format("parquet").option("path", f"{work}/ledger").option(
            "checkpointLocation", f"{work}/ledger-checkpoint"))
        if ledger(spark, work).isEmpty():
            return None
        state = spark.readStream.schema(_LEDGER).option("maxBytesPerTrigger", batch_bytes).parquet(f"{work}/ledger").groupBy(
            "digest").agg(_first(), F.count(F.lit(1)))
        _finish(state.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{work}/state"))
        return spark.read.format("statestore").load(f"{work}/state").select(
            "key.digest", F.col("value.min").alias("first"), F.col("value.count").alias("n"))


def _finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def ledger(spark: SparkSession, work: str) -> DataFrame:
    """doc_id, path, row, text_sha256 and digest of every row seen."""
    return spark.read.schema(_LEDGER).parquet(f"{work}/ledger")


def _position(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))


def bitmap(digests: DataFrame) -> DataFrame:
    """bucket, bits: a bitmap of the digests' positions, at most 2^BITMAP_BITS bits in all."""
    at = digests.select(_position(F.col("digest")).alias("at"))
    return at.groupBy(F.floor(F.col("at") / _PER_BUCKET).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("at") % _PER_BUCKET).alias("bits"))


def _in_bitmap(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows whose digest's bit is set: all rows of the digests in the bitmap, and few others."""
    at = _position(F.col("digest"))
    place = at % _PER_BUCKET
    byte = F.conv(F.hex(F.substring(F.col("bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), F.floor(at / _PER_BUCKET) == F.col("bucket")).where(
        F.getbit(byte, (place % 8).cast("int")) == 1).drop("bucket", "bits")


def _contents(spark: SparkSession, path: str, digest: Callable[[Column], Column]) -> DataFrame:
    rows = spark.read.parquet(path).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.row_index").alias("row"), normalised(F.col("text")).alias("body"))
    return rows.withColumn("digest", digest(F.sha2("body", 256)))


def deduplicate(spark: SparkSession, path: str, work: str | None = None, digest: Callable[[Column], Column] = lambda sha: sha,
                batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, and the locator of the row that stays (keep_path, keep_row),
    for every row of the Parquet files at ``path``.

    ``work`` holds ledger and state between runs (a new shared folder if not given); ``digest`` makes the key of
    the state of the SHA-256 (tests weaken it)."""
    work = work or scratch_path(spark, "llm", "stream-dedup")
    state = update_state(spark, path, work, digest, batch_bytes)
    rows = ledger(spark, work)
    if state is None:
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                           F.lit(True).alias("kept"), "text_sha256", F.col("path").alias("keep_path"), F.col("row").alias("keep_row"))
    hits = written(state.where("n > 1"), "stream-dedup-hits")
    texts = _in_bitmap(_contents(spark, path, digest), bitmap(hits)).groupBy("digest", "body").agg(
        _first().alias("first"), F.count(F.lit(1)).alias("n"))
    several = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("first").alias("x")).where("texts > 1").select("digest")
    several = written(several, "stream-dedup-collisions")
    out = _judged(rows, hits, ["digest"])
    if several.isEmpty():
        return out
    # digests of different texts: their rows are judged by digest and text
    bodies = _contents(spark, path, digest).join(several, "digest", "left_semi")
    groups = bodies.groupBy("digest", "body").agg(_first().alias("first"), F.count(F.lit(1)).alias("n"))
    apart = bodies.withColumn("text_sha256", F.sha2("body", 256))
    return _judged(rows.join(several, "digest", "left_anti"), hits, ["digest"]).unionByName(_judged(apart, groups, ["digest", "body"]))


def _judged(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    first = F.col("first")
    alone = first.isNull()
    return rows.join(groups, key, "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(first["doc_id"]).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | ((F.col("path") == first["path"]) & (F.col("row") == first["row"]))).alias("kept"), "text_sha256",
        F.coalesce(first["path"], F.col("path")).alias("keep_path"), F.coalesce(first["row"], F.col("row")).alias("keep_row"))
