"""The chunk collection as a bucketed table, so insert-if-absent never reshuffles it.

The collection's files live at a path in shared storage; each session registers that
location as a parquet table ``CLUSTERED BY (id) INTO n BUCKETS`` (metadata only, no data
is moved). Anti-joins of a new batch against it then shuffle only the batch: the
collection side is read bucket by bucket with no exchange. Appends write bucketed files,
so the layout stays valid however many batches arrive."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpus_engine.operators.ingest import absent_rows
from corpus_engine.sources.files import COLLECTION_SCHEMA, path_exists

DEFAULT_BUCKETS = 64


def buckets_for(n_bytes: int, bucket_bytes: int = 1 << 30) -> int:
    """Bucket count for a collection expected to hold ``n_bytes`` (a power of two, 64 at least)."""
    count = DEFAULT_BUCKETS
    while count * bucket_bytes < n_bytes:
        count *= 2
    return count


class BucketedCollection:
    """The bucket count, key and columns are stored next to the data when the collection is
    made, and read when it is opened again: a layout that differs is refused, since rows hashed
    another way would not meet the stored ones."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None,
                 schema: str = COLLECTION_SCHEMA, key: str = "id"):
        self.spark, self.path = spark, path.rstrip("/")
        stored = self._layout()
        if stored is None:
            self.buckets, self.key, self.schema = buckets or DEFAULT_BUCKETS, key, schema
            spark.createDataFrame([(self.buckets, key, schema)], "buckets int, key string, columns string") \
                .coalesce(1).write.mode("overwrite").json(f"{self.path}_layout")
        else:
            asked = (buckets or stored["buckets"], key, schema)
            if asked != (stored["buckets"], stored["key"], stored["columns"]):
                raise ValueError(f"the collection at {self.path} has {stored['buckets']} buckets on {stored['key']} with "
                                 f"columns {stored['columns']}, not {asked}")
            self.buckets, self.key, self.schema = asked
        self._open(self.version())

    def _fs(self, path: str):
        hpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hpath

    def version(self) -> int:
        """The version of the files that counts: 0, or the highest that a compaction finished."""
        fs, hpath = self._fs(f"{self.path}_versions")
        done = [int(f.getPath().getName()) for f in fs.listStatus(hpath)] if fs.exists(hpath) else []
        return max((n for n in done if path_exists(self.spark, f"{self.path}_versions/{n}/_SUCCESS")), default=0)

    def location(self, version: int) -> str:
        return f"{self.path}_v{version}" if version else self.path

    def _open(self, version: int) -> None:
        location = self.location(version)
        self.name = "collection_" + hashlib.md5(location.encode()).hexdigest()[:12]
        fs, hpath = self._fs(location)
        if not fs.exists(hpath):
            fs.mkdirs(hpath)  # an existing (empty) location: no probing warnings on CREATE TABLE
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.schema}) USING parquet CLUSTERED BY ({self.key}) "
                       f"SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{location}'")

    def _layout(self):
        path = f"{self.path}_layout"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            return None
        return self.spark.read.schema("buckets int, key string, columns string").json(path).first()

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def insert_if_absent(self, incoming: DataFrame) -> int:
        """K5 at scale: add the rows whose id is absent; returns how many were added. The
        table's files are listed when the plan is made, so the append does not see its
        own output; the number added is observed during the write (no extra pass). A
        failed append commits nothing, and a rerun adds exactly the rows still absent."""
        cols = [f.name for f in self.read().schema.fields]
        seen = Observation(f"{self.name}_insert")
        fresh = absent_rows(self.read(), incoming.select(*cols), self.key) \
            .observe(seen, F.count(F.lit(1)).alias("rows"))
        fresh.write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return int(seen.get["rows"])

    def file_count(self) -> int:
        return self.read().select("_metadata.file_path").distinct().count()

    def compact(self) -> int:
        """Rewrite every bucket as one file, sorted by key, in a new version of the files; returns the version.

        Appends leave a file a bucket and batch; a read then opens them all. The new version counts once its marker is
        written, so readers see the old files or the new ones, and a compaction that is lost leaves no trace
        but unused files. One writer at a time; open the collection again to follow a compaction made elsewhere."""
        version = self.version() + 1
        # read as files: of the table the planner takes the buckets as given, drops the exchange, and then reads by split
        rows = self.spark.read.schema(self.schema).parquet(self.location(version - 1))
        fs, hpath = self._fs(self.location(version))
        fs.delete(hpath, True)  # what a lost compaction may have left
        self._open(version)
        whole = rows.repartition(self.buckets, self.key).sortWithinPartitions(self.key)
        whole.write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        self.spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{self.path}_versions/{version}")
        return version

    def vacuum(self) -> int:
        """Delete the files of the versions before the current one, once nobody reads them; returns how many versions."""
        gone = 0
        for n in range(self.version()):
            fs, hpath = self._fs(self.location(n))
            gone += bool(fs.exists(hpath) and fs.delete(hpath, True))
        return gone
