"""Session helpers: building a session for tests/bench and locating shared storage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "corpus_engine") -> SparkSession:
    """Session for tests and the bench. On a cluster the caller's session is used instead."""
    master = master or os.environ.get("CORPUS_ENGINE_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("CORPUS_ENGINE_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORPUS_ENGINE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir`` (or the context's)."""
    value = spark.conf.get("spark.checkpoint.dir", None)
    if value:
        return value
    return spark.sparkContext.getCheckpointDir()


def _one_machine(spark_context) -> bool:
    """True for local[...] masters only; local-cluster has executors of its own."""
    return re.fullmatch(r"local(\[.*\])?", spark_context.master) is not None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating one only when it is unset.

    On a cluster ``spark.checkpoint.dir`` is set to shared storage and is used as is.
    A fresh scratch folder is made only for local sessions (tests, bench)."""
    current = checkpoint_dir(spark)
    if current:
        return current
    if not _one_machine(spark.sparkContext):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="corpus-engine-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for stage outputs and stream state)."""
    base = ensure_checkpoint_dir(spark)
    return "/".join([base.rstrip("/")] + [p.strip("/") for p in parts])


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A new path under the shared folder, remembered until :func:`release_scratch`."""
    path = shared_path(spark, *parts, uuid.uuid4().hex)
    _SCRATCH.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete what this process wrote under its scratch paths, once the results that read them
    have been consumed; returns the number of paths."""
    jvm, n = spark.sparkContext._jvm, len(_SCRATCH)
    while _SCRATCH:
        hpath = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
    return n


_SHIPPED: set = set()


def _package_zip() -> bytes:
    import io
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    return buf.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpus_engine`` importable in Python workers (executors) via addPyFile.

    Functions run by mapInPandas / pandas UDFs are unpickled in the workers, which import
    this package. The zip is built in memory; on a cluster it is written to the shared
    checkpoint folder (never a machine-local temporary folder), locally to /tmp."""
    key = id(spark.sparkContext)
    if key in _SHIPPED:
        return
    data = _package_zip()
    sc = spark.sparkContext
    if _one_machine(sc):
        fd, zpath = tempfile.mkstemp(prefix="corpus_engine-", suffix=".zip", dir="/tmp")
        with os.fdopen(fd, "wb") as fh:
            fh.write(data)
    else:
        import hashlib

        zpath = shared_path(spark, "pyfiles", f"corpus_engine-{hashlib.sha1(data).hexdigest()[:12]}.zip")
        jvm = sc._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(zpath)
        fs = hpath.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(hpath):
            out = fs.create(hpath, True)
            out.write(bytearray(data))
            out.close()
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
