"""Approximate top-k from a stored inverted-file index.

A coarse quantiser (k-means centroids, fitted on a bounded sample) divides the vectors into cells. The index is a Parquet
table partitioned by cell, so a search reads the cells it probes and no others. Rows are assigned to
their cell when they are inserted; every row is indexed, and an id that is stored already is left as it is. Later
inserts use the stored quantiser.

A query probes its nearest ``probes`` cells, and further ones until they hold k rows; within them distances are exact, so only
neighbours in other cells can be missed. ``probes`` = number of cells is the exact search. ``calibrate`` finds and stores the number
of probes that finds a stated share of the neighbours of a bounded sample of stored rows, by an exact search. Queries go to the tasks in blocks, like
in the exact search; each task keeps k rows a query.

Rows without a vector or with a null id are not indexed; queries without a vector have no neighbours. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from corpus_engine.config import DEFAULTS
from corpus_engine.operators.retrieve import _emit, _global_topk, _matrix, _prune, _result_schema, knn_exact, query_blocks
from corpus_engine.sources.files import path_exists

#: Rows of the sample that the quantiser is fitted on, and rounds of the fit.
FIT_ROWS, FIT_ROUNDS = 20_000, 8
#: Most cells, which are folders of the table.
MOST_CELLS = 4096
#: Rows of a cell that one file takes.
FILE_ROWS = 1_000_000


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * (x @ c.T), 0.0)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = FIT_ROUNDS, seed: int = DEFAULTS.lsh_seed) -> np.ndarray:
    """Centroids of a sample: k-means from distinct sample rows; a cell that gets empty moves to the row farthest from its own."""
    x = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        d = _squared(x, centres)
        own = d.argmin(axis=1)
        far = list(np.argsort(-d[np.arange(len(x)), own], kind="stable")[:len(centres)])
        moved = []
        for c in range(len(centres)):
            mine = x[own == c]
            moved.append(mine.mean(axis=0) if len(mine) else x[far.pop(0)])
        centres = np.array(moved)
    return centres


def cells_for(rows: int) -> int:
    """Number of cells for a collection of so many rows: its square root, at most ``MOST_CELLS``."""
    return max(1, min(MOST_CELLS, math.isqrt(max(rows, 0))))


class IvfIndex:
    """The index stored at ``path``: ``cells`` (centroids) and ``rows`` (id, vector, cell)."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "id", vec_col: str = "embedding"):
        self.spark, self.path, self.id_col, self.vec_col = spark, path.rstrip("/"), id_col, vec_col
        self._centres: np.ndarray | None = None
        self._rows: DataFrame | None = None
        self._sizes: dict[int, int] | None = None

    # build

    def exists(self) -> bool:
        return path_exists(self.spark, f"{self.path}/cells/_SUCCESS")

    def fit(self, rows: DataFrame, cells: int | None = None, sample: int = FIT_ROWS) -> int:
        """Fit and store the quantiser; returns the number of cells. The ``sample`` rows are those of smallest id hash."""
        rows = rows.where(F.col(self.vec_col).isNotNull() & F.col(self.id_col).isNotNull())
        wanted = cells or cells_for(rows.count())
        some = rows.orderBy(F.xxhash64(self.id_col), self.id_col).limit(sample).select(self.vec_col).collect()
        x = np.array([r[0] for r in some], np.float64)
        centres = fit_cells(x, wanted) if len(x) else np.zeros((1, 1))
        self.spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cell int, centre array<double>") \
            .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")
        self._centres = centres
        return len(centres)

    def centres(self) -> np.ndarray:
        """The centroids: at most ``MOST_CELLS`` unless more were asked for."""
        if self._centres is None:
            rows = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
            self._centres = np.array([r["centre"] for r in rows], np.float64)
        return self._centres

    def assign(self, rows: DataFrame) -> DataFrame:
        """The rows with the column ``cell``: their nearest centroid (ties: the smaller number)."""
        sent = self.spark.sparkContext.broadcast(self.centres())
        at = rows.columns.index(self.vec_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = sent.value
            for b in batches:
                if b.num_rows:
                    cell = _squared(_matrix(b.column(at)), centres).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*b.schema.names, "cell"])

        return rows.mapInArrow(run, T_.StructType([*rows.schema.fields, T_.StructField("cell", T_.IntegerType())]))

    def insert(self, rows: DataFrame) -> None:
        """Add the rows whose ids are not stored yet; of equal ids in ``rows`` one is taken."""
        rows = rows.select(self.id_col, self.vec_col).where(F.col(self.vec_col).isNotNull() & F.col(self.id_col).isNotNull())
        if not self.exists():
            self.fit(rows)
        fresh = rows.dropDuplicates([self.id_col])
        if path_exists(self.spark, f"{self.path}/rows"):
            fresh = fresh.join(self.read().select(self.id_col), self.id_col, "left_anti")
        placed = self.assign(fresh.select(self.id_col, self.vec_col))
        # as many files a cell as its rows need: a cell with a third of all rows is many tasks
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("__n"))
        files = {r["cell"]: -(-r["__n"] // FILE_ROWS) for r in sizes.collect()}  # at most one row a cell
        split = [c for c, n in files.items() if n > 1]
        salt = F.lit(0)
        for c in split:
            salt = F.when(F.col("cell") == c, F.pmod(F.xxhash64(self.id_col), F.lit(files[c]))).otherwise(salt)
        spread = placed.withColumn("__salt", salt).repartition("cell", "__salt").drop("__salt")
        if files:
            spread.write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")
        self._rows = self._sizes = None

    def calibrate(self, k: int = DEFAULTS.top_k_loader, share: float = 0.95, sample: int = 200) -> int:
        """Store and return the probes that find ``share`` of the k nearest neighbours of ``sample`` stored rows (of smallest id hash)."""
        asked = self.read().orderBy(F.xxhash64(self.id_col), self.id_col).limit(sample).select(
            F.col(self.id_col).alias("query_id"), F.col(self.vec_col).alias("embedding"))
        near = knn_exact(self.read(), asked, k + 1, self.id_col, self.vec_col, carry=("cell",)).where(F.col("query_id") != F.col(self.id_col))
        hits, x = near.select("query_id", "cell").collect(), {r[0]: r[1] for r in asked.collect()}
        centres = self.centres()
        ranks = {q: np.argsort(np.argsort(_squared(np.array([v], np.float64), centres)[0], kind="stable"), kind="stable") for q, v in x.items()}
        found = sorted(int(ranks[r["query_id"]][r["cell"]]) for r in hits)
        probes = 1 + found[min(len(found) - 1, math.ceil(share * len(found)))] if found else 1
        self.spark.createDataFrame([(probes, share, k)], "probes int, share double, k int").coalesce(1).write.mode("overwrite").json(
            f"{self.path}/probes")
        return probes

    # read

    def read(self) -> DataFrame:
        if self._rows is None:
            if path_exists(self.spark, f"{self.path}/rows"):
                self._rows = self.spark.read.parquet(f"{self.path}/rows")
            else:
                raise ValueError(f"nothing is stored in the index at {self.path}")
        return self._rows

    def cell_sizes(self) -> dict[int, int]:
        if self._sizes is None:
            self._sizes = {r["cell"]: r["n"] for r in self.read().groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        return self._sizes

    def probes(self) -> int:
        """The calibrated number of probes, else a quarter of the cells, 8 at least."""
        path = f"{self.path}/probes"
        if path_exists(self.spark, f"{path}/_SUCCESS"):
            return self.spark.read.schema("probes int").json(path).first()["probes"]
        return max(8, len(self.centres()) // 4)

    def search(self, queries: DataFrame, k: int = DEFAULTS.top_k_loader, probes: int | None = None, query_id: str = "query_id",
               query_vec: str = "embedding", decimals: int = DEFAULTS.distance_decimals,
               max_query_bytes: int = DEFAULTS.max_broadcast_query_bytes, max_state_rows: int = DEFAULTS.max_topk_state_rows) -> DataFrame:
        """query_id, rank, id and squared distance of the k nearest rows in the probed cells."""
        rows = self.read()
        schema = _result_schema(queries, query_id, rows, self.id_col)
        target = to_arrow_schema(schema)
        centres, sizes = self.centres(), self.cell_sizes()
        held = np.array([sizes.get(c, 0) for c in range(len(centres))])
        least = probes or self.probes()
        parts = []
        for q_ids, q_mat in query_blocks(queries, query_id, query_vec, k, max_query_bytes, max_state_rows):
            order = np.argsort(_squared(q_mat, centres), axis=1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]
            use = (np.arange(len(centres))[None, :] < least) | (before < k)
            asks = {int(c): np.nonzero(((order == c) & use).any(axis=1))[0] for c in np.unique(order[use]) if held[c]}
            sent = self.spark.sparkContext.broadcast((q_ids, q_mat, asks))
            found = rows.where(F.col("cell").isin(list(asks))).select(self.id_col, self.vec_col, "cell")
            parts.append(found.mapInArrow(_search(sent, k, decimals, self.id_col, query_id, target), schema))
        return _global_topk(self.spark, parts, schema, query_id, self.id_col, k)


def _search(sent, k: int, decimals: int, id_col: str, out_id: str, target: pa.Schema, cells: int = 2_000_000):
    """Top-k per query of one task: every cell's rows against the queries that probe it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_mat, asks = sent.value
        kept, held = [], 0
        for b in batches:
            b = b.take(pc.sort_indices(b.column(0)))
            cell = b.column(2).to_numpy()
            for c in np.unique(cell):
                at = np.nonzero(cell == c)[0]
                x = _matrix(b.column(1).take(pa.array(at)))
                ids = b.column(0).take(pa.array(at))
                step = max(1, cells // len(at))
                for i in range(0, len(asks[int(c)]), step):
                    q = asks[int(c)][i:i + step]
                    d = np.round(_squared(x, q_mat[q]), decimals)
                    # rows are in id order, so a stable sort breaks ties by id
                    top = np.argsort(d, axis=0, kind="stable")[:k]
                    cols = np.broadcast_to(np.arange(len(q)), top.shape)
                    kept.append(pa.table({"__q": pa.array(q[cols.ravel()]), "distance": pa.array(d[top, cols].ravel()),
                                          id_col: ids.take(pa.array(top.ravel()))}))
                    held += top.size
                    if held > 4 * k * len(q_ids):
                        kept = [_prune(pa.concat_tables(kept), k, id_col)]
                        held = len(kept[0])
        if kept:
            yield from _emit(kept, k, id_col, q_ids, target, out_id)

    return run
