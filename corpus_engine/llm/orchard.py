"""k-means over integer vectors, with nearest centroids found by Orchard's search.

Every centroid has a list of the other centroids by distance. A vector starts at some centroid and walks its
list; whenever a centroid is closer (or as close, with a smaller number), the walk jumps to that centroid's list.
Centroids seen once are marked and not measured again. The walk stops at a list entry strictly beyond twice the current
distance: by the triangle inequality no later entry can be as close. The start is the centroid whose norm is nearest.

Distances are squared and integer, so the test is ``D > 4 d`` and results are exact. A round is one narrow pass:
tasks emit integer sums a centroid, cut into 31-bit limbs, which Spark adds up; the driver gets one row of limbs a
centroid and component, whatever the number of vectors. The lists hold k * (k - 1) entries; k is a parameter.

Vectors are kept that have exactly ``dims`` components, none null or non-finite; others give no row. The first centroids are
the k kept vectors of smallest SHA-256 of ``1:<vec_id>`` (ties, as from repeated ids: by the vector itself), all of them if fewer
are kept; a null vec_id is clustered but starts no centroid. Equal distances go to the smaller number; empty
clusters keep their centroid. Components of any size are exact; a distance or inertia beyond a long is null.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import shipped, written

LIMBS, LIMB_BITS = 6, 31
#: Components up to this size keep all sums of squares within a long, for up to 512 components.
NARROW = 1 << 26
#: Vectors that one step of the search takes together.
BLOCK = 4096


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, as int64, or as Python integers where that is too narrow."""
    out = np.floor(values * float(scale))
    if out.size and np.abs(out).max() > NARROW:
        return np.array([int(v) for v in out.ravel()], dtype=object).reshape(out.shape)
    return out.astype(np.int64)


class Orchard:
    """The centroids with their sorted lists of neighbours."""

    def __init__(self, centroids: list[list[int]]):
        wide = any(abs(v) > NARROW for c in centroids for v in c)
        self.points = np.array(centroids, dtype=object if wide else np.int64)
        diff = self.points[:, None, :] - self.points[None, :, :]
        self.between = (diff * diff).sum(axis=2)
        k = len(centroids)
        self.lists = np.array([[j for j in sorted(range(k), key=lambda j, i=i: (self.between[i][j], j)) if j != i]
                               for i in range(k)], dtype=np.int64).reshape(k, k - 1)
        norms = np.sqrt((self.points.astype(float) ** 2).sum(axis=1))
        self.by_norm = np.argsort(norms, kind="stable")
        self.norms = norms[self.by_norm]

    def _start(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        at = np.searchsorted(self.norms, norm).clip(0, len(self.norms) - 1)
        below = (at - 1).clip(0)
        at = np.where(np.abs(self.norms[below] - norm) < np.abs(self.norms[at] - norm), below, at)
        return self.by_norm[at]

    def _distance(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        diff = x - self.points[to]
        return (diff * diff).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each row's nearest centroid, and the distances measured."""
        n, k = len(x), len(self.points)
        current = self._start(x)
        best = self._distance(x, current)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), current] = True
        place = np.zeros(n, np.int64)
        live, measured = np.arange(n), n
        while len(live) and k > 1:
            candidate = self.lists[current[live], place[live]]
            beyond = self.between[current[live], candidate] > 4 * best[live]
            live, candidate = live[~beyond.astype(bool)], candidate[~beyond.astype(bool)]
            new = ~seen[live, candidate]
            rows, at = live[new], candidate[new]
            place[live] += 1
            if len(rows):
                seen[rows, at] = True
                measured += len(rows)
                d = self._distance(x[rows], at)
                closer = ((d < best[rows]) | ((d == best[rows]) & (at < current[rows]))).astype(bool)
                jump = rows[closer]
                current[jump], best[jump], place[jump] = at[closer], d[closer], 0
            live = live[place[live] < k - 1]
        return current, best, measured


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: int):
    """(ids, scaled vectors) in blocks; the vectors' column holds kept vectors only."""
    for b in batches:
        for i in range(0, b.num_rows, BLOCK):
            part = b.slice(i, BLOCK)
            values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
            yield part.column(0), scaled(values, scale)


def _limbs(total: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(total & ((1 << LIMB_BITS) - 1))
        total >>= LIMB_BITS
    return [*out, total]


def kept_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and x (array<double>) of the vectors with ``dims`` finite components."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where((F.size("embedding") == dims) & ~bad).select("vec_id", x.alias("x"))


def first_centroids(kept: DataFrame, k: int, scale: int) -> list[list[int]]:
    start = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = kept.where("vec_id IS NOT NULL").select(start.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return [[int(v) for v in scaled(np.array([r["x"]]), scale)[0]] for r in rows]


def _sums(kept: DataFrame, centroids: list[list[int]], scale: int) -> dict[int, tuple[int, list[int]]]:
    """centroid -> (vectors, sums of components) of one assignment of all vectors."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        counts, totals = [0] * len(centroids), {}
        for _, x in _blocks(batches, dims, scale):
            cluster, _, _ = search.nearest(x)
            for c in np.unique(cluster):
                rows = x[cluster == c]
                counts[c] += len(rows)
                totals[c] = [a + int(v) for a, v in zip(totals.get(c, [0] * dims), rows.sum(axis=0), strict=True)]
        if totals:
            yield pa.RecordBatch.from_arrays([
                pa.array([int(c) for c in totals], pa.int32()), pa.array([counts[c] for c in totals], pa.int64()),
                pa.array([[v for t in totals[c] for v in _limbs(t)] for c in totals], pa.list_(pa.int64()))], ["c", "n", "limbs"])

    parts = kept.mapInArrow(run, "c int, n long, limbs array<long>")
    flat = parts.select("c", F.posexplode(F.concat(F.array("n"), "limbs")).alias("at", "v")).groupBy("c", "at").agg(F.sum("v").alias("v"))
    out: dict[int, tuple[int, list[int]]] = {}
    values: dict[int, dict[int, int]] = {}
    for r in flat.collect():  # k * (1 + LIMBS * dims) rows
        values.setdefault(r["c"], {})[r["at"]] = r["v"]
    for c, v in values.items():
        out[c] = v[0], [sum(v[1 + LIMBS * i + j] << (LIMB_BITS * j) for j in range(LIMBS)) for i in range(dims)]
    return out


def assign(kept: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """vec_id, cluster and squared distance of every kept vector."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for ids, x in _blocks(batches, dims, scale):
            cluster, distance, _ = search.nearest(x)
            distance = [int(d) if d < 1 << 63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                                             ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, f"vec_id {dict(kept.dtypes)['vec_id']}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = shipped(vectors.sparkSession)
    kept = kept_vectors(vectors, dims)
    centroids = first_centroids(kept, k, scale)
    if not centroids:
        centroids = [[0] * dims]  # no vector with an id: all go to one cluster at the origin
    for _ in range(rounds):
        for c, (n, sums) in _sums(kept, centroids, scale).items():
            centroids[c] = [s // n for s in sums]
    rows = written(assign(kept, centroids, scale), "orchard")
    per = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(
        F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()}
    total = None if None in per.values() else sum(per.values())
    table = [(i, _long(per[i]), _long(total), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
             for i, c in enumerate(centroids) if i in per]
    clusters = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row a centroid
    return rows.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(total) -> int | None:
    return None if total is None or total >= 1 << 63 else int(total)
