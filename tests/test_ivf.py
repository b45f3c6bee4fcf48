"""The stored inverted-file index against exact search."""

import numpy as np
import pytest

from helpers import SF001, SF01
from corpus_engine.operators import ivf
from corpus_engine.operators import retrieve as R
from corpus_engine.plans.queries import QUERIES
from corpus_engine.session import scratch_path


def frame(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def index_of(spark, rows, **kw):
    index = ivf.IvfIndex(spark, scratch_path(spark, "test-ivf"))
    index.fit(frame(spark, rows), **kw)
    index.insert(frame(spark, rows))
    return index


def pairs(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in df.collect())


def clustered(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (12, dim))
    return [(i, [float(v) for v in centres[i % 12] + rng.normal(0, 1, dim)]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_cells_are_the_exact_search(spark, seed):
    rows = clustered(seed, 300) + [(1000 + i, [0.0] * 8) for i in range(20)]  # ties
    q = frame(spark, [r for r in rows if r[0] % 7 == 0] + [(5000, [0.0] * 8)], "query_id")
    index = index_of(spark, rows, cells=9)
    exact = R.knn_exact(frame(spark, rows), q, 5, carry=())
    assert pairs(index.search(q, 5, probes=9)) == pairs(exact)


def test_few_probes_read_few_cells_and_find_most(spark):
    rows = clustered(3, 600)
    index = index_of(spark, rows, cells=12)
    q = frame(spark, rows[:60], "query_id")
    exact = R.knn_exact(frame(spark, rows), q, 5, carry=())
    assert R.recall(exact, index.search(q, 5, probes=2)).first()["recall"] > 0.95
    one = index.search(frame(spark, rows[:1], "query_id"), 5, probes=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    assert index.calibrate(5) <= 3 and index.probes() <= 3


def test_a_query_gets_k_rows_where_its_cells_hold_fewer(spark):
    rows = [(i, [float(i), 0.0]) for i in range(4)] + [(10 + i, [100.0 + i, 0.0]) for i in range(4)]
    index = index_of(spark, rows, cells=4)
    got = pairs(index.search(frame(spark, [(1, [0.0, 0.0])], "query_id"), 6, probes=1))
    assert [g[2] for g in got] == [0, 1, 2, 3, 10, 11]


def test_inserts_do_not_repeat(spark):
    rows = clustered(5, 50)
    index = ivf.IvfIndex(spark, scratch_path(spark, "test-ivf"))
    index.insert(frame(spark, rows[:30] + rows[:5] + [(None, [0.0] * 8), (99, None)]))
    cells = len(index.centres())
    index.insert(frame(spark, rows))
    index.insert(frame(spark, rows))
    assert sorted(r["id"] for r in index.read().collect()) == list(range(50))
    again = ivf.IvfIndex(spark, index.path)  # another session's view of the stored index
    assert len(again.centres()) == cells and sum(again.cell_sizes().values()) == 50
    q = frame(spark, [*rows[:3], (77, None)], "query_id")
    assert pairs(again.search(q, 2, probes=cells)) == pairs(R.knn_exact(frame(spark, rows), q, 2, carry=()))


def test_hot_cell_is_many_files(spark, monkeypatch):
    monkeypatch.setattr(ivf, "FILE_ROWS", 100)
    rows = [(i, [1.0, 1.0]) for i in range(400)] + [(1000, [9.0, 9.0])]
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")  # which would join files as small as these
    try:
        index = index_of(spark, rows, cells=2)
    finally:
        spark.conf.unset(conf)
    files = index.read().selectExpr("cell", "input_file_name() f").distinct().groupBy("cell").count().collect()
    assert max(r["count"] for r in files) >= 2
    assert [g[2] for g in pairs(index.search(frame(spark, [(1, [1.0, 1.0])], "query_id"), 3))] == [0, 1, 2]


def test_nothing_stored(spark):
    index = ivf.IvfIndex(spark, scratch_path(spark, "test-ivf"))
    index.insert(frame(spark, []))
    with pytest.raises(ValueError):
        index.search(frame(spark, [(1, [0.0])], "query_id"))


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_recall(spark, sf):
    assert QUERIES["ivf_recall"](spark, sf).first()["recall"] >= 0.9
