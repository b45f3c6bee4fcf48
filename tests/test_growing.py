"""What grows batch by batch: the upload stream with its ledger, compaction, the key index, sketches."""

import pytest

from corpus_engine.operators import sketches as SK
from corpus_engine.operators.dedup_index import DedupIndex
from corpus_engine.operators.embed import HashEmbedder
from corpus_engine.session import scratch_path
from corpus_engine.sources.collection import BucketedCollection
from corpus_engine.streaming.uploads import UNITS, UploadStream

DROPS = [[("a", 1, "one two"), ("a", 2, "three"), ("b", 1, "four")], [("a", 3, "late page"), ("c", 1, "five"), (None, 1, "nameless")],
         [("b", 9, "again"), ("d", 1, "six"), ("d", 1, "six")]]


def frame(spark, rows):
    return spark.createDataFrame(rows, UNITS)


def held(stream):
    return sorted((r["doc_id"], r["chunk_index"], r["text"]) for r in stream.collection.read().collect())


WANT = sorted([("a", 0, "one two"), ("a", 1, "three"), ("b", 0, "four"), ("c", 0, "five"), ("", 0, "nameless"), ("d", 0, "six"), ("d", 1, "six")])


def test_stream_skips_names_of_earlier_epochs(spark):
    base = scratch_path(spark, "test-uploads")
    for rows in DROPS:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{base}/source")
        stream = UploadStream(spark, f"{base}/state", HashEmbedder(8))  # a new process each time
        stream.run(f"{base}/source")
    stream.run(f"{base}/source")
    assert held(stream) == WANT
    assert sorted(map(tuple, stream.status().collect())) == [(0, 2, 0), (1, 2, 1), (2, 1, 1)]
    assert sorted(map(tuple, stream.ledger.read().collect())) == [("", 1), ("a", 0), ("b", 0), ("c", 1), ("d", 2)]


@pytest.mark.parametrize("lost_after", ["chunks", "names"])
def test_a_replayed_epoch_decides_as_before(spark, monkeypatch, lost_after):
    """The process is lost after the chunks, or after the names, of an epoch were written."""
    stream = UploadStream(spark, scratch_path(spark, "test-uploads"), HashEmbedder(8))
    stream.add(frame(spark, DROPS[0]), 0)

    class Lost(Exception):
        pass

    def lose(*_):
        raise Lost

    target = stream.ledger if lost_after == "chunks" else stream.spark.__class__
    with monkeypatch.context() as m:
        m.setattr(target, "insert_if_absent" if lost_after == "chunks" else "createDataFrame", lose)
        batch = frame(spark, DROPS[1]) if lost_after == "chunks" else spark.table("replayed") if spark.catalog.tableExists("replayed") else None
        if batch is None:
            m.undo()
            frame(spark, DROPS[1]).createOrReplaceTempView("replayed")
            batch = spark.table("replayed")
            m.setattr(target, "createDataFrame", lose)
        with pytest.raises(Lost):
            stream.add(batch, 1)
    stream.add(frame(spark, DROPS[1]), 1)
    stream.add(frame(spark, DROPS[1]), 1)
    stream.add(frame(spark, DROPS[2]), 2)
    assert held(stream) == WANT
    assert sorted(map(tuple, stream.status().collect())) == [(0, 2, 0), (1, 2, 1), (2, 1, 1)]


def test_compaction(spark):
    path = scratch_path(spark, "test-compact")
    coll = BucketedCollection(spark, path, buckets=4, schema="id string, text string")
    rows = [(f"k{i}", f"t{i}") for i in range(200)]
    for at in range(0, 200, 40):
        coll.insert_if_absent(spark.createDataFrame(rows[at:at + 40], "id string, text string"))
    before, files = sorted(map(tuple, coll.read().collect())), coll.file_count()
    assert files > 4 and coll.compact() == 1
    assert coll.file_count() <= 4 and sorted(map(tuple, coll.read().collect())) == before
    again = BucketedCollection(spark, path, buckets=4, schema="id string, text string")
    assert again.insert_if_absent(spark.createDataFrame([("k3", "no"), ("new", "yes")], "id string, text string")) == 1
    plan = again.read().join(spark.createDataFrame([("k1",)], "id string").hint("merge"), "id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of the batch alone
    assert again.compact() == 2 and again.vacuum() == 2
    assert sorted(map(tuple, BucketedCollection(spark, path, buckets=4, schema="id string, text string").read().collect())) == sorted([*before, ("new", "yes")])


def test_a_lost_compaction_changes_nothing(spark, monkeypatch):
    path = scratch_path(spark, "test-compact")
    coll = BucketedCollection(spark, path, buckets=2, schema="id string")
    coll.insert_if_absent(spark.createDataFrame([("a",), ("b",)], "id string"))
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            coll.compact()
    again = BucketedCollection(spark, path, buckets=2, schema="id string")
    assert again.version() == 0 and sorted(r["id"] for r in again.read().collect()) == ["a", "b"]
    assert again.compact() == 1 and sorted(r["id"] for r in again.read().collect()) == ["a", "b"]


def test_key_index(spark):
    schema = "id bigint, text string, n int"
    batches = [[(1, "A b", 1), (2, "a-B", 2), (3, "c", 3), (4, None, 4)], [(5, "C!", 5), (6, "d", 6), (7, "d", 7), (8, "", 8)], [(9, "e", 9), (10, "ab", 10)]]
    index = DedupIndex(spark, scratch_path(spark, "test-index"))
    for _ in range(2):  # a repeated batch keeps the same rows
        got = [sorted(r["id"] for r in index.add(spark.createDataFrame(b, schema), n).collect()) for n, b in enumerate(batches)]
        assert got == [[1, 3, 4], [6], [9]]
    whole = DedupIndex(spark, scratch_path(spark, "test-index"))
    rows = whole.add(spark.createDataFrame([r for b in batches for r in b], schema), 0)
    assert sorted(map(tuple, rows.collect()), key=lambda r: r[0]) == [batches[0][0], batches[0][2], batches[0][3], batches[1][1], batches[2][0]]


def test_sketches_of_batches_equal_those_of_all(spark):
    rows = [(i, " ".join(f"w{(i * k) % 997}" for k in range(i % 50))) for i in range(600)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    parts = SK.batch_sketch(df.where("id % 2 = 0"), "x").unionByName(SK.batch_sketch(df.where("id % 2 = 1"), "y"))
    parts = parts.unionByName(SK.batch_sketch(df.where("false"), "empty")).unionByName(SK.batch_sketch(df.where("id % 2 = 1"), "y"))
    got = SK.statistics(SK.merged(parts)).first()
    lengths = sorted(len((t or "").split()) for _, t in rows)
    distinct = len({w for _, t in rows for w in (t or "").split()})
    assert (got["n_docs"], got["min_words"], got["max_words"]) == (601, 0, 49)
    assert abs(got["average_words"] - sum(lengths) / 601) < 1e-9
    assert abs(got["distinct_words"] - distinct) < 0.05 * distinct
    for q in (25, 50, 75, 95):
        low, high = (lengths[min(600, max(0, int(601 * (q / 100 + d))))] for d in (-0.02, 0.02))
        assert low <= got[f"q{q}"] <= high
    nothing = SK.statistics(SK.merged(SK.batch_sketch(df.where("false"), "empty"))).first()
    assert (nothing["n_docs"], nothing["average_words"], nothing["max_words"], nothing["distinct_words"]) == (0, 0.0, 0, 0)
