"""Session helpers: the checkpoint folder rule and size-checked input balancing."""

from helpers import SF001
from corpus_engine.session import checkpoint_dir, ensure_checkpoint_dir, shared_path
from corpus_engine.sources.tables import balance, estimated_bytes, table


def test_checkpoint_dir_is_read_not_replaced(spark):
    current = ensure_checkpoint_dir(spark)
    assert current and checkpoint_dir(spark) == current
    assert ensure_checkpoint_dir(spark) == current  # an existing setting is kept
    assert shared_path(spark, "a", "b").startswith(current.rstrip("/") + "/a/b")


def test_balance_is_size_checked(spark):
    docs = table(spark, SF001, "documents").select("doc_id", "text")
    size = estimated_bytes(docs)
    assert size > 0
    spread = balance(docs, min_task_bytes=1024)
    assert spread.rdd.getNumPartitions() > 1  # small input: spread over the cores
    assert "RoundRobinPartitioning" in spread._jdf.queryExecution().executedPlan().toString()
    kept = balance(docs, max_bytes=size - 1)   # above the bound: scan splits kept, no shuffle
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    one = balance(docs, min_task_bytes=size * 10)  # fits one task: left alone
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, docs.collect()))


def test_scratch_is_released(spark):
    from corpus_engine.session import release_scratch, scratch_path
    from corpus_engine.sources.files import path_exists

    path = scratch_path(spark, "release-test")
    spark.range(3).write.parquet(path)
    assert path_exists(spark, path) and release_scratch(spark) >= 1
    assert not path_exists(spark, path)
