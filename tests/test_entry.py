"""Driver contract: entry runs, every oracle has a query, names line up."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_and_registry(spark):
    m = load_entry()
    df = m.entry(spark)
    assert df.columns == ["query_id", "context"]
    assert df.count() > 0
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 45


def test_oracles_parse_in_duckdb():
    import duckdb

    from corpus_engine.plans.oracles import ORACLES
    from corpus_engine.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, sql in ORACLES.items():
        con.sql(f"EXPLAIN {sql}")
