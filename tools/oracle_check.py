"""Run registered queries in Spark and their DuckDB oracles side by side and compare
row count, column names and an order-insensitive value hash (our own check, modelled on
the driver's)."""

import hashlib
import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from corpus_engine.plans.oracles import ORACLES  # noqa: E402
from corpus_engine.plans.queries import QUERIES  # noqa: E402
from corpus_engine.session import build_session  # noqa: E402
from corpus_engine.sources.tables import TABLES  # noqa: E402


def norm_value(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, bool):
        return str(v)
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm_value(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = 0
    for name in sorted(QUERIES):
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:22s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            continue
        ts = time.time() - t0
        if name not in ORACLES:
            print(f"{name:22s} rows={len(srows)} (no oracle) spark={ts:.1f}s")
            continue
        t1 = time.time()
        try:
            rel = con.sql(ORACLES[name])
            dcols = rel.columns
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:22s} DUCKDB-ERROR {type(e).__name__}: {str(e)[:400]}")
            continue
        td = time.time() - t1
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        match = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and hs == hd
        ok += match
        print(f"{name:22s} {'OK  ' if match else 'DIFF'} rows={len(srows)}/{len(drows)} "
              f"cols={'same' if sorted(scols) == sorted(dcols) else (scols, dcols)} spark={ts:.1f}s duck={td:.1f}s")
        if not match and sorted(scols) == sorted(dcols):
            a, b = set(ls), set(ld)
            for x in list(a - b)[:2]:
                print("   spark-only:", x[:300])
            for x in list(b - a)[:2]:
                print("   duck-only: ", x[:300])
    print("matched", ok)


if __name__ == "__main__":
    main()
