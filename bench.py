"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed in full through the ``noop`` sink (every row is produced, nothing is
collected to the driver). A warm-up query runs first so JVM start-up is not charged to the
first measured query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus_engine.plans.queries import QUERIES  # noqa: E402
from corpus_engine.session import build_session, release_scratch, ship_package  # noqa: E402

HEADLINE = (
    "clean_text",
    "word_count",
    "html_to_text",
    "chunk_fixed",
    "chunk_sentence",
    "chunk_words",
    "chunk_semantic",
    "chunk_recursive",
    "embed_hash",
    "knn_exact",
    "retrieve_dedup",
    "assemble_context",
    "retrieve_expanded",
    "answer_from_collection",
    "knn_vectors",
    "knn_lsh",
    "dedup_normalized",
    "remove_entities",
    "corpus_stats",
    "compare_answers",
    "upload_chunks",
    "insert_if_absent",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    ship_package(spark)
    # warm-up: JVM code paths and the Python workers, so neither is charged to a query
    QUERIES["corpus_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(0, 64, 1, 16).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    times = {}
    failed = []
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001  (one failing query must not hide the others)
            times[name] = None
            failed.append(name)
            print(f"{name}: FAILED {type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
            continue
        print(f"{name}: {times[name]}s", file=sys.stderr)
        release_scratch(spark)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(v for v in times.values() if v is not None), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        **({"failed": failed} if failed else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
