"""Summarise the physical plan of every registered query: shuffles, broadcasts, Python
nodes, windows, aggregates, joins and what reaches the parquet scans."""

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from corpus_engine.plans.queries import QUERIES  # noqa: E402
from corpus_engine.session import build_session  # noqa: E402

NODES = ("Exchange hashpartitioning", "Exchange RoundRobinPartitioning", "Exchange SinglePartition",
         "Exchange rangepartitioning", "BroadcastExchange", "MapInPandas", "MapInArrow", "ArrowEvalPython",
         "WindowGroupLimit", "Window ", "HashAggregate", "SortAggregate", "ObjectHashAggregate",
         "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
         "CartesianProduct", "Generate", "WholeStageCodegen", "FileScan parquet")
SKIP = {"stream_ingest", "scan_text_files", "scan_binary_files", "stage_reload", "write_report",
        "collection_write", "insert_if_absent", "answer_from_collection", "upload_status", "upload_retrieve"}  # these write before they return


def summary(plan: str) -> str:
    counts = []
    for n in NODES:
        c = len(re.findall(re.escape(n), plan))
        if c:
            counts.append(f"{n.strip()} x{c}")
    return ", ".join(counts)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    for name in sorted(QUERIES):
        if name in SKIP:
            continue
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)))
        pushed = sorted(set(re.findall(r"PushedFilters: (\[[^\]]*\])", plan)) - {"[]"})
        print(f"{name}: {summary(plan)}")
        for s in schemas:
            print(f"    read {s}")
        for p in pushed:
            print(f"    pushed {p}")


if __name__ == "__main__":
    main()
