"""Mixing sources to target weights with a low-discrepancy schedule of equal-word blocks.

1. A document's size is its number of words. Sources, in code-point order with null last,
   weigh 1, 2, 3, repeating, and share all words of the corpus; a target stops at
   ``MAX_REPEATS`` times its source's size and the excess goes to the others by weight. That
   is ``min(cap, level * weight)`` with one common level, found from the sorted caps.
2. Slot ``j`` of the schedule is the golden-ratio point ``frac(j * phi)``; the cumulative
   targets cut the unit interval, and the piece that holds the point names the source. Slots
   are ranked within their source.
3. The documents of a source, in shuffled (MD5) order, form one long run of words, cut into
   blocks of ``block`` words. Slot rank ``r`` of a source takes block ``r mod blocks`` of it; the last slot
   of a source is cut, or the run goes on, so that the source's words equal its rounded target.

Prefix sums and ranks are two-level (bucket totals, then order within a bucket), so no window
holds more than a bucket whatever share of the rows one source has.

Null text has size 0 and is taken 0 times; a null source is a source of its own; repeated rows
are separate documents. If the corpus has no words, every target is 0. An empty table gives an
empty result. Only doc_id, source and text are read; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.llm.common import word_sizes, written

MAX_REPEATS = 3
CYCLE = 3
BUCKET_ROWS = 4096
#: Fraction of the golden ratio; the schedule's step on the unit interval.
GOLDEN = 0.6180339887498949
#: Cells of the unit interval by which slots meet sources.
CELLS = 4096
#: Slots in one chunk of the two-level ranking.
CHUNK = 1 << 14


def source_targets(sized: DataFrame) -> DataFrame:
    """source, weight, source_size, docs and target for every source of ``sized``.

    The windows here run over sources, one row each, never over documents."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % CYCLE + 1).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * MAX_REPEATS).cast("double"))
    every = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every).cast("double")
    # sources sorted by cap per weight: the first that is not capped fixes the level, later ones give less
    left = (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left
    per = per.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    per = per.withColumn("level", F.max("level").over(every))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(
        F.least("cap", F.col("level") * F.col("weight")))
    return per.select("source", "weight", "source_size", "docs", target.alias("target"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """Slots 0..slots-1 as (slot, sid, rank): the source of each slot and its rank there.

    ``sources`` has sid, lo and hi, the piece of the unit interval of each source. Slots meet
    sources by cells of the interval, an equi-join; points spread evenly over the cells."""
    spark = sources.sparkSession
    cells = sources.where("hi > lo").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(
        f"CAST(id AS DOUBLE) * {GOLDEN}D").alias("x")).withColumn("x", F.col("x") - F.floor("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS))
    hit = points.join(cells, "cell").where("x >= lo AND x < hi").select(
        "slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = hit.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "chunk").orderBy("slot")
    return hit.join(offsets, ["sid", "chunk"]).select(
        "slot", "sid", (F.col("base") + F.row_number().over(inside) - 1).alias("rank"))


def placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with ``at``, the words of their source before them in shuffled order."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # the bucket is the leading part of the key, so buckets are in the key's order
    docs = sized.join(sources.select("source", "sid", "docs").withColumnRenamed("source", "_s"),
                      F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    head = F.conv(F.substring(key, 1, 7), 16, 10).cast("double") / float(16 ** 7)
    docs = docs.select("doc_id", "source", "size", "sid", key.alias("key"),
                       F.floor(head * F.ceil(F.col("docs") / BUCKET_ROWS)).alias("bucket"))
    sums = docs.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy(
        "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    return docs.join(offsets, ["sid", "bucket"]).select(
        "doc_id", "source", "size", "sid",
        (F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("at"))


def mix_sources(docs: DataFrame, block: int | None = None, max_slots: int = 1 << 20) -> DataFrame:
    """doc_id, size, source, source_size, target and taken (words, repeats counted) per document.

    ``block`` is the words of a slot; by default the corpus is cut into at most ``max_slots``
    slots of at least 16 words. Targets are met exactly at any block size, since a source's
    last slot is cut; the block size sets how finely the schedule interleaves sources."""
    sized = written(word_sizes(docs, "doc_id", "source"), "mix-sized")
    sources = source_targets(sized)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    run = by_name.rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("target").over(Window.partitionBy())
    sources = written(sources.select(
        "*", F.row_number().over(by_name).alias("sid"),
        F.round("target").cast("long").alias("quota"),
        F.coalesce((F.sum("target").over(run) - F.col("target")) / whole, F.lit(0.0)).alias("lo"),
        F.coalesce(F.sum("target").over(run) / whole, F.lit(0.0)).alias("hi")), "mix-sources")
    # the last piece ends at 1 whatever the rounding
    last = sources.agg(F.max("sid")).first()[0]
    sources = sources.withColumn("hi", F.when(F.col("sid") == F.lit(last), F.lit(1.0)).otherwise(F.col("hi")))
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    block = block or max(16, -(-total // max_slots))
    # golden-ratio points stray from even shares by a few slots, so the schedule runs on a little
    slots = -(-total // block) * 17 // 16 + 64 if total else 0
    plan = schedule(sources.select("sid", "lo", "hi"), slots)
    per = sources.select("sid", "source_size", "quota")
    # rank r takes words [r * block, (r + 1) * block) of the endless run of its source, up to the quota
    turns = plan.join(per, "sid").select(
        "sid", "source_size", (F.col("rank") * block).alias("start"),
        F.least(F.col("quota"), (F.col("rank") + 1) * block).alias("end")).where("start < end")
    # a source of few slots may get one too few; it takes the rest of its quota at the end
    given = plan.groupBy("sid").agg((F.count(F.lit(1)) * block).alias("given"))
    rest = per.join(given, "sid", "left").select(
        "sid", "source_size", F.coalesce("given", F.lit(0)).alias("start"),
        F.col("quota").alias("end")).where("start < end")
    turns = turns.unionByName(rest)
    # cut the turns where a pass over the source ends, and at the block grid
    turns = turns.select("sid", "source_size", F.explode(F.sequence(
        F.floor(F.col("start") / F.col("source_size")), F.floor((F.col("end") - 1) / F.col("source_size")))
    ).alias("lap"), "start", "end")
    low = F.greatest(F.col("start") - F.col("lap") * F.col("source_size"), F.lit(0))
    high = F.least(F.col("end") - F.col("lap") * F.col("source_size"), F.col("source_size"))
    turns = _cut(turns.select("sid", low.alias("lo"), high.alias("hi")), block)
    pieces = written(placed(sized, sources), "mix-places")
    parts = _cut(pieces.where("size > 0").select(
        "sid", "doc_id", "at", F.col("at").alias("lo"), (F.col("at") + F.col("size")).alias("hi")), block)
    taken = parts.alias("p").join(turns.alias("t"), (F.col("p.sid") == F.col("t.sid")) & (
        F.col("p.cell") == F.col("t.cell"))).select("p.sid", "p.doc_id", "p.at", F.greatest(F.lit(0), F.least(
            "p.hi", "t.hi") - F.greatest("p.lo", "t.lo")).alias("n"))
    taken = taken.groupBy(F.col("sid").alias("_sid"), F.col("at").alias("_at")).agg(F.sum("n").alias("taken"))
    out = pieces.join(taken, (F.col("sid") == F.col("_sid")) & (F.col("at") == F.col("_at"))
                      & (F.col("size") > 0), "left")
    info = sources.select(F.col("sid").alias("_k"), "source_size", "target")
    return out.join(info, F.col("sid") == F.col("_k")).select(
        "doc_id", "size", "source", "source_size", "target",
        F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"))


def _cut(spans: DataFrame, block: int) -> DataFrame:
    """Spans [lo, hi) cut at multiples of ``block``, with the cell they lie in."""
    cells = spans.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    return cells.withColumn("lo", F.greatest("lo", F.col("cell") * block)).withColumn(
        "hi", F.least("hi", (F.col("cell") + 1) * block))
