"""Exact Jaccard join of documents on word shingles, by pivots in the Jaccard metric space.

Distance is one minus the Jaccard similarity of two shingle sets. The join runs in these steps:

1. **Classes.** Documents with equal sets are one class, represented by its smallest doc_id.
2. **Token pivots.** A shingle ``t`` is the singleton pivot ``{t}``; a set is nearer to it than
   1 only if it holds ``t``. Shingles are ordered globally, frequent ones last. A set lies in
   the region of its first shingle and is replicated to the regions of its first
   ``n - ceil(0.75 n) + GUARANTEE`` shingles: two linked sets share at least ``GUARANTEE`` of
   these boundary regions (all regions for tiny sets). Sets that meet others in fewer regions
   have no link. Of a set's regions the ``GUARANTEE - 1`` largest can be left out of the search for
   pairs: the smallest region that two linked sets share is among the largest of neither.
3. **Document pivots.** The smallest document of a region is its pivot; members whose distance
   to it is at most the radius link to it directly. A region whose members are one component
   is finished: a large group of near copies leaves here without its pairs.
4. **Recursion.** Regions that still hold several components and many members choose their
   next pivot among the rest and repeat. What then remains is joined, across components only,
   inside the triangle-inequality windows: members whose distances to the region's pivot
   differ by more than the radius cannot link, nor can sets whose sizes differ too much, nor
   pairs that share too few boundary shingles. Small regions join on their shingle. Large regions
   of one pivot are one group, cut into blocks of bounded size that meet two at a time. Survivors
   are compared in full.

So every link between different components is found, and components are exact. Shingles are
compared by 64-bit hashes; regions by 40 bits of them, which only adds candidates.

Null doc_ids are vertices of no link (component null). Null and empty texts have no shingles
and their own component. Rows that share a doc_id are one document: links of any of its texts
are its links. An empty table gives an empty result. Only doc_id and text are read by the
join; :func:`keep_one` passes all columns through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.llm.common import discard, mixed, shipped, word_hashes, written_and_released

SHINGLE = 5
#: A link is 100 * intersection >= LINK * union.
LINK = 75
GUARANTEE = 12
#: Shingles of so many documents are frequent; raised until at most FREQUENT_MAX are.
FREQUENT = 32
FREQUENT_MAX = 500_000
#: Regions of more members choose further pivots before they are joined.
LARGE = 64
ROUNDS = 2
#: Members of one block of a large group.
BLOCK = 512
_K = np.uint64(0x9E3779B97F4A7C15)
def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    h = word_hashes((text or "").encode())
    if not len(h):
        return h
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = out * _K + h[i:i + n]
    out = np.sort(mixed(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def prefix_length(n: int, guarantee: int = GUARANTEE) -> int:
    """Leading shingles by which linked sets of this size surely meet."""
    return min(n, n - (LINK * n + 99) // 100 + guarantee)


def _texts(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def _count_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, count) of shingles met twice or more in a chunk of the task's distinct sets."""
    chunk, held, seen = [], 0, set()

    def flush():
        tokens, counts = np.unique(np.concatenate(chunk), return_counts=True)
        many = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(tokens[many].view(np.int64)), pa.array(
            counts[many].astype(np.int64))], ["token", "n"])

    for _, text in _texts(batches):
        s = shingles(text)
        mark = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
        if len(s) and mark not in seen:
            seen.add(mark)
            chunk.append(s)
            held += len(s)
            if held >= 2_000_000:
                yield flush()
                chunk, held = [], 0
                seen.clear()
    if chunk:
        yield flush()


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that are frequent in the corpus, FREQUENT_MAX at most.

    Tasks drop shingles they meet once, so only repeated ones are shuffled; the least count of
    a frequent shingle doubles until the table has its bounded size. Only the order of
    shingles depends on it, never a link."""
    counts = docs.select("doc_id", "text").mapInArrow(_count_repeated, "token long, n long")
    counts = written_and_released(counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "shingle-counts")
    steps = counts.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()  # one row per power of two
    least, held = 64, 0
    for row in sorted(steps, key=lambda r: -r["k"]):
        held += row["count"]
        if held > FREQUENT_MAX:
            break
        least = row["k"]
    tokens = [r[0] for r in counts.where(F.col("n") >= F.lit(float(2 ** least))).select("token").collect()]
    return np.sort(np.array(tokens, np.int64).view(np.uint64))


def _signed(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        for b in batches:
            ids, ns, his, los, prefixes = [], [], [], [], []
            for i, text in _texts([b]):
                s = shingles(text)
                mark = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                p = prefix_length(len(s))
                if len(last) and len(s):
                    at = np.searchsorted(last, s)
                    at[at == len(last)] = 0
                    late = last[at] == s
                    first = s[~late][:p]
                    if len(first) < p:
                        first = np.concatenate([first, s[late][:p - len(first)]])
                else:
                    first = s[:p]
                ids.append(i)
                ns.append(len(s))
                his.append(int(mark[0]))
                los.append(int(mark[1]))
                prefixes.append((first >> np.uint64(24)).astype(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n", "hi", "lo", "prefix"])
    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b), rows of one b together, to (a, b, both, either)."""
    held, sb = None, None
    for batch in batches:
        a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
        both, either = [], []
        for x, y in zip(ta, tb, strict=True):
            if held is None or y != held:
                held, sb = y, shingles(y)
            sa = shingles(x)
            n = len(np.intersect1d(sa, sb, assume_unique=True))
            both.append(n)
            either.append(len(sa) + len(sb) - n)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(both, pa.int64()),
                                          pa.array(either, pa.int64())], ["a", "b", "both", "either"])


def _distances(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, both, either) for distinct pairs, written; the smallest distance per pair."""
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    full = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    out = full.select("a", "b", "ta", "tb").mapInArrow(_compare, "a long, b long, both long, either long")
    return written_and_released(out, "jaccard-distances")


def _linked(distances: DataFrame) -> DataFrame:
    return distances.where(F.lit(100) * F.col("both") >= F.lit(LINK) * F.col("either")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(v, comp): the smallest vertex reachable over ``links`` (a, b), for every linked vertex.

    Rounds of smallest-neighbour labels with pointer jumping, each written to the shared folder."""
    edges = written_and_released(links.union(links.select("b", "a")).distinct().toDF("v", "w"), "links")
    labels = written_and_released(edges.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("v").alias("w"), "comp"), "w").groupBy("v").agg(F.min("comp").alias("m"))
        low = labels.join(near, "v").select("v", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        jump = low.select(F.col("v").alias("comp"), F.col("comp").alias("to"))
        new = written_and_released(low.join(jump, "comp", "left").select("v", F.least("comp", F.coalesce("to", "comp")).alias("comp"),
                                                            "old"), "labels")
        if new.where("comp < old").isEmpty():
            return new.select("v", "comp")
        labels = new.select("v", "comp")


def _with_comps(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps.withColumnRenamed("v", "doc"), "doc", "left").withColumn(
        "comp", F.coalesce("comp", "doc"))


def _open_regions(rows: DataFrame) -> DataFrame:
    """token, members and pivot of the regions that hold several components."""
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.min("comp").alias("c0"),
                                     F.max("comp").alias("c1")).where("c0 < c1")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    spark = shipped(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs))
    base = written_and_released(docs.mapInArrow(_signed(frequent), "doc_id long, n long, hi long, lo long, prefix array<long>"), "sets")
    sets = base.where("n > 0 AND doc_id IS NOT NULL")
    classes = written_and_released(sets.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "set-classes")
    members = base.select("doc_id", "n", "hi", "lo").join(classes, ["hi", "lo"], "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep"))

    reps = sets.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    rows = reps.select(F.col("doc_id").alias("doc"), "n", F.posexplode("prefix").alias("pos", "token"))
    regions = rows.groupBy("token").agg(F.min("doc").alias("pivot"), F.max("doc").alias("top")).where(
        "pivot < top").select("token", "pivot")
    # a table of its own: its shuffle of all boundary rows is gone before the join shuffles them again
    regions = written_and_released(regions, "region-pivots")
    live = written_and_released(rows.join(regions, "token").select("token", "doc", "n", "pos").distinct(), "regions")
    discard(regions)

    # documents that meet others in too few regions have no link; without them regions shrink
    need = _need("n")
    for _ in range(2):
        busy = live.groupBy("doc", "n").agg(F.countDistinct("token").alias("k")).where(F.col("k") >= need).select("doc").distinct()
        rows = live.join(busy, "doc", "left_semi")
        regions = rows.groupBy("token").agg(F.min("doc").alias("pivot"), F.max("doc").alias("top"), F.count(
            F.lit(1)).alias("members")).where("pivot < top").select("token", "pivot", "members")
        smaller = written_and_released(rows.select("token", "doc", "n", "pos").join(regions, "token"), "regions")
        discard(live)
        live = smaller
    rows = live
    texts = written_and_released(docs.join(rows.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"), "busy-texts")

    # document pivots: members that share much of their boundary with the region's smallest document
    star = rows.where("doc <> pivot").groupBy("doc", "n", "pivot").agg(F.count(F.lit(1)).alias("c")).where(
        F.col("c") * 12 >= F.col("n")).select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()
    far = _distances(star, texts)
    links = _linked(far)
    comps = components(links)

    delta = far.groupBy(F.col("a").alias("doc"), F.col("b").alias("pivot")).agg(
        F.min(1 - F.col("both") / F.col("either")).alias("delta"))
    # the largest regions of a document, as many as it can do without, search no pairs
    by_size = Window.partitionBy("doc", "n").orderBy(F.desc("members"), "token")
    rows = rows.withColumn("rank", F.row_number().over(by_size)).where(F.col("rank") >= need).drop("rank")
    placed = written_and_released(rows.join(delta, ["doc", "pivot"], "left"), "placed")
    for _ in range(ROUNDS):
        now = _with_comps(placed, comps)
        large = _open_regions(now).where(F.col("members") > LARGE).select("token", "c0")
        inside = written_and_released(now.join(large, "token").where("comp <> c0"), "rest")
        if inside.isEmpty():
            break
        # the next pivot is the smallest member outside the first component; it meets the whole region
        nxt = inside.groupBy("token").agg(F.min("doc").alias("b"))
        nxt = nxt.join(placed.select("token", F.col("doc").alias("b"), F.col("n").alias("nb"),
                                     F.col("delta").alias("db")), ["token", "b"])
        meet = placed.join(nxt, "token").where("doc <> b").where(_window("n", "nb", "delta", "db"))
        pairs = meet.groupBy(F.col("doc").alias("a"), "b", "n", "nb").agg(F.count(F.lit(1)).alias("c"))
        pairs = pairs.where(F.col("c") * 12 >= F.greatest("n", "nb")).select("a", "b").distinct()
        found = _linked(_distances(pairs, texts))
        if found.isEmpty():
            break
        links = links.union(found)
        comps = components(links)

    # what remains: pairs across components within their regions
    now = written_and_released(_with_comps(placed, comps), "placed-comps")
    rest = now.join(_open_regions(now).select("token", F.col("members").alias("held")), "token")
    rest = written_and_released(rest.withColumn("big", F.sum(F.when(F.col("held") > LARGE, 1).otherwise(0)).over(
        Window.partitionBy("doc", "n"))), "open-regions")
    pairs = _small_pairs(rest.where(F.col("held") <= LARGE)).unionByName(
        _large_pairs(rest.where(F.col("held") > LARGE), base)).distinct()
    links = links.union(_linked(_distances(pairs, texts)))
    comps = components(links)
    out = members.join(comps.withColumnRenamed("v", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.coalesce("comp", "rep", "doc_id").alias("component_id"))


def _need(n: str) -> Column:
    """Boundary regions that a set of ``n`` shares with any set it links to, at least."""
    return F.least(F.lit(GUARANTEE), F.ceil(F.col(n) * LINK / 100))


def _behind(na: str, nb: str) -> Column:
    """Shingles behind the boundary, which a pair may share unseen."""
    behind = lambda n: F.greatest(F.ceil(F.col(n) * LINK / 100) - GUARANTEE, F.lit(0))
    return F.greatest(behind(na), behind(nb))


def _least_shared(na: str, nb: str) -> Column:
    return F.ceil((F.col(na) + F.col(nb)) * LINK / (100 + LINK))


def _small_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) that meet in small regions and share enough of their boundary shingles.

    ``big`` is the number of a document's large regions, where a pair may share shingles unseen."""
    def side(d, n, c, delta, big):
        return rows.select("token", F.col("doc").alias(d), F.col("n").alias(n), F.col("comp").alias(c),
                           F.col("delta").alias(delta), F.col("big").alias(big))

    meet = side("a", "na", "ca", "da", "la").join(side("b", "nb", "cb", "db", "lb"), "token").where(
        "a < b AND ca <> cb").where(_window("na", "nb", "da", "db"))
    pairs = meet.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"), F.max(F.least("la", "lb")).alias("l"))
    unseen = _need("na") - 1 + _need("nb") - 1 + F.col("l") + _behind("na", "nb")
    return pairs.where(F.col("c") + unseen >= _least_shared("na", "nb")).select("a", "b")


def _blocks_meet(key, table):
    """Members of two blocks of a group to the pairs (a, b) that may link, by boundary shingles."""
    ids, n, comp, delta, block, lists = (table.column(c).to_pylist() for c in ("doc", "n", "comp", "delta", "block", "prefix"))
    first, second = key[1].as_py(), key[2].as_py()
    left = [i for i in range(len(ids)) if block[i] == first]
    right = [i for i in range(len(ids)) if block[i] == second]
    sizes = np.array(n)
    comps = np.array(comp)
    away = np.array([np.nan if d is None else d for d in delta], np.float64)
    behind = np.maximum(-(-LINK * sizes // 100) - GUARANTEE, 0)
    homes: dict[int, list[int]] = {}
    for j, i in enumerate(right):
        for t in lists[i]:
            homes.setdefault(t, []).append(j)
    right_at = np.array(right, np.int64)
    out_a, out_b = [], []
    for i in left:
        met = [j for t in lists[i] for j in homes.get(t, ())]
        if not met:
            continue
        shared = np.bincount(np.array(met), minlength=len(right))
        least = -(-LINK * (sizes[i] + sizes[right_at]) // (100 + LINK))
        ok = (shared > 0) & (comps[right_at] != comps[i]) & (shared + np.maximum(behind[i], behind[right_at]) >= least)
        ok &= 100 * np.minimum(sizes[i], sizes[right_at]) >= LINK * np.maximum(sizes[i], sizes[right_at])
        ok &= ~(np.abs(away[right_at] - away[i]) > (100 - LINK) / 100 + 1e-9)
        for j in right_at[ok]:
            if ids[i] != ids[j]:
                out_a.append(min(ids[i], ids[j]))
                out_b.append(max(ids[i], ids[j]))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _large_pairs(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Pairs (a, b) of large regions: the members of one pivot's regions are a group, dealt into
    blocks of about ``BLOCK`` by a hash; two blocks meet in one task, which holds their boundary lists."""
    group = rows.select("pivot", "doc", "n", "comp", "delta").distinct()
    sizes = group.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    group = group.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    lists = base.where("n > 0").select(F.col("doc_id").alias("doc"), "n", "prefix").join(
        group.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc", "n"])
    group = group.join(lists, ["doc", "n"])
    meet = group.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select("pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                       "doc", "n", "comp", "delta", "block", "prefix")
    return meet.groupBy("pivot", "low", "high").applyInArrow(_blocks_meet, "a long, b long")


def _window(na: str, nb: str, da: str, db: str):
    """Pairs that the sizes and the distances to the region's pivot allow to link."""
    size = F.lit(100) * F.least(na, nb) >= F.lit(LINK) * F.greatest(na, nb)
    return size & F.coalesce(F.abs(F.col(da) - F.col(db)) <= (100 - LINK) / 100 + 1e-9, F.lit(True))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one document of every component (the one with the smallest id).

    Rows that share the kept doc_id are all kept, and so are rows with a null doc_id."""
    names = docs.columns
    kept = jaccard_components(docs.select("doc_id", "text"))
    gone = written_and_released(kept.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-copies")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti").select(*names)


__all__ = ["jaccard_components", "keep_one", "components", "shingles", "prefix_length"]
