"""Token alignment, Orchard clusters and the de-duplicating stream against brute force."""

import hashlib
import math
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corpus_engine.llm import orchard, stream_dedup, token_align
from corpus_engine.session import shared_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
HARD = [None, "", " ", "  a  b ", "x▁y", "<|endoftext|> and <s>", "日本語 テキスト x", "a\nb \n c", "\x00 z", "don't  we'll 've",
        "x" * 3000, "é " * 50, "  a　b c", "😀 😀", "ab́c ﬁ", "a ɐx ɸɸ", "word " * 3_000, " " * 2_000, "a\tb" * 900]


def by_key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def aligned(rows):
    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    docs = []
    for i, text in rows:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False)
        b = b_tok.encode(text or "")
        bytes_a = [bytes(letter[c] for c in t) for t in a.tokens]
        pieces = [b_tok.id_to_piece(x) for x in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            docs.append((i, None))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, at_a, at_b = [], 0, 0
        place_a, place_b = ({e: n for n, e in enumerate(ends)} for ends in (ends_a, ends_b))
        for cut in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = place_a[cut] + 1, place_b[cut] + 1
            groups.append(",".join(map(str, a.ids[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        links, j = [], 0
        for k, end in enumerate(ends_a):
            start = ends_a[k - 1] if k else 0
            while ends_b[j] <= start:
                j += 1
            m = j
            while m < len(b) and (ends_b[m - 1] if m else 0) < end:
                links.append((a.ids[k], b[m]))
                m += 1
        docs.append((i, (len(a.ids), len(b), groups, links)))
    count = Counter(p for _, d in docs if d for p in set(d[3]))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(i, 0, 0, 0, 0, 0, 0, "") if d is None else
            (i, d[0], d[1], len(d[2]), len(d[3]), sum(count[p] == top[p[0]] for p in d[3]), sum(count[p] for p in d[3]),
             hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for i, d in docs]


def texts(spark, n):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(n).collect()
            if len(r["text"] or "") < 20_000]


@pytest.mark.parametrize("sizes", [{}, {"shard_pairs": 300, "block_pairs": 2000}])
def test_alignment(spark, monkeypatch, sizes):
    """Also with small shards, several blocks, a deep tree, short steps and a cache that overflows."""
    if sizes:
        # closures carry the module by name: bounds that tasks read are not patched there
        monkeypatch.setattr(token_align, "FAN_IN", 2)
    rows = texts(spark, 60) + [(None if i % 5 == 0 else 7000 + i, t) for i, t in enumerate(HARD)] + [(3, "a b c")] * 2
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, a int, code string").repartition(6)
    got = sorted((tuple(r) for r in token_align.align(df, **sizes).collect()), key=by_key)
    assert got == sorted(aligned(rows), key=by_key)


def test_alignment_of_no_rows(spark):
    assert token_align.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in token_align.align(nothing).collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_pieces_forgotten_and_encoded_alone(monkeypatch):
    """Ids do not depend on what is known, on neighbours, or on which encoder is used."""
    both = token_align.Pair(*map(token_align.tokenizer_file, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    batch = ["the cat, the dog.\nA  tab\there 'quoted' 1,234 über", None, "x▁y the", " lead", "the", "日本 the"]
    want = [x.tolist() for x in both.documents(batch)]
    assert [x.tolist() for x in both.documents(batch)] == want
    for name, value in (("CACHE", 3), ("CACHE_LETTERS", 1), ("LONG", 0), ("TOGETHER", 5), ("PLAIN", 0)):
        monkeypatch.setattr(token_align, name, value)
        assert [x.tolist() for x in both.documents(batch)] == want
        assert [x.tolist() for x in both.documents(batch)] == want


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 47, n))
        f = token_align.PerfectHash.unpacked(token_align.PerfectHash.build(keys).packed())
        assert sorted(f.index(keys)) == list(range(len(keys)))


def test_stranger_is_refused():
    keys = np.arange(10, dtype=np.int64) << 32
    f = token_align.PerfectHash.build(keys)
    order = np.empty(10, np.int64)
    order[f.index(keys)] = keys
    block = token_align.Block(0, 1 << 31, [(0, f.packed(), order.tobytes())])
    assert len(block.index(keys)) == 10
    with pytest.raises(ValueError):
        block.index(np.array([5 << 32 | 1], np.int64))


def clustered(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(float(v) * 64) for v in x]) for i, x in rows
            if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    c = [x for _, x in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[near(x)[1]].append(x)
        for j, v in groups.items():
            c[j] = [sum(col) // len(v) for col in zip(*v, strict=True)]
    out = [(i, *near(x)) for i, x in kept]
    inertia = Counter()
    for _, d, j in out:
        inertia[j] += d

    def long(v):
        return v if v < 1 << 63 else None

    whole = all(d < 1 << 63 for _, d, _ in out)
    return [(i, j, long(d), long(inertia[j]) if all(e < 1 << 63 for _, e, g in out if g == j) else None,
             long(sum(inertia.values())) if whole else None, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in out]


def vectors(spark):
    return [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]


def clusters(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, c string")
    return sorted((tuple(r) for r in orchard.cluster(df.repartition(5)).collect()), key=by_key)


def test_clusters(spark):
    rows = vectors(spark)
    f32 = [float(np.float32(v)) for v in np.linspace(-1, 1, 64)]
    rows += [(9000, None), (9001, []), (9002, f32[:63]), (9003, [*f32, 0.5]), (9004, [None, *f32[1:]]), (9005, [float("nan"), *f32[1:]]),
             (9006, [float("-inf"), *f32[1:]]), (None, f32), (9007, f32), (9007, f32), (9007, f32[::-1])]
    rows += [(9100 + i, [float(i % 3)] * 64) for i in range(40)]  # ties
    assert clusters(spark, rows) == sorted(clustered(rows), key=by_key)


def test_clusters_of_huge_components(spark):
    big = float(np.float32(3e38))
    rows = [(i, [float(i)] * 64) for i in range(20)] + [(50, [big] * 64), (51, [-big] * 64), (52, [1e7] * 64)]
    assert clusters(spark, rows) == sorted(clustered(rows), key=by_key)


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, [0.25] * 64), (2, [0.5] * 64), (2, [0.5] * 64)]
    assert clusters(spark, rows) == sorted(clustered(rows), key=by_key)
    assert clusters(spark, [(1, [0.5])]) == []
    assert clusters(spark, []) == []
    assert [r[:3] for r in clusters(spark, [(None, [0.5] * 64)])] == [(None, 0, 0)]


@pytest.mark.parametrize("seed", range(5))
def test_orchard_search_is_exact_and_skips(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-300, 300, (40, 3))
    x = np.concatenate([c + rng.integers(-9, 10, (50, 3)) for c in centres] + [centres, rng.integers(-4, 4, (200, 3))])
    search = orchard.Orchard(centres.tolist())
    number, distance, measured = search.nearest(x)
    all_d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert np.array_equal(number, all_d.argmin(axis=1)) and np.array_equal(distance, all_d.min(axis=1))
    assert measured < 0.5 * all_d.size


def deduplicated(rows):
    """rows of (doc_id, text) in the order of their locators."""
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((i is None, i or 0, n, i))
    out = []
    for t, members in groups.items():
        first = min(members)
        out += [(m[3], first[3], len(members), m == first, hashlib.sha256(t.encode()).hexdigest()) for m in members]
    return sorted(out, key=by_key)


COPIES = [(5, "a  b"), (None, "a b"), (3, "a\tb"), (3, "a\n \x0bb"), (9, " a b"), (10, None), (11, ""), (12, "　"), (13, "a b"),
          (14, "long " * 30_000), (2, "long\n" * 30_000), (15, "\r"), (16, " "), (None, None), (17, "A b"), (None, "unique ü")]


def write(spark, rows, path, mode="append"):
    spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, n int, digest string").coalesce(1).write.mode(mode).parquet(path)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=by_key)


@pytest.mark.parametrize("digits", [64, 1])
def test_stream_dedup(spark, digits):
    """Digests of one hexadecimal digit collide: full bytes decide."""
    path = shared_path(spark, "test-stream", uuid.uuid4().hex)
    write(spark, COPIES, path)
    out = stream_dedup.deduplicate(spark, path, digest=lambda sha: F.substring(sha, 1, digits))
    assert result(out) == deduplicated(COPIES)
    # the locator of the row that stays leads to its content
    keep = {(r["keep_path"], r["keep_row"]) for r in out.collect()}
    kept = spark.read.parquet(path).select("_metadata.file_path", "_metadata.row_index", "doc_id").collect()
    assert {r["doc_id"] for r in kept if (r["file_path"], r["row_index"]) in keep} == {r["keep_id"] for r in out.collect()}


def test_stream_dedup_goes_on(spark):
    """New files meet the state of earlier runs; a run without new files changes nothing."""
    path, work = (shared_path(spark, "test-stream", uuid.uuid4().hex) for _ in range(2))
    rows = COPIES + texts(spark, 80)
    for at in range(0, len(rows), 40):
        write(spark, rows[at:at + 40], path)
        out = stream_dedup.deduplicate(spark, path, work, batch_bytes=1)
        got = result(out)
    want = deduplicated(rows)
    assert [r for r in got if r[0] is not None] == [r for r in want if r[0] is not None] and len(got) == len(want)
    assert result(stream_dedup.deduplicate(spark, path, work)) == got


def test_stream_dedup_of_no_rows(spark):
    path = shared_path(spark, "test-stream", uuid.uuid4().hex)
    write(spark, [], path)
    assert result(stream_dedup.deduplicate(spark, path)) == []
