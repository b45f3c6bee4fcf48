"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ARC_TO_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY sha1(h)) AS top, strlen(h)::BIGINT AS n FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM t
"""

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
           FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS w
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
s AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
             len(list_filter(ws, lambda x: list_contains({{stop}}, x))) AS n_stop,
             len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_adjacent,
             len(list_filter(ls, lambda x: substr(ltrim(x), 1, 1) IN ('-', '*', '•'))) AS n_bullets,
             len(list_filter(ls, lambda x: ends_with(rtrim(x), '...') OR ends_with(rtrim(x), '…'))) AS n_ellipses
      FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 16 AND n_symbols / n_words <= 0.25 AND n_stop / n_words >= 0.02
       AND n_upper / word_chars <= 0.5 AND n_dup_lines / n_lines <= 0.4 AND n_adjacent / n_words <= 0.3
       AND n_bullets / n_lines <= 0.9 AND n_ellipses / n_lines <= 0.3 AS kept
FROM b
"""

MIX_SOURCES = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))
             AS level FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, cap, weight, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS level FROM l),
g AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM t),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, round(g.target)::BIGINT AS quota,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size
       + greatest(0, least(pos + size, quota % source_size) - pos) END::BIGINT AS taken
FROM p
"""

JACCARD_JOIN = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.other)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""


STREAM_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


def _orchard(k: int = 16, rounds: int = 3) -> str:
    """k-means by full search: the result that Orchard's search must give."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    ctes = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
            f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS c, x
FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(({{'d': d, 'c': c}})) AS best
FROM (SELECT v.vec_id, v.x, c.c, {distance} AS d FROM v, c{r} c) GROUP BY vec_id)""")
        if r < rounds:
            ctes.append(f"""m{r} AS (SELECT c, list(m ORDER BY i) AS x FROM (SELECT best.c AS c, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m
FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY c)""")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c0.c, coalesce(m.x, c0.x) AS x FROM c{r} c0 LEFT JOIN m{r} m ON m.c = c0.c)")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, a.best.c AS cluster, a.best.d::BIGINT AS distance, (sum(a.best.d) OVER (PARTITION BY a.best.c))::BIGINT AS cluster_inertia,
       (sum(a.best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c"""


def _stop_list() -> str:
    from corpus_engine.llm.quality import STOP_WORDS

    words = sorted({v for w in STOP_WORDS for v in (w, w.capitalize(), w.upper())})
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


LLM_ORACLES = {
    "op1_arc_to_warc": ARC_TO_WARC.strip(),
    "op5_quality_rules": QUALITY_RULES.replace("{stop}", _stop_list()).strip(),
    "op6_mix_sources": MIX_SOURCES.strip(),
    "op8_jaccard_join": JACCARD_JOIN.strip(),
    "op12_orchard_clusters": _orchard(),
    "op13_stream_dedup": STREAM_DEDUP.strip(),
}
