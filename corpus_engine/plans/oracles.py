"""DuckDB oracle SQL for the registered queries.

The SQL is generated from the same rule constants as the Spark expressions (patterns,
templates, HTML steps), so a rule changes in one place. DuckDB specifics: RE2 regexes
(no lookaround: the ISBN rule has no oracle), ``\\1`` group references, string literals
without backslash escapes, Python-style lambdas.
"""

from __future__ import annotations

from corpus_engine.config import DEFAULTS
from corpus_engine.functions import html as H
from corpus_engine.functions import prompts as P
from corpus_engine.functions import text as T
from corpus_engine.operators import feedback as FB
from corpus_engine.operators import sentences as SE

NL = "chr(10)"


def lit(s: str) -> str:
    """A DuckDB string literal; non-printable characters are spelled with chr()."""
    parts, buf = [], ""
    for ch in s:
        if ch.isprintable() or ch == " ":
            buf += ch
        else:
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def rx(expr: str, pattern: str, repl: str = "") -> str:
    import re
    repl2 = re.sub(r"\$(\d)", r"\\\1", repl)
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(repl2)}, 'g')"


ASCII_WS = lit(T.ASCII_WS_CHARS)
UNI_WS = lit(T.UNICODE_WS_CHARS)


def strip_ws(expr: str) -> str:
    return f"trim({expr}, {UNI_WS})"


def filter_lines(expr: str, min_len: int = DEFAULTS.min_line_length) -> str:
    return (f"array_to_string(list_filter(string_split({expr}, {NL}), lambda ln_: "
            f"length(trim(ln_, {ASCII_WS})) >= {min_len} AND regexp_matches(ln_, '[a-zA-Z]')), {NL})")


def clean(expr: str) -> str:
    out = f"lower({expr})"
    for name, pattern in T.CLEAN_STEPS:
        if name == "isbn":
            continue  # lookahead: not expressible in RE2
        if name == "allowed_chars":
            pattern = T.DISALLOWED  # the oracle keeps the whitelist's own negated class
        out = rx(out, pattern)
    return filter_lines(out)


def word_count(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, {lit(T.NON_WS + '+')}))::BIGINT"  # matches, not a split


def normalize(expr: str) -> str:
    return f"lower(translate(regexp_replace({expr}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'), 'Σ', 'σ'))"


def sentences(expr: str) -> str:
    marked = rx(expr, T.SENTENCE_END, "$1" + T._SENT_MARK)
    return (f"list_filter(list_transform(string_split({marked}, {lit(T._SENT_MARK)}), "
            f"lambda s_: {strip_ws('s_')}), lambda s_: s_ <> '')")


def sentence_chunks(sents: str, max_size: int = DEFAULTS.sentence_max_chunk) -> str:
    step = (f"lambda acc_, s_: CASE WHEN length(acc_.cur) + length(s_) <= {max_size} "
            f"THEN {{'ch': acc_.ch, 'cur': acc_.cur || ' ' || s_}} "
            f"ELSE {{'ch': CASE WHEN acc_.cur <> '' THEN list_append(acc_.ch, {strip_ws('acc_.cur')}) "
            f"ELSE acc_.ch END, 'cur': s_}} END")
    fold = f"list_reduce({sents}, {step}, {{'ch': []::VARCHAR[], 'cur': ''}})"
    return (f"list_transform([{fold}], lambda r_: CASE WHEN r_.cur <> '' THEN "
            f"list_append(r_.ch, {strip_ws('r_.cur')}) ELSE r_.ch END)[1]")


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {lit(T.WS + '+')}), lambda w_: w_ <> '')"


def word_chunks(expr: str, size: int = DEFAULTS.word_chunk_size) -> str:
    step = (f"lambda acc_, w_: CASE WHEN acc_.s + length(w_) > {size} "
            f"THEN {{'ch': list_append(acc_.ch, acc_.cur), 'cur': w_, 'n': 1, 's': length(w_)}} "
            f"ELSE {{'ch': acc_.ch, 'cur': CASE WHEN acc_.n = 0 THEN w_ ELSE acc_.cur || ' ' || w_ END, "
            f"'n': acc_.n + 1, 's': acc_.s + length(w_) + 1}} END")
    fold = f"list_reduce({words(expr)}, {step}, {{'ch': []::VARCHAR[], 'cur': '', 'n': 0::BIGINT, 's': 0::BIGINT}})"
    return (f"list_transform([{fold}], lambda r_: CASE WHEN r_.n > 0 THEN list_append(r_.ch, r_.cur) "
            f"ELSE r_.ch END)[1]")


def fixed_chunks(expr: str, size: int = DEFAULTS.fixed_chunk_size, overlap: int = DEFAULTS.fixed_overlap) -> str:
    step = size - overlap
    return (f"list_transform(CASE WHEN length({expr}) > 0 THEN generate_series(0, (length({expr}) - 1) // {step}) "
            f"ELSE []::BIGINT[] END, lambda i_: substring({expr}, i_ * {step} + 1, {size}))")


def explode_chunks(src: str, key: str, arr: str) -> str:
    """Rows (key, chunk_index, id, text) from a table with a chunk array column."""
    return (f"SELECT {key}, unnest(generate_series(0, len({arr}) - 1))::INTEGER AS chunk_index, "
            f"unnest({arr}) AS text FROM {src}")


def with_ids(src: str, key: str) -> str:
    return (f"SELECT {key}, chunk_index, {key}::VARCHAR || '_chunk_' || chunk_index::VARCHAR AS id, text "
            f"FROM ({src})")


DIM = DEFAULTS.embed_dim


def embed_ctes(src: str, key_cols: str, text: str, name: str) -> str:
    """CTEs ``{name}_b``, ``{name}_c``, ``{name}`` (with column e = the embedding)."""
    return (
        f"{name}_b AS (SELECT {key_cols}, list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), "
        f"lambda tk_: (('0x' || substr(md5(tk_), 1, 8))::BIGINT % {DIM})::INTEGER) AS b FROM {src}),\n"
        f"{name}_c AS (SELECT {key_cols}, list_transform(range({DIM}), lambda i_: "
        f"(len(b) - len(list_filter(b, lambda y_: y_ <> i_)))::DOUBLE) AS c FROM {name}_b),\n"
        f"{name}_s AS (SELECT {key_cols}, c, list_reduce(c, lambda a_, x_: a_ + x_ * x_, 0.0::DOUBLE) AS ss FROM {name}_c),\n"
        f"{name} AS (SELECT {key_cols}, list_transform(c, lambda x_: (CASE WHEN ss > 0 THEN x_ / sqrt(ss) "
        f"ELSE 0.0 END)::FLOAT) AS e FROM {name}_s)"
    )


def sq_l2(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(list_zip({a}, {b}), lambda p_: "
            f"(p_[1]::DOUBLE - p_[2]::DOUBLE) * (p_[1]::DOUBLE - p_[2]::DOUBLE)), lambda a_, x_: a_ + x_, 0.0::DOUBLE)")


def dot(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(list_zip({a}, {b}), lambda p_: p_[1]::DOUBLE * p_[2]::DOUBLE), "
            f"lambda a_, x_: a_ + x_, 0.0::DOUBLE)")


def norm(a: str) -> str:
    return f"sqrt(list_reduce(list_transform({a}, lambda x_: x_::DOUBLE * x_::DOUBLE), lambda a_, x_: a_ + x_, 0.0::DOUBLE))"


# --- shared CTE chains ------------------------------------------------------------------

SENT_CHUNKS = (
    f"sc_a AS (SELECT doc_id, {sentences('text')} AS ss FROM documents),\n"
    f"sc_b AS (SELECT doc_id, {sentence_chunks('ss')} AS chs FROM sc_a),\n"
    f"chunks AS ({with_ids(explode_chunks('sc_b', 'doc_id', 'chs'), 'doc_id')})"
)
CORPUS = SENT_CHUNKS + ",\n" + embed_ctes("chunks", "id, text", "text", "corpus")
QUESTIONS = embed_ctes("(SELECT item_id AS query_id, text AS question FROM benchmark)", "query_id, question",
                       "question", "questions")


def knn_ctes(k: int, queries: str = "questions", corpus: str = "corpus", name: str = "knn",
             qcols: str = "q.query_id", ccols: str = "c.id, c.text") -> str:
    return (f"{name}_d AS (SELECT {qcols}, {ccols}, round({sq_l2('q.e', 'c.e')}, {DEFAULTS.distance_decimals}) "
            f"AS distance FROM {queries} q, {corpus} c),\n"
            f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)"
            f"::INTEGER AS rank FROM {name}_d) WHERE rank <= {k})")


def dedup_ctes(src: str, k: int, name: str = "dd") -> str:
    return (f"{name}_a AS (SELECT *, row_number() OVER (PARTITION BY query_id, {normalize('text')} ORDER BY rank) AS f_ "
            f"FROM {src}),\n"
            f"{name} AS (SELECT * REPLACE (rk_ AS rank) FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
            f"ORDER BY rank)::INTEGER AS rk_ FROM {name}_a WHERE f_ = 1) WHERE rk_ <= {k})")


K_APP, FETCH = DEFAULTS.top_k_app, DEFAULTS.top_k_app * DEFAULTS.overfetch_factor
CONTEXT = (CORPUS + ",\n" + QUESTIONS + ",\n" + knn_ctes(FETCH) + ",\n" + dedup_ctes("knn", K_APP) + ",\n"
           f"ctx AS (SELECT query_id, string_agg(rank::VARCHAR || '. ' || text, {NL} || {NL} ORDER BY rank) AS context "
           f"FROM dd GROUP BY query_id)")


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{N}}]+')"


_OPENINGS = " UNION ALL ".join(f"SELECT array_to_string(list_slice(w, {at}, {at + n - 1}), ' '), 'ITEM' FROM (SELECT {tokens('text')} AS w FROM benchmark)"
                               for at, n in ((1, 2), (1, 5), (2, 3), (4, 4)))
#: hit(doc_id, i, n, phrase, label): leftmost-longest matches; every longest phrase knows the next place behind it.
PHRASE_HITS = (
    f"names AS (SELECT n_name AS name, 'LOC' AS label FROM nation UNION ALL SELECT r_name, 'LOC' FROM region "
    f"UNION ALL SELECT p_name, 'PROD' FROM part UNION ALL {_OPENINGS}),\n"
    f"ph AS (SELECT array_to_string(w, ' ') AS phrase, min(label) AS label, len(any_value(w)) AS n FROM (SELECT {tokens('name')} AS w, label FROM names) "
    f"WHERE len(w) > 0 GROUP BY 1),\n"
    f"dt AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {tokens('text')} AS w FROM documents)),\n"
    f"win AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM dt, (SELECT DISTINCT n FROM ph) WHERE i + n - 1 <= len(w)),\n"
    f"cand AS MATERIALIZED (SELECT doc_id, i, max(win.n) AS n, arg_max(phrase, win.n) AS phrase, arg_max(label, win.n) AS label "
    f"FROM win JOIN ph USING (phrase) GROUP BY doc_id, i),\n"
    f"nxt AS MATERIALIZED (SELECT a.doc_id, a.i, b.i AS j FROM cand a ASOF JOIN cand b ON a.doc_id = b.doc_id AND a.i + a.n <= b.i),\n"
    f"taken(doc_id, i) AS (SELECT doc_id, min(i) FROM cand GROUP BY doc_id UNION ALL "
    f"SELECT t.doc_id, x.j FROM taken t JOIN nxt x ON x.doc_id = t.doc_id AND x.i = t.i),\n"
    f"hit AS (SELECT * FROM cand JOIN taken USING (doc_id, i))"
)

_LLR = "({k} * ln({p}) + {m} * ln(1.0::DOUBLE - {p}))"
#: abbr(word, n_period, n_plain, score): the learned abbreviations.
ABBREVIATIONS = (
    f"tw AS (SELECT unnest({words('text')}) AS w FROM documents),\n"
    f"ty AS (SELECT lower(regexp_extract(w, {lit(SE._TYPE)}, 1)) AS word, regexp_extract(w, {lit(SE._TYPE)}, 2) = '.' AS p FROM tw),\n"
    f"pc AS (SELECT word, count(*) FILTER (WHERE p) AS n_period, count(*) FILTER (WHERE NOT p) AS n_plain FROM ty WHERE word <> '' GROUP BY word),\n"
    f"sh AS (SELECT sum(n_period)::DOUBLE / sum(n_period + n_plain)::DOUBLE AS share FROM pc),\n"
    f"sc0 AS (SELECT word, n_period, n_plain, length(word) - length(replace(word, '.', '')) AS inner_, share FROM pc, sh),\n"
    f"sc1 AS (SELECT *, (length(word) - inner_)::DOUBLE AS letters, -2.0::DOUBLE * ({_LLR.format(k='n_period', m='n_plain', p='share')} - "
    f"{_LLR.format(k='n_period', m='n_plain', p=f'{SE.SURE}::DOUBLE')}) AS ratio FROM sc0),\n"
    f"abbr AS (SELECT word, n_period, n_plain, round(ratio * exp(-letters) * (inner_ + 1) * pow(letters, -n_plain::DOUBLE), 6) AS score FROM sc1 "
    f"WHERE n_period >= {SE.MIN_COUNT} AND round(ratio * exp(-letters) * (inner_ + 1) * pow(letters, -n_plain::DOUBLE), 6) >= {SE.THRESHOLD})"
)
_GOES_ON = (f"(list_contains(ab, lower(regexp_extract(p_, {lit(SE._LAST)}, 1))) OR regexp_matches(lower(regexp_extract(p_, {lit(SE._LAST)}, 1)), '^\\p{{L}}$')) "
            f"AND NOT regexp_matches(p_, '\\n[\\t \\x0b\\f\\r]*$')")
LEARNED_SENTENCES = (
    f"ab AS (SELECT coalesce(list(word), []) AS ab FROM abbr),\n"
    f"pieces AS (SELECT doc_id, string_split({rx('text', SE._BREAK, '$1' + SE._MARK)}, {lit(SE._MARK)}) AS p, ab FROM documents, ab WHERE text IS NOT NULL),\n"
    f"flags AS (SELECT doc_id, p, list_transform(p, lambda p_: {_GOES_ON}) AS f FROM pieces),\n"
    f"starts AS (SELECT doc_id, p, list_filter(range(1, len(p) + 1), lambda i_: i_ = 1 OR NOT f[i_ - 1]) AS s FROM flags),\n"
    f"sents AS (SELECT doc_id, list_filter(list_transform(s, lambda s_, k_: {strip_ws("array_to_string(list_slice(p, s_, coalesce(s[k_ + 1], len(p) + 1) - 1), '')")}), "
    f"lambda x_: x_ <> '') AS ss FROM starts)\n"
    f"SELECT doc_id, unnest(generate_series(0, len(ss) - 1))::INTEGER AS sentence_index, unnest(ss) AS sentence FROM sents"
)

#: exq(query_id, e): the questions' vectors expanded by the terms of their first chunks.
FEEDBACK_QUERIES = (
    knn_ctes(FB.FEEDBACK, name="first") + ",\n"
    f"ft AS (SELECT query_id, exp(-distance) AS w, {tokens('text')} AS t FROM first),\n"
    f"fr AS (SELECT query_id, term, sum(w) AS w FROM (SELECT query_id, w / len(t) AS w, unnest(t) AS term FROM ft) GROUP BY ALL),\n"
    f"fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 12) DESC, term) AS r FROM fr) WHERE r <= {FB.TERMS}),\n"
    f"fm AS (SELECT query_id, term, {1 - FB.WEIGHT} * w / sum(w) OVER (PARTITION BY query_id) AS w FROM fs),\n"
    f"fo AS (SELECT query_id, term, {FB.WEIGHT} * sum(1.0::DOUBLE / n) AS w FROM (SELECT query_id, len(t) AS n, unnest(t) AS term "
    f"FROM (SELECT query_id, {tokens('question')} AS t FROM questions)) GROUP BY ALL),\n"
    f"fb AS (SELECT query_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM} AS at, sum(w) AS x FROM (SELECT * FROM fm UNION ALL SELECT * FROM fo) GROUP BY ALL),\n"
    f"fn AS (SELECT query_id, sqrt(sum(x * x)) AS norm FROM fb GROUP BY query_id),\n"
    f"exq AS (SELECT fn.query_id, list(round(coalesce(x, 0) / norm, 9)::FLOAT ORDER BY i) AS e FROM fn CROSS JOIN (SELECT unnest(range({DIM})) AS i) "
    f"LEFT JOIN fb ON fb.query_id = fn.query_id AND fb.at = i GROUP BY fn.query_id)"
)


def fill(template: str, **cols) -> str:
    parts = []
    for kind, v in P.template_parts(template):
        if kind == "lit":
            if v:
                parts.append(lit(v))
        else:
            parts.append(f"coalesce({cols[v]}, '')")
    return "(" + " || ".join(parts) + ")"


def html_steps(expr: str, steps) -> str:
    out = expr
    for kind, pattern, repl in steps:
        if kind == "num":
            digits = "regexp_extract(r_, '([0-9a-fA-F]+);', 1)"
            point = f"('0x' || {digits})::INTEGER" if repl == "hex" else f"{digits}::INTEGER"
            out = (f"list_reduce(list_distinct(regexp_extract_all({out}, {lit(pattern)})), lambda t_, r_: CASE WHEN {point} BETWEEN 1 "
                   f"AND 55295 OR {point} BETWEEN 57344 AND 1048575 THEN replace(t_, r_, chr({point})) ELSE t_ END, {out})")
        else:
            out = rx(out, pattern, repl) if kind == "re" else f"replace({out}, {lit(pattern)}, {lit(repl)})"
    return out


def base_name(expr: str) -> str:
    return f"regexp_extract({expr}, '([^/]*)$', 1)"


def extension(expr: str) -> str:
    return f"lower(regexp_extract({base_name(expr)}, '^\\.*[^.].*(\\.[^.]*)$', 1))"


def clean_answer(expr: str) -> str:
    q = lit(P.QUESTION_SPLIT)
    out = f"CASE WHEN instr({expr}, {q}) > 0 THEN split_part({expr}, {q}, 2) ELSE {expr} END"
    for m in P.ANSWER_MARKERS:
        out = f"replace({out}, {lit(m)}, '')"
    cond = " OR ".join(f"instr(lower(ln_), {lit(w)}) > 0" for w in P.DROP_LINE_WORDS)
    return strip_ws(f"array_to_string(list_filter(string_split({out}, {NL}), lambda ln_: NOT ({cond})), {NL})")


def safe_name(expr: str) -> str:
    return f"CASE WHEN regexp_replace({expr}, '[^a-zA-Z0-9]', '_', 'g') <> '' THEN regexp_replace({expr}, '[^a-zA-Z0-9]', '_', 'g') || '.txt' END"


PAGE_FILES = "page_files AS (SELECT page_id, url, regexp_extract(url, '([^/]+)/*$', 1) AS filename, html FROM pages)"
LEDGER = "ledger AS (SELECT DISTINCT filename FROM page_files WHERE starts_with(url, 'http://'))"
NEW_FILES = ("new_files AS (SELECT filename, min(page_id) AS page_id FROM page_files GROUP BY filename "
             "HAVING filename NOT IN (SELECT filename FROM ledger))")


def upload_rows(src: str) -> str:
    """up(filename, chunk_index, text): chunks of page rows numbered through each file."""
    return (f"up_a AS (SELECT page_id, filename, {html_steps('html', H.TEXT_STEPS)} AS t FROM {src}),\n"
            f"up_b AS (SELECT page_id, filename, {word_chunks('t')} AS chs FROM up_a),\n"
            f"up_c AS (SELECT page_id, filename, unnest(generate_series(1, len(chs))) AS pos, unnest(chs) AS text FROM up_b),\n"
            f"up AS (SELECT filename, (row_number() OVER (PARTITION BY filename ORDER BY page_id, pos) - 1)::INTEGER "
            f"AS chunk_index, text FROM up_c)")


def gazetteer_ctes() -> str:
    return ("names AS (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region),\n"
            "gz_t AS (SELECT regexp_extract_all(lower(name), '[a-z0-9]+') AS toks FROM names),\n"
            "gz AS (SELECT DISTINCT word, CASE WHEN pos = 1 THEN 'B-LOC' ELSE 'I-LOC' END AS entity FROM "
            "(SELECT unnest(toks) AS word, unnest(generate_series(1, len(toks))) AS pos FROM gz_t))")


CLEANED = f"cleaned AS (SELECT doc_id, {clean('text')} AS text FROM documents)"
ENTITIES = (CLEANED + ",\n" + gazetteer_ctes() + ",\n"
            "dt AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[a-z0-9]+'))) AS word FROM cleaned),\n"
            "ents AS (SELECT dt.doc_id, dt.word, gz.entity FROM dt JOIN gz ON dt.word = gz.word)")

ANSWERS = (
    "answers AS (SELECT conv_id::VARCHAR || ':' || (turn // " + str(len(DEFAULTS.models)) + ")::VARCHAR AS query_id, "
    "list_value(" + ", ".join(lit(m) for m in DEFAULTS.models) + ")[(turn % " + str(len(DEFAULTS.models))
    + ") + 1] AS model, CASE WHEN length(text) >= 20 THEN text END AS answer, "
    "CASE WHEN length(text) < 20 THEN 'empty response: ' || text END AS error FROM conversations "
    "WHERE role = 'assistant')"
)


def model_prefix() -> str:
    whens = " ".join(f"WHEN model = {lit(m)} THEN {lit(p)}" for m, (_, _, p) in P.MODEL_PROMPTS.items())
    return f"CASE {whens} ELSE 'An error occurred: ' END"


def fanout_sql(models) -> str:
    rows = []
    for m in models:
        template, uses_ctx, _ = P.MODEL_PROMPTS[m]
        ctx = "qc.context" if uses_ctx else "''"
        rows.append(f"SELECT qc.query_id, {lit(m)} AS model, {fill(template, query='qc.question', context=ctx)} "
                    f"AS prompt FROM qc")
    return "\nUNION ALL\n".join(rows)


QC = "qc AS (SELECT q.query_id, q.question, ctx.context FROM questions q LEFT JOIN ctx ON q.query_id = ctx.query_id)"


def bucket_counts(text_expr: str) -> str:
    """Hash-embedder bucket counts (list of DIM doubles) of one text, hashing once."""
    buckets = (f"list_transform(regexp_extract_all(lower({text_expr}), '[\\p{{L}}\\p{{N}}]+'), "
               f"lambda tk_: (('0x' || substr(md5(tk_), 1, 8))::BIGINT % {DIM})::INTEGER)")
    return (f"list_transform([{buckets}], lambda b_: list_transform(range({DIM}), lambda i_: "
            f"(len(b_) - len(list_filter(b_, lambda y_: y_ <> i_)))::DOUBLE))[1]")


def semantic_sql(threshold: float = DEFAULTS.semantic_threshold) -> str:
    dd = lambda a, b: dot(a, b)
    sim = (f"CASE WHEN sqrt({dd('acc_.cv', 'acc_.cv')}) * sqrt({dd('it_.v', 'it_.v')}) > 0 "
           f"THEN {dd('acc_.cv', 'it_.v')} / (sqrt({dd('acc_.cv', 'acc_.cv')}) * sqrt({dd('it_.v', 'it_.v')})) "
           f"ELSE 0.0 END")
    vadd = "list_transform(list_zip(acc_.cv, it_.v), lambda p_: p_[1] + p_[2])"
    step = (f"lambda acc_, it_: CASE WHEN {sim} > {threshold!r} "
            f"THEN {{'ch': acc_.ch, 'cur': acc_.cur || ' ' || it_.s, 'cv': {vadd}}} "
            f"ELSE {{'ch': list_append(acc_.ch, acc_.cur), 'cur': it_.s, 'cv': it_.v}} END")
    fold = (f"list_reduce(list_slice(items, 2, len(items)), {step}, "
            f"{{'ch': []::VARCHAR[], 'cur': items[1].s, 'cv': items[1].v}})")
    return (f"WITH sem_a AS (SELECT doc_id, {sentences('text')} AS ss FROM documents),\n"
            f"sem_b AS (SELECT doc_id, list_transform(ss, lambda s_: {{'s': s_, 'v': {bucket_counts('s_')}}}) "
            f"AS items FROM sem_a),\n"
            f"sem_c AS (SELECT doc_id, CASE WHEN len(items) = 0 THEN []::VARCHAR[] ELSE "
            f"list_transform([{fold}], lambda r_: list_append(r_.ch, r_.cur))[1] END AS chs FROM sem_b)\n"
            + with_ids(explode_chunks("sem_c", "doc_id", "chs"), "doc_id"))


def o_knn_vectors() -> str:
    return (f"WITH vq AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),\n"
            f"vc AS (SELECT vec_id AS id, embedding AS e FROM embeddings),\n"
            f"{knn_ctes(DEFAULTS.top_k_loader, 'vq', 'vc', 'knn', 'q.query_id', 'c.id')}\n"
            f"SELECT query_id, rank, id, distance FROM knn")


# --- the ISBN rule without lookahead ------------------------------------------------------
# RE2 has no lookahead. A recursive CTE replays Python's scan instead: find the leftmost
# candidate (the rule with its lookahead removed), capture the run of lookahead-class
# characters after the body, accept when body + run is at least the lookahead's minimum
# (exactly the lookahead's condition at the body start), otherwise move on by one
# character. One character of context is kept so \b sees the original text.
ISBN_LOOKAHEAD = "(?=[-0-9xX ]{13,17})"


def _isbn_candidate() -> tuple[str, int]:
    head, body = T.ISBN.split(ISBN_LOOKAHEAD)
    opening, closing = "\\b(?:", ")?"
    assert head.startswith(opening) and head.endswith(closing)
    prefix = head[len(opening):-len(closing)]
    run_class = ISBN_LOOKAHEAD[len("(?="):ISBN_LOOKAHEAD.index("{")]
    min_run = int(ISBN_LOOKAHEAD[ISBN_LOOKAHEAD.index("{") + 1:ISBN_LOOKAHEAD.index(",")])
    return f"(?s)^(.)(.*?)\\b({prefix})?({body})({run_class}*)", min_run


def isbn_ctes(src: str, key: str, text: str, name: str = "isbn") -> str:
    """CTEs ending in ``{name}({key}, t)``; the SQL must start with WITH RECURSIVE."""
    cand, min_run = _isbn_candidate()
    c = lit(cand)
    quick = lit("[0-9][-0-9xX ]{%d}" % (min_run - 1))
    return f"""{name}_in AS (SELECT {key} AS k, {text} AS t FROM {src}),
{name}_scan(k, rest, out, done) AS (
  SELECT k, ' ' || t, '', NOT regexp_matches(t, {quick}) FROM {name}_in
  UNION ALL
  SELECT k,
    CASE WHEN NOT m_ok THEN '' WHEN good
         THEN right(m.body, 1) || substr(rest, 1 + length(m.c) + length(m.gap) + length(m.pre) + length(m.body))
         ELSE substr(rest, 1 + length(m.c) + length(m.gap)) END,
    CASE WHEN NOT m_ok THEN out || substr(rest, 2) WHEN good THEN out || m.gap
         ELSE out || m.gap || substr(m.pre || m.body, 1, 1) END,
    NOT m_ok
  FROM (SELECT k, rest, out, regexp_matches(rest, {c}) AS m_ok,
               regexp_extract(rest, {c}, ['c', 'gap', 'pre', 'body', 'inner', 'tail']) AS m,
               length(regexp_extract(rest, {c}, 4)) + length(regexp_extract(rest, {c}, 6)) >= {min_run} AS good
        FROM {name}_scan WHERE NOT done)
),
{name} AS (SELECT i.k AS {key}, CASE WHEN s.k IS NULL THEN i.t ELSE s.out END AS t
           FROM {name}_in i LEFT JOIN (SELECT k, out FROM {name}_scan WHERE done AND rest = '') s ON i.k = s.k)"""


def after_isbn(expr: str) -> str:
    """The chain's steps after the ISBN rule, then the line filter."""
    out, seen = expr, False
    for name, pattern in T.CLEAN_STEPS:
        if name == "isbn":
            seen = True
            continue
        if not seen:
            continue
        out = rx(out, T.DISALLOWED if name == "allowed_chars" else pattern)
    return filter_lines(out)


NON_ASCII_LOWER = "regexp_replace(lower(text), " + lit(T.NON_ASCII) + ", '', 'g')"


def _sql() -> dict[str, str]:
    o: dict[str, str] = {}
    o["clean_steps"] = f"SELECT doc_id, {clean('text')} AS text FROM documents"
    o["stage_reload"] = o["clean_steps"]
    isbn_base = f"isbn_base AS (SELECT doc_id, {NON_ASCII_LOWER} AS t FROM documents)"
    o["clean_isbn"] = f"WITH RECURSIVE {isbn_base},\n{isbn_ctes('isbn_base', 'doc_id', 't')}\nSELECT doc_id, t AS text FROM isbn"
    o["clean_text"] = (f"WITH RECURSIVE {isbn_base},\n{isbn_ctes('isbn_base', 'doc_id', 't')}\n"
                       f"SELECT doc_id, {after_isbn('t')} AS text FROM isbn")
    steps = [("lower", None)] + list(T.CLEAN_STEPS)  # trace: one row per step, chars removed
    trace_sql = [f"st1 AS (SELECT doc_id, text AS s0, lower(text) AS s1 FROM documents)"]
    prev_cols = "s0, s1"
    i = 1
    for name, pattern in T.CLEAN_STEPS:
        i += 1
        if name == "isbn":
            trace_sql.append(isbn_ctes(f"st{i - 1}", "doc_id", f"s{i - 1}", "tr_isbn"))
            trace_sql.append(f"st{i} AS (SELECT st.doc_id, {prev_cols}, tr.t AS s{i} FROM st{i - 1} st "
                             f"JOIN tr_isbn tr ON st.doc_id = tr.doc_id)")
        else:
            pat = T.DISALLOWED if name == "allowed_chars" else pattern
            trace_sql.append(f"st{i} AS (SELECT doc_id, {prev_cols}, {rx(f's{i - 1}', pat)} AS s{i} FROM st{i - 1})")
        prev_cols += f", s{i}"
    i += 1
    trace_sql.append(f"st{i} AS (SELECT doc_id, {prev_cols}, {filter_lines(f's{i - 1}')} AS s{i} FROM st{i - 1})")
    names = [n for n, _ in steps] + ["line_filter"]
    sums = ", ".join(f"coalesce(sum(length(s{j}) - length(s{j + 1})), 0)::BIGINT AS r{j}" for j in range(len(names)))
    rows = "\nUNION ALL\n".join(f"SELECT {j + 1}::INTEGER AS step_order, {lit(n)} AS step, r{j} AS removed_chars FROM agg"
                                  for j, n in enumerate(names))
    o["clean_trace"] = ("WITH RECURSIVE " + ",\n".join(trace_sql) + f",\nagg AS (SELECT {sums} FROM st{i})\n" + rows)

    o["scan_text_files"] = (f"SELECT {safe_name('doc_id::VARCHAR')} AS safe_name, {clean('text')} || {NL} AS text "
                            f"FROM documents")
    o["scan_binary_files"] = "SELECT page_id, '.txt' AS ext, (strlen(html) + 1)::BIGINT AS n_bytes FROM pages"
    o["scan_convertible_files"] = (
        "SELECT (['.pdf', '.png', '', '.jpg', '', '.pdf'])[page_id % 6 + 1] AS ext, sum(length(page_id::VARCHAR) + 1)::BIGINT AS n_bytes "
        "FROM pages WHERE page_id % 6 NOT IN (2, 4) GROUP BY 1")
    o["collection_compacted"] = f"WITH {SENT_CHUNKS}\nSELECT id, doc_id::VARCHAR AS doc_id, chunk_index, text FROM chunks"
    o["sketch_statistics"] = (
        f"SELECT count(*) AS n_docs, round(avg(n), 6) AS average_words, min(n) AS min_words, max(n) AS max_words, true AS q25_within, true AS q50_within, "
        f"true AS q75_within, true AS q95_within, true AS distinct_within FROM (SELECT coalesce({word_count('text')}, 0) AS n FROM documents)")
    o["stream_uploads"] = (
        f"WITH {PAGE_FILES},\ndropped AS (SELECT *, min(page_id % 3) OVER (PARTITION BY filename) AS drop_ FROM page_files),\n"
        f"first_ AS (SELECT * FROM dropped WHERE page_id % 3 <= drop_),\n{upload_rows('first_')}\n"
        f"SELECT 'pdf_chunk_' || filename || '_' || chunk_index::VARCHAR AS id, filename AS doc_id, chunk_index, text, drop_::INTEGER AS drop "
        f"FROM up JOIN (SELECT DISTINCT filename, drop_ FROM dropped) USING (filename)")
    o["word_count"] = f"SELECT doc_id, {word_count('text')} AS n_words FROM documents"
    o["normalize_text"] = f"SELECT doc_id, {normalize('text')} AS norm FROM documents"
    o["annotate_entities"] = f"WITH {ENTITIES}\nSELECT doc_id, word, entity FROM ents"
    for name, select in (
        ("annotate_phrases", "SELECT doc_id, (i - 1)::INTEGER AS start, n::INTEGER AS n_words, phrase, label FROM hit"),
        ("phrase_entities", "SELECT DISTINCT doc_id, word, CASE WHEN pos = 1 THEN 'B-' ELSE 'I-' END || label AS entity FROM (SELECT doc_id, label, "
                            "unnest(string_split(phrase, ' ')) AS word, unnest(range(1, n + 1)) AS pos FROM hit)")):
        o[name] = f"WITH RECURSIVE {PHRASE_HITS}\n{select}"
    o["learn_abbreviations"] = f"WITH {ABBREVIATIONS}\nSELECT word, n_period, n_plain, score FROM abbr"
    o["sentences_learned"] = f"WITH {ABBREVIATIONS},\n{LEARNED_SENTENCES}"
    o["remove_entities"] = (
        f"WITH {ENTITIES},\n"
        f"rm AS (SELECT doc_id, list_transform(list_sort(list_transform(list_distinct(list(word)), "
        f"lambda w_: {{'l': -length(w_), 'w': w_}})), lambda s_: s_.w) AS ws FROM ents "
        f"WHERE entity IN ({', '.join(lit(x) for x in DEFAULTS.entity_labels)}) AND length(word) >= "
        f"{DEFAULTS.min_entity_length} AND NOT starts_with(word, '##') GROUP BY doc_id)\n"
        f"SELECT c.doc_id, CASE WHEN rm.ws IS NULL THEN c.text ELSE list_reduce(rm.ws, lambda t_, w_: "
        f"replace(t_, w_, ''), c.text) END AS text FROM cleaned c LEFT JOIN rm ON c.doc_id = rm.doc_id")
    o["debug_sample"] = f"WITH {CLEANED}\nSELECT doc_id, text FROM cleaned ORDER BY doc_id LIMIT {DEFAULTS.debug_sample}"
    o["split_sentences"] = (
        f"WITH s AS (SELECT doc_id, {sentences('text')} AS ss FROM documents)\n"
        f"SELECT doc_id, unnest(generate_series(0, len(ss) - 1))::INTEGER AS sentence_index, "
        f"unnest(ss) AS sentence FROM s")
    o["chunk_fixed"] = (f"WITH f AS (SELECT doc_id, {fixed_chunks('text')} AS chs FROM documents)\n"
                        + with_ids(explode_chunks("f", "doc_id", "chs"), "doc_id"))
    o["chunk_sentence"] = f"WITH {SENT_CHUNKS}\nSELECT doc_id, chunk_index, id, text FROM chunks"
    o["collection_write"] = f"WITH {SENT_CHUNKS}\nSELECT id, doc_id, chunk_index, text FROM chunks"
    o["stream_ingest"] = f"WITH {SENT_CHUNKS}\nSELECT id, doc_id::VARCHAR AS doc_id, chunk_index, text FROM chunks"
    o["chunk_semantic"] = semantic_sql()
    o["chunk_words"] = (f"WITH w AS (SELECT doc_id, {word_chunks('text')} AS chs FROM documents)\n"
                        + with_ids(explode_chunks("w", "doc_id", "chs"), "doc_id"))
    o["embed_hash"] = (
        f"WITH {CORPUS},\nx AS (SELECT id, unnest(generate_series(0, {DIM} - 1))::INTEGER AS dim, unnest(e) AS v FROM corpus)\n"
        f"SELECT id, dim, round(v::DOUBLE, 6) AS value FROM x WHERE v <> 0")
    pairs = ("FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
    o["cosine_pairs"] = (
        f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(CASE WHEN {norm('a.embedding')} * {norm('b.embedding')} > 0 "
        f"THEN {dot('a.embedding', 'b.embedding')} / ({norm('a.embedding')} * {norm('b.embedding')}) ELSE 0.0 END, 6) "
        f"AS cosine {pairs}")
    o["vector_distance"] = (f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({sq_l2('a.embedding', 'b.embedding')}, 6) "
                            f"AS distance {pairs}")
    o["knn_exact"] = (f"WITH {CORPUS},\n{QUESTIONS},\n{knn_ctes(DEFAULTS.top_k_loader)}\n"
                      f"SELECT query_id, rank, id, distance FROM knn")
    o["knn_vectors"] = o_knn_vectors()
    o["retrieve_preview"] = (
        f"WITH {CORPUS},\n{QUESTIONS},\n{knn_ctes(DEFAULTS.top_k_loader)}\n"
        f"SELECT query_id, rank, id, round(1.0 - distance, 4) AS relevance, substring(text, 1, 200) || '...' AS preview FROM knn")
    o["retrieve_dedup"] = (f"WITH {CORPUS},\n{QUESTIONS},\n{knn_ctes(FETCH)},\n{dedup_ctes('knn', K_APP)}\n"
                           f"SELECT query_id, rank, id, text, distance FROM dd")
    filtered = (SENT_CHUNKS.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT doc_id FROM labels "
                                    "WHERE quality = 1 AND toxic = 0))", 1)
                + ",\n" + embed_ctes("chunks", "id, text", "text", "corpus"))
    o["retrieve_filtered"] = (f"WITH {filtered},\n{QUESTIONS},\n{knn_ctes(FETCH)},\n{dedup_ctes('knn', K_APP)}\n"
                              f"SELECT query_id, rank, id, text, distance FROM dd")
    o["retrieve_expanded"] = (
        f"WITH {CORPUS},\n{QUESTIONS},\n{knn_ctes(1, name='first')},\n"
        + embed_ctes("(SELECT query_id, text AS expansion FROM first)", "query_id", "expansion", "exq") + ",\n"
        + knn_ctes(FETCH, 'exq', 'corpus', 'knn2') + ",\n" + dedup_ctes("knn2", K_APP) + "\n"
        "SELECT dd.query_id, dd.rank, dd.id, dd.distance, q.question FROM dd JOIN questions q ON dd.query_id = q.query_id")
    o["retrieve_feedback"] = (
        f"WITH {CORPUS},\n{QUESTIONS},\n{FEEDBACK_QUERIES},\n" + knn_ctes(FETCH, 'exq', 'corpus', 'knn2') + ",\n" + dedup_ctes("knn2", K_APP) + "\n"
        "SELECT dd.query_id, dd.rank, dd.id, dd.distance, q.question FROM dd JOIN questions q ON dd.query_id = q.query_id")
    o["dedup_normalized"] = (
        f"SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY {normalize('text')} "
        f"ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
    o["dedup_batches"] = o["dedup_normalized"]
    o["assemble_context"] = f"WITH {CONTEXT}\nSELECT query_id, context FROM ctx"
    o["answer_from_collection"] = o["assemble_context"]
    o["render_prompt"] = (
        f"WITH {CONTEXT},\n{QC}\nSELECT query_id, {fill(P.STANDARD_TEMPLATE, query='question', context='context')} AS prompt, "
        f"{fill(P.EXPANSION_TEMPLATE, query='question')} AS expansion_prompt FROM qc")
    o["fanout_prompts"] = (f"WITH {CONTEXT},\n{QC}\n"
                           + fanout_sql(("rag", "claude_v1", "gpt_v1", "gpt", "claude", "mistral")))
    system = lit("You are an expert in haptics technology. Use the provided context to answer questions accurately and concisely.")
    bodies = {
        "rag": "to_json({'inputs': prompt})",
        "enhanced": "to_json({'inputs': prompt})",
        "gpt": f"to_json({{'model': 'gpt-4', 'temperature': 0.7, 'max_tokens': 500, 'messages': [{{'role': 'system', "
               f"'content': {system}}}, {{'role': 'user', 'content': prompt}}]}})",
        "gpt_v1": "to_json({'model': 'gpt-4o', 'messages': [{'role': 'user', 'content': prompt}]})",
        "claude": "to_json({'anthropic_version': 'bedrock-2023-05-31', 'max_tokens': 1000, 'messages': [{'role': 'user', "
                  "'content': [{'type': 'text', 'text': prompt}]}]})",
        "claude_v1": "to_json({'model': 'claude-3-sonnet-20240229', 'max_tokens': 1024, 'temperature': 0.7, 'messages': "
                     "[{'role': 'user', 'content': prompt}]})",
        "mistral": "to_json({'prompt': prompt, 'max_tokens': 200, 'temperature': 0.5, 'top_p': 0.9, 'top_k': 50})",
    }
    cases = " ".join(f"WHEN model = {lit(m)} THEN {b}::VARCHAR" for m, b in bodies.items())
    o["request_bodies"] = (f"WITH {CONTEXT},\n{QC},\nfp AS ({fanout_sql(tuple(bodies))})\n"
                           f"SELECT query_id, model, CASE {cases} END AS body FROM fp")
    o["parse_responses"] = (
        "WITH b AS (SELECT conv_id, turn, to_json({'content': [{'type': 'text', 'text': text}]}) AS bm, "
        "to_json({'outputs': [{'text': text}]}) AS bc, "
        "CASE WHEN turn % 3 <> 0 THEN to_json({'choices': [{'message': {'content': text}}]}) "
        "ELSE to_json({'choices': []}) END AS bh FROM conversations)\n"
        "SELECT conv_id, turn, json_extract_string(bm, '$.content[0].text') AS messages_text, "
        "json_extract_string(bc, '$.outputs[0].text') AS completion_text, "
        f"coalesce(json_extract_string(bh, '$.choices[0].message.content'), {lit(P.NO_CONTENT)}) AS chat_text FROM b")
    echo = f"{fill(P.STANDARD_TEMPLATE, query='text', context='role')} || 'Today Date: none' || {NL} || text"
    o["clean_answer"] = (f"WITH e AS (SELECT conv_id, turn, {echo} AS t FROM conversations)\n"
                         f"SELECT conv_id, turn, {clean_answer('t')} AS answer FROM e")
    failed = "split_part(query_id, ':', 1)::BIGINT % 7 = 0"
    cells = ", ".join(f"CASE WHEN {failed} THEN 'An error occurred: no collection' ELSE min(CASE WHEN model = {lit(m)} "
                      f"THEN cell END) END AS {m}" for m in DEFAULTS.models)
    o["compare_answers"] = (
        f"WITH {ANSWERS},\nc AS (SELECT query_id, model, coalesce({clean_answer('answer')}, {model_prefix()} || error) AS cell "
        f"FROM answers)\nSELECT query_id, CASE WHEN {failed} THEN 'An error occurred: no collection' ELSE 'context of ' || "
        f"query_id END AS context, {cells}, (count(DISTINCT model || ' ' || cell) - count(DISTINCT CASE WHEN cell IS NOT NULL "
        f"THEN model END))::BIGINT AS other_answers FROM c GROUP BY query_id")
    stats = (f"count(*)::BIGINT AS total_papers, coalesce(avg({word_count('text')}), 0.0) AS average_word_count, "
             f"coalesce(min({word_count('text')}), 0)::BIGINT AS min_word_count, "
             f"coalesce(max({word_count('text')}), 0)::BIGINT AS max_word_count")
    o["corpus_stats"] = f"SELECT {stats} FROM documents"
    o["write_report"] = f"WITH {CLEANED}\nSELECT {stats} FROM cleaned"
    o["stage_stats"] = (f"WITH {CLEANED}\nSELECT 'process' AS stage, {stats} FROM documents\nUNION ALL\n"
                        f"SELECT 'clean' AS stage, {stats} FROM cleaned")
    o["stage_counts"] = (
        f"WITH d AS (SELECT * FROM documents WHERE text <> '')\n"
        f"SELECT count(*)::BIGINT AS num_processed_papers, count(*)::BIGINT AS num_cleaned_papers, "
        f"count(CASE WHEN {safe_name('doc_id::VARCHAR')} IS NOT NULL THEN 1 END)::BIGINT AS num_saved_papers FROM d")
    o["file_info"] = f"SELECT page_id, {base_name('url')} AS name, {extension('url')} AS ext FROM pages"
    sup = DEFAULTS.supported_upload_extensions
    valid = " OR ".join(f"ends_with(ext, {lit(e)})" for e in sup)
    reason = lit("Unsupported file type. Supported types are: (" + ", ".join(f"'{e}'" for e in sup) + ")")
    path_ = "url || (['.pdf', '.docx', '.PPTX', '.txt', '.jpg'])[page_id % 5 + 1]"
    o["validate_extension"] = (
        f"WITH fi AS (SELECT page_id, {base_name(f'({path_})')} AS name, {extension(f'({path_})')} AS ext FROM pages)\n"
        f"SELECT page_id, name, ext, ({valid}) AS valid, CASE WHEN NOT ({valid}) THEN {reason} END AS reject_reason FROM fi")
    o["safe_filename"] = (
        f"WITH n AS (SELECT page_id, {safe_name('url')} AS safe_name FROM pages)\n"
        f"SELECT page_id, safe_name, count(*) OVER (PARTITION BY safe_name) > 1 AS collision FROM n")
    o["html_to_text"] = (f"SELECT page_id, text FROM (SELECT page_id, {html_steps('html', H.TEXT_STEPS)} AS text "
                         f"FROM pages) WHERE text <> ''")
    # the tokeniser reads line breaks as white space, and references to & without their semicolon
    page_ = "regexp_replace(translate(coalesce(html, ''), chr(10), ' '), '&amp([^;])', '&amp;\\1', 'g')"
    o["page_text"] = f"SELECT page_id, {html_steps(page_, H.TEXT_STEPS)} AS text FROM pages"
    o["html_to_markdown"] = f"SELECT page_id, {html_steps('html', H.MARKDOWN_STEPS)} AS markdown FROM pages"
    ext_ = f"regexp_extract({base_name('url')}, '^\\.*[^.].*(\\.[^.]*)$', 1)"
    stem_ = f"substring({base_name('url')}, 1, length({base_name('url')}) - length({ext_}))"
    o["markdown_files"] = (
        f"WITH m AS (SELECT url AS path, {stem_} || '.md' AS md_path, {html_steps('html', H.MARKDOWN_STEPS)} "
        f"AS markdown FROM pages)\nSELECT path, md_path, CASE WHEN markdown IS NULL THEN 'unreadable file' "
        f"WHEN markdown = '' THEN 'no content converted' END AS error FROM m")
    o["extractive_answers"] = (f"WITH {CORPUS},\n{QUESTIONS},\n{knn_ctes(FETCH)},\n{dedup_ctes('knn', K_APP)}\n"
                               f"SELECT query_id, 'extractive' AS model, text AS answer, NULL::VARCHAR AS error "
                               f"FROM dd WHERE rank = 1")
    o["ingest_new_files"] = f"WITH {PAGE_FILES},\n{LEDGER},\n{NEW_FILES}\nSELECT filename, page_id FROM new_files"
    o["ledger_merge"] = (f"WITH {PAGE_FILES},\n{LEDGER},\n{NEW_FILES}\n"
                         f"SELECT filename FROM ledger UNION SELECT filename FROM new_files")
    o["upload_chunks"] = (
        f"WITH {PAGE_FILES},\n{upload_rows('page_files')}\n"
        f"SELECT filename, chunk_index, 'pdf_chunk_' || filename || '_' || chunk_index::VARCHAR AS id, text, "
        f"filename || '_chunk_' || chunk_index::VARCHAR AS source FROM up")
    ok = ("'Successfully processed ' || new_files::VARCHAR || ' new PDF(s). Added ' || total_chunks::VARCHAR "
          "|| ' text chunks to the database.'")
    sk = "'Skipped ' || skipped_files::VARCHAR || ' previously processed file(s).'"
    o["upload_status"] = (
        f"WITH {PAGE_FILES},\n{upload_rows('page_files')},\n"
        f"n AS (SELECT (SELECT count(DISTINCT filename) FROM page_files)::BIGINT AS files, (SELECT count(*) FROM up)::BIGINT AS chunks),\n"
        f"cnt AS (SELECT 1::INTEGER AS run, files AS new_files, chunks AS total_chunks, 0::BIGINT AS skipped_files FROM n "
        f"UNION ALL SELECT 2::INTEGER, 0::BIGINT, 0::BIGINT, files FROM n)\n"
        f"SELECT run, new_files, total_chunks, skipped_files, CASE WHEN concat_ws(' ', CASE WHEN new_files <> 0 THEN {ok} END, "
        f"CASE WHEN skipped_files > 0 THEN {sk} END) = '' THEN 'No new files to process.' ELSE concat_ws(' ', "
        f"CASE WHEN new_files <> 0 THEN {ok} END, CASE WHEN skipped_files > 0 THEN {sk} END) END AS status FROM cnt")
    o["upload_retrieve"] = (
        f"WITH {PAGE_FILES},\n{upload_rows('page_files')},\n"
        f"ups AS (SELECT 'pdf_chunk_' || filename || '_' || chunk_index::VARCHAR AS id, text FROM up),\n"
        + embed_ctes("ups", "id, text", "text", "corpus") + f",\n{QUESTIONS},\n{knn_ctes(DEFAULTS.top_k_loader)}\n"
        "SELECT query_id, rank, id, distance FROM knn")
    o["insert_if_absent"] = (
        f"WITH f AS (SELECT doc_id, {fixed_chunks('text')} AS chs FROM documents WHERE lang = 'en'),\n"
        f"existing AS ({with_ids(explode_chunks('f', 'doc_id', 'chs'), 'doc_id')}),\n{SENT_CHUNKS}\n"
        f"SELECT id, doc_id::VARCHAR AS doc_id, chunk_index, text FROM existing\nUNION ALL\n"
        f"SELECT id, doc_id::VARCHAR AS doc_id, chunk_index, text FROM chunks WHERE id NOT IN (SELECT id FROM existing)")
    return o


ORACLES = _sql()
