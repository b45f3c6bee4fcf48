"""Secret scans with an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its bytes. The ledger is a
Parquet table of (blob, rule_version) pairs already scanned, the findings a second one. A run

1. addresses all paths (one hash per row, map-side minimum per blob),
2. takes the blobs whose (blob, rule_version) pair the ledger does not hold,
3. scans those blobs, once each whatever the number of paths, and appends to both tables,
4. joins the findings back to all paths.

Findings hold blobs with a secret only, so the join back moves few rows; a blob that a third
of all paths share is split by Spark's skew join, both sides being plain exchanges.

Everything is built-in expressions. Offsets are code points: the pieces between the matches of
a pattern (``split``) and the matches (``regexp_extract_all``) come from the same scan, and
their lengths add up to the offsets.

Null text is an empty blob. Repeated rows are paths of one blob each and each gets its row.
Empty tables give an empty result. Columns of the input other than the path and text are
ignored by the scan and kept by :func:`redact`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import written
from corpus_engine.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts and the least length; ``base`` rules are the
    contract's. ``version`` changes when the rule does, so old blobs are scanned again."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True
    version: int = 1


#: A private key from its first line to its last. Without an end line the lines of base64 after the first, and
#: a shorter one that closes them, belong to it.
_PEM = (r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:"
        r"(?:(?:\s|\\[rn])*+[A-Z][A-Za-z]*+(?:-[A-Z][a-z]*+)?+:\x20[^\r\n\\]*+){0,8}+[^-]*+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
        r"|(?:(?:\s|\\[rn])*+[A-Z][A-Za-z]*+(?:-[A-Z][a-z]*+)?+:\x20[^\r\n\\]*+){0,8}+"
        r"(?:(?:\s|\\[rn]){1,8}+[A-Za-z0-9+/]{16,}+={0,2}+){1,400}+(?:(?:\r?\n|\\n)[A-Za-z0-9+/]++={0,2}+(?=[\x20\t]*+(?:[\r\n\\]|\z)))?+"
        r")?+")

#: Fixed rules. Keywords match in either case of ASCII letters.
RULES = (
    Rule("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
    Rule("forge", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False),
    Rule("chat", r"(?<![A-Za-z0-9])xox[abprs]-[0-9A-Za-z-]{10,}", 0, 15, False),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 32, False),
    Rule("pem", _PEM, 0, 20, False, 2),
)

#: Rows without any of these cannot match a rule (cheap tests before the pattern scans).
_HINTS = r"""[:=]|AKIA|[0-9a-f]{24}|gh[pousr]_|xox[abprs]-|eyJ|PRIVATE KEY"""

SPAN = "array<struct<kind:int,start:int,end:int>>"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """The version of a rule set: every rule's kind and version."""
    return ",".join(f"{r.kind}{r.version}" for r in rules)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, hit>> of the leftmost non-overlapping matches, offsets in code points.

    ``split`` gives the gaps and ``regexp_extract_all`` the hits of the same scan; a running
    sum of their lengths places them."""
    p = F.lit(pattern)
    found = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)),
                       lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    state = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,hit:string>>)").alias("out"))

    def step(s, m):
        start = s["at"] + F.length(m["gap"])
        return F.when(m["hit"].isNull(), s).otherwise(F.struct(
            (start + F.length(m["hit"])).alias("at"),
            F.concat(s["out"], F.array(F.struct(start.alias("start"), m["hit"].alias("hit")))).alias("out")))

    return F.when(text.rlike(pattern), F.aggregate(found, state, step, lambda s: s["out"])).otherwise(
        F.expr("CAST(array() AS array<struct<start:int,hit:string>>)"))


def spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of all rules by start, then rule order. An added rule's span that overlaps a base
    span of the same text is kept too; base spans never depend on the added rules."""
    parts = []
    for at, r in enumerate(rules):
        parts.append(_placed(matches(text, r.pattern), r, at))
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    return F.when(text.rlike(_HINTS), F.array_sort(F.concat(*parts))).otherwise(none)


def _placed(found: Column, r: Rule, at: int) -> Column:
    def keep(m):
        value = F.regexp_extract(m["hit"], r.pattern, r.group) if r.group else m["hit"]
        return F.length(value) >= r.least

    return F.transform(F.filter(found, keep), lambda m: F.struct(
        m["start"].alias("start"), F.lit(at).alias("kind"), (m["start"] + F.length(m["hit"])).alias("end")))


def _open(spark, path: str, schema: str) -> DataFrame:
    """A ledger table; empty while nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001  (Spark's own class differs between sessions)
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


FINDINGS = "blob string, rule_version string, spans array<struct<start:int,kind:int,end:int>>"


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger at folder ``ledger`` up to date with ``docs`` and return
    doc_id, blob and spans for every row of ``docs``.

    Findings are written before the ledger's entries: a run that is lost in between scans its
    blobs again, and equal findings of a blob count once."""
    spark, version = docs.sparkSession, rule_version(rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    paths = written(docs.select("doc_id", F.sha2(text, 256).alias("blob")), "blob-paths")
    seen = _open(spark, f"{ledger}/scanned", "blob string, rule_version string").where(
        F.col("rule_version") == version)
    fresh = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(seen, "blob", "left_anti")
    fresh = written(fresh, "blob-fresh")
    # one path's text stands for the blob; a null path is found by its blob alone
    known = docs.select("doc_id", text.alias("text")).withColumn("blob", F.sha2("text", 256))
    # the probe is narrow: rows whose text holds no hint leave before the exchange
    known = known.where(F.col("text").rlike(_HINTS))
    unseen = known.join(fresh.select(F.col("doc_id").alias("_p"), F.col("blob").alias("_b")), (
        F.col("blob") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_p")), "left_semi")
    found = unseen.select("blob", F.lit(version).alias("rule_version"), spans(F.col("text"), rules).alias("spans"))
    found.where(F.size("spans") > 0).dropDuplicates(["blob"]).write.mode("append").parquet(f"{ledger}/findings")
    fresh.select("blob", F.lit(version).alias("rule_version")).write.mode("append").parquet(f"{ledger}/scanned")
    hits = _open(spark, f"{ledger}/findings", FINDINGS).where(F.col("rule_version") == version)
    hits = hits.dropDuplicates(["blob"]).select(F.col("blob").alias("_b"), "spans")
    return paths.join(hits, F.col("blob") == F.col("_b"), "left").select(
        "doc_id", "blob", F.coalesce("spans", F.expr(
            "CAST(array() AS array<struct<start:int,kind:int,end:int>>)")).alias("spans"))


def joined(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def report(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count per base kind, the digest of the base spans and all spans."""
    base = [i for i, r in enumerate(rules) if r.base]
    only = F.filter("spans", lambda s: s["kind"].isin(*base))
    counts = [_count(i).cast("long").alias(f"n_{rules[i].kind}") for i in base]
    return scanned.select("doc_id", *counts, F.sha2(joined(only, rules), 256).alias("base_sha256"),
                          joined(F.col("spans"), rules).alias("spans"))


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark`` and n_chars brought up to date.

    Rows without a finding pass unchanged, and every row is kept."""
    names = docs.columns
    hits = scan(docs, ledger, rules).where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    # the columns of the documents are packed, so none of theirs meets one of ours
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("doc"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("key"))
    rows = rows.join(hits, F.col("key") == F.col("blob"), "left")
    text = F.col("doc")["text"]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        # overlapping spans are one gap: a span that starts inside the last one only extends it
        piece = F.when(x["start"] >= s["at"], F.concat(text.substr(s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], piece).alias("out"))

    clean = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))
    found = F.col("spans").isNotNull()
    rows = rows.withColumn("clean", F.when(found, clean).otherwise(text))
    made = {"text": F.col("clean")}
    if "n_chars" in names:
        n = F.col("doc")["n_chars"]
        made["n_chars"] = F.when(found, F.length("clean").cast(dict(docs.dtypes)["n_chars"])).otherwise(n)
    return rows.select(*(made.get(n, F.col("doc").getField(n)).alias(n) for n in names))


def fresh_ledger(docs: DataFrame, name: str) -> str:
    """A new ledger folder in the cluster's shared folder."""
    return scratch_path(docs.sparkSession, "llm", name)
