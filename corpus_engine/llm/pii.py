"""Personal data: candidate spans of high recall, scored by boosted trees, chosen by calibrated thresholds.

1. Generators propose spans, overlapping ones included: the four base kinds, whose checked
   matches always stay, and looser shapes (written-out mail addresses, local phone numbers, national
   ids, bank accounts).
2. A gradient-boosted tree model (``pyspark.ml``) scores the looser candidates from format and
   context features. It is trained on a bounded number of labelled rows: written
   examples of both classes, set into contexts taken from the documents.
3. The trees are compiled into one SQL expression, so scoring is part of the projection that finds the
   candidates: no user function, no shuffle, one pass over the texts.
4. A threshold per kind is the least score that keeps ``PRECISION`` on held-out labelled rows.

Offsets are code points. Null text is an empty text; empty texts have no spans. Repeated rows are
scanned one by one; an empty table gives an empty result (the model then has no contexts and no spans to score).
Only doc_id and text are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.secrets import matches

PRECISION = 0.98
#: Labelled rows of the model, all told (bounded).
LABELLED = 6000
TREES, DEPTH = 12, 3
CONTEXT = 24
BASE = ("email", "ip", "card", "phone")

_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


@dataclass(frozen=True)
class Generator:
    """A pattern that proposes spans of a kind; ``hint`` is a cheap test that texts must pass."""

    kind: str
    pattern: str
    hint: str


#: Fixed patterns. Look-behinds keep long runs linear: a match can only start where its run does.
GENERATORS = (
    Generator("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Generator("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Generator("card", r"[0-9](?:[\x20-]?[0-9])++", r"(?:[0-9][\x20-]?){12}"),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    Generator("email_words", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]?\x20?(?:at|AT)\x20?[\])]?\x20?[A-Za-z0-9-]{1,63}\x20?[\[(]?\x20?(?:dot|DOT)\x20?[\])]?\x20?[A-Za-z]{2,24}(?![A-Za-z0-9])", r"(?:dot|DOT)"),
    Generator("phone_local", r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    Generator("national_id", r"(?<![0-9A-Za-z.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{2}[\x20-][0-9]{4}"),
    Generator("account", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}"),
)
KINDS = tuple(g.kind for g in GENERATORS)
LOOSE = range(len(BASE), len(GENERATORS))

SPAN = "array<struct<kind:int,start:int,end:int>>"

#: Words before personal data (fixed values), and before numbers that are none.
PERSONAL_CUE = r"(?i)(?:phone|tel|call|mobile|cell|fax|contact|reach|mail|write|ssn|social|id|iban|account|bank)[^A-Za-z0-9]{0,4}(?:is|no|number|me|us)?[^A-Za-z0-9]{0,4}$"
OTHER_CUE = r"(?i)(?:version|order|part|item|build|ticket|isbn|page|look|stop|sku|model|serial|figure)[^A-Za-z0-9]{0,4}(?:no|number)?[^A-Za-z0-9]{0,4}$"

FEATURES = ("kind", "length", "digits", "upper", "seps", "same_sep", "brackets", "leading_zero", "personal_cue", "other_cue",
            "digit_before", "digit_after", "word_before")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    def term(i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), term), F.lit(0), lambda s, x: s + x)
    return total % 10 == 0


def _checked(kind: str, hit: Column) -> Column:
    """The contract's test of a base match."""
    if kind == "ip":
        return hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        d = _digits(hit)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def features(kind: Column, hit: Column, before: Column, after: Column) -> list[Column]:
    """Format and context features of a candidate, in the order of ``FEATURES``."""
    seps = F.regexp_replace(hit, r"[A-Za-z0-9]+", "")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        kind.cast("double"), F.length(hit).cast("double"), F.length(_digits(hit)).cast("double"),
        F.length(F.regexp_replace(hit, "[^A-Z]+", "")).cast("double"), F.length(seps).cast("double"),
        flag(seps.rlike(r"^(.)\1*$")), flag(hit.rlike(r"[\[(]")), flag(hit.rlike("^[(]?0")),
        flag(before.rlike(PERSONAL_CUE)), flag(before.rlike(OTHER_CUE)), flag(before.rlike(r"[0-9][^A-Za-z0-9]*$")),
        flag(after.rlike(r"^[^A-Za-z0-9]*[0-9]")), flag(before.rlike(r"[A-Za-z][.,:;]?\x20$")),
    ]


def labelled_rows(docs: DataFrame, rows: int = LABELLED) -> DataFrame:
    """(kind, hit, before, after, label, part): written examples in contexts of ``docs``.

    At most ``rows`` rows: contexts come from the documents with the smallest id hashes."""
    ctx = docs.where(F.length("text") > 4 * CONTEXT).select(F.xxhash64("doc_id").alias("h"), F.substring(
        "text", 2 * CONTEXT, CONTEXT).alias("left"), F.substring("text", 3 * CONTEXT, CONTEXT).alias("right"))
    ctx = ctx.orderBy("h", "left").limit(max(1, rows // 40))
    r = lambda a, b, salt: (F.pmod(F.xxhash64("h", F.lit(salt), "at"), F.lit(b - a)) + a).cast("string")
    d3, d2, d4 = r(100, 1000, "a"), r(10, 100, "b"), r(1000, 10000, "c")
    e3 = r(200, 1000, "d")
    shapes = []  # kind, text, cue, label
    at = {k: i for i, k in enumerate(KINDS)}

    def add(kind, text, cues, label):
        for cue in cues:
            shapes.append(F.struct(F.lit(at[kind]).alias("kind"), text.alias("hit"), F.lit(cue).alias("cue"),
                                   F.lit(float(label)).alias("label")))

    name = F.substring(F.md5(F.concat(F.col("h").cast("string"), F.col("at").cast("string"))), 1, 6)
    c = F.concat
    lit = F.lit
    add("phone_local", c(lit("("), e3, lit(") "), d3, lit("-"), d4), ("call ", "phone: ", "", "tel. "), 1)
    add("phone_local", c(e3, lit("-"), d3, lit("-"), d4), ("call ", "mobile ", "contact: "), 1)
    add("phone_local", c(d3, lit("."), d3, lit("."), d4), ("version ", "build ", "part no "), 0)
    add("phone_local", c(d3, lit(" "), d3, lit(" "), d4), ("order ", "item ", "", "page "), 0)
    add("national_id", c(d3, lit("-"), d2, lit("-"), d4), ("ssn ", "social: ", "id number "), 1)
    add("national_id", c(d3, lit(" "), d2, lit(" "), d4), ("", "order ", "page "), 0)
    add("national_id", c(d3, lit("-"), d2, lit("-"), d4), ("part ", "serial ", "isbn "), 0)
    add("account", c(lit("DE"), d2, lit(" "), d4, lit(" "), d4, lit(" "), d4, lit(" "), d4, lit(" "), d2), ("iban ", "account: ", "bank "), 1)
    add("account", c(lit("FR"), d2, d4, d4, d4, d4, d4), ("iban ", "", "account no "), 1)
    add("account", c(lit("AB"), d2, lit("ABCD"), lit("EFGH"), lit("IJKL")), ("model ", "sku ", "", "part "), 0)
    add("email_words", c(name, lit(" at "), name, lit(" dot com")), ("mail ", "contact: ", "write to me: "), 1)
    add("email_words", c(name, lit(" [at] "), name, lit(" [dot] org")), ("", "mail "), 1)
    add("email_words", c(lit("look at the dot in")), ("", "we ", "stop and "), 0)
    add("email_words", c(lit("stands at a dot of")), ("", "it "), 0)
    out = ctx.withColumn("at", F.lit(0)).select("h", "left", "right", F.explode(F.array(*shapes)).alias("s"))
    return out.select("s.kind", "s.hit", F.concat("left", F.lit(" "), "s.cue").alias("before"), F.concat(
        F.lit(" "), "right").alias("after"), "s.label", F.pmod("h", F.lit(2)).alias("part"))


def _tree(lines: list[str], at: int, f: Column) -> tuple[Column, int]:
    """A tree's printed lines from ``at`` as an expression over the feature struct ``f``, and
    the line after it."""
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1])), at + 1
    m = re.match(r"If \(feature (\d+) <= ([-0-9.eE]+)\)", line)
    if m is None:
        raise ValueError(f"unknown tree line {line!r}")
    yes, at = _tree(lines, at + 1, f)
    no, at = _tree(lines, at + 1, f)  # the line at ``at`` is the Else
    return F.when(f[FEATURES[int(m[1])]] <= float(m[2]), yes).otherwise(no), at


def compiled(printed: tuple[str, ...], weights: tuple[float, ...], f: Column) -> Column:
    """A boosted-tree model's margin as one expression over the feature struct ``f``."""
    total = F.lit(0.0)
    for text, weight in zip(printed, weights, strict=True):
        total = total + F.lit(float(weight)) * _tree(text.strip().split("\n")[1:], 0, f)[0]
    return total


@dataclass(frozen=True)
class Scorer:
    """The printed trees with their weights, and the least margin per loose kind."""

    trees: tuple[str, ...]
    weights: tuple[float, ...]
    thresholds: dict[int, float]

    def margin(self, f: Column) -> Column:
        return compiled(self.trees, self.weights, f)


def fit(docs: DataFrame, rows: int = LABELLED, precision: float = PRECISION) -> Scorer:
    """Train on one half of the labelled rows; choose thresholds on the other."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    made = labelled_rows(docs, rows)
    named = [c.alias(n) for c, n in zip(features(F.col("kind"), F.col("hit"), F.col("before"), F.col("after")),
                                        FEATURES, strict=True)]
    table = made.select("label", "part", *named).coalesce(1).cache()
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    if train.where("part = 0").select("label").distinct().count() < 2:
        return Scorer((), (), {})
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(train.where("part = 0"))
    scorer = Scorer(tuple(t.toDebugString for t in model.trees), tuple(model.treeWeights), {})
    held = table.where("part = 1").select("kind", "label", F.struct(*FEATURES).alias("f"))
    # scores of a small model take few values: one row per kind and score
    steps = held.select("kind", "label", scorer.margin(F.col("f")).alias("s")).groupBy("kind", "s").agg(
        F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("kind", F.desc("s")).collect()
    table.unpersist()
    thresholds: dict[int, float] = {}
    good: dict[int, float] = {}
    seen: dict[int, int] = {}
    for row in steps:
        k = int(row["kind"])
        good[k] = good.get(k, 0.0) + row["good"]
        seen[k] = seen.get(k, 0) + row["n"]
        if good[k] >= precision * seen[k]:
            thresholds[k] = row["s"]
    return Scorer(scorer.trees, scorer.weights, thresholds)


def find_spans(text: Column, scorer: Scorer) -> tuple[Column, Column]:
    """(base spans, added spans) of a text, each by kind and start."""
    none = F.expr(f"CAST(array() AS {SPAN})")

    def hits(g: Generator) -> Column:
        return F.when(text.rlike(g.hint), matches(text, g.pattern)).otherwise(
            F.expr("CAST(array() AS array<struct<start:int,hit:string>>)"))

    def span(kind: int):
        return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"),
                                  (m["start"] + F.length(m["hit"])).alias("end"))

    def base(kind: int) -> Column:
        g = GENERATORS[kind]
        return F.transform(F.filter(hits(g), lambda m: _checked(g.kind, m["hit"])), span(kind))

    def loose(kind: int) -> Column:
        least = scorer.thresholds.get(kind)
        if least is None:
            return none

        def chosen(m):
            start, end = m["start"], m["start"] + F.length(m["hit"])
            before = text.substr(F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
            made = F.struct(*[c.alias(n) for c, n in zip(features(
                F.lit(kind), m["hit"], before, text.substr(end + 1, F.lit(CONTEXT))), FEATURES, strict=True)])
            return F.transform(F.array(made), scorer.margin)[0] >= least - 1e-9

        return F.transform(F.filter(hits(GENERATORS[kind]), chosen), span(kind))

    return (F.concat(*[base(k) for k in range(len(BASE))]), F.concat(*[loose(k) for k in LOOSE]))


def joined(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """doc_id, a count per base kind, the digest of the base spans and all spans, per row of ``docs``.

    An added span that overlaps a base span says nothing new and is left out."""
    scorer = fit(docs) if scorer is None else scorer
    text = F.coalesce(F.col("text"), F.lit(""))
    base, added = find_spans(F.col("text"), scorer)
    rows = docs.select("doc_id", text.alias("text"))
    # one generated row each, so that spans are found once and not repeated where they are used
    rows = rows.select("doc_id", F.explode(F.array(F.struct(base.alias("base"), added.alias("added")))).alias("s"))
    rows = rows.select("doc_id", "s.base", "s.added")
    fresh = F.filter("added", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    counts = [_count(k).cast("long").alias(f"n_{BASE[k]}") for k in range(len(BASE))]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                       joined(F.concat("base", fresh)).alias("spans"))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def redact(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """doc_id and the text with every chosen span replaced by its kind in brackets."""
    scorer = fit(docs) if scorer is None else scorer
    base, added = find_spans(F.col("text"), scorer)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = F.array_sort(F.transform(F.concat(base, added), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    rows = rows.select("doc_id", "text", F.explode(F.array(order)).alias("spans"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        piece = F.when(x["start"] >= s["at"], F.concat(F.col("text").substr(s["at"] + 1, x["start"] - s["at"]), F.element_at(
            names, x["kind"] + 1))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], piece).alias("out"))

    return rows.select("doc_id", F.aggregate("spans", start, step, lambda s: F.concat(
        s["out"], F.col("text").substr(s["at"] + 1, F.length("text")))).alias("text"))
