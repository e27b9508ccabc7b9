"""Sentences that address a model (D1) or rule its use (P1), and what becomes of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .hidden import directive

RANK = {name: i for i, name in enumerate(fixed.SEVERITIES)}


def rank(column: str = "severity") -> Column:
    return F.coalesce(*(F.when(F.col(column) == n, F.lit(i)) for n, i in RANK.items()))


def _original(seen: Column, body: Column, place: Column) -> Column:
    """The offset in body of an offset in its visible text: one more for every invisible character before it.

    Folded over the pieces between invisible characters; a text without any is not looked at."""
    zero = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("hid"), F.lit(False).alias("done"))

    def step(a: Column, piece: Column) -> Column:
        n = F.length(piece)
        past = ~a["done"] & (place >= a["seen"] + n)
        return F.struct(F.when(past, a["seen"] + n).otherwise(a["seen"]).alias("seen"), F.when(past, a["hid"] + 1).otherwise(a["hid"]).alias("hid"), (a["done"] | ~past).alias("done"))

    found = F.aggregate(F.split(body, fixed.INVISIBLE, -1), zero, step, lambda a: F.when(a["done"], place + a["hid"]).otherwise(F.length(body)))
    return F.when(seen == body, place).otherwise(found)


def text_findings(segments: DataFrame, keys: tuple[str, ...] = ("doc_id", "segment_id")) -> DataFrame:
    """D1 and P1 findings: keys, detector, kind, severity, status, excerpt, start, end, note. At most one of each a sentence.

    One pass: a text is stripped and cut into sentences once, if anything in it calls for either detector, and a
    sentence gives a row for each detector that fires."""
    policy = lambda c: text.has(c, fixed.AI_TERMS) & text.has(c, fixed.POLICY_TERMS)
    seen = segments.select(*keys, "text", text.strip_invisible("text").alias("seen"))
    seen = seen.where(directive("seen").isNotNull() | policy("seen"))
    rows = seen.select("*", F.explode_outer(text.sentences("seen")).alias("sentence")).where("sentence IS NOT NULL")
    rows = rows.withColumn("pattern", directive("sentence.text")).withColumn("policy", F.coalesce(policy("sentence.text"), F.lit(False)))
    hit = F.lit(None).cast("string")
    for i, p in reversed(list(enumerate(fixed.DIRECTIVES))):
        hit = F.when(F.col("pattern") == i, F.regexp_extract("sentence.text", "(?iU)" + p, 0)).otherwise(hit)
    at = F.col("sentence.start") + F.instr(F.col("sentence.text"), F.col("hit")) - 1
    rows = rows.where("pattern IS NOT NULL OR policy").withColumn("hit", hit).withColumn("at", at)

    def found(detector: str, kind: str, severity: str, start: Column, length: Column, note: Column) -> Column:
        return F.struct(F.lit(detector).alias("detector"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), start.alias("at"), (start + length).alias("to"), note.alias("note"))

    d1 = found("D1", "ai_directive", "warning", F.col("at"), F.length("hit"), F.concat(F.lit("directive pattern "), F.col("pattern")))
    p1 = found("P1", "ai_policy", "info", F.col("sentence.start"), F.length("sentence.text"), F.lit("statement about the use of AI tools"))
    both = F.array_compact(F.array(F.when(F.col("pattern").isNotNull(), d1), F.when(F.col("policy"), p1)))
    rows = rows.select(*keys, "text", "seen", text.excerpt("sentence.text").alias("excerpt"), F.explode(both).alias("f"))
    place = lambda c: _original(F.col("seen"), F.col("text"), F.col(c))
    return rows.select(*keys, "f.detector", "f.kind", "f.severity", F.lit("open").alias("status"), "excerpt", place("f.at").alias("start"), place("f.to").alias("end"), "f.note")


def attach(findings: DataFrame, segments: DataFrame, key: str = "finding") -> DataFrame:
    """findings with the first segment of their document that spans their block, and its first page where they have none.

    A segment is a row for each of its blocks, so findings meet it by an equal key and not by all pairs of a document."""
    spans = segments.select(F.col("doc_id").alias("_d"), F.struct(F.col("seq").alias("_q"), F.col("page_start").alias("_p")).alias("_s"), F.explode(F.sequence("block_start", "block_end")).alias("_b"))
    first = spans.groupBy("_d", "_b").agg(F.min("_s").alias("_s"))
    joined = findings.join(first, (F.col("doc_id") == F.col("_d")) & (F.col("block") == F.col("_b")), "left")
    return joined.select(*(c for c in findings.columns if c != "page"), F.coalesce(F.when(F.col("page") > 0, F.col("page")), F.col("_s._p")).alias("page"), F.concat(F.lit("s"), F.col("_s._q")).alias("segment_id"))


def escalate(findings: DataFrame, hidden: DataFrame) -> DataFrame:
    """Findings in hidden segments (doc_id, segment_id) are quarantined; beside a directive they are critical."""
    marked = findings.join(hidden.select("doc_id", "segment_id").distinct().withColumn("_hidden", F.lit(True)), ["doc_id", "segment_id"], "left")
    w = Window.partitionBy("doc_id", "segment_id")
    marked = marked.withColumn("_hidden", F.coalesce("_hidden", F.lit(False))).withColumn("_told", F.max((F.col("detector") == "D1") & F.col("_hidden")).over(w))
    out = {
        "status": F.when(F.col("_hidden"), "quarantined").otherwise(F.col("status")),
        "severity": F.when(F.col("_hidden") & F.col("_told"), "critical").otherwise(F.col("severity")),
        "note": F.when(F.col("_hidden") & (F.col("detector") == "D1"), "AI-directed instruction inside hidden text").otherwise(F.col("note")),
    }
    return marked.select(*(out[c].alias(c) if c in out else F.col(c) for c in findings.columns))


def order(page: str = "page", block: str = "block", tie: str = "finding") -> list[Column]:
    return [rank(), F.coalesce(page, F.lit(0)), F.coalesce(block, F.lit(0)), F.col("detector"), F.col(tie)]


def fails(findings: DataFrame, level: str, key: str = "doc_id") -> DataFrame:
    """(key, fails): whether any finding that is not dismissed reaches the level."""
    if level not in RANK:
        raise ValueError(f"unknown level {level!r}; levels: {', '.join(RANK)}")
    return findings.groupBy(key).agg(F.bool_or((rank() <= RANK[level]) & (F.col("status") != "dismissed")).alias("fails"))


def verdicts(findings: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document the verdict and the counts of findings, hidden ones by place."""
    place = text.where_label("page", "segment_id")
    counts = findings.groupBy(key).agg(
        F.countDistinct(F.when(F.col("severity") == "critical", place)).alias("critical"), F.countDistinct(F.when(F.col("status") == "quarantined", place)).alias("quarantined"),
        F.count(F.when(F.col("kind") == "ai_policy", 1)).alias("ai_policy"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"), F.count("*").alias("findings"),
    )
    rows = docs.select(key).join(counts, key, "left").fillna(0, ["critical", "quarantined", "ai_policy", "warnings", "findings"])
    verdict = F.when(F.col("critical") > 0, "unsafe").when(F.col("quarantined") > 0, "caution").when(F.col("warnings") > 0, "review").otherwise("clean")
    return rows.select(key, verdict.alias("verdict"), "critical", "quarantined", "ai_policy", "findings")


def by_place(findings: DataFrame, key: str = "doc_id", tie: str = "finding") -> DataFrame:
    """Findings of one place as one item, in the order in which places are first seen."""
    rows = findings.withColumn("place", text.where_label("page", "segment_id")).groupBy(key, "place").agg(F.min(tie).alias("first"), F.array_sort(F.collect_set("detector")).alias("detectors"), F.min_by("excerpt", tie).alias("excerpt"), F.count("*").alias("n"))
    return rows.withColumn("item", F.row_number().over(Window.partitionBy(key).orderBy("first"))).drop("first")
