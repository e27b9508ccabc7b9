"""Measures of zoning and detection, gold labels and the attack corpus they are taken on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text

#: Recall and precision that each technique must reach; macro-F1 for zones, armed from so many documents on.
RECALL, PRECISION, MACRO_F1, ARMED = 0.90, 0.80, 0.75, 30

#: The attacks that text can carry, with the detector that must see each.
TECHNIQUES = ("visible_directive", "zero_width", "tag_smuggling", "homoglyph", "html_comment", "display_none")


def gold_labels(segments: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """segments with the zone of the first gold phrase (key, ordinal, match, gold_zone) that they contain; null if none."""
    flat = lambda c: F.lower(text.collapse(c))
    g = gold.select(F.col(key).alias("_k"), "ordinal", flat("match").alias("_m"), "gold_zone")
    hit = segments.withColumn("_t", flat("text")).join(g, (F.col(key) == F.col("_k")) & F.contains("_t", "_m"))
    first = hit.groupBy(key, "seq").agg(F.min_by("gold_zone", "ordinal").alias("gold"))
    return segments.join(first, [key, "seq"], "left")


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def metrics(matrix: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) from counts (gold, predicted, n); absent ones are null."""
    hits = F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0))
    by_gold = matrix.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), hits.alias("tp"))
    by_predicted = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("named"), hits.alias("tp2"))
    both = by_gold.join(by_predicted, "label", "full").fillna(0, ["support", "tp", "named", "tp2"])
    ratio = lambda a, b: F.when(b > 0, a / b)
    p, r = ratio(F.col("tp2"), F.col("named")), ratio(F.col("tp"), F.col("support"))
    return both.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * F.greatest("tp", "tp2") / F.nullif(F.col("support") + F.col("named"), F.lit(0)), 6).alias("f1"))


def gate(table: DataFrame, docs: int) -> bool:
    """Whether zones are good enough, or too few documents are labelled to say."""
    row = table.where("support > 0").agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("f")).first()
    return docs < ARMED or (row.f or 0.0) >= MACRO_F1


def weighted_mean(folds: DataFrame, metric: str, n: str) -> DataFrame:
    return folds.agg((F.sum(F.col(metric) * F.col(n)) / F.sum(n)).alias(metric))


def agreement(rows: DataFrame, gold: str, predicted: str, sure: str, bar: float = fixed.JUDGE_BELOW) -> DataFrame:
    """Agreement overall and where the second opinion was sure."""
    same = (F.col(gold) == F.col(predicted)).cast("double")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(same), 6).alias("agreement"), F.round(F.avg(F.when(F.col(sure) >= bar, same)), 6).alias("agreement_sure"), F.count(F.when(F.col(sure) >= bar, 1)).alias("n_sure"))


def red_team(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Per technique, from cases (case, technique, payload, expected) and findings (case, detector, status, severity, excerpt):
    attacked and detected cases, false positives of its detector on clean cases, recall and precision (null for 0/0)."""
    attacked = cases.where("technique IS NOT NULL")
    own = findings.select("case", "detector", F.col("excerpt").alias("_e"))
    on = (F.col("a.case") == F.col("f.case")) & (F.col("f.detector") == F.col("a.expected")) & text.overlaps("a.payload", "f._e")
    hits = attacked.alias("a").join(own.alias("f"), on, "left_semi").groupBy("technique").agg(F.count("*").alias("detected"))
    totals = attacked.groupBy("technique", "expected").agg(F.count("*").alias("attacked"))
    wrong = findings.join(cases.where("technique IS NULL").select("case"), "case", "left_semi").groupBy(F.col("detector").alias("expected")).agg(F.countDistinct("case").alias("false_positives"))
    rows = totals.join(hits, "technique", "left").join(wrong, "expected", "left").fillna(0, ["detected", "false_positives"])
    named = F.col("detected") + F.col("false_positives")
    return rows.select(
        "technique", F.col("expected").alias("detector"), "attacked", "detected", "false_positives", F.round(F.col("detected") / F.col("attacked"), 6).alias("recall"),
        F.round(F.when(named > 0, F.col("detected") / named), 6).alias("precision"),
    )


def red_team_gate(table: DataFrame) -> bool:
    """Whether every technique reaches both bars."""
    return table.where((F.col("recall") < RECALL) | (F.coalesce("precision", F.lit(0.0)) < PRECISION)).isEmpty()


def inject(docs: DataFrame, payload: str, key: str = "doc_id", body: str = "text") -> DataFrame:
    """docs as attack cases: by key modulo, every technique in turn, one in seven clean."""
    n = len(TECHNIQUES)
    which = F.pmod(F.col(key), F.lit(n + 1))
    zw = payload[:3] + "​" + payload[3:]
    tags = "".join(chr(0xE0000 + ord(c)) for c in payload)
    parts = {"visible_directive": payload, "zero_width": zw, "tag_smuggling": "note" + tags, "homoglyph": payload.replace("o", "о", 1), "html_comment": f"<!-- {payload} -->", "display_none": f'<p style="display:none">{payload}</p>'}
    text_ = F.col(body)
    name = F.lit(None).cast("string")
    for i, t in enumerate(TECHNIQUES):
        text_ = F.when(which == i, F.concat(F.col(body), F.lit("\n\n" + parts[t]))).otherwise(text_)
        name = F.when(which == i, F.lit(t)).otherwise(name)
    return docs.select(F.col(key).alias("case"), text_.alias("text"), name.alias("technique"), F.when(name == "homoglyph", parts["homoglyph"]).otherwise(payload).alias("payload"))


def snapshots_differ(now: DataFrame, golden: DataFrame) -> DataFrame:
    """Rows on one side only, with the side."""
    return now.exceptAll(golden).withColumn("side", F.lit("now")).unionByName(golden.exceptAll(now).withColumn("side", F.lit("golden")))


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def status_changes(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """The rows where a key's status differs from its row before."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("_last", F.lag(status).over(w)).where(F.col("_last").isNull() | (F.col("_last") != F.col(status))).drop("_last")
