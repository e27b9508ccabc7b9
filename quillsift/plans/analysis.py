"""From blocks to an analysis: screen, segment, attach, screen text, escalate, zone, share.

Everything up to the findings is a projection of the row of a document; findings and shares need one shuffle
by document. The screened rows feed several branches, so a caller with a large corpus gives a `cut` that
writes them and reads them back."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import classifier, emit, hidden, screening, segmenter, zoning


class Analysis(NamedTuple):
    docs: DataFrame
    segments: DataFrame
    findings: DataFrame
    shares: DataFrame


def block_findings(screened: DataFrame) -> DataFrame:
    rows = screened.select("doc_id", F.posexplode_outer("block_findings").alias("finding", "f")).where("finding IS NOT NULL")
    return rows.select("doc_id", F.col("finding").cast("long").alias("finding"), "f.*")


def with_findings(segments: DataFrame, findings: DataFrame) -> DataFrame:
    """segments with what the rules need to know of their findings."""
    span = F.coalesce(F.col("end") - F.col("start"), F.lit(0))
    by = findings.where("segment_id IS NOT NULL").groupBy("doc_id", "segment_id").agg(
        F.sum(span).alias("covered"), F.count(F.when(F.col("detector") == "D1", 1)).alias("n_d1"), F.count(F.when(F.col("detector") == "P1", 1)).alias("n_p1")
    )
    return segments.join(by, ["doc_id", "segment_id"], "left").fillna(0, ["covered", "n_d1", "n_p1"])


def analyze(docs: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda df: df, model: tuple[DataFrame, DataFrame] | None = None) -> Analysis:
    """docs: doc_id, format, title, meta, blocks. model: weights and bias of a classifier for what the rules leave unsure."""
    screened = cut(hidden.screen(docs))
    segments = cut(segmenter.segments(screened))
    placed = screening.attach(block_findings(screened), segments).withColumn("stage", F.lit(0))
    said = screening.text_findings(segments.select("doc_id", "segment_id", "seq", "text", F.col("page_start").alias("page")), ("doc_id", "segment_id", "seq", "page"))
    said = said.withColumn("stage", F.when(F.col("detector") == "D1", 1).otherwise(2)).withColumn("block", F.lit(None).cast("int"))
    both = placed.withColumns({"seq": F.lit(0), "start": F.lit(None).cast("int"), "end": F.lit(None).cast("int")}).unionByName(said.withColumn("finding", F.lit(None).cast("long")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("stage", "finding", "seq", "start")) - 1
    both = both.withColumn("finding", number.cast("long")).drop("stage", "seq")
    findings = cut(screening.escalate(both, segments.where(F.exists("flags", lambda f: f.startswith("hidden:")))))
    zoned = zoning.zone(with_findings(segments, findings)).drop("covered", "n_d1", "n_p1")
    if model is not None:
        zoned = cut(zoned)
        keys = ["doc_id", "seq"]
        vectors = classifier.features(classifier.tokens(zoned), keys)
        zoned = classifier.gate(zoned, classifier.best(classifier.probabilities(vectors, *model, keys), keys), keys).drop("changed")
    zoned = cut(zoned)
    return Analysis(screened.drop("block_findings"), zoned, findings, emit.zone_shares(zoned))


def as_json(a: Analysis) -> DataFrame:
    """(doc_id, json): the whole analysis of a document in one object."""
    segments = a.segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "segment_id", "heading_path", "text", "tokens_est", "zone", "confidence", "method", "signals", "flags", "page_start", "page_end", "block_start", "block_end"))).alias("segments"))
    order = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(screening.order())))
    finding = F.struct("detector", "kind", "severity", "status", "segment_id", "page", "block", "excerpt", "start", "end", "note")
    findings = a.findings.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), finding.alias("f")))), lambda x: x["f"]).alias("findings"))
    shares = a.shares.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("zone", "share"))).alias("zone_shares"))
    rows = a.docs.select("doc_id", "format", "title").join(segments, "doc_id", "left").join(findings, "doc_id", "left").join(shares, "doc_id", "left")
    return rows.select("doc_id", F.to_json(F.struct("format", "title", "segments", "findings", "zone_shares")).alias("json"))
