"""A person's decisions over an analysis, the gate before an export, and the history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def kept_zones(zones: list[str]) -> list[str]:
    """Known zones without those that are never kept, in the order of zones; an unknown name is an error."""
    if bad := sorted(set(zones) - set(fixed.ZONES)):
        raise ValueError(f"unknown zone(s): {', '.join(bad)}")
    return [z for z in fixed.ZONES if z in zones and z not in fixed.NEVER_KEEP]


def overlay(segments: DataFrame, decisions: DataFrame, keep: list[str], key: str = "doc_id") -> DataFrame:
    """segments after decisions (key, segment_id, new_zone, keep): first a new zone, then kept or dropped by moving zones.

    Zones that are never kept neither change nor are given."""
    keep = kept_zones(keep)
    to_keep, to_drop = keep[0] if keep else "task", "unknown" if "structure" in keep else "structure"
    free = [z for z in fixed.ZONES if z not in fixed.NEVER_KEEP]
    rows = segments.join(decisions.select(key, "segment_id", "new_zone", F.col("keep").alias("_keep")), [key, "segment_id"], "left")
    mutable = ~F.col("zone").isin(*fixed.NEVER_KEEP)
    over = F.coalesce(mutable & F.col("new_zone").isin(*free), F.lit(False))
    mid = F.when(over, F.col("new_zone")).otherwise(F.col("zone"))
    up = F.coalesce(mutable & F.col("_keep") & ~mid.isin(*keep), F.lit(False))
    down = F.coalesce(mutable & ~F.col("_keep") & mid.isin(*keep), F.lit(False))
    signals = F.array_compact(F.array(F.when(over, F.lit("review:zone_override")), F.when(up, F.lit("review:kept")), F.when(down, F.lit("review:dropped"))))
    out = {"zone": F.when(up, to_keep).when(down, to_drop).otherwise(mid), "signals": F.concat("signals", signals)}
    return rows.select(*(out[c].alias(c) if c in out else F.col(c) for c in segments.columns))


def findings_overlay(findings: DataFrame, decisions: DataFrame, key: str = "doc_id", tie: str = "finding") -> DataFrame:
    """findings after statuses (key, index from 0, status); quarantine stays, and only open and dismissed are accepted."""
    asked = decisions.where(F.col("status").isin("open", "dismissed")).select(key, F.col("index").alias("_i"), F.col("status").alias("_s"))
    rows = findings.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(tie)) - 1).join(asked, [key, "_i"], "left")
    new = F.when(F.col("status") == "quarantined", F.col("status")).otherwise(F.coalesce("_s", "status"))
    return rows.select(*(new.alias(c) if c == "status" else F.col(c) for c in findings.columns))


def export_gate(requests: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """requests (key, status, format, dry, acknowledged) with `code` and `logged`: 409 unless ready and, for a copy or
    brief of a document that states rules about AI use, acknowledged; JSON and dry runs need no acknowledgement."""
    rules = findings.where("detector = 'P1'").select(key).distinct().withColumn("_rules", F.lit(True))
    rows = requests.join(rules, key, "left")
    blocked = F.coalesce("_rules", F.lit(False)) & F.col("format").isin("clean", "brief") & ~F.col("dry") & ~F.col("acknowledged")
    code = F.when(F.col("status") != "ready", 409).when(blocked, 409).otherwise(200)
    return rows.select(*requests.columns, code.alias("code"), ((code == 200) & ~F.col("dry")).alias("logged"))


def upsert(now: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """The latest row of each key; of equal stamps the new one."""
    both = now.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(stamp), F.desc("_n"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_n")


def unreferenced(files: DataFrame, analyses: DataFrame, key: str = "sha256") -> DataFrame:
    """Files that no analysis names any more."""
    return files.join(analyses, key, "left_anti")


def once_by_content(docs: DataFrame, content: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """docs with `sha256` and `first`, whether a row is the one of its content that is worked on."""
    rows = docs.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    w = Window.partitionBy("sha256", *keys).orderBy(*[c for c in docs.columns if c != content])
    return rows.withColumn("first", F.row_number().over(w) == 1)
