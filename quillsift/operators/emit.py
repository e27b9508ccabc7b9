"""Clean copies, removal reports, briefs and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text


def selection(keep: list[str] | None = None, drop: list[str] | None = None) -> list[str]:
    """The zones a copy keeps, in the order of zones; unknown names are an error, some zones are never kept."""
    if bad := [z for z in [*(keep or []), *(drop or [])] if z not in fixed.ZONES]:
        raise ValueError(f"unknown zone(s): {', '.join(bad)}; zones: {', '.join(fixed.ZONES)}")
    chosen = set(keep or fixed.DEFAULT_KEEP) - set(drop or ()) - set(fixed.NEVER_KEEP)
    return [z for z in fixed.ZONES if z in chosen]


def clean_copies(segments: DataFrame, keep: list[str], key: str = "doc_id") -> DataFrame:
    """(key, text, removed): kept segments in order without invisible characters, and how many of these there were."""
    seen = text.strip_invisible("text")
    part = F.regexp_replace(seen, r"(?U)^\s+|\s+$", "")
    rows = segments.withColumn("_keep", F.col("zone").isin(*keep)).groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("_keep") & (part != ""), F.struct("seq", part.alias("t"))))).alias("own"),
        F.sum(F.when(F.col("_keep"), F.length("text") - F.length(seen)).otherwise(0)).alias("removed"),
    )
    return rows.select(key, F.concat(F.array_join(F.transform("own", lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("text"), "removed")


def zone_shares(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, zone, share) by estimated tokens, to four places."""
    by = segments.groupBy(key, "zone").agg(F.sum("tokens_est").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    return by.where("n > 0").select(key, "zone", F.bround(F.col("n") / F.greatest(F.lit(1), total), 4).alias("share"))


def zone_table(segments: DataFrame, keep: list[str], key: str = "doc_id") -> DataFrame:
    """(key, zone, position, segments, percent, kept): the table of a removal report."""
    by = segments.groupBy(key, "zone").agg(F.count("*").alias("segments"), F.sum("tokens_est").alias("n"))
    total = F.greatest(F.lit(1), F.sum("n").over(Window.partitionBy(key)))
    kept = F.when(F.col("zone").isin(*keep), "yes").when(F.col("zone").isin(*fixed.NEVER_KEEP), "never").otherwise("no")
    position = F.array_position(F.array(*map(F.lit, fixed.REPORT_ORDER)), F.col("zone"))
    return by.select(key, "zone", position.alias("position"), "segments", F.bround(100 * F.col("n") / total, 0).cast("int").alias("percent"), kept.alias("kept"))


def removal_reports(segments: DataFrame, findings: DataFrame, docs: DataFrame, keep: list[str], key: str = "doc_id") -> DataFrame:
    """(key, report): Markdown with what was kept, every policy statement, all other findings and what was quarantined."""
    zones = zone_table(segments, keep, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", F.format_string("| %s | %d | %d%% | %s |", "zone", "segments", "percent", "kept").alias("line")))).alias("z"))
    kept = segments.groupBy(key).agg(
        F.sum(F.when(F.col("zone").isin(*keep), F.col("tokens_est")).otherwise(0)).alias("k"), F.sum("tokens_est").alias("t"),
        F.count(F.when(F.col("zone").isin(*keep), 1)).alias("ks"), F.count("*").alias("ts"),
    )
    place = text.where_label("page", "segment_id")
    is_policy = F.col("kind") == "ai_policy"
    line = F.when(is_policy, F.concat(F.lit("- "), place, F.lit(" "), F.col("excerpt"))).otherwise(F.concat(F.lit("| "), F.concat_ws(" | ", "detector", "kind", "severity", "status", place, text.table_cell("excerpt")), F.lit(" |")))
    listed = findings.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(is_policy, F.struct("finding", line.alias("l"))))).alias("policy"), F.array_sort(F.collect_list(F.when(~is_policy, F.struct("finding", line.alias("l"))))).alias("other"),
        F.count("*").alias("n"), F.count(F.when(F.col("status") == "quarantined", 1)).alias("q"),
    )
    rows = docs.select(key).join(kept, key, "left").join(zones, key, "left").join(listed, key, "left").fillna(0, ["n", "q", "k", "t", "ks", "ts"])
    lines = lambda c, f="l": F.array_join(F.transform(F.coalesce(F.col(c), F.expr("array()")), lambda x: x[f]), "\n")
    head = F.format_string("## Removal report\n\nKept %d%% of the text (%d of %d segments).\n\n| zone | segments | share | kept |\n|---|---:|---:|---|\n", F.bround(100 * F.col("k") / F.greatest(F.lit(1), F.col("t")), 0).cast("int"), "ks", "ts")
    policy = F.when(F.size("policy") > 0, F.concat(F.lit("\n\nStatements about AI use (always reported, never copied):\n"), lines("policy"))).otherwise("")
    other = F.when(F.size("other") > 0, F.concat(F.lit("\n\n| detector | kind | severity | status | where | excerpt |\n|---|---|---|---|---|---|\n"), lines("other"))).otherwise("")
    none = F.when(F.col("n") == 0, "\n\nNothing hidden, nothing addressed to a model, no rules about its use.").otherwise("")
    held = F.when(F.col("q") > 0, F.format_string("\n\n%d finding(s) quarantined.", "q")).otherwise("")
    zone_lines = F.array_join(F.transform(F.coalesce("z", F.expr("array()")), lambda x: x["line"]), "\n")
    return rows.select(key, F.concat(head, zone_lines, F.format_string("\n\n### Findings (%d)", "n"), none, policy, other, held).alias("report"))


def first_line(body: str = "text", limit: int = fixed.ASK_CHARS) -> Column:
    """The first line that is neither blank nor a heading, cut at the limit; null if there is none."""
    kept = F.filter(F.split(F.col(body), "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    line = F.regexp_replace(F.get(kept, F.lit(0)), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("…"))).otherwise(line)


def asks(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ask_no, ask): the first lines of the first task segments of each document."""
    rows = segments.where("zone = 'task'").withColumn("ask", first_line()).where("ask <> ''")
    ranked = rows.withColumn("ask_no", F.row_number().over(Window.partitionBy(key).orderBy("seq")))
    return ranked.where(F.col("ask_no") <= fixed.ASKS).select(key, "ask_no", "ask")


def outline(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seq, entry): what a model may see of a document, until the budget of tokens is first exceeded."""
    flat = text.collapse("text")
    snippet = F.when(F.length(flat) > fixed.SNIPPET_CHARS, F.concat(F.rtrim(F.substring(flat, 1, fixed.SNIPPET_CHARS)), F.lit(" […]"))).otherwise(flat)
    path = F.array_join("heading_path", " > ")
    entry = F.concat(F.lit("["), F.col("segment_id"), F.lit("] "), F.when(path != "", F.concat(F.lit("("), path, F.lit(") "))).otherwise(""), snippet)
    open_ = (F.col("zone") != "hidden") & ((F.col("zone") != "structure") | F.array_contains("flags", "heading_only"))
    rows = segments.where(open_).select(key, "seq", entry.alias("entry"))
    used = F.sum(F.floor(F.length("entry") / 4) + 1).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_used", used).where(F.col("_used") <= fixed.OUTLINE_TOKENS).drop("_used")


def briefs(segments: DataFrame, findings: DataFrame, docs: DataFrame, keep: list[str], key: str = "doc_id") -> DataFrame:
    """(key, brief): what the document asks, its rules about AI use, what was found and what a copy keeps, as Markdown."""
    asked = asks(segments, key).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ask_no", "ask"))), lambda x: F.concat(F.lit("- "), x["ask"])), "\n").alias("asks"))
    place = text.where_label("page", "segment_id")
    told = lambda when, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("finding", line.alias("l"))))), lambda x: x["l"]), "\n")
    warned = (F.col("severity") == "warning") & (F.col("status") != "dismissed")
    said = findings.groupBy(key).agg(
        told(F.col("kind") == "ai_policy", F.concat(F.lit("- "), place, F.lit(" "), F.col("excerpt"))).alias("policy"),
        told(warned, F.concat(F.lit("- "), place, F.lit(" "), F.col("detector"), F.lit(" "), F.col("kind"), F.lit(": "), F.col("excerpt"))).alias("warned"),
    )
    grave = by_place_lines(findings, key)
    zones = segments.groupBy(key, "zone").agg(F.count("*").alias("c"), F.sum("tokens_est").alias("n"), F.lit(1).alias("one"))
    spot = F.array_position(F.array(*map(F.lit, fixed.ZONES)), F.col("zone"))
    kept = F.col("zone").isin(*keep)
    listed = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(spot.alias("p"), F.format_string("%s (%d)", "zone", "c").alias("l"))))), lambda x: x["l"]), ", ")
    copy = zones.groupBy(key).agg(listed(kept).alias("in"), listed(~kept).alias("out"), F.bround(100 * F.sum(F.when(kept, F.col("n")).otherwise(0)) / F.greatest(F.lit(1), F.sum("n")), 0).cast("int").alias("percent"))
    rows = docs.select(key, "title").join(asked, key, "left").join(said, key, "left").join(grave, key, "left").join(copy, key, "left")
    or_ = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) == "", other).otherwise(F.col(c))
    found = F.when((F.coalesce("grave", F.lit("")) == "") & (F.coalesce("warned", F.lit("")) == ""), "Nothing hidden and nothing addressed to a model.").otherwise(F.concat_ws("\n", F.nullif("grave", F.lit("")), F.nullif("warned", F.lit(""))))
    parts = [F.concat(F.lit("# Brief: "), F.coalesce("title", F.col(key).cast("string"))), F.lit("## What it asks"), or_("asks", "- Nothing."), F.lit("## Rules about AI use"), or_("policy", "None stated."), F.lit("## What was found"), found,
             F.lit("## What a clean copy keeps"), F.format_string("%d%% of the text: %s. Left out: %s.", F.coalesce("percent", F.lit(0)), or_("in", "nothing"), or_("out", "nothing"))]
    return rows.select(key, F.concat_ws("\n\n", *parts).alias("brief"))


def by_place_lines(findings: DataFrame, key: str) -> DataFrame:
    from .screening import by_place

    rows = by_place(findings.where("severity = 'critical'"), key)
    line = F.concat(F.lit("- "), F.col("place"), F.lit(" ["), F.array_join("detectors", ", "), F.lit("] "), F.col("excerpt"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", line.alias("l")))), lambda x: x["l"]), "\n").alias("grave"))


def preview(body: str = "text", limit: int = 90) -> Column:
    """The first line that is no heading, cut short; the first line where all are headings."""
    own = F.coalesce(first_line(body, limit), F.get(F.split(F.col(body), "\n"), F.lit(0)))
    return F.when(F.length(own) > limit + 1, F.concat(F.substring(own, 1, limit), F.lit("…"))).otherwise(own)


def page_range(first: str = "page_start", last: str = "page_end") -> Column:
    """p3 or p3-5, empty without pages."""
    a, b = F.col(first), F.coalesce(F.col(last), F.col(first))
    return F.when(a.isNull(), "").when(a == b, F.concat(F.lit("p"), a)).otherwise(F.concat(F.lit("p"), a, F.lit("-"), b))


def zone_map(segments: DataFrame, key: str = "doc_id", width: int = 20) -> DataFrame:
    """(key, line): a bar for each zone of a document, the largest first."""
    share = F.col("share")
    bar = F.rpad(F.repeat(F.lit("#"), F.bround(share * width).cast("int")), width, ".")
    return zone_shares(segments, key).select(key, "zone", F.format_string("%-13s %s %3d%%", "zone", bar, F.bround(share * 100).cast("int")).alias("line"), share)


def listing(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seq, line): a line for each segment, furniture as one line for each document."""
    furniture = F.arrays_overlap("flags", F.array(*map(F.lit, fixed.FURNITURE)))
    own = segments.where(~furniture).select(key, "seq", F.concat_ws("  ", "segment_id", "zone", F.format_string("%.2f", "confidence"), F.nullif(page_range(), F.lit("")), preview()).alias("line"))
    rest = segments.where(furniture).groupBy(key).agg(F.min("seq").alias("seq"), F.concat(F.count("*").cast("string"), F.lit(" page headers, footers or numbers, p"), F.min("page_start").cast("string"), F.lit("-"), F.max("page_end").cast("string")).alias("line"))
    return own.unionByName(rest.withColumn("line", F.coalesce("line", F.lit("page headers, footers or numbers"))))
