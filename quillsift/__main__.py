"""scan, clean and brief over files: python -m quillsift scan FOLDER [--json] [--fail-on LEVEL]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .operators import emit, screening
from .plans.analysis import analyze, as_json
from .sources import files


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: a file could not be read; 2: wrong use; 3: findings at the level of --fail-on."""
    parser = argparse.ArgumentParser(prog="quillsift")
    parser.add_argument("command", choices=["scan", "clean", "brief"])
    parser.add_argument("path")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--fail-on", choices=fixed.SEVERITIES)
    parser.add_argument("--keep", help="zones, comma-separated")
    parser.add_argument("--drop", help="zones, comma-separated")
    parser.add_argument("--no-report", action="store_true")
    own = parser.parse_args(args)
    try:
        keep = emit.selection(*(x.split(",") if x else None for x in (own.keep, own.drop)))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    loaded = files.load(spark, own.path).withColumn("doc_id", F.col("source")).persist()
    bad = loaded.where("error IS NOT NULL").select("source", "error").collect()
    for row in bad:
        print(f"{row.source}: {row.error}", file=sys.stderr)
    a = analyze(loaded.where("error IS NULL").select("doc_id", "format", "title", "meta", "blocks"), cut=lambda df: df.persist())
    if own.command == "scan":
        rows = as_json(a).select("json") if own.json else screening.verdicts(a.findings, a.docs).select(F.concat_ws("  ", "doc_id", "verdict", F.concat("findings", F.lit(" finding(s)"))))
    elif own.command == "clean":
        copies = emit.clean_copies(a.segments, keep)
        rows = copies.select("text") if own.no_report else copies.join(emit.removal_reports(a.segments, a.findings, a.docs, keep), "doc_id").select(F.concat("text", F.lit("\n"), "report"))
    else:
        rows = emit.briefs(a.segments, a.findings, a.docs, keep).select("brief")
    for row in rows.toLocalIterator():
        print(row[0])
    if own.fail_on and screening.fails(a.findings, own.fail_on).where("fails").head(1):
        return 3
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
