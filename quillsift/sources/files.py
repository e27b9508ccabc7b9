"""Files of any supported format under a path, each one row of blocks or one row with its error."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import html, markdown, office


def _text(content: bytes):
    return None, {}, content.decode("utf-8", "replace")


#: Suffix to converter name and parser. A parser gives title, properties, and blocks or the Markdown of a text.
CONVERTERS = {
    **dict.fromkeys(("md", "markdown", "txt", "text"), ("markdown", _text)),
    **dict.fromkeys(("html", "htm"), ("html", lambda content: html.parse(content.decode("utf-8", "replace")))),
    "docx": ("docx", office.docx), "pptx": ("office", office.pptx), "xlsx": ("office", office.xlsx), "epub": ("office", office.epub), "rtf": ("office", office.rtf),
}


def supported() -> list[str]:
    return sorted(CONVERTERS)


def convert(df: DataFrame) -> DataFrame:
    """Rows of the binaryFile source to source, sha256, format, converter, title, meta, blocks and error."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "sha256", "format", "converter", "title")])
    schema = schema.add("meta", T.MapType(T.StringType(), T.StringType())).add("blocks", T._parse_datatype_string(markdown.BLOCKS)).add("markdown", "string").add("error", "string")

    def one(path: str, sha: str, content: bytes):
        suffix = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
        if suffix not in CONVERTERS:
            return path, sha, suffix, None, None, [], [], None, f"unsupported format {suffix!r}; supported: {', '.join(supported())}"
        if not content:
            return path, sha, suffix, None, None, [], [], None, "empty file"
        name, parse = CONVERTERS[suffix]
        try:
            title, meta, blocks = parse(content)
        except Exception as e:  # a damaged file is a row with its error, not a lost job
            return path, sha, suffix, name, None, [], [], None, f"{type(e).__name__}: {e}"
        text = blocks if isinstance(blocks, str) else None
        return path, sha, suffix, name, title, list(meta.items()), [] if text is not None else blocks, text, None

    kinds = [pa.string()] * 5 + [pa.map_(pa.string(), pa.string()), markdown.ARROW, pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [one(p, s, c) for p, s, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)

    rows = df.select("path", F.sha2("content", 256).alias("sha"), "content").mapInArrow(run, schema)
    rows = markdown.with_blocks(rows.withColumn("_md", F.col("markdown")), "_md", "_own")
    rows = rows.withColumn("blocks", F.when(F.col("markdown").isNotNull(), F.col("_own")).otherwise(F.col("blocks")))
    return rows.withColumn("title", F.coalesce("title", F.when(F.col("markdown").isNotNull(), markdown.title()))).select(*(c for c in schema.names if c != "markdown"))


def load(spark: SparkSession, path: str) -> DataFrame:
    return convert(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def label_rows(spark: SparkSession, path: str, schema: str, zone: str, zones: tuple[str, ...]) -> DataFrame:
    """JSON lines with a trainable zone."""
    return spark.read.schema(schema).json(path).where(F.col(zone).isin(*zones))


def manifest(text: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a five-column Markdown table: id, kind, format, licence, url; repeated ids are an error."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(F.col(column)), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = text.where(F.trim(F.col(column)).startswith("|")).select(cells.alias("c")).where((F.size("c") == 5) & ~F.get("c", F.lit(0)).rlike(r"^(id|:?-+:?)$"))
    names = ("id", "kind", "format", "licence", "url")
    found = rows.select(*(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)))
    again = found.groupBy("id").count().where("count > 1")
    if row := again.first():
        raise ValueError(f"id {row.id!r} occurs {row['count']} times")
    return found
