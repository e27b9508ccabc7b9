"""Positioned words of pages to lines, runs, furniture and blocks, by windows over (document, page).

Words: doc_id, page, ord, text, x0, x1, top, bottom, size, font, color. Extraction from PDF bytes is a source
of its own; everything after it is here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text

PAGE = ("doc_id", "page")
PAGE_NUMBER = r"^\W*(page\s*)?\d{1,4}(\s*(/|of)\s*\d{1,4})?\W*$"


def _runs(changed: Column, *keys: str, order: str = "ord") -> Column:
    """The number of changes up to each row."""
    return F.sum(changed.cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def lines(words: DataFrame) -> DataFrame:
    """words with `line` from 0: a new one where the top moves by more than half a size, two points at least, in flow order."""
    w = Window.partitionBy(*PAGE).orderBy("ord")
    last, size = F.lag("top").over(w), F.lag("size").over(w)
    far = F.abs(F.col("top") - last) > F.greatest(F.lit(2.0), 0.5 * F.greatest(F.coalesce(size, F.lit(1.0)), F.coalesce("size", F.lit(1.0)), F.lit(1.0)))
    return words.withColumn("_new", F.coalesce(far, F.lit(False))).withColumn("line", _runs(F.col("_new"), *PAGE)).drop("_new")


def line_rows(words: DataFrame) -> DataFrame:
    """One row for each line: text from left to right, box, largest size, whether all is bold."""
    own = F.array_sort(F.collect_list(F.struct("x0", "ord", "text")))
    bold = F.bool_and(F.coalesce(F.lower("font").contains("bold"), F.lit(False)))
    return lines(words).groupBy(*PAGE, "line").agg(
        F.array_join(F.transform(own, lambda x: x["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.max("size").alias("size"), bold.alias("bold"),
    )


def runs(words: DataFrame, keys: tuple[str, ...] = ("doc_id", "page", "line")) -> DataFrame:
    """words with `run` from 0: a new one where size (to a tenth), font, colour or background changes."""
    w = Window.partitionBy(*keys).orderBy("ord")
    style = F.struct(F.bround("size", 1).alias("s"), "font", "color", *(["background"] if "background" in words.columns else []))
    changed = F.coalesce(~style.eqNullSafe(F.lag(style).over(w)) & F.lag("ord").over(w).isNotNull(), F.lit(False))
    return words.withColumn("_new", changed).withColumn("run", _runs(F.col("_new"), *keys)).drop("_new")


def backgrounds(words: DataFrame, shapes: DataFrame) -> DataFrame:
    """words with the colour of the smallest shape under their centre; pages with too many shapes have none."""
    few = shapes.withColumn("_n", F.count("*").over(Window.partitionBy(*PAGE))).where(F.col("_n") <= fixed.MOST_SHAPES).drop("_n")
    area = (F.col("s.x1") - F.col("s.x0")) * (F.col("s.bottom") - F.col("s.top"))
    x, y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    under = (F.col("w.doc_id") == F.col("s.doc_id")) & (F.col("w.page") == F.col("s.page")) & x.between(F.col("s.x0"), F.col("s.x1")) & y.between(F.col("s.top"), F.col("s.bottom"))
    hit = words.alias("w").join(few.alias("s"), under).groupBy("w.doc_id", "w.page", "w.ord").agg(F.min_by("s.color", F.struct(area.alias("a"), F.col("s.shape_ord"))).alias("background"))
    return words.join(hit, [*PAGE, "ord"], "left")


def furniture(rows: DataFrame, heights: DataFrame) -> DataFrame:
    """Lines with `furniture`: page_number or repeated in the upper and lower bands, header and footer where a band's line is on one page only."""
    placed = rows.join(heights, [*PAGE])
    band = F.when(F.col("bottom") <= fixed.BAND * F.col("height"), "header").when(F.col("top") >= (1 - fixed.BAND) * F.col("height"), "footer")
    placed = placed.withColumn("band", band).withColumn("key", text.furniture_key("text"))
    pages = repeated(placed.where("band IS NOT NULL"), "doc_id", "page", "key")
    marked = placed.join(pages.withColumn("again", F.lit(True)), ["doc_id", "key"], "left")
    kind = F.when(F.col("band").isNull(), None).when(text.has("text", PAGE_NUMBER), "page_number").when(F.col("again"), "repeated").otherwise(F.col("band"))
    return marked.withColumn("furniture", kind).drop("key", "again", "band", "height")


def repeated(rows: DataFrame, doc: str, page: str, key: str) -> DataFrame:
    """(doc, key) of lines on two pages or more."""
    return rows.groupBy(doc, key).agg(F.countDistinct(page).alias("pages")).where("pages >= 2").select(doc, key)


def body_size(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, body): the size, to halves, that most characters have; the earliest line wins a tie."""
    by = rows.where("size IS NOT NULL").groupBy(key, (F.bround(F.col("size") * 2) / 2).alias("s")).agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "line")).alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return by.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(key, F.col("s").alias("body"))


def typed(rows: DataFrame) -> DataFrame:
    """Lines with type and level: bullets are items; large short lines are headings, their rank the level; short bold lines one level below."""
    sized = rows.join(body_size(rows), "doc_id", "left").withColumn("body", F.coalesce("body", F.lit(10.0)))
    large = (F.col("size") >= fixed.HEADING_FACTOR * F.col("body")) & (F.length("text") <= fixed.HEADING_CHARS)
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.when(large, -F.col("size")).asc_nulls_last()))
    sized = sized.withColumn("_rank", F.when(large, rank)).withColumn("_rank", F.when(F.col("_rank") <= fixed.HEADING_RANKS, F.col("_rank")))
    deepest = F.coalesce(F.max("_rank").over(Window.partitionBy("doc_id")), F.lit(0)) + 1
    bold = F.col("bold") & (text.count("text", r"\S+") <= 12) & ~F.col("text").rlike(r"[.,;]$")
    item = F.col("text").rlike("(?U)" + fixed.BULLET) | F.col("text").rlike("(?U)" + fixed.MARKDOWN_ITEM)
    kind = F.when(item, "list_item").when(F.col("_rank").isNotNull() | bold, "heading").otherwise("paragraph")
    level = F.when(kind == "heading", F.coalesce("_rank", deepest))
    return sized.withColumn("type", kind).withColumn("level", level).drop("_rank", "body")


def blocks(rows: DataFrame) -> DataFrame:
    """Typed body lines to one row for each block: a line goes on with the block above unless page, type, gap, size or indent part them."""
    w = Window.partitionBy("doc_id").orderBy("page", "line")
    lag = lambda c: F.lag(c).over(w)
    height = F.col("bottom") - F.col("top")
    apart = (
        lag("page").isNull() | (lag("page") != F.col("page")) | (F.col("type") == "heading") | (lag("type") == "heading") | (F.col("type") == "list_item")
        | (F.col("top") - lag("bottom") > 0.9 * height) | (F.abs(F.col("size") - lag("size")) > 1.5)
    )
    first = rows.withColumn("_new", F.coalesce(apart, F.lit(True))).withColumn("_b", _runs(F.col("_new"), "doc_id", order="_o") if "_o" in rows.columns else F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("doc_id", "_b").orderBy("page", "line")
    head = F.first("type").over(own)
    outdented = (head == "list_item") & ~F.col("_new") & (F.col("x0") <= F.first("x0").over(own) + 2)
    left = F.max(outdented.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    done = first.withColumn("_left", left).groupBy("doc_id", "_b", "_left").agg(
        F.min("page").alias("page"), F.min(F.struct("page", "line")).alias("_at"), F.min_by("type", "line").alias("type"), F.min_by("level", "line").alias("level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("_at")) - 1
    return done.withColumn("type", F.when(F.col("_left") == 1, "paragraph").otherwise(F.col("type"))).select("doc_id", number.alias("block"), "page", "type", "level", "text")


def off_page(width: Column, height: Column) -> Column:
    """Whether a box lies wholly outside its page."""
    return (F.col("x1") <= 0) | (F.col("bottom") <= 0) | (F.col("x0") >= width) | (F.col("top") >= height)


def dominant_style(words: DataFrame, keys: tuple[str, ...] = ("doc_id", "page", "line")) -> DataFrame:
    """(keys, size, font, color, box) with the value of each that most characters have; the earliest word wins a tie."""
    out = words.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    for c in ("size", "font", "color"):
        by = words.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.sum(F.length("text")).alias("n"), F.min("ord").alias("first"))
        out = out.join(by.groupBy(*keys).agg(F.max_by(c, F.struct("n", -F.col("first"))).alias(c)), [*keys], "left")
    return out
