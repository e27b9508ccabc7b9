"""Scalar functions over text columns. All are JVM expressions; patterns are Unicode-aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

Text = Column | str
#: Elements that are folded at once.
CHUNK = 256


def _col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pattern(p: str, flags: str = "iU") -> Column:
    """A literal pattern; words, boundaries, space and case are those of Unicode."""
    return F.lit(f"(?{flags}){p}")


def has(text: Text, p: str, flags: str = "iU") -> Column:
    return F.rlike(_col(text), pattern(p, flags))


def count(text: Text, p: str, flags: str = "iU") -> Column:
    return F.regexp_count(_col(text), pattern(p, flags))


def est_tokens(text: Text) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(_col(text)) / 4)).cast("int")


def collapse(text: Text) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def strip_invisible(text: Text) -> Column:
    return F.regexp_replace(_col(text), fixed.INVISIBLE, "")


def invisible_counts(text: Text) -> Column:
    """map<string,int> of the classes that occur."""
    kinds = {"zero_width": fixed.ZERO_WIDTH, "bidi": fixed.BIDI, "private_use": fixed.PRIVATE_USE, "tag": fixed.TAGS}
    every = F.create_map(*(x for k, p in kinds.items() for x in (F.lit(k), F.regexp_count(_col(text), F.lit(p)))))
    return F.map_filter(every, lambda _, n: n > 0)


def decode_tags(text: Text) -> Column:
    """The printable ASCII that tag characters spell."""
    seen = "".join(chr(c) for c in range(0x20, 0x7F))
    tags = "".join(chr(0xE0000 + c) for c in range(0x20, 0x7F))
    return F.translate(F.regexp_replace(_col(text), r"[^\x{E0020}-\x{E007E}]", ""), tags, seen)


#: Letters that Java's scripts count otherwise than Unicode names do.
LATIN = r"[\p{IsLatin}&&[^ªºK℀-⅏Ａ-Ｚａ-ｚ]]"
OTHER_SCRIPT = r"[\p{IsCyrillic}\p{IsGreek}&&[^Ω]]"


def mixed_script_words(text: Text, limit: int = 5) -> Column:
    """The first words that mix Latin with Cyrillic or Greek letters, repeats kept."""
    words = F.regexp_extract_all(_col(text), F.lit(r"([\p{IsAlphabetic}\p{IsDigit}_&&[^\p{M}]]+)"))
    mixed = F.filter(words, lambda w: w.rlike(LATIN) & w.rlike(OTHER_SCRIPT))
    return F.slice(mixed, 1, limit)


def sentences(text: Text, p: str = fixed.SENTENCE) -> Column:
    """array<struct<start,text>>: trimmed sentences with the start of their untrimmed part, blank ones dropped."""
    text = _col(text)
    parts, gaps = F.split(text, "(?U)" + p, -1), F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(0))
    both = F.zip_with(parts, gaps, lambda a, b: F.struct(F.length(a).alias("n"), F.coalesce(F.length(b), F.lit(0)).alias("g"), a.alias("t")))
    # in chunks, since a fold copies what it has found so far
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / CHUNK).cast("int")), lambda c: F.slice(both, c * CHUNK + 1, CHUNK))
    none = F.expr("cast(array() as array<struct<start:int,text:string>>)")
    own = lambda x, at: F.struct(at.alias("start"), F.regexp_replace(x["t"], r"(?U)^\s+|\s+$", "").alias("text"))
    step = lambda a, x: F.struct((a["at"] + x["n"] + x["g"]).alias("at"), F.concat(a["out"], F.array(own(x, a["at"]))).alias("out"))
    found = F.aggregate(
        chunks, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,text:string>>>)").alias("out")),
        lambda t, c: F.aggregate(c, F.struct(t["at"].alias("at"), none.alias("out")), step, lambda a: F.struct(a["at"].alias("at"), F.concat(t["out"], F.array(a["out"])).alias("out"))),
        lambda t: F.flatten(t["out"]),
    )
    return F.filter(found, lambda s: s["text"] != "")


def excerpt(text: Text, limit: int = fixed.EXCERPT) -> Column:
    text = _col(text)
    cut = F.concat(F.regexp_replace(F.substring(text, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def render(kind: Text, level: Text, text: Text) -> Column:
    """How a block reads inside a segment."""
    text = _col(text)
    item = F.when(text.rlike("(?U)" + fixed.MARKDOWN_ITEM), text).otherwise(F.concat(F.lit("- "), F.regexp_replace(text, "(?U)" + fixed.BULLET, "")))
    head = F.concat(F.expr("repeat('#', 1)") if isinstance(level, int) else F.repeat(F.lit("#"), F.least(F.lit(6), F.coalesce(_col(level), F.lit(1)))), F.lit(" "), text)
    return F.when(_col(kind) == "heading", head).when(_col(kind) == "list_item", item).otherwise(text)


def luminance(color: Text) -> Column:
    """0 to 1 of #rrggbb; null otherwise."""
    color = _col(color)
    part = lambda at: F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255
    return F.when(F.length(color) == 7, 0.2126 * part(2) + 0.7152 * part(4) + 0.0722 * part(6))


def color_to_hex(values: Text) -> Column:
    """#rrggbb of grey, RGB or CMYK values, which are shares of one or, if any exceeds one, of 255; halves round to even."""
    values = _col(values)
    n, scaled = F.size(values), F.when(F.exists(values, lambda v: v > 1), F.transform(values, lambda v: v / 255)).otherwise(values)
    at = lambda i: F.get(scaled, F.lit(i))
    ink = lambda i: (1 - at(i)) * (1 - at(3))
    rgb = F.when(n == 1, F.array(at(0), at(0), at(0))).when(n == 3, scaled).when(n == 4, F.array(ink(0), ink(1), ink(2)))
    two = lambda v: F.lpad(F.lower(F.hex(F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) * 255).cast("int"))), 2, "0")
    return F.when(n.isin(1, 3, 4), F.concat(F.lit("#"), F.array_join(F.transform(rgb, two), "")))


def furniture_key(text: Text) -> Column:
    """A line with its numbers blurred, to find repeats over pages."""
    return F.trim(F.lower(F.regexp_replace(_col(text), r"(?U)\d+", "#")))


def alnum(text: Text) -> Column:
    return F.regexp_replace(F.lower(_col(text)), r"(?U)[\W_]+", "")


def overlaps(payload: Text, found: Text) -> Column:
    """Either text contains the other, or the found one the first 30 characters of the payload, letters and digits alone."""
    a, b = alnum(payload), alnum(found)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | F.contains(b, F.substring(a, 1, 30)))


EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PHONE = r"(?<![\w./-])\+?(?:\(\d{2,4}\)[\s-]?)?\d{2,4}(?:[\s-]\d{2,4}){2,4}(?![\w/-])"


def redact(text: Text) -> Column:
    """struct<text, n>: e-mail addresses and phone numbers replaced, and how many."""
    text = _col(text)
    no_mail = F.regexp_replace(text, "(?U)" + EMAIL, "[email]")
    n = F.regexp_count(text, F.lit("(?U)" + EMAIL)) + F.regexp_count(no_mail, F.lit("(?U)" + PHONE))
    return F.struct(F.regexp_replace(no_mail, "(?U)" + PHONE, "[phone]").alias("text"), n.alias("n"))


def truncate(text: Text, limit: int = fixed.TRUNCATE_CHARS) -> Column:
    """At most limit characters, cut at the last blank line unless that is before the middle."""
    text = _col(text)
    head = F.substring(text, 1, limit)
    back = F.locate("\n\n", F.reverse(head))
    keep = F.when(back > 0, limit - back - 1).otherwise(-1)
    return F.when(F.length(text) <= limit, text).when(keep > limit / 2, F.substring(head, F.lit(1), keep.cast("int"))).otherwise(head)


def feature_slot(key: Text) -> Column:
    return (F.crc32(F.encode(_col(key), "UTF-8")) % fixed.SLOTS).cast("int")


def bucket(value: Text, edges: tuple[float, ...]) -> Column:
    """The number of the first edge above the value."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(_col(value) < edges[i], F.lit(i)).otherwise(out)
    return out.cast("string")


def where_label(page: Text, segment: Text) -> Column:
    """(p3, s2), or (document properties) where there is neither."""
    page, segment = _col(page), _col(segment)
    spot = F.concat_ws(", ", F.when(page > 0, F.concat(F.lit("p"), page)), F.when(segment != "", segment))
    return F.when(spot == "", F.lit("(document properties)")).otherwise(F.concat(F.lit("("), spot, F.lit(")")))


def table_cell(text: Text) -> Column:
    return F.replace(collapse(text), F.lit("|"), F.lit("\\|"))


def xml_attribute(text: Text) -> Column:
    out = _col(text)
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def signal_name(signal: Text) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(signal), r"[\d×/=().]+", ""), "^:+|:+$", "")


def usage_cost(tokens_in: Text, tokens_out: Text, price_in: Text, price_out: Text) -> Column:
    return F.bround((_col(tokens_in) * _col(price_in) + _col(tokens_out) * _col(price_out)) / 1e6, 6)
