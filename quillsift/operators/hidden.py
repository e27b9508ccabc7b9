"""Detectors of text that is in a file but not on the page, and the rewrite that sets it apart.

Rows are documents (format, meta, blocks) and stay so: detectors are expressions over the array of blocks, the
rewrite gives a new array and an array of findings. Hidden blocks are flagged, partly hidden blocks are cut at
the borders of their hidden runs, and text spelled in tag characters becomes a hidden block of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text

FINDING = "struct<detector:string,kind:string,severity:string,status:string,block:int,page:int,excerpt:string,note:string>"


def invisible_color(color, background):
    """Whether ink and ground are too close; unknown colours and pictures are never judged, a bare page is white."""
    ground = F.when(F.col(background).isNull(), F.lit(1.0)).when(F.col(background) != "image", text.luminance(background))
    return F.coalesce(F.abs(text.luminance(color) - ground) < fixed.CONTRAST, F.lit(False))


def tiny(size, body):
    """Whether a size cannot be read, or hardly and is far below the body's."""
    small = (F.col(size) < fixed.TINY_RELATIVE_PT) & (F.col(size) < fixed.TINY_RATIO * F.col(body))
    return F.coalesce((F.col(size) <= fixed.TINY_PT) | F.coalesce(small, F.lit(False)), F.lit(False))


def body_font_size(rows: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """(key, body): the size, to halves, of most characters; null where too few have a size; the first seen wins a tie."""
    n = F.length("text")
    by = rows.groupBy(key, (F.bround(F.col("size") * 2) / 2).alias("s")).agg(F.sum(n).alias("n"), F.min(order).alias("first"))
    total = F.sum("n").over(Window.partitionBy(key))
    sized = F.sum(F.when(F.col("s") > 0, F.col("n")).otherwise(0)).over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.when(F.col("s") > 0, F.col("n")).otherwise(-1)), "first"))
    best = by.select(key, "s", total.alias("t"), sized.alias("z"), rank.alias("r")).where("r = 1")
    return best.select(key, F.when((F.col("s") > 0) & (F.col("z") >= fixed.SIZED_SHARE * F.greatest(F.lit(1), F.col("t"))), F.col("s")).alias("body"))


def _luminance(c: str) -> str:
    part = lambda i: f"cast(conv(substr({c}, {i}, 2), 16, 10) as double) / 255"
    return f"(CASE WHEN length({c}) = 7 THEN 0.2126D * {part(2)} + 0.7152D * {part(4)} + 0.0722D * {part(6)} END)"


def _indexes(condition: str) -> str:
    return f"filter(transform(b.runs, (r, i) -> CASE WHEN {condition} THEN i END), i -> i IS NOT NULL)"


def _hits() -> tuple[str, str]:
    """SQL for the hits on a whole block and on runs of it."""
    ink = f"format IN ('pdf', 'docx') AND abs({_luminance('r.color')} - CASE WHEN r.background IS NULL THEN 1D WHEN r.background <> 'image' THEN {_luminance('r.background')} END) < {fixed.CONTRAST}D"
    small = f"(r.size <= {fixed.TINY_PT} OR (r.size < {fixed.TINY_RELATIVE_PT} AND r.size < {fixed.TINY_RATIO} * s.z))"
    reasons = "filter(b.flags, f -> startswith(f, 'hidden:'))"
    whole = f"""array_compact(array(
        CASE WHEN array_contains(b.flags, 'off_page') THEN named_struct('d', 'H3', 'k', 'off_page', 'n', 'drawn outside the page') END,
        CASE WHEN size({reasons}) > 0 THEN named_struct('d', 'H4', 'k', CASE WHEN forall({reasons}, f -> f = 'hidden:comment') THEN 'html_comment' ELSE concat(format, '_hidden') END,
            'n', array_join({reasons}, ', ')) END))"""

    def part(d: str, k: str, note: str, condition: str) -> str:
        return f"CASE WHEN size({_indexes(condition)}) > 0 THEN named_struct('d', '{d}', 'k', {k}, 'n', '{note}', 'r', {_indexes(condition)}) END"

    partial = f"""filter(array_compact(array({part("H1", "'invisible_color'", "ink like its ground", ink)}, {part("H2", "'tiny_font'", "too small to read", small)},
        {part("H3", "'off_page'", "drawn outside the page", "array_contains(r.flags, 'off_page')")},
        {part("H4", "concat(format, '_hidden')", "hidden by format", "exists(r.flags, f -> startswith(f, 'hidden:'))")})),
        h -> NOT (h.d = 'H3' AND array_contains(b.flags, 'off_page')) AND NOT (h.d = 'H4' AND size({reasons}) > 0))"""
    return whole, partial


def _block(body: str, flags: str, runs: str = "x.b.runs", level: str = "x.b.level") -> str:
    return f"named_struct('block', 0, 'page', x.b.page, 'type', x.b.type, 'level', {level}, 'text', {body}, 'flags', {flags}, 'runs', {runs})"


def _clip(body: str) -> str:
    flat = f"trim(regexp_replace({body}, r'(?U)\\s+', ' '))"
    return f"CASE WHEN length({flat}) <= {fixed.EXCERPT} THEN {flat} ELSE concat(rtrim(substr({flat}, 1, {fixed.EXCERPT - 1})), '…') END"


def _found(hits: str, at: str, body: str, status: str) -> str:
    return f"""transform({hits}, h -> named_struct('detector', h.d, 'kind', h.k, 'severity', 'warning', 'status', '{status}', 'block', {at}, 'page', x.b.page, 'excerpt', {_clip(body)}, 'note', h.n))"""


def _bind(name: str, value: str, body: str) -> str:
    """SQL for body with a name for a value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _body_size() -> str:
    """SQL for the size, to halves, of most characters of a document's runs; null where too few have one."""
    sizes = "flatten(transform(blocks, b -> transform(b.runs, r -> named_struct('s', bround(r.size * 2) / 2, 'n', length(r.text)))))"
    weights = f"aggregate({sizes}, cast(map() as map<double,int>), (m, r) -> CASE WHEN r.s > 0 THEN map_concat(map_filter(m, (k, v) -> k <> r.s), map(r.s, coalesce(m[r.s], 0) + r.n)) ELSE m END)"
    chars = "aggregate(blocks, 0, (n, b) -> n + length(b.text))"
    best = "try_element_at(array_sort(map_entries(m), (a, b) -> b.value - a.value), 1).key"
    return _bind("m", weights, f"CASE WHEN aggregate(map_values(m), 0, (n, v) -> n + v) >= {fixed.SIZED_SHARE} * greatest(1, {chars}) THEN {best} END")


def _encoded() -> str:
    """SQL for what a block's characters hide: a payload in tags, counts of invisible ones, words of mixed scripts."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    seen, tags = "".join(map(chr, range(0x20, 0x7F))), "".join(chr(0xE0000 + c) for c in range(0x20, 0x7F))
    spelled = f"translate(regexp_replace(b.text, r'[^\\x{{E0020}}-\\x{{E007E}}]', ''), {quote(tags)}, {quote(seen)})"
    kinds = {"zero_width": fixed.ZERO_WIDTH, "bidi": fixed.BIDI, "private_use": fixed.PRIVATE_USE}
    listed = "array_join(array_compact(array(" + ", ".join(f"CASE WHEN regexp_count(b.text, r'{p}') > 0 THEN concat('{k}=', regexp_count(b.text, r'{p}')) END" for k, p in kinds.items()) + ")), ', ')"
    first = f"regexp_instr(b.text, r'{fixed.INVISIBLE}')"
    window = f"substr(b.text, greatest(1, {first} - 60), 240 + least(0, {first} - 60))"
    words = rf"slice(filter(regexp_extract_all(b.text, r'([\p{{IsAlphabetic}}\p{{IsDigit}}_&&[^\p{{M}}]]+)', 0), w -> w rlike r'{text.LATIN}' AND w rlike r'{text.OTHER_SCRIPT}'), 1, 5)"
    hit = lambda kind, note, found: f"named_struct('d', 'H6', 'k', '{kind}', 'n', {note}, 'x', {found})"
    odd = f"b.text rlike r'{fixed.INVISIBLE}'"
    return f"""named_struct('payload', CASE WHEN {odd} THEN nullif(trim({spelled}), '') END,
        'counts', CASE WHEN {odd} THEN CASE WHEN {listed} <> '' THEN {hit("invisible_characters", listed, window)} END END,
        'mixed', CASE WHEN b.text rlike r'{text.OTHER_SCRIPT}' THEN CASE WHEN size({words}) > 0 THEN {hit("mixed_script", f"array_join({words}, ', ')", "b.text")} END END)"""


def screen(docs: DataFrame) -> DataFrame:
    """docs with rewritten `blocks` and an array `block_findings`, findings about metadata first."""
    whole, partial = _hits()
    hits = f"transform(s.bs, b -> named_struct('b', b, 'w', {whole}, 'p', {partial}, 'e', {_encoded()}))"
    rows = docs.withColumn("_h", F.expr(_bind("s", f"named_struct('bs', blocks, 'z', {_body_size()})", hits)))
    covered = "size(array_distinct(flatten(transform(x.p, h -> h.r)))) >= size(x.b.runs)"
    is_whole = f"(size(x.w) > 0 OR (size(x.p) > 0 AND size(x.b.runs) > 0 AND {covered}))"
    both = "concat(x.w, transform(x.p, h -> named_struct('d', h.d, 'k', h.k, 'n', h.n)))"
    flagged = f"CASE WHEN exists(x.b.flags, f -> startswith(f, 'hidden:')) THEN x.b.flags ELSE concat(x.b.flags, array(concat('hidden:', {both}[0].k))) END"
    none = f"cast(array() as array<{FINDING}>)"
    groups = """aggregate(sequence(0, size(x.b.runs) - 1), cast(array() as array<struct<h:boolean,r:array<int>>>), (a, i) ->
        CASE WHEN size(a) > 0 AND try_element_at(a, -1).h = exists(x.p, h -> array_contains(h.r, i))
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('h', element_at(a, -1).h, 'r', concat(element_at(a, -1).r, array(i)))))
        ELSE concat(a, array(named_struct('h', exists(x.p, h -> array_contains(h.r, i)), 'r', array(i)))) END)"""
    plain = "filter(x.b.flags, f -> NOT startswith(f, 'hidden:'))"
    kinds = "transform(array_sort(array_distinct(transform(x.p, h -> h.k))), k -> concat('hidden:', k))"
    piece = "trim(array_join(transform(g.r, i -> x.b.runs[i].text), ' '))"
    split = f"transform({groups}, (g, j) -> named_struct('b', {_block(piece, f'CASE WHEN g.h THEN concat({plain}, {kinds}) ELSE {plain} END', 'transform(g.r, i -> x.b.runs[i])')}, 'f', CASE WHEN g.h THEN {_found('filter(x.p, h -> arrays_overlap(h.r, g.r))', '0', piece, 'quarantined')} ELSE {none} END))"
    disclosed = f"""transform(array_compact(array(x.e.counts, x.e.mixed)), h -> named_struct('detector', h.d, 'kind', h.k, 'severity', 'warning', 'status', 'open', 'block', 0, 'page', x.b.page, 'excerpt', {_clip("h.x")}, 'note', h.n))"""
    extra = f"""CASE WHEN x.e.payload IS NOT NULL THEN array(named_struct('b', {_block("x.e.payload", "array('hidden:tag_characters')", "slice(x.b.runs, 1, 0)", "cast(null as int)")},
        'f', array(named_struct('detector', 'H6', 'kind', 'tag_characters', 'severity', 'warning', 'status', 'quarantined', 'block', 0, 'page', x.b.page, 'excerpt', {_clip("x.e.payload")}, 'note', 'text spelled in tag characters')))) ELSE array() END"""
    out = f"""flatten(transform(_h, x -> concat(CASE WHEN {is_whole} THEN array(named_struct('b', {_block("x.b.text", flagged)}, 'f', {_found(both, "0", "x.b.text", "quarantined")}))
        WHEN size(x.p) > 0 AND size(x.b.runs) > 0 THEN {split}
        ELSE array(named_struct('b', {_block("x.b.text", "x.b.flags")}, 'f', {disclosed})) END, {extra})))"""
    rows = rows.withColumn("_out", F.expr(out))
    number = "transform(_out, (o, i) -> named_struct('block', i, 'page', o.b.page, 'type', o.b.type, 'level', o.b.level, 'text', o.b.text, 'flags', o.b.flags, 'runs', o.b.runs))"
    placed = "flatten(transform(_out, (o, i) -> transform(o.f, f -> named_struct('detector', f.detector, 'kind', f.kind, 'severity', f.severity, 'status', f.status, 'block', i, 'page', f.page, 'excerpt', f.excerpt, 'note', f.note))))"
    rows = rows.withColumn("block_findings", F.concat(metadata_findings("meta"), F.expr(placed))).withColumn("blocks", F.expr(number))
    return rows.drop("_h", "_out")


#: Every directive pattern holds one of these; most texts hold none and are judged by this alone.
_HINTS = (
    r"\b(ignore|disregard|forget|you are|as an?|reviewer|reader|system|agent|grader|reading this|rate|grade|score|evaluate|review|assess|give|recommend|mark|flag|"
    r"do not|respond|reply|answer|output|begin|important|attention|note|notice|instruction|prompt|directive)"
)


def directive(body) -> F.Column:
    """The number of the first directive pattern that a text matches, from 0; null if none does."""
    return F.when(text.has(body, _HINTS), F.coalesce(*(F.when(text.has(body, p), F.lit(i)) for i, p in enumerate(fixed.DIRECTIVES))))


def metadata_findings(meta: str = "meta") -> F.Column:
    """Findings about document properties that address a model or are long."""
    def one(e):
        hit = directive(e["value"]).isNotNull()
        flat = text.collapse(e["value"])
        return F.struct(
            F.lit("H5").alias("detector"), F.lit("metadata_payload").alias("kind"), F.when(hit, "critical").otherwise("warning").alias("severity"), F.lit("quarantined").alias("status"),
            F.lit(None).cast("int").alias("block"), F.lit(None).cast("int").alias("page"), text.excerpt(flat).alias("excerpt"), F.concat(F.lit("property "), e["key"]).alias("note"),
        )

    entries = F.filter(F.map_entries(F.col(meta)), lambda e: (e["key"] != "empty_pages") & (directive(e["value"]).isNotNull() | (F.length(e["value"]) > fixed.METADATA_CHARS)))
    return F.coalesce(F.transform(entries, one), F.expr(f"cast(array() as array<{FINDING}>)"))
