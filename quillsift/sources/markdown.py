"""Markdown and plain text to typed blocks, in Catalyst expressions over the row of a document.

Every line is described by itself: what it could be, how far it is indented, and whether the line below underlines it.
One fold over these descriptions, in chunks so that it stays linear, notes at which lines something begins or a gap
does; a block is the lines from one such note to the next. Null texts have no blocks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Line patterns of the format.
ATX = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
SETEXT = r"^(=+|-+)\s*$"
LIST = r"^(\s*)([-*+•]|\d+[.)]|[a-zA-Z][.)]|\(\d+\))\s+(.*)$"
TABLE = r"^\s*\|.*\|\s*$"
#: Lines that are folded at once.
CHUNK = 256

RUN = "struct<text:string,size:double,font:string,color:string,background:string,flags:array<string>>"
BLOCKS = f"array<struct<block:int,page:int,type:string,level:int,text:string,flags:array<string>,runs:array<{RUN}>>>"
_RUN = pa.struct([("text", pa.string()), ("size", pa.float64()), ("font", pa.string()), ("color", pa.string()), ("background", pa.string()), ("flags", pa.list_(pa.string()))])
ARROW = pa.list_(pa.struct([("block", pa.int32()), ("page", pa.int32()), ("type", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("flags", pa.list_(pa.string())), ("runs", pa.list_(_RUN))]))


def block(kind: str, body: str, level: int | None = None, flags=(), runs=(), page: int | None = None) -> dict:
    return {"block": 0, "page": page, "type": kind, "level": level, "text": body, "flags": list(flags), "runs": list(runs)}


def numbered(blocks) -> list[dict]:
    """Blocks with text, numbered in order."""
    kept = [b | {"text": b["text"].strip("\n")} for b in blocks if b["text"].strip()]
    return [b | {"block": i} for i, b in enumerate(kept)]


def _re(pattern: str) -> str:
    """A literal in SQL; space, digits and line ends as the format has them."""
    wide = pattern.replace(r"\s", r"[\s\x1c-\x1f]")
    return "r'(?dU)" + wide + "'"


def _bare(line: str) -> str:
    return f"regexp_replace({line}, {_re(r'^\s+|\s+$')}, '')"


#: SQL for the lines of `_text`, for their descriptions, for what begins where, and for the blocks; each reads the one before.
_LINES = r"split(regexp_replace(_text, '\r\n?', '\n'), '\n')"
_SEEN = f"""transform(_lines, (l, i) -> named_struct('at', i, 'row', l rlike {_re(TABLE)}, 'item', l rlike {_re(LIST)}, 'indent', length(regexp_extract(l, {_re(r'^(\s*)')}, 1)),
    'bare', {_bare("l")}, 'under', CASE WHEN {_bare("get(_lines, i + 1)")} rlike {_re(SETEXT)} THEN CASE WHEN startswith({_bare("get(_lines, i + 1)")}, '=') THEN 1 ELSE 2 END ELSE 0 END))"""


def _notes() -> str:
    """SQL for the notes: (first line, type or null for a gap, level), folded over the lines with what is open: prose, code
    with its fence, a table, an item with its indent, or the underline of a heading."""
    note = "struct<at:int,type:string,level:int>"

    def go(open_: str, kind: str | None = None, level: str = "cast(null as int)", fence: str = "s.fence", indent: str = "s.indent", note_: bool = True) -> str:
        made = f"named_struct('at', x.at, 'type', {repr(kind) if kind else 'cast(null as string)'}, 'level', {level})"
        out = f"concat(s.out, array({made}))" if note_ else "s.out"
        return f"named_struct('open', {open_}, 'fence', {fence}, 'indent', {indent}, 'out', {out})"

    same = go("s.open", note_=False)
    fence = "CASE WHEN left(x.bare, 3) IN ('```', '~~~') THEN left(x.bare, 3) ELSE '' END"
    depth = f"length(regexp_extract(x.bare, {_re(ATX)}, 1))"
    step = f"""CASE WHEN s.open = 'underline' THEN {go("'nothing'")}
        WHEN s.open = 'code' THEN CASE WHEN startswith(x.bare, s.fence) THEN {go("'nothing'", note_=False)} ELSE {same} END
        WHEN s.open = 'item' AND x.bare <> '' AND NOT x.item AND x.indent > s.indent THEN {same}
        WHEN s.open = 'table' AND x.row THEN {same}
        WHEN x.bare = '' THEN {go("'nothing'")}
        WHEN {fence} <> '' THEN {go("'code'", "code", fence=fence)}
        WHEN {depth} > 0 THEN {go("'nothing'", "heading", depth)}
        WHEN s.open <> 'prose' AND x.under > 0 THEN {go("'underline'", "heading", "x.under")}
        WHEN x.row THEN {go("'table'", "table")}
        WHEN x.item THEN {go("'item'", "list_item", indent="x.indent")}
        WHEN s.open = 'prose' THEN {same} ELSE {go("'prose'", "paragraph")} END"""
    start = f"named_struct('open', a.open, 'fence', a.fence, 'indent', a.indent, 'out', cast(array() as array<{note}>))"
    chunks = f"transform(sequence(0, cast((size(_seen) - 1) / {CHUNK} as int)), c -> slice(_seen, c * {CHUNK} + 1, {CHUNK}))"
    return f"""aggregate({chunks}, named_struct('open', 'nothing', 'fence', '', 'indent', 0, 'out', cast(array() as array<array<{note}>>)),
        (a, c) -> aggregate(c, {start}, (s, x) -> {step}, s -> named_struct('open', s.open, 'fence', s.fence, 'indent', s.indent, 'out', concat(a.out, array(s.out)))), a -> flatten(a.out))"""


def _blocks() -> str:
    own = "slice(_lines, n.at + 1, coalesce(get(_notes, i + 1).at, size(_lines)) - n.at)"
    body = f"""CASE WHEN n.type IN ('code', 'table') THEN regexp_replace(array_join({own}, '\n'), '^\n+|\n+$', '')
        WHEN n.type = 'heading' AND _seen[n.at].bare rlike {_re(ATX)} THEN regexp_extract(_seen[n.at].bare, {_re(ATX)}, 2)
        ELSE array_join(transform({own}, l -> {_bare("l")}), ' ') END"""
    made = f"transform(_notes, (n, i) -> CASE WHEN n.type IS NOT NULL THEN named_struct('type', n.type, 'level', n.level, 'text', {body}) END)"
    kept = f"filter({made}, b -> b IS NOT NULL AND {_bare('b.text')} <> '')"
    return f"""transform({kept}, (b, i) -> named_struct('block', i, 'page', cast(null as int), 'type', b.type, 'level', b.level, 'text', b.text,
        'flags', cast(array() as array<string>), 'runs', cast(array() as array<{RUN}>)))"""


def with_blocks(df: DataFrame, column: str, out: str = "blocks") -> DataFrame:
    """df without the column but with the blocks of its Markdown."""
    rows = df.withColumn("_text", F.coalesce(F.col(column), F.lit(""))).withColumn("_lines", F.expr(_LINES)).withColumn("_seen", F.expr(_SEEN)).withColumn("_notes", F.expr(_notes()))
    return rows.withColumn(out, F.expr(_blocks())).drop("_text", "_lines", "_seen", "_notes", *([column] if column != out else []))


def title(blocks: str = "blocks") -> Column:
    """The text of the first heading of level 1."""
    return F.expr(f"try_element_at(filter({blocks}, b -> b.type = 'heading' AND b.level = 1), 1).text")


def title_of(blocks: list[dict]) -> str | None:
    return next((b["text"] for b in blocks if b["type"] == "heading" and b["level"] == 1), None)


def parsed(df: DataFrame, column: str, parse, fmt: str) -> DataFrame:
    """df without the column but with format, title, meta and blocks; parse gives (title, meta, blocks)."""
    at, names = df.columns.index(column), [c for c in df.columns if c != column]
    schema = T.StructType([df.schema[c] for c in names]).add("format", "string").add("title", "string").add("meta", T.MapType(T.StringType(), T.StringType())).add("blocks", T._parse_datatype_string(BLOCKS))

    def run(batches):
        for batch in batches:
            found = [parse(x) for x in batch.column(at).to_pylist()]
            arrays = [c for i, c in enumerate(batch.columns) if i != at]
            arrays += [pa.array([fmt] * len(found), pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array([list(f[1].items()) for f in found], pa.map_(pa.string(), pa.string())), pa.array([f[2] for f in found], ARROW)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return df.mapInArrow(run, schema)


def read(df: DataFrame, column: str = "text", fmt: str = "md") -> DataFrame:
    """df without the column but with format, title, meta and blocks."""
    rows = with_blocks(df, column)
    others = [c for c in df.columns if c != column]
    return rows.select(*others, F.lit(fmt).alias("format"), title().alias("title"), F.expr("cast(map() as map<string,string>)").alias("meta"), "blocks")
