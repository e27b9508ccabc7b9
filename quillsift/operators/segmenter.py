"""Blocks to segments: one row for each document in, nested arrays throughout, no shuffle.

Every document keeps its blocks in one array. Blocks become items (long paragraphs several), one fold opens
and closes segments, a second joins small tails to their predecessor, and segments are numbered in the order
of their first block. All of it is Catalyst expressions over the row, folded in chunks so that the work is in proportion to a document. Arrays that cost much are exploded by
the outer generator: for the inner one the optimizer would add a filter that computes them a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

BLOCK = "struct<block:int,page:int,type:string,level:int,text:string,flags:array<string>>"
ITEM = "struct<block:int,page:int,kind:string,type:string,level:int,raw:string,body:string,n:int,flags:array<string>>"
SEGMENT = "struct<path:array<string>,text:string,tokens:int,flags:array<string>,page_start:int,page_end:int,block_start:int,block_end:int>"


def est(sql: str) -> str:
    return f"cast(greatest(1, ceil(length({sql}) / 4)) as int)"


def pieces(sql: str) -> str:
    """SQL for the parts of a long paragraph: sentences packed greedily up to the most tokens of a segment."""
    parts = f"""split({sql}, r'(?U){fixed.SENTENCE_CAPITAL.replace("'", "\\x27")}')"""
    step = f"""CASE WHEN a.now IS NULL THEN named_struct('out', a.out, 'now', s)
            WHEN {est("a.now")} + {est("s")} > {fixed.MAX_TOKENS} THEN named_struct('out', concat(a.out, array(a.now)), 'now', s)
            ELSE named_struct('out', a.out, 'now', concat(a.now, ' ', s)) END"""
    none = "cast(array() as array<string>)"
    return f"""transform(array({parts}), p -> aggregate({_chunks("p", "size(p)")}, named_struct('out', cast(array() as array<array<string>>), 'now', cast(null as string)),
        (t, c) -> aggregate(c, named_struct('out', {none}, 'now', t.now), (a, s) -> {step}, a -> named_struct('out', concat(t.out, array(a.out)), 'now', a.now)),
        t -> CASE WHEN t.now IS NULL THEN flatten(t.out) ELSE concat(flatten(t.out), array(t.now)) END))[0]"""


def _render(kind: str, level: str, body: str) -> str:
    return f"""CASE {kind} WHEN 'heading' THEN concat(repeat('#', least(6, coalesce({level}, 1))), ' ', {body})
        WHEN 'list_item' THEN CASE WHEN {body} rlike r'(?U){fixed.MARKDOWN_ITEM}' THEN {body} ELSE concat('- ', regexp_replace({body}, r'(?U){fixed.BULLET}', '')) END
        ELSE {body} END"""


def items(blocks: str = "blocks") -> str:
    """SQL for the array of items of an array of blocks."""
    furniture = ", ".join(f"'{f}'" for f in fixed.FURNITURE)
    kind = f"""CASE WHEN exists(b.flags, f -> startswith(f, 'hidden:')) THEN 'hidden'
        WHEN arrays_overlap(b.flags, array({furniture})) THEN 'furniture' WHEN b.type = 'heading' THEN 'heading' ELSE 'content' END"""
    huge = f"({kind}) = 'content' AND b.type NOT IN ('code', 'table') AND {est('b.text')} > {fixed.MAX_TOKENS * fixed.HUGE_FACTOR}"
    body = _render("b.type", "b.level", "t")
    return f"""flatten(transform({blocks}, b -> transform(CASE WHEN {huge} THEN {pieces("b.text")} ELSE array(b.text) END,
        t -> named_struct('block', b.block, 'page', b.page, 'kind', {kind}, 'type', b.type, 'level', b.level, 'raw', t, 'body', {body}, 'n', {est(f"({body})")}, 'flags', b.flags))))"""


#: Elements that are folded at once: what a fold has found is appended to all that was found before only once for each.
CHUNK = 256


def _chunks(array: str, size: str) -> str:
    return f"transform(sequence(0, cast(({size} - 1) / {CHUNK} as int)), c -> slice({array}, c * {CHUNK} + 1, {CHUNK}))"


def _fold() -> str:
    """SQL that folds `items` into groups (path, furniture, first and last item) in the order in which they close.

    The fold goes over numbers and keeps only where the open group and the open run of furniture began."""
    group = "struct<path:array<string>,furniture:boolean,first:int,last:int>"
    names = "transform(s.stack, h -> h.text)"
    made = lambda path, furniture, first: f"named_struct('path', {path}, 'furniture', {furniture}, 'first', {first}, 'last', i - 1)"
    shut = f"CASE WHEN s.furn >= 0 THEN array({made(names, 'true', 's.furn')}) ELSE cast(array() as array<{group}>) END"
    close = f"CASE WHEN s.cur >= 0 THEN array({made('s.path', 'false', 's.cur')}) ELSE cast(array() as array<{group}>) END"
    x = "items[i]"
    up = f"concat(filter(s.stack, h -> h.level < coalesce({x}.level, 1)), array(named_struct('level', coalesce({x}.level, 1), 'text', {x}.raw)))"
    full = f"s.have > 0 AND s.have + {x}.n > {fixed.MAX_TOKENS} AND s.have >= {fixed.MIN_TOKENS}"

    def state(stack="s.stack", cur="s.cur", have="s.have", solid="s.solid", path="s.path", furn="-1", out="s.out"):
        return f"named_struct('stack', {stack}, 'cur', {cur}, 'have', {have}, 'solid', {solid}, 'path', {path}, 'furn', {furn}, 'out', {out})"

    alone = f"array(named_struct('path', {names}, 'furniture', false, 'first', i, 'last', i))"
    hidden = state(cur="-1", have="0", solid="false", out=f"concat(s.out, {shut}, {close}, {alone})")
    head_new = state(stack=up, cur="i", have=f"{x}.n", solid="false", path=f"transform({up}, h -> h.text)", out=f"concat(s.out, {shut}, {close})")
    head_more = state(stack=up, have=f"s.have + {x}.n", out=f"concat(s.out, {shut})")
    body_new = state(cur="i", have=f"{x}.n", solid="true", path=names, out=f"concat(s.out, {shut}, {close})")
    body_more = state(have=f"s.have + {x}.n", solid="true", out=f"concat(s.out, {shut})")
    step = f"""CASE WHEN {x}.kind = 'furniture' THEN {state(furn="CASE WHEN s.furn >= 0 THEN s.furn ELSE i END")}
        WHEN {x}.kind = 'hidden' THEN {hidden}
        WHEN {x}.kind = 'heading' AND (s.solid OR s.cur < 0) THEN {head_new}
        WHEN {x}.kind = 'heading' THEN {head_more}
        WHEN s.cur < 0 OR ({full}) THEN {body_new} ELSE {body_more} END"""
    none = f"cast(array() as array<{group}>)"
    zero = f"""named_struct('stack', cast(array() as array<struct<level:int,text:string>>), 'cur', -1, 'have', 0, 'solid', false,
        'path', cast(array() as array<string>), 'furn', -1, 'out', cast(array() as array<array<{group}>>))"""
    start = "named_struct('stack', a.stack, 'cur', a.cur, 'have', a.have, 'solid', a.solid, 'path', a.path, 'furn', a.furn, 'out', " + none + ")"
    chunks = _chunks("sequence(0, size(items) - 1)", "size(items)")
    rest = f"{close}, {shut}".replace("s.", "a.").replace("i - 1", "size(items) - 1")
    return f"""CASE WHEN size(items) = 0 THEN {none} ELSE aggregate({chunks}, {zero},
        (a, c) -> aggregate(c, {start}, (s, i) -> {step}, s -> {state(furn="s.furn", out="concat(a.out, array(s.out))")}),
        a -> concat(flatten(a.out), {rest})) END"""


def _owned() -> str:
    """SQL for the folded groups with their items: a run of furniture inside a group is not its own."""
    return "transform(groups, g -> named_struct('path', g.path, 'own', filter(slice(items, g.first + 1, g.last - g.first + 1), x -> g.furniture OR x.kind <> 'furniture')))"


def _build() -> str:
    """SQL that turns groups with their items into segment structs."""
    chars = lambda where: f"aggregate(filter(g.own, x -> {where}), 0, (n, x) -> n + length(x.raw))"
    whole = f"greatest(1, {chars('true')})"
    body = "array_join(transform(g.own, x -> x.body), '\\n\\n')"
    flags = f"""concat(array_sort(array_distinct(flatten(transform(g.own, x -> x.flags)))),
        CASE WHEN forall(g.own, x -> x.type = 'heading') THEN array('heading_only') ELSE cast(array() as array<string>) END,
        CASE WHEN {chars("x.type IN ('code', 'table')")} / {whole} >= {fixed.CODE_HEAVY} THEN array('code_heavy') ELSE cast(array() as array<string>) END,
        CASE WHEN {chars("x.type = 'list_item'")} / {whole} >= {fixed.LIST_HEAVY} THEN array('list_heavy') ELSE cast(array() as array<string>) END)"""
    return f"""transform(groups, g -> named_struct('path', g.path, 'text', {body}, 'tokens', {est(body)}, 'flags', {flags},
        'page_start', array_min(transform(g.own, x -> x.page)), 'page_end', array_max(transform(g.own, x -> x.page)),
        'block_start', g.own[0].block, 'block_end', element_at(g.own, -1).block))"""


def tails(segments: str = "made") -> str:
    """SQL that joins a small tail to the segment before it, which may grow further."""
    none = f"cast(array() as array<{SEGMENT}>)"
    furniture = ", ".join(f"'{f}'" for f in fixed.FURNITURE)
    joins = f"""a.last IS NOT NULL AND s.tokens < {fixed.MIN_TOKENS // 2} AND s.path = a.last.path
        AND NOT arrays_overlap(concat(s.flags, a.last.flags), array({furniture}))
        AND NOT exists(concat(s.flags, a.last.flags), f -> startswith(f, 'hidden:'))
        AND NOT array_contains(a.last.flags, 'heading_only')
        AND a.last.tokens + s.tokens <= {fixed.MAX_TOKENS * fixed.MERGE_FACTOR}
        AND s.block_start = a.last.block_end + 1"""
    both = "concat(a.last.text, '\\n\\n', s.text)"
    joined = f"""named_struct('path', a.last.path, 'text', {both}, 'tokens', {est(both)}, 'flags', array_sort(array_union(a.last.flags, s.flags)),
        'page_start', a.last.page_start, 'page_end', coalesce(s.page_end, a.last.page_end), 'block_start', a.last.block_start, 'block_end', s.block_end)"""
    step = f"""CASE WHEN {joins} THEN named_struct('out', a.out, 'last', {joined})
        ELSE named_struct('out', concat(a.out, CASE WHEN a.last IS NULL THEN {none} ELSE array(a.last) END), 'last', s) END"""
    return f"""aggregate({_chunks(segments, f"greatest(1, size({segments}))")}, named_struct('out', cast(array() as array<array<{SEGMENT}>>), 'last', cast(null as {SEGMENT})),
        (t, c) -> aggregate(c, named_struct('out', {none}, 'last', t.last), (a, s) -> {step}, a -> named_struct('out', concat(t.out, array(a.out)), 'last', a.last)),
        t -> concat(flatten(t.out), CASE WHEN t.last IS NULL THEN {none} ELSE array(t.last) END))"""


def segment_arrays(docs: DataFrame, out: str = "segments") -> DataFrame:
    """docs with `blocks` to docs with an array of segments in order."""
    made = docs.withColumn("items", F.expr(items())).withColumn("groups", F.expr(_fold())).withColumn("groups", F.expr(_owned())).withColumn("made", F.expr(_build()))
    joined = made.withColumn("joined", F.expr(tails()))
    order = "transform(array_sort(transform(joined, (s, i) -> named_struct('b', s.block_start, 'i', i))), o -> joined[o.i])"
    return joined.withColumn(out, F.expr(order)).drop("items", "groups", "made", "joined")


def segments(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row for each segment: id, seq from 1, heading path, text, tokens, flags, pages and blocks."""
    rows = segment_arrays(docs.select(doc_id, "blocks")).select(doc_id, F.posexplode_outer("segments").alias("at", "s")).where("at IS NOT NULL")
    return rows.select(
        doc_id, (F.col("at") + 1).alias("seq"), F.concat(F.lit("s"), F.col("at") + 1).alias("segment_id"), F.col("s.path").alias("heading_path"),
        "s.text", F.col("s.tokens").alias("tokens_est"), "s.flags", "s.page_start", "s.page_end", "s.block_start", "s.block_end",
    )


def greedy(rows: DataFrame, doc_id: str, order: str, tokens: str) -> DataFrame:
    """Packs ordered pieces of each document: (doc_id, order, segment number from 1)."""
    own = rows.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).alias("n")))).alias("own"))
    full = f"a.have + x.n > {fixed.MAX_TOKENS} AND a.have >= {fixed.MIN_TOKENS}"
    fold = f"""aggregate(own, named_struct('seg', 1, 'have', 0, 'out', cast(array() as array<int>)),
        (a, x) -> CASE WHEN {full} THEN named_struct('seg', a.seg + 1, 'have', int(x.n), 'out', concat(a.out, array(a.seg + 1)))
            ELSE named_struct('seg', a.seg, 'have', int(a.have + x.n), 'out', concat(a.out, array(a.seg))) END, a -> a.out)"""
    return own.select(doc_id, F.explode_outer(F.arrays_zip("own", F.expr(fold).alias("seg"))).alias("x")).where("x IS NOT NULL").select(doc_id, F.col("x.own.o").alias(order), F.col("x.seg").alias("segment"))


def heading_paths(lines: DataFrame, doc_id: str, order: str, level: str, body: str, depth: int = 6) -> DataFrame:
    """lines with the path of open headings at each line, by one running window for each level."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc_id).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col(level) == k, F.struct(F.col(order).alias("o"), F.col(body).alias("t"))), ignorenulls=True).over(w) for k in range(1, depth + 1)]
    seen = lines.withColumns({f"_h{k}": c for k, c in enumerate(last, 1)})
    open_ = []
    for k in range(1, depth + 1):
        above = [F.coalesce(F.col(f"_h{j}.o"), F.lit(-1)) for j in range(1, k)]
        ok = F.col(f"_h{k}.o").isNotNull() & (F.col(f"_h{k}.o") > F.greatest(*above, F.lit(-1)) if above else F.lit(True))
        open_.append(F.when(ok, F.col(f"_h{k}.t")))
    return seen.withColumn("path", F.array_compact(F.array(*open_))).drop(*(f"_h{k}" for k in range(1, depth + 1)))

