"""Personal data by patterns that are bootstrapped from seed entities, in DataFrame and SQL functions only.

Seeds are e-mail addresses, IP addresses, card numbers (Luhn), phone numbers and secrets (keys of hexadecimal digits),
found by expression. The one and two words before a seed, and the one and two behind it, are lexical patterns; tokens
that look like identifiers (a digit, an at sign, or letters joined by a sign) are instances, patterns and instances are
the two sides of a graph with an edge for each mention. In each round a pattern is scored by the share of its
occurrences that stand beside a known instance and by how many different known instances it stands beside; patterns
above both thresholds make the identifiers beside them known instances of the pattern's kind, and the next round starts
from these, until a round finds no new one. Spans of unseen identifiers, and of secrets, are added to the seeds of the
four base kinds, which always stay.

Occurrences and mentions are counted in all distinct texts; a text is known by its SHA-256. Expressions cannot
backtrack over long runs: their loops are possessive, and a run of characters is entered only at its start or where the
match before ended, which leaves the leftmost matches as they are.

Defined results: null and empty texts have no spans; a text that occurs again has the same spans; spans of equal kind
never overlap; added spans overlap no seed; of equally good kinds the first in order is taken; a very long text, and a
very long word beside an identifier, count whole; an empty table gives no rows. Columns besides id and text are not
looked at, whatever their names. Positions are code points, ends exclusive. redact() keeps all columns; of overlapping
spans the first is replaced and the others are swallowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Kinds in order, with the expression of each. The leading alternatives enter a run of characters once.
KINDS = ("email", "ip", "card", "phone")
EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before its expression is tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: The kind of seeds beyond the base, and what a token must be to be one.
ALL_KINDS = (*KINDS, "secret")
SECRET = "^(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
#: A token from its first digit, at sign, or sign before a letter on; the rest of it is the end of the gap before. What an
#: instance is when it is trimmed.
TOKEN = r"(?:[0-9@]|[._/:=+\[\](){}-]++[A-Za-z0-9])\S*+"
INSTANCE = r"(?:[0-9][^0-9]*+){4}|[@0-9A-Za-z][._/:=+\[\](){}@-]+[0-9A-Za-z]"
#: Known instances that a pattern needs; share of its occurrences that known instances must stand beside.
SUPPORT, CONFIDENCE = 3, 0.5
#: Characters of patterns that may be broadcast; one in so many texts gives the least that a pattern occurs.
SENT, PROBE = 16 << 20, 64
#: Words of 64 bits in the table that leaves out words that no pattern holds.
CELLS = 4096
SPANS = "array<struct<s:int,e:int,v:string>>"


def _quoted(expression: str) -> str:
    return "r'" + expression + "'"


def _spans(found: str, gaps: str) -> str:
    """SQL for the spans of matches from the matches and the gaps around them; long rows of matches are summed in blocks."""
    block = "512"
    pairs = f"transform(sequence(1, size({found})), i -> named_struct('g', length({gaps}[i - 1]), 'n', length({found}[i - 1]), 'v', {found}[i - 1]))"
    blocks = f"transform(sequence(0, cast((size({found}) - 1) / {block} as int)), b -> slice({pairs}, b * {block} + 1, {block}))"
    local = f"""transform({blocks}, own -> aggregate(own, named_struct('at', 0, 'out', cast(array() as {SPANS})),
        (a, x) -> named_struct('at', a.at + x.g + x.n, 'out', concat(a.out, array(named_struct('s', a.at + x.g, 'e', a.at + x.g + x.n, 'v', x.v))))))"""
    return f"""CASE WHEN size({found}) > 0 THEN aggregate({local}, named_struct('at', 0, 'out', cast(array() as array<{SPANS}>)),
        (a, x) -> named_struct('at', a.at + x.at, 'out', concat(a.out, array(transform(x.out, y -> named_struct('s', y.s + a.at, 'e', y.e + a.at, 'v', y.v))))),
        a -> flatten(a.out)) ELSE cast(array() as {SPANS}) END"""


_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN int(substr({_DIGITS}, i, 1))
    WHEN int(substr({_DIGITS}, i, 1)) > 4 THEN 2 * int(substr({_DIGITS}, i, 1)) - 9 ELSE 2 * int(substr({_DIGITS}, i, 1)) END) % 10 = 0"""
VALID = {
    "email": "true",
    "ip": r"forall(split(x.v, '[.]'), p -> p rlike '^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}


def seeds(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns in keep, `_key` (SHA-256 of the text), `_base` (seeds: kind number, start, end) and `_cands`
    (identifier-like tokens: start, end, value, up to two words to the left and to the right, the nearest first)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, body.alias("_text"))
    matched = []
    for kind in KINDS:
        all_of = F.expr(f"regexp_extract_all(_text, {_quoted(EXPRESSIONS[kind])}, 0)")
        if kind in NEEDS:
            all_of = F.when(F.instr(F.col("_text"), NEEDS[kind]) > 0, all_of).otherwise(F.expr("cast(array() as array<string>)"))
        matched.append(all_of.alias(f"_m_{kind}"))
    rows = rows.select(*keep, "_text", *matched, F.expr(f"regexp_extract_all(_text, {_quoted(TOKEN)}, 0)").alias("_m_token"))
    cuts = {**EXPRESSIONS, "token": TOKEN}
    rows = rows.select("*", *(F.expr(f"CASE WHEN size(_m_{k}) > 0 THEN split(_text, {_quoted(e)}, -1) END").alias(f"_g_{k}") for k, e in cuts.items()))
    rows = rows.select("*", *(F.expr(_spans(f"_m_{k}", f"_g_{k}")).alias(f"_s_{k}") for k in cuts))
    base = "concat(" + ", ".join(f"transform(filter(_s_{k}, x -> {VALID[k]}), x -> named_struct('k', {n}, 's', x.s, 'e', x.e))" for n, k in enumerate(KINDS)) + ")"
    head = r"length(regexp_extract(reverse(_g_token[i]), r'^\S*+', 0))"
    left, right = "reverse(lower(_g_token[i]))", "lower(concat(_g_token[i + 1], coalesce(get(_s_token, i + 1).v, '')))"
    words = lambda gap, turn, *of: "filter(array(" + ", ".join(f"{turn}(regexp_extract({gap}, {_quoted(x)}, 1))" for x in of) + "), w -> w <> '')"
    near = f"""transform(_s_token, (x, i) -> named_struct('s', x.s - {head}, 'e', x.e, 'v', concat(right(_g_token[i], {head}), x.v),
        'l', {words(left, "reverse", r"^\S*+\s++(\S++)", r"^\S*+\s++\S++\s++(\S++)")}, 'r', {words(right, "", r"^\s*+(\S++)", r"^\s*+\S++\s++(\S++)")}))"""
    return rows.select(*keep, F.unhex(F.sha2("_text", 256)).alias("_key"), F.expr(base).alias("_base"), F.expr(near).alias("_cands"))


def mentions(found: DataFrame) -> DataFrame:
    """A row for each mention: _key, span, instance, seed kind or null, and its patterns (side, words). Tokens inside a seed that begins before them are none."""
    texts = found.where("size(_cands) > 0").select("_key", "_base", "_cands").dropDuplicates(["_key"])
    rows = texts.select("_key", "_base", F.explode("_cands").alias("c")).select("_key", "c", F.expr("filter(_base, b -> b.s < c.e AND b.e > c.s)").alias("b"))
    rows = rows.select(
        "_key", "c", F.expr("try_element_at(b, 1)").alias("b"),
        F.expr("regexp_extract(c.v, '^[^0-9A-Za-z@+]*+', 0)").alias("lead"),
        F.expr("regexp_replace(regexp_replace(c.v, '^[^0-9A-Za-z@+]++', ''), '[^0-9A-Za-z]{1,8}$', '')").alias("inst"),
    )
    rows = rows.where("b IS NULL OR b.s >= c.s").where(F.col("b").isNotNull() | F.col("inst").rlike(INSTANCE))
    patterns = F.expr("""concat(
        CASE WHEN size(c.l) > 0 THEN array(named_struct('side', 'l', 'words', c.l[0])) ELSE array() END,
        CASE WHEN size(c.l) > 1 THEN array(named_struct('side', 'l', 'words', concat(c.l[1], ' ', c.l[0]))) ELSE array() END,
        CASE WHEN size(c.r) > 0 THEN array(named_struct('side', 'r', 'words', c.r[0])) ELSE array() END,
        CASE WHEN size(c.r) > 1 THEN array(named_struct('side', 'r', 'words', concat(c.r[0], ' ', c.r[1]))) ELSE array() END)""")
    start = F.expr("c.s + length(lead)")
    kind = F.coalesce("b.k", F.when(F.col("inst").rlike(SECRET), ALL_KINDS.index("secret")))
    return rows.select("_key", start.alias("s"), (start + F.length("inst")).alias("e"), "inst", F.col("b").isNotNull().alias("base"), kind.alias("kind"), patterns.alias("patterns"))


def _totals(docs: DataFrame, text: str, wide: DataFrame) -> DataFrame:
    """(side, words, total): how often the patterns in wide occur in distinct texts with a word on their open side; texts are not shuffled to find their copies."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(F.col(text), 256)).alias("_key"), F.split(F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " ")), " ").alias("t"))
    wanted = wide.select("words").distinct()
    # words that cannot be meant are left out by a fixed table of bits before they become rows
    cell = F.expr(f"pmod(hash(words), {64 * CELLS})")
    bits = dict(wanted.select(cell.alias("h")).groupBy(F.floor(F.col("h") / 64).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, h % 64)")).alias("b")).collect())
    table = "from_json('[" + ",".join(str(bits.get(i, 0)) for i in range(CELLS)) + "]', 'array<bigint>')"
    meant = lambda found: F.expr(f"filter({found}, x -> getbit({table}[cast(floor(pmod(hash(x.words), {64 * CELLS}) / 64) as int)], pmod(hash(x.words), 64)) = 1)")
    exploded = lambda found, size: words.select("row", "_key", F.size("t").alias("n"), F.explode(meant(found)).alias("x")).select("row", "_key", "n", "x.words", F.col("x.i").alias("at"), (F.col("x.i") + size).alias("end"))
    ones = exploded("transform(t, (w, i) -> named_struct('i', i, 'words', w))", 1)
    twos = exploded("CASE WHEN size(t) > 1 THEN transform(sequence(0, size(t) - 2), i -> named_struct('i', i, 'words', concat(t[i], ' ', t[i + 1]))) END", 2)
    if (wanted.agg(F.sum(F.length("words") + 40)).first()[0] or 0) <= SENT:
        wanted = F.broadcast(wanted)
    by_row = ones.unionByName(twos).join(wanted, "words", "left_semi").groupBy("row", "_key", "words").agg(F.count(F.when(F.col("end") < F.col("n"), 1)).alias("l"), F.count(F.when(F.col("at") > 0, 1)).alias("r"))
    by_text = by_row.groupBy("_key", "words").agg(F.max("l").alias("l"), F.max("r").alias("r")).groupBy("words").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return wide.join(by_text, "words").select("side", "words", F.when(F.col("side") == "l", F.col("l")).otherwise(F.col("r")).alias("total"))


def discover(docs: DataFrame, text: str, found: DataFrame) -> DataFrame | None:
    """(_key, added: array of kind number, start, end) of texts with secrets or unseen identifiers; None if there are none."""
    all_of = cut(mentions(found), "pii")
    more = all_of.where("NOT base AND kind IS NOT NULL").select("_key", F.struct(F.col("kind").alias("k"), "s", "e").alias("x"))
    side = ["side", "words"]
    edges = cut(all_of.select("inst", "kind", F.explode("patterns").alias("p")).select("inst", "kind", "p.*").groupBy(*side, "inst", "kind").agg(F.count("*").alias("n")), "pii")
    known, total, least, size = None, None, None, 0
    while not edges.where("kind IS NULL").isEmpty():
        now = edges if known is None else edges.join(known, "inst", "left").withColumn("kind", F.coalesce("kind", "learned")).drop("learned")
        # the edges of one pattern and instance have one row for each seed kind, so counts of rows are counts of instances
        by_kind = now.where("kind IS NOT NULL").groupBy(*side, "kind").agg(F.count("*").alias("support"), F.sum("n").alias("hits"))
        best = by_kind.groupBy(*side).agg(F.max_by("kind", F.struct("support", -F.col("kind"))).alias("learned"), F.sum("support").alias("support"), F.sum("hits").alias("hits"))
        # a pattern without an unseen identifier beside it can teach nothing
        open_ = edges.where("kind IS NULL").select(*side).distinct()
        best = cut(best.where(F.col("support") >= SUPPORT).join(open_, side, "left_semi"), "pii")
        # most words beside identifiers occur so often that a part of the texts rules them out: the rest are counted in all
        new = best.select(*side) if least is None else cut(best.select(*side).join(least, side, "left_anti"), "pii")
        if not new.isEmpty():
            part = _totals(docs.where(F.pmod(F.xxhash64(text), F.lit(PROBE)) == 0), text, new).withColumnRenamed("total", "least")
            found_ = new.join(part, side, "left").fillna(0, ["least"])
            least = cut(found_ if least is None else least.unionByName(found_), "pii")
        if least is None:
            break
        likely = best.join(least, side).where(F.col("hits") >= CONFIDENCE * F.col("least")).select(*side)
        fresh = cut(likely if total is None else likely.join(total, side, "left_anti"), "pii")
        if not fresh.isEmpty():
            # a pattern without a total keeps a null, so that it is not looked for again
            counted = fresh.join(_totals(docs, text, fresh), side, "left")
            total = cut(counted if total is None else total.unionByName(counted), "pii")
        if total is None:
            break
        good = best.join(total, side).where(F.col("hits") >= CONFIDENCE * F.col("total")).select(*side, "learned", (F.col("hits") / F.col("total") * F.log2(F.col("support") + 1)).alias("score"))
        learned = edges.where("kind IS NULL").join(good, side).groupBy("inst").agg(F.max_by("learned", F.struct("score", -F.col("learned"))).alias("learned"))
        known = cut(learned, "pii")
        # known instances never become unknown, so the same number is the same set
        was, size = size, known.count()
        if size == was:
            break
    if size:
        more = more.unionByName(all_of.where("kind IS NULL").join(known, "inst").select("_key", F.struct(F.col("learned").alias("k"), "s", "e").alias("x")))
    added = cut(more.groupBy("_key").agg(F.collect_set("x").alias("added")), "pii")
    return None if added.isEmpty() else added


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _both(found: DataFrame, added: DataFrame | None) -> DataFrame:
    none = F.expr("cast(array() as array<struct<k:int,s:int,e:int>>)")
    if added is None:
        return found.withColumn("_all", F.col("_base"))
    joined = found.join(added.withColumnsRenamed({"added": "_added"}), "_key", "left")
    return joined.withColumn("_all", F.array_sort(F.concat("_base", F.coalesce("_added", none)))).drop("_added")


def _listed(column: str) -> F.Column:
    names = "array(" + ", ".join(f"'{k}'" for k in ALL_KINDS) + ")"
    return F.expr(f"array_join(transform({column}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of seeds of each kind, the digest of their spans, and all spans."""
    found = cut(seeds(docs.select(doc_id, text), text, [doc_id]), "pii")
    both = _both(found, discover(docs, text, found))
    counts = (F.expr(f"cast(size(filter(_base, x -> x.k = {n})) as long)").alias(f"n_{k}") for n, k in enumerate(KINDS))
    return both.select(doc_id, *counts, F.sha2(_listed("_base").cast("binary"), 256).alias("base_sha256"), _listed("_all").alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets.

    Seeds are found again in the row that is redacted, so that texts are joined with nothing but the spans that
    were discovered, which are few, and are not shuffled unless these are many."""
    # written before it is filtered: a filter on spans would be pushed down and find them a second time
    found = cut(seeds(docs.select(text), text, []), "pii")
    added = discover(docs, text, found)
    plain = [f"c{i}" for i in range(len(docs.columns))]
    body = plain[docs.columns.index(text)]
    rows = _both(seeds(docs.toDF(*plain), body, plain), added)
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in ALL_KINDS) + ")"
    pieces = f"""aggregate(array_sort(transform(_all, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k))), named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, x) -> CASE WHEN x.s >= a.at THEN named_struct('at', x.e, 'out', concat(a.out, array(substr({body}, a.at + 1, x.s - a.at), {names}[x.k])))
        ELSE named_struct('at', greatest(a.at, x.e), 'out', a.out) END,
        a -> concat(array_join(a.out, ''), substr({body}, a.at + 1)))"""
    rows = rows.withColumn(body, F.expr(f"CASE WHEN size(_all) > 0 THEN {pieces} ELSE {body} END"))
    return rows.select(*plain).toDF(*docs.columns)
