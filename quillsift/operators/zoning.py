"""The zone of a segment by rules: features in one projection, one CASE over them in the next.

Features and rules are written once as SQL that two dialects share; a dialect supplies what they spell
differently (patterns, arrays). Spark's is what runs; the other one lets a database check it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def _literal(p: str) -> str:
    return p.replace("'", "\\x27")


class Spark:
    size, contains, line_filter, one = "size", "array_contains", "filter", "1.0"

    @staticmethod
    def has(x: str, p: str, flags: str = "i") -> str:
        return f"({x} rlike r'(?{flags}U){_literal(p)}')"

    @staticmethod
    def count(x: str, p: str, flags: str = "i") -> str:
        return f"regexp_count({x}, r'(?{flags}U){_literal(p)}')"

    @staticmethod
    def replace(x: str, p: str, to: str = "", flags: str = "i") -> str:
        return f"regexp_replace({x}, r'(?{flags}U){_literal(p)}', '{to}')"

    @staticmethod
    def lam(name: str, body: str) -> str:
        return f"{name} -> {body}"

    @staticmethod
    def lines(x: str) -> str:
        return f"filter(split({x}, '\\n'), l -> trim(l) <> '')"

    @staticmethod
    def words(x: str) -> str:
        return f"regexp_count({x}, r'(?U)\\S+')"

    @staticmethod
    def last(x: str) -> str:
        return f"try_element_at({x}, -1)"

    @staticmethod
    def headings(x: str) -> str:
        return f"regexp_extract_all({x}, r'(?m)^#+[^\\n]*', 0)"

    @staticmethod
    def sentences(x: str) -> str:
        return f"filter(split({x}, r'(?U){fixed.SENTENCE_NO_INITIAL}'), s -> s is not null and trim(s) <> '')"

    @staticmethod
    def total(x: str, name: str, body: str) -> str:
        return f"aggregate({x}, 0, (n, {name}) -> n + int({body}))"

    @staticmethod
    def join_all(x: str, p: str) -> str:
        return f"array_join(regexp_extract_all({x}, r'(?s){_literal(p)}', 0), '')"

    strip = staticmethod(lambda x: f"regexp_replace({x}, r'(?U)^\\s+|\\s+$', '')")
    pieces = staticmethod(lambda x, p: f"filter(split({x}, r'(?U){p}'), s -> trim(s) <> '')")
    task = staticmethod(lambda x: Spark.count(x, fixed.TASK_MARKERS))
    before = staticmethod(lambda x, p: f"split({x}, r'(?U){p}')[0]")
    rounded = staticmethod(lambda x: F.bround(x, 2))


#: White space and word boundaries of ASCII, and the letters outside ASCII whose case is that of a letter inside.
_ASCII_SPACE = r"\t\n\f\r "
_ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_ASCII_CASE = {"s": "ſ", "k": "\u212a"}


def _ascii(p: str, flags: str = "") -> str:
    """A pattern for Java that matches what the other dialect's engine does: classes and boundaries of ASCII, lines that only
    \\n ends, and ends of the text after its last line break."""
    out, inside, at = [], False, 0
    while at < len(p):
        x = p[at : at + 2] if p[at] == "\\" else p[at]
        at += len(x)
        more = _ASCII_CASE.get(x.lower(), "") if "i" in flags else ""
        if x == r"\s":
            x = _ASCII_SPACE if inside else f"[{_ASCII_SPACE}]"
        elif x == r"\S":
            x = f"[^{_ASCII_SPACE}]"
        elif inside:
            if "i" in flags and x.lower() == "z" and p[at - 3 : at - 1].lower() == "a-":
                more = "".join(_ASCII_CASE.values())
            inside, x = x != "]", x + more
        elif x == "[":
            inside = True
        elif x == r"\b":
            x = _ASCII_BOUNDARY
        elif x == "^" and "m" in flags:
            x = r"(?<![^\n])"
        elif x == "$":
            x = r"(?![^\n])" if "m" in flags else r"\z"
        elif more:
            x = f"[{x}{more}]"
        out.append(x)
    return "(?d" + flags.replace("m", "") + ")" + _literal("".join(out))


class Ascii(Spark):
    """What Duck's SQL gives, in Spark: words, space and boundaries are those of ASCII and sentences end by marks; shares are doubles."""

    one = "1D"

    @staticmethod
    def has(x: str, p: str, flags: str = "i") -> str:
        return f"({x} rlike r'{_ascii(p, flags)}')"

    @staticmethod
    def count(x: str, p: str, flags: str = "i") -> str:
        return f"regexp_count({x}, r'{_ascii(p, flags)}')"

    @staticmethod
    def replace(x: str, p: str, to: str = "", flags: str = "i") -> str:
        return f"regexp_replace({x}, r'{_ascii(p, flags)}', '{to}')"

    @staticmethod
    def filled(x: str) -> str:
        """The other dialect trims all space separators."""
        return f"filter({x}, s -> s rlike r'\\P{{Zs}}')"

    @staticmethod
    def lines(x: str) -> str:
        return Ascii.filled(f"split({x}, '\\n')")

    @staticmethod
    def words(x: str) -> str:
        return Ascii.count(x, r"\S+", "")

    @staticmethod
    def headings(x: str) -> str:
        return f"regexp_extract_all({x}, r'{_ascii('^#+[^' + chr(92) + 'n]*', 'm')}', 0)"

    @staticmethod
    def sentences(x: str) -> str:
        guarded = f"regexp_replace({x}, r'([A-Z][.])[ \t]+', '$1{chr(30)}')"
        marked = f"regexp_replace(regexp_replace({guarded}, r'{_ascii('([.!?])' + chr(92) + 's+')}', '$1{chr(31)}'), r'\n+', '{chr(31)}')"
        return f"transform({Ascii.filled(f"split({marked}, '{chr(31)}')")}, s -> replace(s, '{chr(30)}', ' '))"

    @staticmethod
    def join_all(x: str, p: str) -> str:
        return f"array_join(regexp_extract_all({x}, r'{_ascii(p, 's')}', 0), '')"

    @staticmethod
    def pieces(x: str, p: str) -> str:
        """The other dialect begins anew after each piece."""
        return Ascii.filled(f"split({x}, r'{_ascii(p).replace('^', '^|' + chr(92) + 'G', 1)}')")

    strip = staticmethod(lambda x: Ascii.replace(x, r"^\s+|\s+$", flags=""))
    task = staticmethod(lambda x: f"({Ascii.count(x, fixed.TASK_MARKERS.replace('due(?! to)', 'due'))} - {Ascii.count(x, chr(92) + 'bdue to' + chr(92) + 'b')})")
    before = staticmethod(lambda x, p: f"split({x}, r'{_ascii(p)}')[0]")
    rounded = staticmethod(lambda x: F.rint(x * 100) / 100)


class Duck(Spark):
    size, contains, line_filter = "len", "list_contains", "list_filter"

    @staticmethod
    def has(x: str, p: str, flags: str = "i") -> str:
        return f"regexp_matches({x}, '(?{flags}){_literal(p)}')"

    @staticmethod
    def count(x: str, p: str, flags: str = "i") -> str:
        return f"len(regexp_extract_all({x}, '(?{flags}){_literal(p)}'))"

    @staticmethod
    def replace(x: str, p: str, to: str = "", flags: str = "i") -> str:
        return f"regexp_replace({x}, '(?{flags}){_literal(p)}', '{to}', 'g')"

    @staticmethod
    def lam(name: str, body: str) -> str:
        return f"lambda {name}: {body}"

    @staticmethod
    def lines(x: str) -> str:
        return f"list_filter(string_split({x}, chr(10)), lambda l: trim(l) <> '')"

    @staticmethod
    def words(x: str) -> str:
        return f"len(regexp_extract_all({x}, '\\S+'))"

    @staticmethod
    def last(x: str) -> str:
        return f"{x}[-1]"

    @staticmethod
    def headings(x: str) -> str:
        return f"regexp_extract_all({x}, '(?m)^#+[^\\n]*')"

    @staticmethod
    def sentences(x: str) -> str:
        """No lookaround here: ends are marked, and initials are guarded from the mark."""
        guarded = f"regexp_replace({x}, '([A-Z]\\.)[ \\t]+', '\\1' || chr(30), 'g')"
        marked = f"regexp_replace(regexp_replace({guarded}, '([.!?])\\s+', '\\1' || chr(31), 'g'), '\\n+', chr(31), 'g')"
        return f"list_transform(list_filter(string_split({marked}, chr(31)), lambda s: trim(s) <> ''), lambda s: replace(s, chr(30), ' '))"

    @staticmethod
    def total(x: str, name: str, body: str) -> str:
        return f"CAST(coalesce(list_sum(list_transform({x}, lambda {name}: {body})), 0) AS INTEGER)"

    @staticmethod
    def join_all(x: str, p: str) -> str:
        return f"array_to_string(regexp_extract_all({x}, '(?s){_literal(p)}'), '')"

    strip = staticmethod(lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')")
    pieces = staticmethod(lambda x, p: f"list_filter(regexp_split_to_array({x}, '{p}'), lambda s: trim(s) <> '')")
    task = staticmethod(lambda x: f"({Duck.count(x, fixed.TASK_MARKERS.replace('due(?! to)', 'due'))} - {Duck.count(x, chr(92) + 'bdue to' + chr(92) + 'b')})")
    before = staticmethod(lambda x, p: f"regexp_split_to_array({x}, '{p}')[1]")


def feature_levels(d) -> list[dict[str, str]]:
    """Columns to add, level by level, from seq, text, tokens_est, flags, heading_path, covered, n_d1, n_p1."""
    begins = lambda x, p: d.has(d.strip(x), p)
    fence = "```.*?```"
    share = lambda a, b: f"({d.one} * {a} / greatest(1, {b}))"
    return [
        {"body": d.strip(d.replace("text", r"^#+ [^\n]*$", flags="m")), "own": d.last(d.headings("text"))},
        {
            "heading": f"coalesce({d.strip(d.replace('own', '^#+'))}, {d.last('heading_path')}, '')",
            "fenced": f"{d.join_all('body', fence)}",
            "no_fence": d.replace("body", fence, flags="s"),
            "hidden": f"{d.size}({d.line_filter}(flags, {d.lam('f', _starts(d, 'f', 'hidden:'))})) > 0",
            "furniture": f"{d.size}({d.line_filter}(flags, {d.lam('f', 'f IN (' + ', '.join(repr(x) for x in fixed.FURNITURE) + ')')})) > 0",
        },
        {
            "odd_fence": f"{d.count('body', '```', 's')} % 2 = 1",
            "cut_fence": f"CASE WHEN {d.count('body', '```', 's')} % 2 = 1 THEN {d.join_all('no_fence', '```.*$')} ELSE '' END",
        },
        {"prose": d.strip("no_fence"), "code": "concat(fenced, cut_fence)", "outside": "replace(no_fence, CASE WHEN cut_fence = '' THEN chr(0) ELSE cut_fence END, '')", "plain": d.replace("body", fixed.MARKUP, flags="s")},
        {
            "meta": d.count("substring(body, 1, 600)", fixed.METADATA_KEY, "s"),
            "starts_imperative": begins("body", fixed.IMPERATIVE_START),
            "starts_alnum": d.has("body", r"^[\p{L}\p{N}]", "s"),
            "any_task": f"{d.task('body')} > 0",
            "share": share("covered", "length(text)"),
            "h_structure": f"({d.has('heading', fixed.STRUCTURE_HEADINGS)} OR {d.has(d.strip('heading'), fixed.TERMS_HEADING)})",
            "h_chrome": d.has("heading", fixed.SITE_CHROME_HEADINGS),
            "h_pointer": d.has("heading", fixed.POINTER_HEADINGS),
            "pointer_chars": f"length({d.replace('body', r'[(]https?://[^)]*[)]', flags='s')})",
            "instructs": d.has("body", fixed.INSTRUCTION),
            "instructs_outside": d.has("outside", fixed.INSTRUCTION),
            "badges": d.count("body", fixed.BADGE, "s"),
            "badge_rest": f"length({d.strip(d.replace('body', r'\[!\[.*?\)\)|!\[.*?\)|\[.*?\]\(.*?\)|<[^>]+>', flags='m'))})",
            "revisions": d.has("body", r"\|\s*(revision|version)\s*\|"),
            "h_table": d.has("heading", fixed.TABLE_CONTENT_HEADINGS),
            "h_example": d.has("heading", fixed.EXAMPLE_HEADINGS),
            "h_role": d.has("heading", fixed.ROLE_HEADINGS),
            "h_task": d.has("heading", fixed.TASK_HEADINGS),
            "h_background": d.has("heading", fixed.BACKGROUND_HEADINGS),
            "code_share": share("length(code)", "length(body)"),
            "code_lines": d.lines("plain"),
            "marks_example": d.has("body", fixed.EXAMPLE_MARKERS, "im"),
            "toc": d.count("body", fixed.TOC_LINE, "m"),
            "toc_named": f"({d.has('heading', r'\btable of contents\b')} OR {d.has('substring(text, 1, 80)', r'\btable of contents\b')})",
            "lines": d.lines("prose"),
            "urls": d.count("prose", fixed.URL),
            "sents": d.sentences("prose"),
            "legal": d.count("prose", fixed.LEGAL_BOILERPLATE),
            "citations": d.count("prose", fixed.CITATION_LINE, "m"),
            "nav_head": f"CASE WHEN {d.has('prose', fixed.NAV_SPLIT, 's')} THEN {d.words(d.before('prose', fixed.NAV_SPLIT))} END",
            "nav_items": d.pieces("prose", fixed.NAV_SPLIT),
            "ends_sentence": d.has("prose", r"[a-z]{3}[.!?](\s|$)", "s"),
            "background_hits": d.count("prose", fixed.BACKGROUND_MARKERS),
            "task_words": d.task("prose"),
            "ends_prose": d.has("prose", r"[.!?][)\]*_`]*$", "s"),
        },
        {
            "n_lines": f"{d.size}(lines)",
            "n_code": f"{d.size}(code_lines)",
            "code_like": d.total("code_lines", "l", f"CASE WHEN {d.has('l', fixed.CODE_LINE, 's')} THEN 1 ELSE 0 END"),
            "grammar": d.total("code_lines", "l", f"CASE WHEN {d.has('l', r'^\s*[\w-]+\s*=\s', 's')} THEN 1 ELSE 0 END"),
            "ruled": d.total("code_lines", "l", f"CASE WHEN {d.has('l', r'^\s*[-=_ ]{6,}\s*$', 's')} THEN 1 ELSE 0 END"),
            "short_lines": d.total("lines", "l", f"CASE WHEN {d.words('l')} <= 4 THEN 1 ELSE 0 END"),
            "link_items": d.total("lines", "l", f"CASE WHEN {d.has('l', fixed.LINK_ITEM, 's')} THEN 1 ELSE 0 END"),
            "n_sents": f"{d.size}(sents)",
            "legal_chars": d.total("sents", "s", f"CASE WHEN {d.has('s', fixed.LEGAL_BOILERPLATE)} THEN length(s) ELSE 0 END"),
            "n_nav": f"{d.size}(nav_items)",
            "short_nav": d.total("nav_items", "s", f"CASE WHEN {d.words('s')} <= 6 THEN 1 ELSE 0 END"),
            "nav_words": d.total("nav_items", "s", d.words("s")),
            "nav_imperatives": d.total("nav_items", "s", f"CASE WHEN {begins('s', fixed.IMPERATIVE_START)} THEN 1 ELSE 0 END"),
            "imperatives": d.total("sents", "s", f"CASE WHEN {begins('s', fixed.IMPERATIVE_START)} THEN 1 ELSE 0 END"),
            "sent_words": d.total("sents", "s", d.words("s")),
        },
        {"task_hits": "task_words + imperatives", "density": f"{d.one} * (task_words + imperatives) / greatest(1, n_sents)", "mean_words": f"{d.one} * sent_words / greatest(1, n_sents)"},
    ]


def _starts(d, x: str, prefix: str) -> str:
    return f"starts_with({x}, '{prefix}')" if d is Duck else f"startswith({x}, '{prefix}')"


@dataclass(frozen=True)
class Rule:
    name: str
    when: str
    zone: str
    confidence: str
    signal: str


def rules(d) -> list[Rule]:
    """In order; the first that holds decides. Each signal is SQL for one string."""
    flag = lambda f: f"{d.contains}(flags, '{f}')"
    says = lambda *parts: "concat(" + ", ".join(p if p.startswith("cast") else f"'{p}'" for p in parts) + ")"
    n = lambda c: f"cast({c} as {'varchar' if d is Duck else 'string'})"
    r = Rule
    return [
        r("hidden", "hidden", "hidden", "0.95", "'flag:hidden'"),
        r("title", f"seq = 1 AND {d.size}(heading_path) > 0 AND {_starts(d, 'text', '# ')} AND length(body) <= 160 AND {d.count('body', chr(10), 's')} <= 1 AND NOT starts_imperative AND NOT any_task", "structure", "0.6", "'title_block'"),
        r("metadata", f"(meta >= 2 AND {_starts(d, 'body', '---')}) OR (meta >= 3 AND seq = 1 AND length(body) <= 900)", "structure", "0.75", says("metadata_block=", n("meta"))),
        r("stub", "length(body) BETWEEN 1 AND 20 AND NOT starts_alnum AND NOT body LIKE '%```%'", "structure", "0.5", "'stub'"),
        r("furniture", "furniture", "structure", "0.92", "'flag:furniture'"),
        r("policy", "n_p1 > 0 AND (share >= 0.4 OR tokens_est <= 60)", "ai_policy", "0.85", says("P1x", n("n_p1"))),
        r("directive", "n_d1 > 0 AND (share >= 0.3 OR tokens_est <= 60)", "ai_directive", "0.8", says("D1x", n("n_d1"))),
        r("heading", "h_structure", "structure", "0.75", "'heading:structure'"),
        r("chrome", "h_chrome", "structure", "0.75", "'heading:site_chrome'"),
        r("pointer", "h_pointer AND pointer_chars <= 400 AND NOT starts_imperative AND NOT instructs", "structure", "0.7", "'heading:pointer'"),
        r("badges", "badges >= 2 AND seq <= 2 AND badge_rest <= 160", "structure", "0.7", "'badges'"),
        r("revisions", f"{flag('code_heavy')} AND revisions", "structure", "0.75", "'flag:code_heavy'"),
        r("timetable", f"{flag('code_heavy')} AND h_table AND NOT h_example", "background", "0.6", "'flag:code_heavy'"),
        r("code", flag("code_heavy"), "example", "0.9", "'flag:code_heavy'"),
        r("do_code", "code <> '' AND instructs_outside AND code_share < 0.7", "task", "0.65", "'instructions+code'"),
        r("fenced", "code <> '' AND code_share >= 0.5", "example", "CASE WHEN code_share >= 0.7 THEN 0.85 ELSE 0.7 END", "'fenced_code'"),
        r("grammar", "grammar >= 3 OR ruled >= 2", "example", "0.7", says("grammar=", n("grammar"), ",rules=", n("ruled"))),
        r("code_like", "n_code >= 3 AND code_like >= 0.5 * n_code", "example", "0.7", says("code_like=", n("code_like"), "/", n("n_code"))),
        r("example_heading", "h_example", "example", "0.75", "'heading:example'"),
        r("example_marker", "marks_example AND (code <> '' OR tokens_est <= 250)", "example", "0.6", "'marker:example'"),
        r("heading_only", flag("heading_only"), "structure", "0.6", "'flag:heading_only'"),
        r("toc", "toc >= 3 OR toc_named", "structure", "0.85", says("toc_lines=", n("toc"))),
        r("boilerplate", "legal > 0 AND legal_chars >= 0.5 * greatest(1, length(prose)) AND (tokens_est <= 80 OR (legal >= 2 AND tokens_est <= 160))", "structure", "0.8", says("boilerplate=", n("legal"))),
        r("link_line", "urls >= 2 AND tokens_est <= 60 AND n_lines <= 3", "structure", "0.75", says("link_line:urls=", n("urls"))),
        r("short_lines", "n_lines > 0 AND short_lines >= 0.7 * n_lines AND (urls >= 2 OR n_lines >= 6)", "structure", "0.7", says("short_lines=", n("short_lines"), "/", n("n_lines"), ",urls=", n("urls"))),
        r("references", "citations >= 3 AND citations >= 0.5 * greatest(1, n_lines)", "structure", "0.75", says("references=", n("citations"))),
        r("link_list", "n_lines >= 3 AND link_items >= 0.8 * n_lines", "structure", "0.7", says("link_list=", n("link_items"), "/", n("n_lines"))),
        r("navigation", "nav_head <= 8 AND n_nav >= 3 AND short_nav >= 0.8 * n_nav AND NOT ends_sentence AND nav_imperatives <= 0.1 * n_nav AND nav_words <= 200", "structure", "0.7", says("nav_list=", n("n_nav"))),
        r("role", "h_role", "background", "0.7", "'heading:role'"),
        r("background_heading", "h_background AND NOT h_task AND imperatives < 2", "background", "CASE WHEN density < 0.25 THEN 0.7 ELSE 0.65 END", "'heading:background'"),
        r("dense_task", "density >= 0.6 AND task_hits >= 2", "task", "least(0.9, 0.7 + 0.1 * density)", says("task_markers=", n("task_hits"), "/", n("greatest(1, n_sents)"))),
        r("task_heading", "h_task AND task_hits >= 1", "task", "0.75", "'heading:task'"),
        r("calm_background", "h_background AND density < 0.25", "background", "0.7", "'heading:background'"),
        r("some_task", "density >= 0.35", "task", "0.6", says("task_markers=", n("task_hits"), "/", n("greatest(1, n_sents)"))),
        r("narrative", "mean_words >= 12 AND density < 0.2 AND (background_hits > 0 OR greatest(1, n_sents) >= 2)", "background", "0.6", "'narrative'"),
        r("any_task", "task_hits > 0", "task", "0.5", says("task_markers=", n("task_hits"), "/", n("greatest(1, n_sents)"))),
        r("any_background", "background_hits > 0", "background", "0.5", says("background_markers=", n("background_hits"))),
        r("prose", "n_sents > 0 AND mean_words >= 8 AND ends_prose", "background", "0.4", "'prose'"),
        r("bare_task_heading", "h_task", "task", "0.55", "'heading:task'"),
    ]


def _case(found: list[Rule], part: str, other: str) -> str:
    value = {"zone": lambda r: f"'{r.zone}'", "confidence": lambda r: f"cast({r.confidence} as double)", "signal": lambda r: r.signal, "rule": lambda r: f"'{r.name}'"}[part]
    return "CASE " + " ".join(f"WHEN {r.when} THEN {value(r)}" for r in found) + f" ELSE {other} END"


INPUT = ("seq", "text", "tokens_est", "flags", "heading_path", "covered", "n_d1", "n_p1")


def zone(segments: DataFrame, d: type[Spark] = Spark) -> DataFrame:
    """segments, with the INPUT columns, plus zone, confidence, method, rule and signals."""
    rows = segments
    added: list[str] = []
    for level in feature_levels(d):
        rows = rows.select("*", *(F.expr(sql).alias("z_" + name) for name, sql in _prefixed(level, added).items()))
        added += level
    found = [Rule(*(_rename(x, added) if i in (1, 3, 4) else x for i, x in enumerate((r.name, r.when, r.zone, r.confidence, r.signal)))) for r in rules(d)]
    index = "CASE " + " ".join(f"WHEN {r.when} THEN {i}" for i, r in enumerate(found)) + f" ELSE {len(found)} END"
    rows = rows.withColumn("z_rule", F.expr(index))
    pick = lambda values, other: "CASE z_rule " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {other} END"
    before = F.expr("array_compact(array(CASE WHEN n_p1 > 0 THEN concat('P1x', n_p1) END, CASE WHEN n_d1 > 0 THEN concat('D1x', n_d1) END))")
    signal = F.expr(pick([r.signal for r in found], "cast(null as string)"))
    after = next(i for i, r in enumerate(found) if r.name == "policy")
    signals = F.array_distinct(F.concat(F.when(F.col("z_rule") > after, before).otherwise(F.expr("cast(array() as array<string>)")), F.array_compact(F.array(signal))))
    return rows.select(
        *segments.columns, F.expr(pick([f"'{r.zone}'" for r in found], "'unknown'")).alias("zone"),
        d.rounded(F.expr(pick([f"cast({r.confidence} as double)" for r in found], "cast(0.3 as double)"))).alias("confidence"),
        F.lit("heuristic").alias("method"), F.expr(pick([f"'{r.name}'" for r in found], "'none'")).alias("rule"), signals.alias("signals"),
    )


def _rename(sql: str, names: list[str]) -> str:
    """Feature names, but not those of the input or inside strings, get the prefix of their columns."""
    import re

    known = set(names)
    parts = re.split(r"(r?'(?:[^'])*')", sql)
    word = re.compile(r"\b[a-z_][a-z_0-9]*\b(?!\s*\()")
    return "".join(p if i % 2 else word.sub(lambda m: "z_" + m[0] if m[0] in known else m[0], p) for i, p in enumerate(parts))


def _prefixed(level: dict[str, str], before: list[str]) -> dict[str, str]:
    return {name: _rename(sql, before) for name, sql in level.items()}


def duck_sql(source: str, columns: str) -> str:
    """The same features and rules as a query over a relation with the INPUT columns, for another engine."""
    sql = f"SELECT * FROM {source}"
    for level in feature_levels(Duck):
        sql = f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in level.items())} FROM ({sql})"
    found = rules(Duck)
    return f"SELECT {columns}, {_case(found, 'zone', chr(39) + 'unknown' + chr(39))} AS zone, round_even({_case(found, 'confidence', '0.3')}, 2) AS confidence, {_case(found, 'rule', chr(39) + 'none' + chr(39))} AS rule FROM ({sql})"
