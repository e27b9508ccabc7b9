"""HTML to typed blocks, with the evidence that text is hidden.

One streaming pass: a stack of open elements carries the reasons for hiding, the background and the page part
down to the text. An element that adds a reason opens a block of its own. In compatible mode (the default)
hiding inside a paragraph, heading, list item or cell is not looked at, its text is taken whole; in strict
mode it is a hidden block too. Only simple selectors count; later rules overwrite earlier ones.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from ..functions import fixed
from .markdown import block, numbered, parsed

#: Elements by their part in the tree, and colours by name.
SKIPPED = frozenset("script style noscript template svg head title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PARTS = ("nav", "footer", "header", "aside")
LEAVES = {"p": "paragraph", "li": "list_item", "pre": "code", "blockquote": "paragraph", **{f"h{n}": "heading" for n in range(1, 7)}}
CONTAINERS = frozenset("html body div section article main nav header footer aside ul ol dl form figure fieldset details summary address hgroup".split())
NAMED = {"white": (1.0, 1.0, 1.0), "black": (0.0, 0.0, 0.0)}


def css(text: str | None) -> dict[str, str]:
    return {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(":") for x in (text or "").split(";")) if v}


def stylesheet(text: str) -> dict[str, dict[str, str]]:
    rules: dict[str, dict[str, str]] = {}
    for names, body in re.findall(r"([^{}]+)\{([^{}]*)\}", re.sub(r"/\*.*?\*/", "", text, flags=re.S)):
        for name in (n.strip().lower() for n in names.split(",")):
            if re.fullmatch(r"[.#]?[\w-]+", name):
                rules.setdefault(name, {}).update(css(body))
    return rules


def color(value: str | None) -> tuple[float, float, float] | None:
    """Shares of red, green and blue; None for unknown or transparent colours."""
    value = (value or "").strip().lower()
    if value in NAMED:
        return NAMED[value]
    if m := re.match(r"#([0-9a-f]{6}|[0-9a-f]{3})\b", value):
        full = m[1] if len(m[1]) == 6 else "".join(c * 2 for c in m[1])
        return tuple(int(full[i : i + 2], 16) / 255 for i in (0, 2, 4))
    if m := re.match(r"rgba?\(([^)]*)\)", value):
        parts = re.split(r"[\s,/]+", m[1].strip())
        share = lambda p, whole: float(p[:-1]) / 100 if p.endswith("%") else float(p) / whole
        try:
            if len(parts) < 3 or len(parts) > 3 and share(parts[3], 1.0) == 0:
                return None
            return tuple(share(p, 255.0) for p in parts[:3])
        except ValueError:
            return None
    return None


def reasons(style: dict[str, str], ground: tuple[float, float, float] | None) -> list[str]:
    """Why an element with this style cannot be seen on that background."""
    number = lambda key: float(m[0]) if (m := re.match(r"-?\d*\.?\d+", style.get(key, ""))) else None
    ink = color(style.get("color"))
    offset = re.search(r"-\d{4,}(\.\d+)?px|-9999|-100\s*%", " ".join(style.get(k, "") for k in ("left", "top", "right", "bottom", "margin-left")))
    small = re.match(r"0(\.\d+)?(px|pt|em|rem|%)?$", style.get("font-size", "x"))
    checks = (
        ("display-none", style.get("display") == "none"),
        ("visibility-hidden", style.get("visibility") in ("hidden", "collapse")),
        ("font-size-0", bool(small) and (number("font-size") == 0 or style["font-size"].endswith("px"))),
        ("opacity-0", number("opacity") == 0),
        ("offscreen", style.get("position") in ("absolute", "fixed") and bool(offset) or bool(re.match(r"-(\d{4,}px|9999|100\s*%)", style.get("text-indent", "")))),
        ("fg-bg", bool(ink and ground) and max(abs(a - b) for a, b in zip(ink, ground, strict=True)) < fixed.HTML_CONTRAST),
        ("zero-size", style.get("overflow") == "hidden" and (number("width") == 0 or number("height") == 0)),
    )
    return [name for name, holds in checks if holds]


class Blocks(HTMLParser):
    def __init__(self, strict: bool = False, mark: str = "&"):
        super().__init__(convert_charrefs=True)
        self.mark = mark  # what stands for an ampersand
        self.strict, self.rules, self.blocks, self.meta, self.title = strict, {}, [], {}, None
        self.stack: list[dict] = [{"tag": "", "why": [], "ground": (1.0, 1.0, 1.0), "part": [], "leaf": None}]
        self.text: list[str] = []
        self.rows: list[list[str]] | None = None
        self.skipped: list[str] = []
        self.raw: list[str] = []

    def _flush(self) -> None:
        top, raw = self.stack[-1], "".join(self.text)
        self.text = []
        if not raw.strip() or self.skipped:
            return
        if self.rows is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join(raw.split()))
            return
        kind = LEAVES.get(top["leaf"] or "", "paragraph")
        body = raw.strip("\n") if kind == "code" else " ".join(raw.split())
        level = int(top["leaf"][1]) if kind == "heading" else None
        self.blocks.append(block(kind, body, level, [f"hidden:{w}" for w in top["why"]] + top["part"]))

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipped.append(tag)
            self.raw = []
            return
        given = {k: v or "" for k, v in attrs}
        if self.mark != "&":
            given = {k: unescape(v.replace(self.mark, "&")) for k, v in given.items()}
        if tag == "meta" and (name := given.get("name") or given.get("property")):
            self.meta[name] = given.get("content", "")
        if self.skipped:
            return
        if tag == "br":
            self.text.append(" " if self.stack[-1]["leaf"] != "pre" else "\n")
        if tag in VOID:
            return
        top = self.stack[-1]
        style: dict[str, str] = {}
        for name in (tag, *("." + c for c in given.get("class", "").lower().split()), "#" + given.get("id", "").lower()):
            style |= self.rules.get(name, {})
        style |= css(given.get("style"))
        ground = color(style.get("background-color") or style.get("background", "").split(" ")[0]) or top["ground"]
        own = (["hidden-attr"] if "hidden" in given else []) + reasons(style, ground)
        why = list(dict.fromkeys(top["why"] + own))
        breaks = tag in LEAVES or tag in CONTAINERS or tag in ("table", "tr", "td", "th") or (why != top["why"] and (self.strict or top["leaf"] is None))
        if breaks:
            self._flush()
        if tag in LEAVES and top["leaf"] == "p":
            self._close("p")
            top = self.stack[-1]
        if tag == "li" and top["leaf"] == "li":
            self._close("li")
            top = self.stack[-1]
        if tag == "table":
            self.rows = []
        if tag == "tr" and self.rows is not None:
            self.rows.append([])
        leaf = tag if tag in LEAVES else None if tag in CONTAINERS else top["leaf"]
        if why != top["why"] and not breaks:
            why = top["why"]
        self.stack.append({"tag": tag, "why": why, "ground": ground, "part": top["part"] + ([tag] if tag in PARTS else []), "leaf": leaf, "breaks": breaks})

    def _close(self, tag: str) -> None:
        for n in range(len(self.stack) - 1, 0, -1):
            if self.stack[n]["tag"] == tag:
                while len(self.stack) > n:
                    if any(f.get("breaks") for f in self.stack[n:]):
                        self._flush()
                    self.stack.pop()
                return

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
                if tag == "style":
                    self.rules |= stylesheet("".join(self.raw))
                if tag == "title" and self.title is None:
                    self.title = " ".join("".join(self.raw).split()) or None
            return
        if self.skipped:
            return
        if tag in ("td", "th"):
            self._flush()
        if tag == "table" and self.rows is not None:
            self._flush()
            rows, self.rows, top = self.rows, None, self.stack[-1]
            self.blocks.append(block("table", "\n".join("| " + " | ".join(r) + " |" for r in rows if r), None, [f"hidden:{w}" for w in top["why"]] + top["part"]))
        self._close(tag)

    def handle_data(self, data):
        if self.skipped:
            self.raw.append(data)
        else:
            self.text.append(data)

    def handle_comment(self, data):
        if self.skipped or not data.strip():
            return
        if self.strict or self.stack[-1]["leaf"] is None:
            self._flush()
            self.blocks.append(block("other", " ".join(data.split()), None, ["hidden:comment", *self.stack[-1]["part"]]))

    def close(self):
        super().close()
        self._flush()


def parse(html: str | None, strict: bool = False, decode: bool = True) -> tuple[str | None, dict[str, str], list[dict]]:
    """(title, meta, blocks). Without decode the character references of title and blocks stay as they are written; the
    parser then sees another character, which the page lacks, for each ampersand."""
    html = html or ""
    mark = "&" if decode else next(c for c in map(chr, range(0xE000, 0x110000)) if c not in html)
    reader = Blocks(strict, mark)
    reader.feed(html.replace("&", mark))
    reader.close()
    title, blocks = reader.title, numbered(reader.blocks)
    if not decode:
        title = title and title.replace(mark, "&")
        blocks = [b | {"text": b["text"].replace(mark, "&")} for b in blocks]
    return title, reader.meta, blocks


def read(df: DataFrame, column: str = "html", strict: bool = False, decode: bool = True) -> DataFrame:
    return parsed(df, column, lambda x: parse(x, strict, decode), "html")
