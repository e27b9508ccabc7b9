"""The main text of web pages by text-to-tag ratio.

Pages stream through the standard library's parser. Every block is a line with its characters, the tags around
them and the characters in links; lines inside menus, page headers, footers, sidebars, notices, adverts, forms,
scripts, styles, hidden elements and reader comments are left out where their element or its class, id or role says
so outright. The ratios of characters outside links to tags are smoothed by a Gaussian over neighbouring lines and
parted in two clusters by an iterated threshold, and the upper cluster decides:

* the innermost container with HOLDS of its characters is the region; if that lies in an article (or main), this is
  given whole;
* any other region goes on, above and below, over neighbouring headings, paragraphs and lines of the upper cluster
  that lie beside it in the containers around it; rows of lines that are nothing but links are menus;
* an element whose class or id only hints at what it is (`related-work`, `ad-slot`) stays if its lines are in the
  upper cluster.

Defined results: null and empty pages, and pages without text, give an empty string; markup that is never
closed ends with its parent or the page; of containers that hold equally much the innermost is taken; a very long page
is fed in parts and read to its end; repeated rows give repeated results; an empty table gives no rows. Only the named
columns are used, whatever else a table has.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spread of the Gaussian in lines; share of the upper cluster that the region must hold; characters fed at once.
SIGMA, HOLDS, FEED = 1.0, 0.9, 1 << 16
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article body center div main ol section table td ul".split())
LEFT_OUT = frozenset("aside button canvas datalist dialog footer form head iframe math menu nav noscript object optgroup option script search select style svg template textarea title".split())
#: A start tag of the key closes open elements of its value, up to the nearest block that may hold them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("article aside body div dl footer form header html main nav ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that no name marks, since they are text or hold all of it.
TEXTUAL = HEADINGS | frozenset("html body main hgroup p".split())
#: Words of class, id and role that mark what is no main text, and words that say the element only surrounds it.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie cookies disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted "
    "promotion recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets alert login".split()
)
AROUND = frozenset("has with without no layout".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Line:
    __slots__ = ("text", "tags", "linked", "within", "tag", "hinted")

    def __init__(self, text: str, tags: int, linked: int, within: tuple[int, ...], tag: str, hinted: bool):
        self.text, self.tags, self.linked, self.within, self.tag, self.hinted = text, tags, linked, within, tag, hinted


class Reader(HTMLParser):
    """Events to lines. The stack holds blocks, and other elements only where they are left out or hinted at."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, number of the container or -1, whether it is left out, whether a name hints at that
        self.kinds: list[str] = []
        self.out = self.hints = self.articles = self.links = self.tags = self.linked = 0
        self.buffer: list[str] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, tuple(x[1] for x in self.stack if x[1] >= 0), self.stack[-1][0] if self.stack else "", self.hints > 0))
            self.tags = 0
        self.buffer, self.linked = [], 0

    def _judged(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether the element is left out, and whether its names hint that it might be."""
        if tag in LEFT_OUT or tag == "header" and not self.articles:
            return True, False
        hinted = False
        for key, value in attrs:
            if tag in ("html", "body", "main"):
                break
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value or ""):
                return True, False
            if key in ("class", "id", "role") and tag not in TEXTUAL and (tag != "article" or self.articles):
                for name in (value or "").split():
                    if name.lower() in MARKS and not (self.articles and name.lower() == "header"):
                        return True, False
                    words = {w.lower() for w in WORD.findall(name)}
                    if words & MARKS and not words & AROUND:
                        if key == "class" and not self.articles:
                            return True, False
                        hinted = True
        return False, hinted

    def _pop(self, n: int) -> None:
        """Closes the stack down to n elements."""
        while len(self.stack) > n:
            tag, _, out, hinted = self.stack.pop()
            self.out -= out
            self.hints -= hinted
            self.articles -= tag in ("article", "main")

    def handle_starttag(self, tag, attrs):
        if not self.out:
            self.tags += 1
        if tag == "br":
            self.buffer.append(" ")
        if tag == "a":
            self.links += 1
        out, hinted = self._judged(tag, attrs)
        if tag in BLOCKS:
            self._flush()
            shut = {"p"} | CLOSES.get(tag, set())
            for n in range(len(self.stack) - 1, -1, -1):
                if self.stack[n][0] in shut:
                    self._pop(n)
                elif self.stack[n][0] in FENCE:
                    break
        elif not out and not hinted:
            return
        if tag in VOID:
            return
        number = -1
        if tag in CONTAINERS:
            number = len(self.kinds)
            self.kinds.append(tag)
        self.stack.append((tag, number, out, hinted))
        self.out += out
        self.hints += hinted
        self.articles += tag in ("article", "main")

    def handle_endtag(self, tag):
        if not self.out:
            self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCKS:
            self._flush()
            self.links = 0
        for n in range(len(self.stack) - 1, -1, -1):
            if self.stack[n][0] == tag:
                self._pop(n)
                break

    def handle_data(self, data):
        if not self.out:
            self.buffer.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self):
        super().close()
        self._flush()


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        own = [(kernel[j - i + reach], values[j]) for j in range(max(0, i - reach), min(len(values), i + reach + 1))]
        out.append(sum(k * v for k, v in own) / sum(k for k, _ in own))
    return out


def threshold(values: list[float]) -> float:
    """The value midway between the means of the two clusters that it parts; the least value if there is one cluster."""
    cut = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not low or not high:
            return min(values)
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if new == cut:
            break
        cut = new
    return cut


def _menus(lines: list[Line], root: int) -> set[int]:
    """Containers in the region, and lists, in which two lines or more are nothing but links."""
    plain: dict[int, list[bool]] = {}
    for x in lines:
        for n in x.within[x.within.index(root) + 1 :] if root in x.within else ():
            plain.setdefault(n, []).append(x.linked >= len(x.text))
    return {n for n, own in plain.items() if len(own) > 1 and all(own)}


def extract(html: str | None) -> str:
    reader = Reader()
    for at in range(0, len(html or ""), FEED):
        reader.feed(html[at : at + FEED])
    reader.close()
    lines = reader.lines
    if not lines:
        return ""
    own = [(len(x.text) - x.linked) / max(1, x.tags) for x in lines]
    ratios = smoothed(own)
    cut = threshold(ratios)
    lines, own, ratios = zip(*((x, o, r) for x, o, r in zip(lines, own, ratios, strict=True) if r >= cut or not x.hinted), strict=True)
    weight: dict[int, int] = {}
    total = 0
    for line, ratio in zip(lines, ratios, strict=True):
        if ratio >= cut:
            total += len(line.text)
            for n in line.within:
                weight[n] = weight.get(n, 0) + len(line.text)
    holding = [n for n, w in weight.items() if w >= HOLDS * total]
    root = max(holding, default=-1)  # containers are numbered as they open, so the last is the innermost
    path = next((x.within[: x.within.index(root) + 1] for x in lines if root in x.within), ())
    whole = [n for n in path if reader.kinds[n] == "article"] or [n for n in path if reader.kinds[n] == "main"]
    if whole:
        return "\n".join(x.text for x in lines if whole[0] in x.within)
    if root < 0:
        return "\n".join(x.text for x in lines)
    inside = [i for i, x in enumerate(lines) if root in x.within]
    first, last = inside[0], inside[-1]

    def beside(i: int) -> bool:
        """Whether a line next to the region goes on with it."""
        x = lines[i]
        return x.within == path[: len(x.within)] and (x.tag in HEADINGS or x.linked < len(x.text) and (x.tag == "p" or own[i] >= cut))

    while first > 0 and beside(first - 1):
        first -= 1
    while last + 1 < len(lines) and beside(last + 1):
        last += 1
    menus = _menus(lines, root)
    return "\n".join(x.text for x in lines[first : last + 1] if menus.isdisjoint(x.within))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    schema = T.StructType([T.StructField(c, pages.schema[c].dataType) for c in (page_id, url)] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return pages.select(page_id, url, F.col(html).cast("string")).mapInArrow(run, schema)
