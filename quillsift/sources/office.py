"""DOCX with its styling, and text of PPTX, XLSX, EPUB and RTF, from their bytes."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from . import html, markdown
from .markdown import block, numbered

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Stems of heading styles by language, and document properties that are kept.
HEADING = re.compile(r"(?:heading|überschrift|uberschrift|titre)\s*(\d)", re.I)
PROPERTIES = ("title", "subject", "creator", "description", "keywords", "category", "comments")

Parsed = tuple[str | None, dict[str, str], list[dict]]


def _run(r) -> dict | None:
    text = "".join((x.text or "") if x.tag == W + "t" else "\t" if x.tag == W + "tab" else " " if x.tag == W + "br" else "" for x in r.iter())
    if not text:
        return None
    style = r.find(W + "rPr")
    get = lambda name: None if style is None or style.find(W + name) is None else style.find(W + name).get(W + "val", "true")
    ink, size = get("color"), get("sz")
    hidden = get("vanish") not in (None, "0", "false")
    return {
        "text": text, "size": float(size) / 2 if size else None, "font": None, "background": None, "flags": ["hidden:vanish"] if hidden else [],
        "color": f"#{ink.lower()}" if ink and re.fullmatch(r"[0-9A-Fa-f]{6}", ink) else None,
    }


def _paragraph(p) -> dict | None:
    runs = [x for r in p.iter(W + "r") if (x := _run(r))]
    name = next((s.get(W + "val", "") for s in p.iter(W + "pStyle")), "")
    head = HEADING.search(re.sub(r"(?<=[a-zü])(?=\d)", " ", name))
    kind, level = ("heading", int(head[1])) if head else ("heading", 1) if name.lower() == "title" else ("list_item" if "list" in name.lower() or next(p.iter(W + "numPr"), None) is not None else "paragraph", None)
    flags = ["hidden:vanish"] if runs and all(r["flags"] for r in runs if r["text"].strip()) and any(r["flags"] for r in runs) else []
    body = "".join(r["text"] for r in runs)
    return block(kind, body, level, flags, runs) if body.strip() else None


def docx(content: bytes) -> Parsed:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else []
    meta = {x.tag.rsplit("}")[-1]: x.text for x in core if x.text and x.tag.rsplit("}")[-1] in PROPERTIES}
    blocks = []
    for part in body if body is not None else ():
        if part.tag == W + "p":
            blocks.append(_paragraph(part))
        elif part.tag == W + "tbl":
            rows = [[" ".join("".join(t.text or "" for t in c.iter(W + "t")).split()) for c in r.iter(W + "tc")] for r in part.iter(W + "tr")]
            blocks.append(block("table", "\n".join("| " + " | ".join(r) + " |" for r in rows)))
    found = numbered(b for b in blocks if b)
    return meta.get("title") or markdown.title_of(found), meta, found


def _members(z: zipfile.ZipFile, pattern: str) -> list[str]:
    number = lambda n: [int(x) for x in re.findall(r"\d+", n)]
    return sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: (number(n), n))


def pptx(content: bytes) -> Parsed:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = [ElementTree.fromstring(z.read(n)) for n in _members(z, r"ppt/slides/slide\d+\.xml")]
    text = [["".join(t.text or "" for t in p.iter(A + "t")) for p in s.iter(A + "p")] for s in slides]
    found = "\n\n".join(f"## Slide {i}\n\n" + "\n\n".join(x for x in own if x.strip()) for i, own in enumerate(text, 1))
    return None, {}, found


def xlsx(content: bytes) -> Parsed:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in s.iter(S + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = [ElementTree.fromstring(z.read(n)) for n in _members(z, r"xl/worksheets/sheet\d+\.xml")]

    def cell(c) -> str:
        value = next((v.text or "" for v in c.iter(S + "v")), "".join(t.text or "" for t in c.iter(S + "t")))
        return shared[int(value)] if c.get("t") == "s" and value else value

    tables = ["\n".join("| " + " | ".join(cell(c) for c in r.iter(S + "c")) + " |" for r in s.iter(S + "row")) for s in sheets]
    return None, {}, "\n\n".join(f"## Sheet {i}\n\n{t}" for i, t in enumerate(tables, 1))


def epub(content: bytes) -> Parsed:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        pages = [z.read(n).decode("utf-8", "replace") for n in _members(z, r".*\.x?html?")]
    return None, {}, numbered(b for p in pages for b in html.parse(p)[2])


def rtf(content: bytes) -> Parsed:
    text = content.decode("latin-1")
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n\n", text)
    return None, {}, re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text)
