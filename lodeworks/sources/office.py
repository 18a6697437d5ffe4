"""Readers of zipped office files with the standard library: spreadsheets, text documents, presentations."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

#: Namespaces of the formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Fixed value: how much larger than the middle size all runs of a heading are.
LARGER = 1.25


def _links(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relations by id."""
    folder, name = posixpath.split(part)
    where = f"{folder}/_rels/{name}.rels"
    if where not in book.namelist():
        return {}
    found = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read(where))}
    return {k: t[1:] if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t)) for k, t in found.items()}


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() and "e" not in text.lower() and "." not in text else repr(value)


def sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of each sheet in order; cells are strings, blank rows go. Dates come as the numbers that the file holds."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        links, out = _links(book, "xl/workbook.xml"), []
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            rows = []
            for row in ElementTree.fromstring(book.read(links[sheet.get(LINK)])).iter(f"{MAIN}row"):
                cells: dict[int, str] = {}
                for k, cell in enumerate(row.iter(f"{MAIN}c")):
                    cells[_column(cell.get("r"), k)] = _cell(cell, shared)
                line = [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]
                if any(c.strip() for c in line):
                    rows.append(line)
            out.append((sheet.get("name"), rows))
        return out


def _column(place: str | None, default: int) -> int:
    letters = re.match(r"[A-Z]+", place or "")
    if not letters:
        return default
    n = 0
    for c in letters[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(cell, shared: list[str]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    value = cell.findtext(f"{MAIN}v")
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    return value if kind in ("str", "e") else _number(value)


def _tree(items: list[dict]) -> dict:
    """A converted document of items in order: texts and tables with references from the body."""
    out: dict = {"texts": [], "tables": [], "body": {"children": []}}
    for item in items:
        kind = "tables" if item["label"] == "table" else "texts"
        out["body"]["children"].append({"$ref": f"#/{kind}/{len(out[kind])}"})
        out[kind].append(item)
    return out


def text_document(content: bytes) -> dict:
    """A converted document of a DOCX file: headings by style, lists, paragraphs, tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        body = ElementTree.fromstring(book.read("word/document.xml")).find(f"{WORD}body")
    items = []
    for block in body:
        if block.tag == f"{WORD}tbl":
            grid = [[{"text": "\n".join(_said(p) for p in c.iter(f"{WORD}p"))} for c in row.iter(f"{WORD}tc")] for row in block.iter(f"{WORD}tr")]
            items.append({"label": "table", "data": {"grid": grid}})
        elif block.tag == f"{WORD}p":
            style = block.find(f"{WORD}pPr/{WORD}pStyle")
            style = "" if style is None else style.get(f"{WORD}val") or ""
            level = re.fullmatch(r"(?i)heading\s*(\d)", style)
            item = {"label": "paragraph", "text": _said(block)}
            if level or style.lower() == "title":
                item |= {"label": "section_header", "level": int(level[1]) if level else 1}
            elif block.find(f"{WORD}pPr/{WORD}numPr") is not None:
                item["label"] = "list_item"
            items.append(item)
    return _tree(items)


def _said(paragraph) -> str:
    return "".join(t.text or "" if t.tag == f"{WORD}t" else "\t" if t.tag == f"{WORD}tab" else "\n" if t.tag == f"{WORD}br" else "" for t in paragraph.iter())


def _slides(book: zipfile.ZipFile):
    """Slides in the order of the presentation."""
    links = _links(book, "ppt/presentation.xml")
    for n, slide in enumerate(ElementTree.fromstring(book.read("ppt/presentation.xml")).iter(f"{SLIDE}sldId"), 1):
        yield n, ElementTree.fromstring(book.read(links[slide.get(LINK)]))


def presentation(content: bytes) -> dict:
    """A converted document of a PPTX file: a paragraph for each text shape, a table for each table, pages are slides."""
    items = []
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        for n, slide in _slides(book):
            for shape in (s for s in slide.iter() if s.tag in (f"{SLIDE}sp", f"{DRAW}tbl")):
                if shape.tag == f"{DRAW}tbl":
                    grid = [[{"text": _lines(c)} for c in row.iter(f"{DRAW}tc")] for row in shape.iter(f"{DRAW}tr")]
                    items.append({"label": "table", "data": {"grid": grid}, "prov": [{"page_no": n}]})
                else:
                    items.append({"label": "paragraph", "text": _lines(shape), "prov": [{"page_no": n}]})
    return _tree(items)


def _lines(shape) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(f"{DRAW}t")) for p in shape.iter(f"{DRAW}p"))


def heading_texts(content: bytes) -> set[str]:
    """Texts of a presentation's shapes whose runs are all bold, or all much larger than their middle size."""
    out = set()
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        for _, slide in _slides(book):
            for tree in slide.iter(f"{SLIDE}spTree"):
                for shape in tree:
                    runs = [r for r in shape.iter(f"{DRAW}r") if "".join(t.text or "" for t in r.iter(f"{DRAW}t")).strip()]
                    told = [r.find(f"{DRAW}rPr") for r in runs]
                    sizes = sorted(int(p.get("sz")) for p in told if p is not None and p.get("sz"))
                    bold = bool(runs) and all(p is not None and p.get("b") in ("1", "true") for p in told)
                    if bold or (sizes and sizes[0] >= LARGER * sizes[len(sizes) // 2]):
                        out.add(_lines(shape).strip())
    return out - {""}
