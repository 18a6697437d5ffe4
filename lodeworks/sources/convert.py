"""Converted documents: a converter gives a tree of texts, tables and pictures with references; here it becomes elements in order."""

from __future__ import annotations

import base64
import json
import urllib.request
import uuid
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.images import cropped
from ..functions.tables import grid_to_markdown
from . import office
from .files import IMAGES, csv_rows

ELEMENTS = (
    "name string, seq int, id string, type string, text string, page int, section_path array<string>, level int, ordered boolean, "
    "sheet_name string, table_rows array<array<string>>, image string, error string"
)
FIELDS = [f.strip().split(" ")[0] for f in ELEMENTS.split(",") if f.strip()]
#: Labels of a converted document's items and the elements that they become.
KIND_OF_LABEL = {
    "section_header": "heading", "heading": "heading", "title": "heading",
    "paragraph": "paragraph", "text": "paragraph", "caption": "paragraph", "footnote": "paragraph",
    "list_item": "list_item", "table": "table", "picture": "picture",
}


class Converter(Protocol):
    def convert(self, name: str, content: bytes) -> dict:
        """The converted document; raises where it can't read the file."""


class OfficeConverter:
    """Reads DOCX, PPTX and PNG files itself; refuses the others, such as PDF, which need a converter of their own."""

    def convert(self, name: str, content: bytes) -> dict:
        kind = name.lower().rpartition(".")[2]
        if kind == "docx":
            return office.text_document(content)
        if kind == "pptx":
            return office.presentation(content)
        if f".{kind}" in IMAGES:
            mime = "png" if kind == "png" else "jpeg" if kind in ("jpg", "jpeg") else kind
            return {"pages": {"1": {"image": {"uri": f"data:image/{mime};base64,{base64.b64encode(content).decode()}"}}}}
        raise ValueError(f"no converter for {name}")


class HttpConverter:
    """A conversion service: the file as a multipart form, the tree as JSON in the reply."""

    def __init__(self, url: str, timeout: float = 180.0):
        self.url, self.timeout = url.rstrip("/"), timeout

    def request(self, name: str, content: bytes, form: str = "json") -> urllib.request.Request:
        edge = uuid.uuid4().hex
        fields = {"to_formats": form, "do_ocr": "false"} | ({"image_export_mode": "embedded"} if form == "json" else {})
        parts = [f'--{edge}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
        head = f'--{edge}\r\nContent-Disposition: form-data; name="files"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'
        body = b"".join(parts) + head.encode() + content + f"\r\n--{edge}--\r\n".encode()
        return urllib.request.Request(f"{self.url}/v1/convert/file", body, {"Content-Type": f"multipart/form-data; boundary={edge}"}, method="POST")

    def convert(self, name: str, content: bytes) -> dict:
        with urllib.request.urlopen(self.request(name, content), timeout=self.timeout) as reply:
            document = json.loads(reply.read())["document"]["json_content"]
        return json.loads(document) if isinstance(document, str) else document


def data_uri(uri: str | None) -> bytes | None:
    if not isinstance(uri, str) or not uri.startswith("data:") or "," not in uri:
        return None
    try:
        return base64.b64decode(uri.split(",", 1)[1])
    except ValueError:
        return None


def page_image(document: dict, number) -> bytes | None:
    pages = document.get("pages")
    if isinstance(pages, list):
        page = pages[int(number) - 1] if isinstance(number, int) and 0 < number <= len(pages) else None
    else:
        page = (pages or {}).get(str(number))
    return data_uri(((page or {}).get("image") or {}).get("uri"))


def picture(document: dict, item: dict) -> str | None:
    """The picture in base64: its own image, else what its box holds of the page's; None where neither can be read."""
    own = data_uri((item.get("image") or {}).get("uri"))
    try:
        if not own:
            place = (item.get("prov") or [{}])[0]
            page = page_image(document, place.get("page_no"))
            own = cropped(page, place.get("bbox")) if page else None
    except (ValueError, TypeError, KeyError):
        own = None
    return base64.b64encode(own).decode() if own else None


def in_order(document: dict) -> Iterator[dict]:
    """Items below the body, depth first; groups count as what is in them."""
    known = {}
    for kind in ("texts", "tables", "pictures", "groups"):
        for k, item in enumerate(document.get(kind) or []):
            known[f"#/{kind}/{k}"] = known[item.get("self_ref") or f"#/{kind}/{k}"] = item
    todo = [iter((document.get("body") or {}).get("children") or [])]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            continue
        item = known.get(child.get("$ref") or "")
        if item is not None and "/groups/" in child["$ref"]:
            todo.append(iter(item.get("children") or []))
        elif item is not None:
            yield item


def elements_of(document: dict) -> list[dict]:
    """Elements with ids e0, e1, ... and the headings above them; a heading's path ends with itself. Blank texts and tables go."""
    out: list[dict] = []
    above: list[str] = []
    for item in in_order(document):
        kind = KIND_OF_LABEL.get(item.get("label"))
        text = item.get("text") or item.get("orig") or ""
        more: dict = {}
        if kind == "heading":
            level = item.get("level")
            level = int(level) if str(level).isdigit() and int(level) else 1
            above, more = [*above[: level - 1], text], {"level": level}
        elif kind == "list_item":
            more["ordered"] = bool(item.get("enumerated") or item.get("ordered"))
            if more["ordered"] and item.get("marker"):
                blank = not text.strip()
                text = "" if blank else f"{item['marker'].strip()} {text}"
        elif kind == "table":
            text = grid_to_markdown(item)
        elif kind == "picture":
            text, more = "", {"image": picture(document, item)}
        if kind is None or (kind in ("paragraph", "list_item", "table") and not text.strip()):
            continue
        page = (item.get("prov") or [{}])[0].get("page_no")
        out.append({"id": f"e{len(out)}", "type": kind, "text": text, "page": page, "section_path": list(above), **more})
    return out


def sheet_elements(name: str, found: list[tuple[str, list[list[str]]]]) -> list[dict]:
    """A heading for each sheet, and its table where it has rows."""
    out = []
    for title, rows in found:
        path = [title]
        out.append({"type": "heading", "text": title, "level": 1, "section_path": path, "sheet_name": title})
        if rows:
            text = "\n".join(" | ".join(r) for r in rows)
            out.append({"type": "table", "text": text, "section_path": path, "sheet_name": title, "table_rows": rows})
    return [{"id": f"e{k}"} | e for k, e in enumerate(out)]


def parse_file(name: str, content: bytes, converter: Converter) -> list[dict]:
    """The elements of one file of the pipeline formats."""
    kind = "." + name.lower().rpartition(".")[2]
    if kind == ".xlsx":
        return sheet_elements(name, office.sheets(content))
    if kind == ".csv":
        return sheet_elements(name, [(name.rpartition(".")[0], csv_rows(content))])
    document = converter.convert(name, content)
    out = elements_of(document)
    if kind in IMAGES and not out:
        pages = document.get("pages") or {}
        first = min((int(p) for p in pages), default=None) if isinstance(pages, dict) else 1
        shown = page_image(document, first)
        if shown:
            out = [{"id": "e0", "type": "picture", "text": "", "page": first, "section_path": [], "image": base64.b64encode(shown).decode()}]
    if kind == ".pptx":
        bold = {" ".join(t.split()).lower() for t in office.heading_texts(content)}
        for e in out:
            if e["type"] == "paragraph" and " ".join(e["text"].split()).lower() in bold:
                e |= {"type": "heading", "level": e.get("level") or 1}
    return out


def elements(files: DataFrame, converter: Converter | None = None) -> DataFrame:
    """Elements of all files (name, content) of the pipeline formats. A file that fails gives one row with its error and no
    element, so it stops no other."""
    converter = converter or OfficeConverter()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["name"], f["content"], strict=True):
                try:
                    found = [{"name": name, "seq": k, **e} for k, e in enumerate(parse_file(name, bytes(content), converter))]
                except Exception as error:  # one file's failure is that file's
                    found = [{"name": name, "error": f"{type(error).__name__}: {error}"}]
                if found:
                    yield pd.DataFrame([{c: e.get(c) for c in FIELDS} for e in found], columns=FIELDS).astype(object)

    return files.where(F.col("route") == "pipeline").select("name", "content").mapInPandas(run, ELEMENTS)
