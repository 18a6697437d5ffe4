"""Small office files made by hand."""

from __future__ import annotations

import io
import zipfile

RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
LINK = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SLIDE = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def xlsx(sheets: dict[str, list[list]]) -> bytes:
    names = list(sheets)
    parts = {
        "xl/workbook.xml": f"<workbook {MAIN} {LINK}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": RELS.format("".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(names)))),
        "xl/sharedStrings.xml": f"<sst {MAIN}><si><t>shared</t></si></sst>",
    }
    for k, n in enumerate(names):
        rows = ""
        for y, row in enumerate(sheets[n], 1):
            cells = ""
            for x, v in enumerate(row):
                at = f"{chr(65 + x)}{y}"
                if v is None:
                    continue
                if v == "shared":
                    cells += f'<c r="{at}" t="s"><v>0</v></c>'
                elif isinstance(v, bool):
                    cells += f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
                elif isinstance(v, int | float):
                    cells += f'<c r="{at}"><v>{v}</v></c>'
                else:
                    cells += f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
            rows += f'<row r="{y}">{cells}</row>'
        parts[f"xl/worksheets/s{k}.xml"] = f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>"
    return zipped(parts)


def docx(blocks: list[tuple[str, str]]) -> bytes:
    def paragraph(style: str, text: str) -> str:
        told = '<w:numPr><w:numId w:val="1"/></w:numPr>' if style == "list" else f'<w:pStyle w:val="{style}"/>' if style else ""
        return f"<w:p><w:pPr>{told}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"

    body = ""
    for kind, text in blocks:
        if kind == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph('', c)}</w:tc>" for c in line.split("|")) + "</w:tr>" for line in text.split("\n"))
            body += f"<w:tbl>{rows}</w:tbl>"
        else:
            body += paragraph(kind, text)
    return zipped({"word/document.xml": f"<w:document {WORD}><w:body>{body}</w:body></w:document>"})


def pptx(slides: list[list[tuple[str, str]]]) -> bytes:
    """Shapes as (attributes of the run, text)."""
    parts = {
        "ppt/presentation.xml": f'<p:presentation {SLIDE} {LINK}><p:sldIdLst>' + "".join(f'<p:sldId id="{k}" r:id="r{k}"/>' for k in range(len(slides))) + "</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": RELS.format("".join(f'<Relationship Id="r{k}" Target="slides/s{k}.xml"/>' for k in range(len(slides)))),
    }
    for k, shapes in enumerate(slides):
        body = "".join(f"<p:sp><p:txBody><a:p><a:r><a:rPr {how}/><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>" for how, text in shapes)
        parts[f"ppt/slides/s{k}.xml"] = f"<p:sld {SLIDE}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
    return zipped(parts)
