"""Documents to chunks: readers, converted trees, tables, groups, pictures."""

import base64
import json
import math
import random
import re

import numpy as np
import office_files
import pytest
from pyspark.sql import functions as F

from lodeworks.functions import images, tables, text
from lodeworks.operators import chunking, documents
from lodeworks.operators import tables as grids
from lodeworks.plans import vision
from lodeworks.sources import convert, files, office

ELEMENT = "name string, stem string, seq int, id string, type string, text string, page int, section_path array<string>, ordered boolean, sheet_name string, table_rows array<array<string>>"


def element(seq, kind, said, page=None, path=("S",), ordered=None, rows=None, name="f.docx", sheet=None):
    return (name, name.rpartition(".")[0], seq, f"e{seq}", kind, said, page, list(path), ordered, sheet, rows)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_windows_linear(spark):
    """Windows of any text equal slices, characters beyond the basic plane and small steps too."""
    rnd = random.Random(1)
    for size, overlap in ((800, 80), (7, 6), (5, 0), (10, 9), (3, 1)):
        s = "".join(rnd.choice("ab \n😀é") for _ in range(rnd.randrange(200)))
        want, at = [], 0
        while at < len(s):
            want.append(s[at : at + size])
            if at + size >= len(s):
                break
            at += size - overlap
        assert one(spark, chunking.char_windows(F.lit(s), size, overlap)) == want


def test_separators():
    """Parts are pieces of the text, no longer than asked, that leave out nothing but white space; the best separator is taken."""
    assert chunking.cut_at_separators("aaa. bbb. ccc", 8, 0) == ["aaa. bbb", ". ccc"]
    assert chunking.cut_at_separators("one two\n\nthree four\n\nfive", 12, 0) == ["one two", "three four", "five"]
    assert chunking.cut_at_separators("a b c d e f", 5, 2) == ["a b c", "c d", "d e", "e f"]
    assert chunking.cut_at_separators("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]
    rnd = random.Random(2)
    for _ in range(300):
        s = "".join(rnd.choice(["a", "bc", " ", "  ", ".", "\n", "\n\n", "。", "!", "long-word-here"]) for _ in range(rnd.randint(1, 60)))
        bare = lambda x: re.sub(r"\s", "", x)
        assert bare("".join(chunking.cut_at_separators(s, 20, 0))) == bare(s)
        for overlap in (0, 3, 8):
            parts = chunking.cut_at_separators(s, 20, overlap)
            assert all(0 < len(p) <= 20 and p == p.strip() and p in s for p in parts)
            assert set(bare(s)) <= set(bare("".join(parts)))


def test_spreadsheet():
    data = office_files.xlsx({"One": [["shared", "B"], [None, None], ["x", 1.5, True], ["y", 3]], "Empty": []})
    assert office.sheets(data) == [("One", [["shared", "B"], ["x", "1.5", "True"], ["y", "3"]]), ("Empty", [])]
    found = convert.parse_file("t.xlsx", data, convert.OfficeConverter())
    assert [(e["type"], e["sheet_name"]) for e in found] == [("heading", "One"), ("table", "One"), ("heading", "Empty")]


def test_text_document():
    data = office_files.docx([("Heading1", "Top"), ("", "Hello there"), ("", "  "), ("Heading2", "Below"), ("list", "item"), ("table", "a|b\n1|2"), ("Heading1", "Next")])
    found = convert.parse_file("d.docx", data, convert.OfficeConverter())
    assert [(e["id"], e["type"], e["section_path"]) for e in found] == [
        ("e0", "heading", ["Top"]), ("e1", "paragraph", ["Top"]), ("e2", "heading", ["Top", "Below"]),
        ("e3", "list_item", ["Top", "Below"]), ("e4", "table", ["Top", "Below"]), ("e5", "heading", ["Next"]),
    ]
    assert found[4]["text"] == "| a | b |\n| --- | --- |\n| 1 | 2 |"


def test_presentation():
    data = office_files.pptx([[('b="1"', "Bold title"), ('sz="1200"', "plain words")], [('sz="1800"', "other")]])
    assert office.heading_texts(data) == {"Bold title"}
    found = convert.parse_file("p.pptx", data, convert.OfficeConverter())
    assert [(e["type"], e["text"], e["page"]) for e in found] == [("heading", "Bold title", 1), ("paragraph", "plain words", 1), ("paragraph", "other", 2)]


def pixels(height, width):
    return np.random.default_rng(1).integers(0, 256, (height, width, 3)).astype(np.uint8)


def test_png():
    x = pixels(20, 30)
    data = images.encode_png(x)
    assert (images.decode_png(data) == x).all()
    assert images.png_size(data) == (30, 20)
    box = {"l": 5, "t": 18, "r": 10, "b": 8, "coord_origin": "BOTTOMLEFT"}
    assert (images.decode_png(images.cropped(data, box)) == x[2:12, 5:10]).all()
    assert (images.decode_png(images.cropped(data, {"l": 5, "t": 2, "r": 10, "b": 12})) == x[2:12, 5:10]).all()
    for whole in ({"l": 1}, {"l": 9, "t": 1, "r": 9, "b": 5}, None):
        assert (images.decode_png(images.cropped(data, whole)) == x).all()
    big = images.decode_png(images.enlarged(data))
    assert big.shape[1] >= 400 and big.shape[0] >= 150 and math.isclose(big.shape[1] / big.shape[0], 1.5, rel_tol=0.01)
    with pytest.raises(ValueError, match="PNG"):
        images.decode_png(b"GIF89a")


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    """Lines filtered in each way come back as they were."""
    import struct
    import zlib

    x = pixels(6, 5).astype(int)
    raw = b""
    for y in range(6):
        line, up = x[y].ravel(), x[y - 1].ravel() if y else np.zeros(15, int)
        left = np.concatenate([np.zeros(3, int), line[:-3]])
        corner = np.concatenate([np.zeros(3, int), up[:-3]])
        if kind == 1:
            guess = left
        elif kind == 2:
            guess = up
        elif kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = np.array([min((a, b, c), key=lambda v, q=q: abs(q - v)) for a, b, c, q in zip(left, up, corner, p, strict=True)])
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = images.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    assert (images.decode_png(data) == x).all()


def uri(data):
    return "data:image/png;base64," + base64.b64encode(data).decode()


def test_converted_tree(spark):
    page = images.encode_png(pixels(20, 30))
    document = {
        "texts": [{"label": "title", "text": "T", "level": "x"}, {"label": "list_item", "text": "go", "marker": " 1. ", "enumerated": True}, {"label": "text", "text": " "}, {"label": "footnote", "orig": "note", "prov": [{"page_no": 2}]}, {"label": "odd", "text": "gone"}],
        "tables": [{"label": "table", "data": {"grid": [[{"text": "a"}, {"text": None}], [{"text": "b"}]]}}, {"label": "table", "data": {"grid": ["broken"]}, "text": "kept"}],
        "pictures": [{"label": "picture", "image": {"uri": uri(b"own")}}, {"label": "picture", "prov": [{"page_no": 1, "bbox": {"l": 0, "t": 0, "r": 4, "b": 5}}]}, {"label": "picture", "prov": [{"page_no": 7}]}],
        "groups": [{"self_ref": "#/groups/0", "children": [{"$ref": "#/texts/1"}, {"$ref": "#/texts/2"}]}],
        "pages": {"1": {"image": {"uri": uri(page)}}},
        "body": {"children": [{"$ref": x} for x in ("#/texts/0", "#/groups/0", "#/texts/3", "#/texts/4", "#/tables/0", "#/tables/1", "#/pictures/0", "#/pictures/1", "#/pictures/2", "#/nowhere/1")]},
    }
    found = convert.elements_of(document)
    assert [(e["id"], e["type"], e["text"], e["page"]) for e in found] == [
        ("e0", "heading", "T", None), ("e1", "list_item", "1. go", None), ("e2", "paragraph", "note", 2), ("e3", "table", "| a |  |\n| --- | --- |\n| b |  |", None),
        ("e4", "table", "kept", None), ("e5", "picture", "", None), ("e6", "picture", "", 1), ("e7", "picture", "", 7),
    ]
    assert base64.b64decode(found[5]["image"]) == b"own"
    assert images.decode_png(base64.b64decode(found[6]["image"])).shape == (5, 4, 3)
    assert found[7]["image"] is None and all(e["section_path"] == ["T"] for e in found)


def test_image_file():
    data = images.encode_png(pixels(4, 4))
    found = convert.parse_file("x.png", data, convert.OfficeConverter())
    assert [(e["type"], base64.b64decode(e["image"])) for e in found] == [("picture", data)]


def test_http_converter():
    r = convert.HttpConverter("http://localhost:1/").request("a.pdf", b"%PDF")
    assert r.full_url == "http://localhost:1/v1/convert/file" and b'filename="a.pdf"' in r.data and b"%PDF" in r.data and b"embedded" in r.data


def test_files_fail_alone(spark, tmp_path):
    (tmp_path / "good.docx").write_bytes(office_files.docx([("", "fine")]))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    (tmp_path / "latin.txt").write_bytes("café au lait".encode("latin-1"))
    (tmp_path / "song.mp3").write_bytes(bytes(range(200, 256)))
    found = files.scan(spark, f"file://{tmp_path}")
    rows = convert.elements(found).collect()
    assert {r["name"]: r["error"] is None for r in rows} == {"good.docx": True, "bad.docx": False, "p.pdf": False}
    assert {r["name"]: r["text"] for r in files.texts(found).collect()} == {"latin.txt": "caf� au lait"}
    heard = files.texts(found, lambda name, content: F.concat(F.lit("heard "), F.length(content))).collect()
    assert {r["name"]: r["text"] for r in heard}["song.mp3"] == "heard 56"
    assert files.route("A.PDF") == "pipeline" and files.route("x.ogg") == "passthrough"
    with pytest.raises(ValueError, match="unsupported"):
        files.route("x.exe")


def massive(names, metrics, title=True):
    rows = [["Data sheet", *[""] * len(names)]] if title else []
    return [*rows, ["", *names], *([m, *[f"{m[:2]}{k}" if (k + len(m)) % 4 else "" for k in range(len(names))]] for m in metrics)]


def plain_model(rows):
    width = max(map(len, rows))
    grid = [[c.strip() for c in r + [""] * (width - len(r))] for r in rows]
    filled = [sum(c != "" for c in r[1:]) for r in grid[:4]]
    head = filled.index(max(filled))
    names = [(k, c) for k, c in enumerate(grid[head]) if k and c]
    data = [(r[0], [r[k] for k, _ in names]) for r in grid[head + 1 :] if r[0] and any(r[k] for k, _ in names)]
    sparse = sum(sum(c != "" for c in r) <= max(1, width // 4) for r in grid[:head])
    return head, names, data, sparse


def test_canonical_model(spark):
    rnd = random.Random(3)
    for _ in range(12):
        rows = [[rnd.choice(["", "a", " b ", "Size (unit: mm)"]) for _ in range(rnd.randint(1, 5))] for _ in range(rnd.randint(1, 9))]
        m = one(spark, grids.canonical(F.from_json(F.lit(json.dumps(rows)), "array<array<string>>")))
        head, names, data, sparse = plain_model(rows)
        assert (m["header"], [(e["place"], e["name"]) for e in m["entities"]], [(r["metric"], r["values"]) for r in m["data"]], m["sparse"]) == (head, names, data, sparse)
        assert all(r["unit"] == ("mm" if "unit" in r["metric"] else None) for r in m["data"])


def test_massive_table(spark):
    names, metrics = [f"Model {c}" for c in "ABCDE"], [f"m{k} (unit: kg)" for k in range(7)]
    rows = massive(names, metrics)
    e = spark.createDataFrame([element(0, "heading", "Sheet"), element(1, "table", "x", rows=rows, sheet="Sheet"), element(2, "table", "| x | y |\n| - | - |\n| c | d |")], ELEMENT)
    got = {r["chunk_id"]: r for r in grids.table_chunks(e, grids.TableOptions(profile=5)).collect()}
    assert {k for k in got if "entity" in k} == {f"f_table_0_entity_{i}_part_{p}" for i in range(5) for p in range(-(-sum(bool(r[i + 1]) for r in rows[2:]) // 5))}
    assert {k for k in got if "comparison" in k} == {"f_table_0_comparison_0", "f_table_0_comparison_1"}
    first = got["f_table_0_entity_0_part_0"]
    assert first["text"].startswith("Entity Profile: Model A\nSheet: Sheet\nSource: (unknown)\n\n- m0 (unit: kg): m00 [kg]" if rows[2][1] else "Entity Profile: Model A\nSheet: Sheet")
    assert first["entity_group"] == "Model A::part_0" and first["table_strategy"] == "massive_entity_profile" and first["table_type"] == "massive"
    assert got["f_table_0_comparison_1"]["comparison_scope"] == ["Model D", "Model E"]
    assert "f_table_1" in got and got["f_table_1"]["table_type"] == "general"
    plain = {r["chunk_id"] for r in grids.table_chunks(e, grids.TableOptions(massive=False)).collect()}
    assert plain == {"f_table_0", "f_table_1"}
    assert grids.TableOptions(profile=1, window=1, overlap=-1, metrics=2) == grids.TableOptions(profile=5, window=2, overlap=0, metrics=8)


def test_table_stage(spark):
    faq = "| Question | Answer |\n| --- | --- |\n| who | me |\n| why | |\n| how | so |\nand so"
    long = "| h | k |\n| --- | --- |\n" + "\n".join(f"| row {k} | {'x' * 40} |" for k in range(6))
    drawn = "┌───┐\nx"
    e = spark.createDataFrame([element(0, "table", faq, 3), element(1, "paragraph", "plain"), element(2, "table", long), element(3, "paragraph", drawn), element(4, "table", " ")], ELEMENT)
    tell = lambda t, s: F.when(t.contains("row 0"), F.concat(F.lit("Told in "), s))
    got = {r["chunk_id"]: r for r in grids.table_chunks(e, grids.TableOptions(size=150), tell).collect()}
    assert got["f_table_0_row_0"]["text"] == "Q: who\nA: me" and got["f_table_0_row_1"]["text"] == "Q: how\nA: so\nand so"
    assert got["f_table_1_part_0"]["natural"] == "Told in S" and got["f_table_1_part_1"]["natural"] is None
    assert all(p["text"].startswith("| h | k |\n| --- | --- |\n") and len(p["text"]) <= 150 for k, p in got.items() if "part" in k)
    assert got["f_table_2"]["text"] == drawn
    u = {r["chunk_id"]: r for r in documents.unified(documents.text_chunks(e), grids.table_chunks(e, grids.TableOptions(size=150), tell)).collect()}
    part = u["f_table_1_part_0"]
    assert part["chunk_text_original"] == "Told in S" and part["chunk_text_raw"].startswith("| h") and part["chunk_type"] == "parts_table"
    assert u["f_table_0_row_0"]["chunk_text_embedded"] == "[Document: f | Section: S | Page: 3]\nQ: who\nA: me"
    assert any(r["chunk_type"] == "text" and "plain" in r["chunk_text_original"] for r in u.values())


def plain_chunks(rows, size=60, overlap=5):
    """Text chunks of one file's elements by a plain statement of the rules."""
    groups, now = [], []
    for e in rows:
        kind, said, page, path = e[4], e[5], e[6], e[7]
        if kind == "picture":
            said = f"[Image on page {page}]" if page is not None else "[Image]"
        if kind in ("paragraph", "list_item") and now and (now[-1][6], now[-1][7]) == (page, path):
            now.append(e)
            continue
        if now:
            groups.append(now)
        now = [e] if kind in ("paragraph", "list_item") else []
        if kind in ("picture", "heading"):
            groups.append([(*e[:5], said, *e[6:])])
    if now:
        groups.append(now)
    raw = []
    for g in groups:
        block = "\n".join(e[5] for e in g if e[5].strip())
        if g[0][4] == "heading" or not block.strip():
            continue
        kind = "picture" if g[0][4] == "picture" else "procedure_step" if g[0][4] == "list_item" and g[0][8] else "text"
        if len(block) > size and kind == "text":
            parts = chunking.cut_at_separators(block, size, overlap)
        else:
            parts = [block[k : k + size] for k in range(0, max(1, len(block) - overlap), size - overlap)]
        raw += [{"text": p, "page": g[0][6], "section": g[0][7][-1] if g[0][7] else None, "kind": kind} for p in parts if p.strip()]
    for k, c in enumerate(raw):
        c["id"] = f"f_{k}"
    short = lambda c: c["kind"] != "procedure_step" and len(c["text"].strip()) < 80 and "\n" not in c["text"].strip()
    merged, k, n = [], 0, 0
    while k < len(raw):
        group = [raw[k]]
        while short(raw[k]) and k + len(group) < len(raw):
            x = raw[k + len(group)]
            if not short(x) or (x["page"], x["section"]) != (raw[k]["page"], raw[k]["section"]) or sum(len(c["text"].strip()) + 3 for c in group) + len(x["text"].strip()) >= 400:
                break
            group.append(x)
        if len(group) > 1:
            n += 1
            merged.append(raw[k] | {"id": f"f_merged_{n}", "text": " | ".join(c["text"].strip() for c in group), "kind": "text"})
        else:
            merged.append(raw[k])
        k += len(group)
    out, k = [], 0
    while k < len(merged):
        c = merged[k]
        warns = len(c["text"].strip()) < 50 and re.search(r"\b(DANGER|WARNING|CAUTION|NOTICE|NOTE)\b", c["text"])
        if warns and k + 1 < len(merged) and merged[k + 1]["page"] == c["page"]:
            out.append(merged[k + 1] | {"text": c["text"].strip() + "\n" + merged[k + 1]["text"].strip()})
            k += 2
        else:
            out.append(c)
            k += 1
    return [(c["id"], c["text"], c["page"], c["section"], c["kind"]) for c in out]


def test_text_chunks(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(150):
        kind = rnd.choice(["paragraph"] * 4 + ["list_item", "heading", "picture", "table"])
        said = rnd.choice(["", " ", "short", "WARNING: hot", "NOTE", "words of a sentence. " * rnd.randint(1, 8), "y" * 130])
        rows.append(element(k, kind, said, rnd.choice([1, 1, 1, 2, None]), rnd.choice([["S"], ["S"], ["S", "T"], []]), kind == "list_item" and rnd.random() < 0.5))
    got = documents.text_chunks(spark.createDataFrame(rows, ELEMENT), None, 60, 5).collect()
    got = sorted(got, key=lambda r: r["place"])
    assert [(r["chunk_id"], r["text"], r["page"], r["section_title"], r["preliminary"]) for r in got] == plain_chunks(rows)


class Seeing:
    """A vision model that answers by the kind of the prompt."""

    def __init__(self, **replies):
        self.replies, self.calls = replies, []

    def __call__(self, prompt, picture, how):
        kind = next(k for k, v in vision.CALLS.items() if v == how)
        self.calls.append((kind, prompt, picture is not None))
        reply = self.replies.get(kind, "")
        if reply is None:
            raise RuntimeError("down")
        return reply


def test_vision(spark):
    data = images.encode_png(pixels(300, 400))
    m = Seeing(caption="A flow chart.", details="a\na\n\nb", together=" It flows. ")
    assert vision.summary(data, m) == "It flows."
    assert m.calls[1][1] == vision.DETAILS["flowchart"] and "a\nb" in m.calls[2][1] and [c[2] for c in m.calls] == [True, True, False]
    assert vision.summary(data, Seeing(caption="Logo", details="words", together=None)) == "[Caption] Logo\n[OCR] words"
    assert vision.summary(data, Seeing(caption="Logo", details="Read all text in this image. No explanations", together="")) == "[Caption] Logo"
    assert vision.summary(data, Seeing(caption=None)) == ""
    small = Seeing(caption="A bar chart")
    vision.summary(images.encode_png(pixels(10, 10)), small)
    assert small.calls[1][1] == vision.READ
    e = spark.createDataFrame([("f", "e0", "picture", base64.b64encode(data).decode()), ("f", "e1", "picture", None), ("f", "e2", "paragraph", "x")], "name string, id string, type string, image string")
    assert [tuple(r) for r in vision.summaries(e, Seeing(caption="Logo", together="A logo.")).collect()] == [("f", "e0", "A logo.")]
    told = vision.narrator(Seeing(table="Sure, here:\nBelow is it\nThe pump has 3 kW."))
    assert one(spark, told(F.lit("| a |"), F.lit("S"))) == "The pump has 3 kW."
    assert one(spark, vision.narrator(Seeing(table=None))(F.lit("| a |"), F.lit(None).cast("string"))) is None


def test_languages(spark):
    said = {"the pump is in the room and it is hot": "EN", "die Pumpe ist nicht mit der Leitung": "DE", "la bomba y el motor que en una": "ES", "les pompes et le moteur dans une": "FR", "泵 在 房间 里": "ZH-TW", "": "EN", "123": "EN"}
    for s, want in said.items():
        assert one(spark, text.language_tag(text.detect_language(F.lit(s)))) == want


def test_faq_rows(spark):
    got = one(spark, tables.faq_rows(F.lit("go\n| Q | A | B |\n|---|\n| 1 |\n more | |\n||\n| 2 | x | y | z |\n\nlast")))
    assert (got["headers"], got["rows"]) == (["Q", "A", "B"], [["1\nmore", "", ""], ["", "", ""], ["2", "x", "y\nlast"]])
