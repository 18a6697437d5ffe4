"""Markdown tables: rendering, parsing, measuring and classifying, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

FAQ_WORDS = ("question", "answer", "q&a", "faq", "| q |", "| a |")
Q_HEADERS = ("q", "question", "questions", "問題")
A_HEADERS = ("a", "answer", "answers", "答案", "回答", "solution", "solutions", "description")
#: A separator row: only these characters, and a dash.
RULE = r"^[|\-:+ ]+$"


def row_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def rows_to_markdown(rows: Column) -> Column:
    """Rows padded to the widest; the first is the header."""

    def render(width: Column) -> Column:
        lines = F.transform(rows, lambda r: row_line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
        rule = row_line(F.array_repeat(F.lit("---"), width))
        return let(lines, lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.array(rule), F.slice(x, 2, F.greatest(F.size(x), F.lit(1)))), "\n"))

    return F.when(F.size(rows) == 0, "").otherwise(let(F.array_max(F.transform(rows, F.size)), render))


def grid_to_markdown(item: dict) -> str:
    """The table of a converted document's item; its text where it has no grid or a broken one."""
    try:
        rows = [[cell.get("text") or "" for cell in row] for row in item.get("data", {}).get("grid", [])]
    except (AttributeError, TypeError):
        rows = []
    if not rows:
        return item.get("text") or ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def lines_of(md: Column) -> Column:
    return F.transform(F.split(md, "\n"), strip)


def is_rule(line: Column) -> Column:
    return line.rlike(RULE) & line.contains("-")


def cells_of(line: Column) -> Column:
    """Cells without the empty outer ones."""
    cells = F.transform(F.split(line, r"\|"), strip)
    cells = F.when(F.element_at(cells, 1) == "", F.slice(cells, 2, F.size(cells))).otherwise(cells)
    return F.when((F.size(cells) > 0) & (F.try_element_at(cells, F.lit(-1)) == ""), F.slice(cells, 1, F.greatest(F.size(cells) - 1, F.lit(0)))).otherwise(cells)


def markdown_to_rows(md: Column) -> Column:
    kept = F.filter(lines_of(md), lambda x: x.startswith("|") & ~is_rule(x))
    return F.transform(kept, cells_of)


def dimensions(md: Column) -> tuple[Column, Column]:
    """Rows and columns of what looks like a table; rows of only |, + and - don't count."""
    lines = F.filter(lines_of(md), lambda x: x.contains("|") & ~F.regexp_replace(x, " ", "").rlike(r"^[|+\-]*$"))
    counts = F.filter(F.transform(lines, lambda x: F.size(F.filter(F.split(x, r"\|"), lambda c: strip(c) != ""))), lambda n: n > 0)
    return F.size(counts), F.coalesce(F.array_max(counts), F.lit(0))


def table_type(md: Column, cols: Column) -> Column:
    content = F.filter(lines_of(md), lambda x: x.contains("|") & ~is_rule(x))
    header, data = F.lower(F.try_element_at(content, F.lit(1))), F.slice(content, 2, F.greatest(F.size(content), F.lit(1)))
    asks = F.lit(False)
    for w in FAQ_WORDS:
        asks = asks | header.contains(w)
    share = F.size(F.filter(data, lambda x: x.contains("?"))) / F.size(data)
    cells = F.flatten(F.transform(data, lambda x: F.slice(F.filter(F.transform(F.split(x, r"\|"), strip), lambda c: c != ""), 2, 1 << 20)))
    mean = F.aggregate(cells, F.lit(0), lambda s, c: s + F.length(c)) / F.size(cells)
    some = F.size(data) > 0
    return F.when(F.size(content) == 0, "general").when(asks, "faq").when(some & (share > 0.3), "faq").when((cols >= 3) & some & (F.size(cells) > 0) & (mean < 30), "spec").otherwise("general")


def faq_rows(md: Column) -> Column:
    """headers and rows of a table: rows are as wide as the headers, and lines that don't begin with a bar go on with the last filled
    cell of the row above."""
    unit = "struct<headers:array<string>,rows:array<array<string>>>"
    start = F.struct(F.array().cast("array<string>").alias("headers"), F.array().cast("array<array<string>>").alias("rows")).cast(unit)

    def add(s: Column, line: Column) -> Column:
        width = F.size(s["headers"])

        def row(cells: Column) -> Column:
            wide = F.slice(F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)))), 1, width)
            first = F.struct(cells.alias("headers"), s["rows"].alias("rows"))
            return F.when(F.size(cells) == 0, s).when(width == 0, first).otherwise(F.struct(s["headers"].alias("headers"), F.concat(s["rows"], F.array(wide)).alias("rows")))

        def more(said: Column) -> Column:
            last = F.try_element_at(s["rows"], F.lit(-1))
            at = F.array_max(F.filter(F.transform(last, lambda c, i: F.when(c != "", i)), lambda i: i.isNotNull()))
            longer = F.transform(last, lambda c, i: F.when(i == at, F.concat(c, F.lit("\n"), said)).otherwise(c))
            rows = F.concat(F.slice(s["rows"], 1, F.greatest(F.size(s["rows"]) - 1, F.lit(0))), F.array(longer))
            return F.when((F.size(s["rows"]) == 0) | (said == ""), s).otherwise(F.struct(s["headers"].alias("headers"), rows.alias("rows")))

        tail = strip(F.regexp_replace(line, r"[| ]+$", ""))
        return F.when(line.startswith("|"), let(cells_of(line), row)).otherwise(let(tail, more))

    kept = F.filter(lines_of(md), lambda x: (x != "") & ~(x.startswith("|") & is_rule(x)))
    return F.aggregate(kept, start, add)


def faq_text(headers: Column, row: Column) -> Column:
    """Q and A of a row by its headers' names (the last that fits), else by place; blank if there is no answer."""

    def last(names: tuple[str, ...]) -> Column:
        hits = F.transform(headers, lambda h, i: F.when(F.lower(strip(h)).isin(*names), i + 1))
        return F.array_max(F.filter(hits, lambda i: i.isNotNull()))

    q, a = last(Q_HEADERS), last(A_HEADERS)
    n, both = F.size(headers), q.isNotNull() & a.isNotNull()
    q = F.when(both, q).when(n == 2, 1).when(n >= 3, 2).otherwise(1)
    a = F.when(both, a).when(n == 2, 2).when(n >= 3, 3).otherwise(1)
    qt, at = (F.coalesce(strip(F.try_element_at(row, i)), F.lit("")) for i in (q, a))
    return F.when((qt != "") & (at != ""), F.concat(F.lit("Q: "), qt, F.lit("\nA: "), at)).otherwise(at)


def has_box_drawing(text: Column) -> Column:
    """Three box characters in a row, or more than 15 % of the text."""
    boxes = F.length(text) - F.length(F.regexp_replace(text, "[─-╿]", ""))
    return text.rlike("[─-╿]{3}") | ((F.length(text) > 0) & (boxes / F.length(text) > 0.15))


def split_rows(md: Column, limit: int, spare: int = 0, spare_whole: int = 0) -> Column:
    """Parts of a table of at most limit characters where rows allow, each with header and separator. spare characters of each part
    are left free, spare_whole of a table that stays whole."""
    empty = F.array().cast("array<string>")

    def parts(lines: Column, fixed: Column) -> Column:
        start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("now"), fixed.alias("size"))

        def add(s: Column, row: Column) -> Column:
            cost = F.length(row) + 1
            full = (s["size"] + cost > limit) & (F.size(s["now"]) > 0)
            return F.struct(
                F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
                F.when(full, F.array(row)).otherwise(F.concat(s["now"], F.array(row))).alias("now"),
                F.when(full, fixed + cost).otherwise(s["size"] + cost).cast("int").alias("size"),
            )

        rows = F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1)))
        groups = F.aggregate(rows, start, add, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))
        return let(F.slice(lines, 1, 2), lambda head: F.transform(groups, lambda g: F.array_join(F.concat(head, g), "\n")))

    def split(whole: Column) -> Column:
        def cut(lines: Column) -> Column:
            fixed = (F.length(F.element_at(lines, 1)) + F.length(F.try_element_at(lines, F.lit(2))) + 2 + spare).cast("int")
            return F.when(F.size(lines) <= 3, F.array(whole)).otherwise(let(fixed, lambda n: parts(lines, n)))

        lines = F.filter(F.split(whole, "\n"), lambda x: strip(x) != "")
        return F.when((F.length(whole) + spare_whole <= limit) | (F.lit(limit) <= 0), F.array(whole)).otherwise(let(lines, cut))

    return let(md, split)
