"""Tables of documents as chunks: profiles and comparisons of massive ones, a row of a list of questions each, parts of the others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, tables
from ..functions.text import let, strip, unit_hint

#: Fixed value: rows at the top among which the header is looked for.
HEADER_ROWS = 4


@dataclass(frozen=True)
class TableOptions:
    """Characters of a part of a table (0: whole), whether massive tables get chunks of their own, metrics of a profile, entities of
    a comparison and how many the next one shares, metrics of a comparison."""

    size: int = 0
    massive: bool = True
    profile: int = 40
    window: int = 4
    overlap: int = 1
    metrics: int = 36

    def __post_init__(self):
        for field, least in (("profile", 5), ("window", 2), ("overlap", 0), ("metrics", 8)):
            object.__setattr__(self, field, max(least, getattr(self, field)))


def padded(rows: Column) -> Column:
    """Stripped cells, all rows as wide as the widest."""
    width = F.array_max(F.transform(rows, F.size))
    return let(width, lambda n: F.transform(rows, lambda r: F.transform(F.concat(r, F.array_repeat(F.lit(""), n - F.size(r))), strip)))


def header_index(rows: Column) -> Column:
    """Place, from 0, of the first of the top rows with the most filled cells behind the first cell."""
    filled = F.transform(F.slice(rows, 1, HEADER_ROWS), lambda r: F.size(F.filter(r, lambda c, i: (i > 0) & (c != ""))))
    return let(filled, lambda f: F.array_position(f, F.array_max(f)).cast("int") - 1)


def canonical(rows: Column) -> Column:
    """The model of a table: header (its place), entities (place and name of each named column behind the first), data (metric, unit
    and a value for each entity, for rows with a metric and some value), sparse (nearly empty rows above the header)."""

    def model(grid: Column, header: Column) -> Column:
        named = F.transform(F.get(grid, header), lambda c, i: F.struct(i.alias("place"), c.alias("name")))
        entities = F.filter(named, lambda e: (e["place"] > 0) & (e["name"] != ""))

        def of(found: Column) -> Column:
            below = F.slice(grid, header + 2, F.greatest(F.size(grid) - header - 1, F.lit(0)))
            cells = F.transform(below, lambda r: F.struct(F.get(r, F.lit(0)).alias("metric"), F.transform(found, lambda e: F.get(r, e["place"])).alias("values")))
            kept = F.filter(cells, lambda d: (d["metric"] != "") & F.exists(d["values"], lambda v: v != ""))
            data = F.transform(kept, lambda d: F.struct(d["metric"].alias("metric"), unit_hint(d["metric"]).alias("unit"), d["values"].alias("values")))
            above = F.slice(grid, 1, header)
            few = F.greatest(F.lit(1), F.floor(F.size(F.get(grid, header)) / 4))
            sparse = F.size(F.filter(above, lambda r: F.size(F.filter(r, lambda c: c != "")) <= few))
            return F.struct(header.alias("header"), found.alias("entities"), data.alias("data"), sparse.alias("sparse"))

        return let(entities, of)

    whole = let(padded(rows), lambda grid: let(header_index(grid), lambda header: model(grid, header)))
    return F.when(F.size(rows) > 0, whole)


def is_massive(model: Column) -> Column:
    """Three entities and six rows at least, and a title above the header or eight entities. Rows without a metric are no data rows,
    so the share of rows with one is always full."""
    wide = F.size(model["entities"])
    return F.coalesce((wide >= 3) & (F.size(model["data"]) >= 6) & ((model["sparse"] >= 1) | (wide >= 8)), F.lit(False))


def profiles(massive: DataFrame, keep: list[str], options: TableOptions) -> DataFrame:
    """keep, entity_index, part, text and what the chunk holds: the filled metrics of one entity, options.profile at a time. massive
    has a model and a sheet_name."""
    one = massive.select(*keep, "model", "sheet_name", F.posexplode("model.entities").alias("entity_index", "entity"))
    value = lambda d: F.struct(d["metric"].alias("metric"), F.get(d["values"], F.col("entity_index")).alias("value"), d["unit"].alias("unit"))
    one = one.withColumn("pairs", F.filter(F.transform("model.data", value), lambda p: p["value"] != "")).where("size(pairs) > 0")
    starts = F.sequence(F.lit(0), F.size("pairs") - 1, F.lit(options.profile))
    one = one.select("*", F.posexplode(F.transform(starts, lambda s: F.slice("pairs", s + 1, F.lit(options.profile)))).alias("part", "few"))
    line = lambda p: F.concat(F.lit("- "), p["metric"], F.lit(": "), p["value"], F.coalesce(F.concat(F.lit(" ["), p["unit"], F.lit("]")), F.lit("")))
    sheet = F.when(F.coalesce("sheet_name", F.lit("")) == "", "(unknown)").otherwise(F.col("sheet_name"))
    head = F.concat(F.lit("Entity Profile: "), F.col("entity.name"), F.lit("\nSheet: "), sheet, F.lit("\nSource: (unknown)\n\n"))
    return one.select(
        *keep, "entity_index", "part", strip(F.concat(head, F.array_join(F.transform("few", line), "\n"))).alias("text"), F.col("entity.name").alias("entity_name"),
        F.concat(F.col("entity.name"), F.lit("::part_"), "part").alias("entity_group"), F.transform("few", lambda p: p["metric"]).alias("metric_keys"),
        F.size("model.data").alias("rows"), (F.size("model.entities") + 1).alias("cols"),
    )


def comparisons(massive: DataFrame, keep: list[str], options: TableOptions) -> DataFrame:
    """keep, comparison, text and what the chunk holds: tables of a window of entities, without rows that are blank there."""
    step = max(1, options.window - min(options.overlap, options.window - 1))
    starts = F.sequence(F.lit(0), F.size("model.entities") - 1, F.lit(step))
    groups = F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("model.entities", s + 1, F.lit(options.window)).alias("group")))
    one = massive.select(*keep, "model", F.explode(groups).alias("w")).select(*keep, "model", "w.s", "w.group").where("size(group) >= 2")
    named = lambda d: F.concat(d["metric"], F.coalesce(F.concat(F.lit(" ("), d["unit"], F.lit(")")), F.lit("")))
    row = lambda d: F.struct(d["metric"].alias("metric"), named(d).alias("named"), F.slice(d["values"], F.col("s") + 1, F.size("group")).alias("values"))
    first = F.slice("model.data", 1, options.metrics)
    one = one.withColumn("filled", F.filter(F.transform(first, row), lambda r: F.exists(r["values"], lambda v: v != ""))).where("size(filled) > 0")
    names = F.transform("group", lambda e: e["name"])
    head = F.array(tables.row_line(F.concat(F.array(F.lit("Metric")), names)), tables.row_line(F.array_repeat(F.lit("---"), F.size("group") + 1)))
    body = F.transform("filled", lambda r: tables.row_line(F.concat(F.array(r["named"]), r["values"])))
    number = F.row_number().over(Window.partitionBy(*keep).orderBy("s")) - 1
    return one.select(
        *keep, number.alias("comparison"), F.array_join(F.concat(head, body), "\n").alias("text"), names.alias("comparison_scope"),
        F.transform("filled", lambda r: r["metric"]).alias("metric_keys"), F.size("model.data").alias("rows"), (F.size("group") + 1).alias("cols"),
    )


CHUNK = (
    "name string, stem string, place array<int>, chunk_id string, text string, natural string, page int, section_title string, ocr_difficulty string, rows int, cols int, "
    "table_type string, chunk_type string, table_strategy string, entity_name string, entity_group string, sheet_name string, metric_keys array<string>, comparison_scope array<string>"
)
CHUNK_FIELDS = [tuple(f.split()) for f in CHUNK.split(", ")]


def shaped(df: DataFrame) -> DataFrame:
    """df with all columns of a table's chunk, null where it lacks them."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in CHUNK_FIELDS))


def table_chunks(elements: DataFrame, options: TableOptions = TableOptions(), narrate: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Chunks of all tables among elements (name, stem, seq, type, text, page, section_path, sheet_name, table_rows).

    A table is an element of that type, or a paragraph drawn with box characters. Tables are numbered in each file. narrate, where
    given, tells a table in sentences (text, section title); null keeps the Markdown."""
    drawn = F.col("type").isin("paragraph", "text") & tables.has_box_drawing(F.col("text"))
    found = elements.where(((F.col("type") == "table") | drawn) & (strip(F.col("text")) != ""))
    section = F.try_element_at("section_path", F.lit(-1))
    number = F.row_number().over(Window.partitionBy("name").orderBy("seq")) - 1
    found = found.select("name", "stem", "type", "text", "page", section.alias("section_title"), F.coalesce("sheet_name", section).alias("sheet_name"), "table_rows", number.alias("t"))
    grid = F.when(F.size(F.coalesce("table_rows", F.array().cast("array<array<string>>"))) > 0, F.col("table_rows")).otherwise(tables.markdown_to_rows(F.col("text")))
    found = found.withColumn("model", F.when(F.col("type") == "table", canonical(grid))) if options.massive else found
    massive = is_massive(F.col("model")) if options.massive else F.lit(False)
    keep = ["name", "stem", "t", "page", "sheet_name"]
    rows, cols = tables.dimensions(F.col("text"))
    plain = found.where(~massive).withColumns({"rows": rows, "cols": cols})
    plain = plain.withColumns({"ocr_difficulty": rules.difficulty(F.col("rows"), F.col("cols")), "table_type": tables.table_type(F.col("text"), F.col("cols"))}).drop("sheet_name")
    base = F.concat(F.col("stem"), F.lit("_table_"), "t")

    faq = tables.faq_rows(F.col("text"))
    asked = plain.where("table_type = 'faq'").withColumn("faq", faq)
    asked = asked.select("*", F.posexplode("faq.rows").alias("r", "cells")).withColumn("text", tables.faq_text(F.col("faq.headers"), F.col("cells"))).where(strip(F.col("text")) != "")
    asked = asked.withColumn("r", F.row_number().over(Window.partitionBy("name", "t").orderBy("r")) - 1)
    asked = asked.withColumns({"chunk_id": F.concat(base, F.lit("_row_"), "r"), "place": F.array("t", "r")})

    parted = plain.where("table_type <> 'faq'").withColumn("parts", tables.split_rows(F.col("text"), options.size))
    parted = parted.select("*", F.posexplode("parts").alias("r", "part")).withColumn("text", F.col("part"))
    told = F.lit(None).cast("string") if narrate is None else narrate(F.col("text"), F.col("section_title"))
    parted = parted.withColumns({"chunk_id": F.when(F.size("parts") == 1, base).otherwise(F.concat(base, F.lit("_part_"), "r")), "place": F.array("t", "r"), "natural": told})
    out = shaped(asked).unionByName(shaped(parted))
    if options.massive:
        large = found.where(massive)
        each = profiles(large, keep, options).withColumns({"chunk_id": F.concat(base, F.lit("_entity_"), "entity_index", F.lit("_part_"), "part"), "chunk_type": F.lit("entity_profile"), "place": F.array("t", F.lit(0), "entity_index", "part")})
        side = comparisons(large, keep, options).withColumns({"chunk_id": F.concat(base, F.lit("_comparison_"), "comparison"), "chunk_type": F.lit("table_comparison"), "place": F.array("t", F.lit(1), "comparison")})
        for df in (each, side):
            df = df.withColumns({"ocr_difficulty": rules.difficulty(F.col("rows"), F.col("cols")), "table_type": F.lit("massive"), "table_strategy": F.lit("massive_entity_profile"), "section_title": F.col("sheet_name")})
            out = out.unionByName(shaped(df))
    return out
