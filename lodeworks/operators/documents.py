"""Chunks of a document's elements: text in groups, tables, and one schema for both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.ids import content_hash
from ..functions.text import context_prefix, detect_language, language_tag, strip
from . import chunking

#: Kinds of elements that text chunks are made of.
SPOKEN = ("paragraph", "heading", "list_item", "picture")
CHUNK = (
    "name string, place array<int>, chunk_id string, source string, chunk_type string, chunk_text_original string, chunk_text_embedded string, chunk_text_raw string, "
    "page_number int, section_title string, language string, chunk_hash string, ocr_difficulty string, rows int, cols int, table_type string, table_strategy string, "
    "entity_name string, entity_group string, sheet_name string, metric_keys array<string>, comparison_scope array<string>"
)
CHUNK_FIELDS = [tuple(f.split()) for f in CHUNK.split(", ")]


def with_summaries(elements: DataFrame, summaries: DataFrame | None) -> DataFrame:
    """elements whose pictures say their summary (name, id, summary), or where on which page they stand."""
    if summaries is None:
        summaries = elements.sparkSession.createDataFrame([], "name string, id string, summary string")
    said = elements.join(summaries, ["name", "id"], "left")
    place = F.when(F.col("page").isNull(), "[Image]").otherwise(F.concat(F.lit("[Image on page "), "page", F.lit("]")))
    shown = F.when(strip(F.coalesce("summary", F.lit(""))) != "", strip(F.col("summary"))).otherwise(place)
    return said.withColumn("text", F.when(F.col("type") == "picture", shown).otherwise(F.col("text"))).drop("summary")


def text_chunks(elements: DataFrame, summaries: DataFrame | None = None, size: int = 800, overlap: int = 80) -> DataFrame:
    """(name, stem, place, chunk_id, text, page, section_title, preliminary) of the text and pictures among elements.

    Runs of text of one section and page are joined and cut into windows, plain text at separators; headings alone give no chunk. Then
    short neighbours are joined, and short warnings go to the chunk behind them."""
    e = with_summaries(elements, summaries)
    e = chunking.element_groups(e, "name", "seq", F.col("type"), F.col("section_path"), F.col("page"))
    first = F.min(F.struct("seq", "type", "page", "section_path", "ordered", "stem")).alias("f")
    filled = F.when(strip(F.col("text")) != "", F.col("text"))
    joined = e.where(F.col("type").isin(*SPOKEN)).groupBy("name", "grp").agg(first, chunking.ordered_join("seq", filled, "\n").alias("block"))
    joined = joined.where((F.col("f.type") != "heading") & (strip(F.col("block")) != ""))
    kind = rules.preliminary_type(F.col("f.type"), F.col("f.ordered"))
    joined = joined.select("name", "f.stem", "grp", "block", "f.page", F.try_element_at("f.section_path", F.lit(-1)).alias("section_title"), kind.alias("preliminary"))
    fine = (F.length("block") > size) & (F.col("preliminary") == "text")
    windows = F.when(fine, chunking.separator_windows(F.when(fine, F.col("block")), size, overlap)).otherwise(chunking.char_windows(F.col("block"), size, overlap))
    raw = joined.withColumn("windows", windows).select("*", F.posexplode("windows").alias("k", "text")).where(strip(F.col("text")) != "")
    raw = raw.withColumn("i", F.row_number().over(Window.partitionBy("name").orderBy("grp", "k")) - 1)
    raw = raw.select("name", "stem", "i", "text", "page", "section_title", "preliminary")
    short = chunking.merge_short(raw, "name", "i", "text", "section_title", "preliminary", "page")
    merged = raw.drop("text").join(short.withColumnRenamed("first", "i"), ["name", "i"])
    many = F.col("merged") > 1
    number = F.sum(many.cast("int")).over(Window.partitionBy("name").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    ids = F.when(many, F.concat("stem", F.lit("_merged_"), number)).otherwise(F.concat_ws("_", "stem", "i"))
    merged = merged.withColumns({"chunk_id": ids, "preliminary": F.when(many, "text").otherwise(F.col("preliminary"))})
    out = chunking.merge_warnings(merged, "name", "i", "text", F.col("page"))
    return out.select("name", "stem", F.array("i").alias("place"), "chunk_id", "text", "page", "section_title", "preliminary")


def unified(text: DataFrame, tables: DataFrame | None = None, language: Callable[[Column], Column] = detect_language) -> DataFrame:
    """Both kinds of chunks with one schema: type, prefix, language and hash; of a table that is told in sentences these count, its
    Markdown stays beside them. In order of (name, source, place)."""

    def told(df: DataFrame, said: Column, source: str, **more: Column) -> DataFrame:
        prefix = context_prefix(F.col("stem"), F.col("section_title"), F.col("page"))
        df = df.withColumn("chunk_text_original", said)
        embedded = F.concat(prefix, F.lit("\n"), F.col("chunk_text_original"))
        known = {"source": F.lit(source), "chunk_text_embedded": embedded, "page_number": F.col("page"), "language": language_tag(language(F.col("chunk_text_original"))), "chunk_hash": content_hash(F.col("chunk_text_original"))}
        df = df.withColumns(known | more)
        return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in CHUNK_FIELDS))

    kind = F.when(F.col("preliminary").isin("picture", "procedure_step"), F.col("preliminary")).otherwise("text")
    out = told(text, F.col("text"), "chunk", chunk_type=kind)
    if tables is None:
        return out
    natural = F.when(F.coalesce("natural", F.lit("")) != "", F.col("natural")).otherwise(F.col("text"))
    return out.unionByName(told(tables, natural, "table", chunk_text_raw=F.col("text"), chunk_type=F.coalesce("chunk_type", F.lit("parts_table"))))


def passthrough_chunks(texts: DataFrame, size: int = 800, overlap: int = 80) -> DataFrame:
    """Chunks of plain files (name, stem, text)."""
    c = chunking.exploded(texts, chunking.char_windows(F.col("text"), size, overlap), "name", "stem")
    c = c.select("name", "stem", F.array("chunk_index").alias("place"), F.concat_ws("_", "stem", "chunk_index").alias("chunk_id"), F.col("chunk_text").alias("text"))
    return unified(c.withColumns({"page": F.lit(None).cast("int"), "section_title": F.lit(None).cast("string"), "preliminary": F.lit("text")}))
