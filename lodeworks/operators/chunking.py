"""Chunkers: one text to many windows, in closed form, and merges of neighbouring chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, strip, words

#: Where a long text may be cut, from the best place to the worst.
SEPARATORS = ("\n\n", "\n", "。", ".", "！", "!", "？", "?", "；", ";", "：", ":", " ", "")


def check_window(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must be at least 0 and less than size {size}")


def starts(n: Column, size: int, overlap: int) -> Column:
    """Offsets of windows over n items: none for none, else up to the first that reaches the end."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda k: k * step))


def char_windows(text: Column, size: int = 800, overlap: int = 80) -> Column:
    """The text is cut once into pieces of a step each, and a window joins those that it reaches over: time grows with the length."""
    check_window(size, overlap)
    step = size - overlap
    reach = -(-size // step)

    def windows(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
        return let(
            pieces,
            lambda p: F.transform(
                starts(F.length(t), size, overlap),
                lambda s: F.substring(F.array_join(F.slice(p, (s / step).cast("int") + 1, F.lit(reach)), ""), 1, size),
            ),
        )

    return let(text, windows)


def word_windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Windows of words joined by one space; a text of at most size words stays as it is, stripped."""
    check_window(size, overlap)

    def windows(w: Column) -> Column:
        many = F.transform(starts(F.size(w), size, overlap), lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= size, F.array(strip(text))).otherwise(many)

    return let(words(text), windows)


def sentence_windows(text: Column, size: int = 10, overlap: int = 2) -> Column:
    check_window(size, overlap)

    def windows(s: Column) -> Column:
        many = F.transform(starts(F.size(s), size, overlap), lambda k: F.array_join(F.slice(s, k + 1, F.lit(size)), " "))
        return F.when(F.size(s) <= size, F.array(strip(text))).otherwise(many)

    return let(F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda x: x != ""), windows)


def cut_at_separators(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts of at most size characters, cut before the best separator that the text holds; what is still too long is cut at the
    next one. Neighbouring short pieces share a part, and a part starts with as much of the last one as overlap lets."""
    at = next(k for k, s in enumerate(separators) if s in text)
    mark, finer = separators[at], separators[at + 1 :]
    pieces = [p for p in re.split(f"(?={re.escape(mark)})", text) if p] if mark else list(text)
    out: list[str] = []
    part: list[str] = []

    def close() -> None:
        whole = "".join(part).strip()
        if whole:
            out.append(whole)

    for piece in pieces:
        if len(piece) >= size and finer:
            close()
            part = []
            out += cut_at_separators(piece, size, overlap, finer)
            continue
        room = size - len(piece)
        if sum(map(len, part)) > room:
            close()
            while part and (sum(map(len, part)) > overlap or sum(map(len, part)) > room):
                del part[0]
        part.append(piece)
    close()
    return out


def separator_windows(text: Column, size: int = 800, overlap: int = 80) -> Column:
    """Windows of text cut at separators; no closed form, so it runs in Arrow batches."""
    check_window(size, overlap)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [] if t is None else cut_at_separators(t, size, overlap) if t else [])

    return run(text)


def exploded(df: DataFrame, windows: Column, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(windows).alias("chunk_index", "chunk_text"))


def element_groups(elements: DataFrame, doc: str, order: str, kind: Column, section: Column, page: Column | None = None) -> DataFrame:
    """elements with grp: runs of text of one section and page; headings and pictures stand alone, other kinds break runs."""
    w = Window.partitionBy(doc).orderBy(order)
    page = F.lit(None).cast("int") if page is None else page
    e = elements.withColumns({"kind_": kind, "section_": section, "page_": page})
    alone = ~F.col("kind_").isin("paragraph", "list_item")
    last = lambda c: F.lag(c).over(w)
    moved = ~F.col("section_").eqNullSafe(last("section_")) | ~F.col("page_").eqNullSafe(last("page_"))
    fresh = alone | last("kind_").isNull() | ~last("kind_").isin("paragraph", "list_item") | moved
    e = e.withColumn("fresh", fresh.cast("int"))
    return e.withColumn("grp", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("kind_", "section_", "page_", "fresh")


def ordered_join(order: Column | str, text: Column | str, separator: str) -> Column:
    """An aggregate: texts joined in order."""
    order, text = (F.col(c) if isinstance(c, str) else c for c in (order, text))
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), separator)


def merge_short(chunks: DataFrame, doc: str, order: str, text: str, section: str, ptype: str | None = None, page: str | None = None, short: int = 80, limit: int = 400) -> DataFrame:
    """(doc, first, text, merged): runs of short one-line chunks of a section and page joined by ' | ' while they stay under limit.

    The fold needs a run of short chunks in order. Chunks that are not short end every run, so the fold goes over one run at a
    time, and only the chunks of a run are gathered."""
    small = (F.length(strip(F.col(text))) < short) & ~strip(F.col(text)).contains("\n")
    if ptype is not None:
        small = small & (F.col(ptype) != "procedure_step")
    place = F.struct(F.col(section).alias("s"), (F.lit(None).cast("int") if page is None else F.col(page)).alias("p"))
    c = chunks.select(doc, F.col(order).cast("long").alias("o_"), F.col(text).alias("raw_"), small.alias("small_"), place.alias("place_"))
    w = Window.partitionBy(doc).orderBy("o_")
    breaks = ~F.col("small_") | F.lag("small_").over(w).isNull() | ~F.lag("small_").over(w) | ~F.col("place_").eqNullSafe(F.lag("place_").over(w))
    c = c.withColumn("run_", F.sum(breaks.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct(F.col("o_").alias("o"), F.col("raw_").alias("raw"), strip(F.col("raw_")).alias("t"))
    runs = c.groupBy(doc, "run_").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    unit = "struct<first:bigint,text:string,merged:bigint,total:int>"
    zero = F.struct(F.array().cast(f"array<{unit}>").alias("done"), F.lit(None).cast(unit).alias("now"))

    def step(s: Column, r: Column) -> Column:
        now, n = s["now"], F.length(r["t"])
        joins = now.isNotNull() & (now["total"] + 3 * now["merged"] + n < limit)
        fresh = F.struct(r["o"].alias("first"), r["raw"].alias("text"), F.lit(1).cast("long").alias("merged"), n.alias("total"))
        joined = F.concat(strip(now["text"]), F.lit(" | "), r["t"])
        more = F.struct(now["first"].alias("first"), joined.alias("text"), (now["merged"] + 1).alias("merged"), (now["total"] + n).alias("total"))
        done = F.when(joins | now.isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(now)))
        return F.struct(done.alias("done"), F.when(joins, more).otherwise(fresh).cast(unit).alias("now"))

    out = F.aggregate("rows", zero, step, lambda s: F.concat(s["done"], F.array(s["now"])))
    return runs.select(doc, F.explode(out).alias("c")).select(doc, F.col("c.first").alias("first"), F.col("c.text").alias("text"), F.col("c.merged").alias("merged"))


def merge_warnings(chunks: DataFrame, doc: str, order: str, text: str, page: Column | None = None) -> DataFrame:
    """chunks without the short warnings that the chunk behind them takes over; of a run of warnings every second one is taken over too."""
    w = Window.partitionBy(doc).orderBy(order)
    c = chunks.withColumn("page_", F.lit(0) if page is None else page)
    short = (F.length(strip(F.col(text))) < 50) & F.col(text).rlike(r"\b(DANGER|WARNING|CAUTION|NOTICE|NOTE)\b")
    follows = F.lead("page_").over(w).eqNullSafe(F.col("page_")) & F.lead(F.lit(1)).over(w).isNotNull()
    c = c.withColumn("warn", short & follows)
    plain = (~F.col("warn")).cast("int")
    c = c.withColumn("run", F.sum(plain).over(w.rowsBetween(Window.unboundedPreceding, 0)) - plain)
    run = Window.partitionBy(doc, "run").orderBy(order)
    c = c.withColumn("pos", F.row_number().over(run) - 1).withColumn("head", F.col("warn") & (F.col("pos") % 2 == 0))
    taken = F.coalesce(F.lag("head").over(w), F.lit(False))
    joined = F.concat(strip(F.lag(text).over(w)), F.lit("\n"), strip(F.col(text)))
    c = c.withColumn("joined", F.when(taken, joined).otherwise(F.col(text)))
    return c.where(~F.col("head")).withColumn(text, F.col("joined")).drop("page_", "warn", "run", "pos", "head", "joined")
