"""Mixing sources to target weights. Native: DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Ranges of hash keys that a source is dealt over; each range is sorted and summed on its own.
RANGES = 1024
#: A document counts as its words, runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def targets(totals: DataFrame, epochs: int = 3) -> DataFrame:
    """Totals (source, source_size) with target, the words that the mix wants of each source.

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3... A target stops at epochs times the source's
    size and the excess is shared again by weight: the level at which targets are min(cap, level * weight). One row
    per source, so the windows without a key are small.
    """
    by_name, by_cap = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("ratio", "place")
    every = Window.partitionBy()
    t = totals.withColumn("place", F.row_number().over(by_name)).withColumn("weight", (F.col("place") - 1) % 3 + 1)
    t = t.withColumn("ratio", F.lit(float(epochs)) * F.col("source_size") / F.col("weight"))
    smaller = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"all_size": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every)})
    t = t.withColumns({f"capped_{c}": F.coalesce(F.sum(f).over(smaller), F.lit(0)) for c, f in (("size", "source_size"), ("weight", "weight"))})
    # With all sources of a smaller ratio at their caps, the level that shares the rest; it holds from the first source above it.
    t = t.withColumn("level", (F.col("all_size") - F.lit(float(epochs)) * F.col("capped_size")) / (F.col("all_weight") - F.col("capped_weight")))
    t = t.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "level"))).over(every)["level"])
    shared = F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")
    return t.select("source", "source_size", F.least(F.lit(float(epochs)) * F.col("source_size"), shared).alias("target"))


def hash_key(seed: str = "mix") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def ranged(docs: DataFrame, seed: str, ranges: int, *extra: Column) -> DataFrame:
    """doc_id, source, size, key, range, part of each document, and what else is asked for. Rows without a doc_id share one
    key, so their range has a part for each of their sizes, between those for smaller and for larger keys."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"), hash_key(seed).alias("key"), *extra)
    place = F.floor(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * ranges / F.lit(1 << 24)).cast("int")
    lost = hashlib.md5(f"{seed}:null".encode()).hexdigest()
    part = F.when(F.col("doc_id").isNull(), F.col("size") + 1).when(F.col("key") <= lost, F.lit(0)).otherwise(F.lit(1 << 62))
    return sized.withColumns({"range": place, "part": part.cast("long")})


def planned(sized: DataFrame, epochs: int, *extra: str) -> DataFrame:
    """The rows of ranged with source_size, target, taken."""
    sums = cut(sized.groupBy("source", "range", "part").agg(F.sum("size").alias("range_size")))
    goal = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), epochs)
    by_range = Window.partitionBy("source").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("range_size").over(by_range) - F.col("range_size")
    # hash ranges hold a share of a hot source each, so the join's key is not hot
    starts = sums.withColumn("range_start", before).alias("s").join(goal.alias("g"), F.expr("s.source <=> g.source"))
    starts = starts.select("s.source", "s.range", "s.part", "range_start", "source_size", "target")
    d = sized.alias("d").join(starts.alias("s"), F.expr("d.source <=> s.source and d.range = s.range and d.part = s.part"))
    d = d.select("doc_id", "d.source", "d.range", "d.part", "key", "size", "range_start", "source_size", "target", *extra)
    w = Window.partitionBy("source", "range", "part").orderBy("key", F.asc_nulls_last("doc_id"), "size", *extra[:1])
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("start", F.col("range_start") + F.sum("size").over(w) - F.col("size"))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return d.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *extra)


def mix_sources(docs: DataFrame, seed: str = "mix", epochs: int = 3, ranges: int = RANGES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words that the mix takes).

    Each source is ordered by a hash of doc_id, then by size; taken words stop at exactly the whole part of
    the target, cutting the last document, after whole epochs where a target exceeds its source. Prefix sums are
    distributed: sums of hash ranges first, then inside each range. Null texts and empty texts have size 0 and nothing
    taken; a null source is a source of its own; rows that repeat are documents of their own; no rows give no rows.
    """
    return planned(cut(ranged(docs, seed, ranges)), epochs)


def apply_mix(docs: DataFrame, seed: str = "mix", epochs: int = 3, ranges: int = RANGES) -> DataFrame:
    """The mixed documents, with the columns of docs: a document taken k times stands there k times; a part of one
    that the budget cuts stands there as its first words. Documents of which nothing is taken are left out.

    What is taken travels with its row, so rows that repeat a doc_id or have none are dealt with each on its own, as in
    mix_sources, and columns may have any names. Rows alike in doc_id and size may change places with each other."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    mark = F.xxhash64(F.coalesce("text", F.lit("")).cast("string")).alias("mark")
    d = planned(cut(ranged(docs, seed, ranges, mark, row)), epochs, "mark", "row").where("taken > 0")
    d = d.select("row", "size", "taken", F.floor(F.col("taken") / F.col("size")).alias("whole"))
    d = d.withColumn("rest", F.col("taken") - F.col("whole") * F.col("size"))
    copies = F.sequence(F.lit(1), F.when(F.col("rest") > 0, F.col("whole") + 1).otherwise(F.col("whole")))
    d = d.withColumn("copy", F.explode(copies)).withColumn("part", F.col("copy") > F.col("whole"))
    words = F.split(F.regexp_replace(F.col("row.text"), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    d = d.withColumn("head", F.when(F.col("part"), F.array_join(F.slice(words, F.lit(1), F.col("rest").cast("int")), " ")))
    out = {"text": F.coalesce("head", "row.text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("part"), F.length("head").cast(kind)).otherwise(F.col("row.n_chars"))
    return d.select(*(out.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
