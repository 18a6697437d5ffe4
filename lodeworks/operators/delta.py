"""Incremental state: what changed between two manifests, and what that means for an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delta(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, status): new, modified, deleted or unchanged, from manifests (name, sha256)."""
    d, s = disk.select("name", F.col("sha256").alias("d")), stored.select("name", F.col("sha256").alias("s"))
    status = F.when(F.col("s").isNull(), "new").when(F.col("d").isNull(), "deleted").when(F.col("d") != F.col("s"), "modified").otherwise("unchanged")
    return d.join(s, "name", "full_outer").select("name", status.alias("status"))


def index_status(disk: DataFrame, stored: DataFrame, have_manifest: bool = True) -> DataFrame:
    """One row: not_indexed, indexed or new_docs; deleted files don't count."""
    if not have_manifest:
        return disk.sparkSession.range(1).select(F.lit("not_indexed").alias("index_status"))
    j = disk.alias("d").join(stored.alias("s"), "name", "left").select((F.col("s.sha256").isNull() | (F.col("s.sha256") != F.col("d.sha256"))).alias("fresh"))
    return j.agg(F.when(F.coalesce(F.bool_or("fresh"), F.lit(False)), "new_docs").otherwise("indexed").alias("index_status"))


def next_manifest(disk: DataFrame, changes: DataFrame, loaded: DataFrame) -> DataFrame:
    """The manifest to store: files that changed but failed to load stay out, so they are tried again."""
    failed = changes.where("status in ('new', 'modified')").join(loaded.select("name"), "name", "left_anti").select("name")
    return disk.join(failed, "name", "left_anti")


def cache_hits(cached: DataFrame, current: DataFrame) -> DataFrame:
    """(name, hit): whether the sets of chunk hashes agree and aren't empty."""
    sets = [df.groupBy("name").agg(F.array_sort(F.collect_set("chunk_hash")).alias(c)) for df, c in ((current, "now"), (cached, "old"))]
    return sets[0].join(sets[1], "name", "left").select("name", F.coalesce((F.size("now") > 0) & (F.col("now") == F.col("old")), F.lit(False)).alias("hit"))
