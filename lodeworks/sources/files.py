"""File sources: directory scans, manifests and CSV files."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem, strip, suffix

#: Suffixes by the way that they are read.
IMAGES = (".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp")
PIPELINE = (".pdf", ".docx", ".xlsx", ".csv", ".pptx", *IMAGES)
SOUND = (".wav", ".mp3", ".m4a", ".aac", ".ogg", ".flac", ".mp4", ".avi", ".mov")
PASSTHROUGH = (".md", ".markdown", ".adoc", ".asciidoc", ".tex", ".html", ".htm", ".xhtml", ".txt", ".text", ".vtt", *SOUND)
SUPPORTED = PIPELINE + PASSTHROUGH


def scan(spark: SparkSession, folder: str, names: DataFrame | None = None, recursive: bool = True) -> DataFrame:
    """(name, path, route, content) of all supported files in folder and, if recursive, below; of equal names the one of the largest path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(suffix(F.col("name")).isin(*SUPPORTED))
    if names is not None:
        files = files.join(names.select("name").distinct(), "name", "left_semi")
    last = files.groupBy("name").agg(F.max("path").alias("path"))
    route = F.when(suffix(F.col("name")).isin(*PIPELINE), "pipeline").otherwise("passthrough")
    return files.join(last, ["name", "path"], "left_semi").select("name", "path", route.alias("route"), "content")


def route(name: str) -> str:
    """pipeline or passthrough; a file of neither kind is refused."""
    kind = "." + name.lower().rpartition(".")[2]
    if kind not in SUPPORTED:
        raise ValueError(f"unsupported file {name}")
    return "pipeline" if kind in PIPELINE else "passthrough"


def manifest(files: DataFrame) -> DataFrame:
    return files.select("name", F.sha2("content", 256).alias("sha256"))


def texts(files: DataFrame, transcribe: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(name, stem, text) of passthrough files; markup loses its tags; blank ones go. Bytes that aren't UTF-8 become replacement
    characters. Sound and video need transcribe (name, content); without it they give nothing and are tried again."""
    heard = suffix(F.col("name")).isin(*SOUND)
    told = F.lit(None).cast("string") if transcribe is None else transcribe(F.col("name"), F.col("content"))
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    read = F.when(heard, told).when(suffix(F.col("name")).isin(".html", ".htm", ".xhtml"), bare).otherwise(raw)
    out = files.where("route = 'passthrough'").select("name", stem(F.col("name")).alias("stem"), strip(read).alias("text"))
    return out.where("text <> ''")


def csv_rows(content: bytes) -> list[list[str]]:
    """Stripped cells of a CSV file's rows that aren't blank; the dialect is guessed from its first 4096 characters."""
    text = content.decode("utf-8-sig", "replace")
    try:
        dialect = csv.Sniffer().sniff(text[:4096])
    except csv.Error:
        dialect = csv.excel
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), dialect)]
    return [r for r in rows if any(r)]
