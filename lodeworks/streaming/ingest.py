"""Incremental ingest: files that arrive are chunked once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import char_windows, exploded
from ..sources.store import Files, scratch


def chunk_stream(spark: SparkSession, path: str, size: int = 800, overlap: int = 80) -> DataFrame:
    """Chunks of all documents under path by a stream that ends when what is there has been read. The checkpoint of the
    stream and its sink lie in the shared folder."""
    home = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    files = Files(spark, path)
    if files.fs.getFileStatus(files.path).isDirectory():
        docs = spark.readStream.schema(schema).parquet(path)
    else:  # a stream watches a folder
        docs = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    chunks = exploded(docs, char_windows(F.col("text"), size, overlap), "doc_id")
    q = chunks.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("doc_id long, chunk_index int, chunk_text string").parquet(f"{home}/out")
