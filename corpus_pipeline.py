"""A corpus pipeline: toxic documents go, one of each group of near copies stays, sources are mixed, the rest is packed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeworks.llm import ngram_join, packing, queries, source_mixing, toxicity
from lodeworks.llm.common import shared_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that op4 predicts to be toxic, with the columns of documents."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, docs, sf_dir))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each component that op9 finds."""
    return ngram_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as op2 takes them."""
    return source_mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of op10."""
    return packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", ngram_join_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No stage but the mixing can be told in SQL (a trained decoder, components, a vocabulary file).
ORACLE_SQL: dict[str, str] | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{home}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
