"""Answer quality: question sets, samples of a collection's answers, judged by metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

#: Characters of a context and of an answer that a metric reads, and how many contexts; the name of the category field.
READ, CONTEXTS, CATEGORY = 1200, 3, "子分類"
QUESTIONS = f"user_input string, reference string, `{CATEGORY}` string"
#: A metric of a sample (user_input, response, retrieved_contexts, reference); it may raise.
Metric = Callable[[dict], float]


def load_questions(spark: SparkSession, folder: str, collection: str) -> DataFrame:
    """(file, question, ground_truth, category) of all files {collection}_*.json, stripped, without blank questions. In order of the
    files' names and of the questions in each."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"{collection}_*.json").load(folder)
    items = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.posexplode(F.from_json(F.col("content").cast("string"), f"array<struct<{QUESTIONS.replace(' string', ':string')}>>")).alias("at", "x"))
    said = lambda c: strip(F.coalesce(F.col(f"x.`{c}`"), F.lit("")))
    out = items.select("file", "at", said("user_input").alias("question"), said("reference").alias("ground_truth"), said(CATEGORY).alias("category"))
    return out.where("question <> ''").orderBy("file", "at").drop("at")


def samples(collection, questions: DataFrame, k: int = 5) -> list[dict]:
    """What a collection answers to each question, with the contexts found. One search and one answer a question, as a user would ask."""
    out = []
    for q in questions.collect():
        reply = collection.answer(q["question"], "vector", k)
        contexts = [s["full_text"] for s in reply["sources"] if s["full_text"]]
        out.append({"user_input": q["question"], "response": reply["answer"], "retrieved_contexts": contexts, "reference": q["ground_truth"]})
    return out


def shortened(sample: dict) -> dict:
    """What a metric reads of a sample."""
    contexts = [c[:READ] for c in (sample["retrieved_contexts"] or [])[:CONTEXTS]]
    return sample | {"response": (sample["response"] or "")[:READ], "retrieved_contexts": contexts}


def judged(found: list[dict], metrics: dict[str, Metric]) -> list[dict]:
    """A row a sample with each metric's value; null, with the error beside it, where a metric fails."""
    rows = []
    for sample in found:
        row = {"user_input": sample["user_input"], "reference": sample["reference"]}
        for name, metric in metrics.items():
            try:
                row[name] = float(metric(shortened(sample)))
            except Exception as error:  # one failed judgement is no failed run
                row |= {name: None, f"_{name}_error": repr(error)}
        rows.append(row)
    return rows


def means(rows: DataFrame, *metrics: str) -> DataFrame:
    """The mean of each metric over the rows that have a value; null if none has."""
    value: Callable[[str], Column] = lambda m: F.avg(F.col(m)).alias(m)
    return rows.agg(*map(value, metrics))


def word_recall(sample: dict) -> float:
    """A metric without a model: the share of the reference's words that the answer holds."""
    want = set(sample["reference"].lower().split())
    if not want:
        raise ValueError("no reference")
    return len(want & set(sample["response"].lower().split())) / len(want)
