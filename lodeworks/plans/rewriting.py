"""Questions in other words before the search: a passage that would answer them, paraphrases, a broader question."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search

log = logging.getLogger(__name__)
Complete = Callable[[str], str]
#: Fixed value: paraphrases asked for.
PARAPHRASES = 3
PASSAGE = "Write two to four sentences that answer the question as a reference text would. Leave the question itself out.\n\n"
SAME = "Put the question in {n} other ways that ask for the same. One on each line, without numbers or blank lines.\n\n"
BROADER = "Ask the more general question that lies behind this one. Reply with that question alone.\n\n"


@dataclass(frozen=True)
class Rewrite:
    mode: str
    original: str
    queries: list[str]
    passage: str | None = None


def _say(complete: Complete, prompt: str) -> str:
    """The model's reply; nothing where it fails."""
    try:
        return complete(prompt) or ""
    except Exception as error:  # the question itself will do
        log.warning("rewriting failed: %s", error)
        return ""


def hyde(question: str, complete: Complete) -> Rewrite:
    passage = _say(complete, PASSAGE + question) or question
    return Rewrite("hyde", question, [passage], passage)


def multi_query(question: str, complete: Complete, n: int = PARAPHRASES) -> Rewrite:
    lines = [x.strip() for x in _say(complete, SAME.format(n=n) + question).splitlines()]
    return Rewrite("multi_query", question, [question, *[x for x in lines if x][:n]])


def step_back(question: str, complete: Complete) -> Rewrite:
    return Rewrite("step_back", question, [question, (_say(complete, BROADER + question) or question).strip()])


MODES = {"hyde": hyde, "multi_query": multi_query, "step_back": step_back}


def rewrite(question: str, mode: str, complete: Complete) -> Rewrite:
    if mode not in MODES:
        raise ValueError(f"unknown rewrite mode {mode!r}")
    return MODES[mode](question, complete)


def merged(found: DataFrame) -> DataFrame:
    """Rows of several searches (query_id, rank, doc_id, metadata) in order, each chunk where it comes first. Nothing is cut off."""
    index = F.coalesce(F.get_json_object("metadata", "$.chunk_index").cast("long"), F.lit(0))
    return search.first_seen(found.withColumn("chunk_index", index), ("doc_id", "chunk_index"), ("query_id", "rank")).orderBy("query_id", "rank")
