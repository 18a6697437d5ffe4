"""Triples from texts: extractors behind one interface, replies of a text model as rows, and the steps up to the store."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import node_id
from ..functions.rules import ENTITY_TYPES, RELATION_TYPES, clamp
from ..functions.text import json_array, strip
from . import chunking, graph

FOUND = "source_doc string, chunk int, seq int, subject string, subject_type string, predicate string, object string, object_type string, weight double"
FIELDS = [f.split()[0] for f in FOUND.split(", ")]
#: Characters of a text that a model reads when it extracts, and when it classifies; pairs asked about for a text and
#: at a time; triples of the rules below which the model reads the whole text.
READ, CLASSIFIED, MOST_PAIRS, PAIRS_A_CALL, LEAST_TRIPLES = 4000, 3000, 20, 10, 2

EXTRACT = (
    "List the facts that the text states as a JSON array of objects with the keys subject, subject_type, relation, object, object_type and "
    f"confidence (0 to 1). Entity types: {', '.join(ENTITY_TYPES)}. Relations: {', '.join(RELATION_TYPES)}. Reply with the array alone.\n\nText:\n"
)
CLASSIFY = (
    "For each pair name the relation that the text states between subject and object, as a JSON array of objects with the keys subject, "
    f"subject_type, relation, object, object_type and confidence (0 to 1). Relations: {', '.join(RELATION_TYPES)}. Reply with the array alone.\n\n"
)


class Extractor(Protocol):
    """What a text extractor must offer: the triples of a text as dictionaries with subject, subject_type, predicate, object,
    object_type and weight."""

    def extract(self, text: str, source_doc: str) -> list[dict]: ...


def extracted(chunks: DataFrame, extractor: Extractor) -> DataFrame:
    """FOUND of chunks (source_doc, chunk_index, chunk_text). Blank chunks are not asked about; one that the extractor fails on gives
    nothing and stops no other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, chunk, text in zip(f["source_doc"], f["chunk_index"], f["chunk_text"], strict=True):
                try:
                    found = extractor.extract(text, doc)
                except Exception:  # that chunk's triples are lost, not the run
                    found = []
                rows += [(doc, chunk, k, *(t.get(c) for c in FIELDS[3:])) for k, t in enumerate(found)]
            yield pd.DataFrame(rows, columns=FIELDS)

    return chunks.where(strip(F.col("chunk_text")) != "").select("source_doc", "chunk_index", "chunk_text").mapInPandas(run, FOUND)


REPLY = "array<struct<subject:string,subject_type:string,relation:string,object:string,object_type:string,confidence:string>>"


def reply_triples(replies: DataFrame, reply: str, *keep: str) -> DataFrame:
    """keep, seq and a triple for each usable item of the JSON array in a model's reply.

    Fences and text around the array go; a reply without one gives nothing. Items without subject or object or with a confidence that
    is no number are left out; types default to Other, the relation to related_to, the confidence to 1."""
    items = F.from_json(json_array(F.col(reply)), REPLY)
    x = replies.select(*keep, F.posexplode(items).alias("seq", "x")).where("x.subject is not null and x.object is not null")
    sure = F.col("x.confidence").try_cast("double")
    x = x.where(F.col("x.confidence").isNull() | sure.isNotNull())
    other = lambda c: strip(F.coalesce(F.col(f"x.{c}"), F.lit("Other"))).alias(c)
    return x.select(
        *keep, "seq", strip(F.col("x.subject")).alias("subject"), other("subject_type"), strip(F.coalesce("x.relation", F.lit("related_to"))).alias("predicate"),
        strip(F.col("x.object")).alias("object"), other("object_type"), clamp(sure).alias("weight"),
    )


def asked(prompts: DataFrame, prompt: str, complete: Callable[[str], str]) -> DataFrame:
    """prompts with reply, what the model says to each; null where it fails."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def say(p: str) -> str | None:
            try:
                return complete(p)
            except Exception:  # a call that fails says nothing
                return None

        for s in batches:
            yield s.map(say)

    return prompts.withColumn("reply", run(F.col(prompt)))


def model_triples(chunks: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """FOUND of what a text model extracts from the first READ characters of each chunk."""
    prompts = chunks.where(strip(F.col("chunk_text")) != "").select("source_doc", F.col("chunk_index").alias("chunk"), F.concat(F.lit(EXTRACT), F.substring("chunk_text", 1, READ)).alias("prompt"))
    return reply_triples(asked(prompts, "prompt", complete), "reply", "source_doc", "chunk").select(*FIELDS)


def candidate_pairs(found: DataFrame) -> DataFrame:
    """Pairs of nodes that the rules' triples name, whichever way round, in the order first seen, at most MOST_PAIRS a chunk:
    source_doc, chunk, call, at, and names and types of both."""
    one, two = node_id(F.col("subject"), F.col("subject_type")), node_id(F.col("object"), F.col("object_type"))
    pair = found.withColumn("pair", F.concat_ws("::", F.least(one, two), F.greatest(one, two)))
    named = F.struct("subject", "subject_type", "object", "object_type")
    pair = pair.groupBy("source_doc", "chunk", "pair").agg(F.min_by(named, "seq").alias("x"), F.min("seq").alias("first"))
    at = F.row_number().over(Window.partitionBy("source_doc", "chunk").orderBy("first")) - 1
    pair = pair.withColumn("at", at).where(F.col("at") < MOST_PAIRS)
    return pair.select("source_doc", "chunk", F.floor(F.col("at") / PAIRS_A_CALL).alias("call"), "at", "x.*")


def hybrid_triples(chunks: DataFrame, rules: Extractor, complete: Callable[[str], str]) -> DataFrame:
    """FOUND where rules propose the pairs and a model names their relations, PAIRS_A_CALL at a time; nodes keep the rules' spelling and
    type where the model's names agree but for case. Chunks with fewer than LEAST_TRIPLES by rule are read by the model alone."""
    found = extracted(chunks, rules)
    many = found.groupBy("source_doc", F.col("chunk").alias("chunk_index")).agg(F.count("*").alias("n")).where(f"n >= {LEAST_TRIPLES}")
    few = chunks.join(many, ["source_doc", "chunk_index"], "left_anti")
    rich = chunks.join(many, ["source_doc", "chunk_index"], "left_semi").withColumnRenamed("chunk_index", "chunk")
    pairs = candidate_pairs(found)
    listed = pairs.groupBy("source_doc", "chunk", "call").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("at", "subject", "subject_type", "object", "object_type"))), lambda p: p.dropFields("at"))).alias("pairs"))
    prompts = rich.join(listed, ["source_doc", "chunk"])
    prompts = prompts.select("source_doc", "chunk", "call", F.concat(F.lit(CLASSIFY + "Text:\n"), F.substring("chunk_text", 1, CLASSIFIED), F.lit("\n\nPairs:\n"), "pairs").alias("prompt"))
    told = reply_triples(asked(prompts, "prompt", complete), "reply", "source_doc", "chunk", "call")
    # the spelling seen last in a call's pairs, objects after subjects of the same pair
    sides = [pairs.select("source_doc", "chunk", "call", F.lower(c).alias("low"), F.struct(F.col(c).alias("name"), F.col(f"{c}_type").alias("type")).alias("node"), (F.col("at") * 2 + k).alias("o")) for k, c in enumerate(("subject", "object"))]
    names = sides[0].unionByName(sides[1]).groupBy("source_doc", "chunk", "call", "low").agg(F.max_by("node", "o").alias("node"))
    for c in ("subject", "object"):
        told = told.withColumn("low", F.lower(c)).join(names, ["source_doc", "chunk", "call", "low"], "left")
        told = told.withColumns({c: F.coalesce("node.name", c), f"{c}_type": F.coalesce("node.type", f"{c}_type")}).drop("low", "node")
    told = told.withColumn("seq", F.col("call") * 1000 + F.col("seq")).select(*(F.col(f).cast(t).alias(f) for f, t in (d.split() for d in FOUND.split(", "))))
    return told.unionByName(model_triples(few, complete))


def to_triples(found: DataFrame, method: str) -> DataFrame:
    """Triples of FOUND with ids and the order in which they came in their document."""
    ids = {f"{x}_id": node_id(F.col(f"{x}_name"), F.col(f"{x}_type")) for x in ("subject", "object")}
    t = found.withColumnsRenamed({"subject": "subject_name", "object": "object_name"}).withColumns(ids)
    order = Window.partitionBy("source_doc").orderBy("chunk", "seq")
    return t.withColumns({"seq": F.row_number().over(order).cast("long"), "method": F.lit(method)}).drop("chunk")


Extract = Callable[[DataFrame], DataFrame]


def by_method(method: str, rules: Extractor, complete: Callable[[str], str] | None = None) -> tuple[str, Extract]:
    """The extraction of a method's name, lower-cased: rules, llm, or, for any other name too, hybrid. Those that ask a model need one."""
    method = method.lower()
    if method == "rules":
        return method, lambda chunks: extracted(chunks, rules)
    if complete is None:
        raise ValueError(f"extraction by {method} needs a text model")
    if method == "llm":
        return method, lambda chunks: model_triples(chunks, complete)
    return method, lambda chunks: hybrid_triples(chunks, rules, complete)


class Pipeline:
    """Texts to triples of one method: windows of words, extraction, one node for each key of a document, the heaviest of equal edges."""

    def __init__(self, method: str, extract: Extract, size: int = 1000, overlap: int = 200):
        self.method, self.extract, self.size, self.overlap = method, extract, size, overlap

    def steps(self, texts: DataFrame) -> Iterator[tuple[str, DataFrame]]:
        """Each step's name and rows, for texts (source_doc, text): chunks, triples, deduped."""
        windows = F.posexplode(chunking.word_windows(F.col("text"), self.size, self.overlap)).alias("chunk_index", "chunk_text")
        chunks = texts.select("source_doc", windows)
        yield "chunks", chunks
        triples = to_triples(self.extract(chunks), self.method)
        yield "triples", triples
        yield "deduped", graph.dedup(triples.select("*", F.col("source_doc").alias("doc")), "doc").drop("doc")

    def run(self, texts: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the store with the new triples instead of the documents' old ones of this method, counts by document: chunks,
        raw_triples, deduplicated_triples). Of documents that state the same fact the last by name keeps it, as ids don't name the document."""
        steps = dict(self.steps(texts))
        old = existing.join(texts.select("source_doc", F.lit(self.method).alias("method")).distinct(), ["source_doc", "method"], "left_anti")
        rows = graph.stored(steps["deduped"])
        rest = [c for c in rows.columns if c != "triple_id"]
        last = rows.groupBy("triple_id").agg(F.max_by(F.struct(*rest), "source_doc").alias("x")).select("triple_id", "x.*")
        counts = texts.select("source_doc").distinct()
        for name, step in (("chunks", "chunks"), ("raw_triples", "triples"), ("deduplicated_triples", "deduped")):
            counts = counts.join(steps[step].groupBy("source_doc").agg(F.count("*").alias(name)), "source_doc", "left").na.fill(0, [name])
        return graph.upsert(old.select(*graph.STORED), last.select(*graph.STORED)), counts


class FixedReplies:
    """A text model that gives set replies in turn, for tests and demonstrations."""

    def __init__(self, *items: dict):
        self.reply = json.dumps(list(items))

    def __call__(self, prompt: str) -> str:
        return self.reply


def unlisted(triples: DataFrame) -> DataFrame:
    """(field, value, n) of types and relations outside the closed lists, which nothing enforces."""
    told = [("subject_type", ENTITY_TYPES), ("object_type", ENTITY_TYPES), ("predicate", RELATION_TYPES)]
    rows = [triples.where(~F.col(c).isin(*known)).groupBy(F.lit(c).alias("field"), F.col(c).alias("value")).agg(F.count("*").alias("n")) for c, known in told]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])

