"""A collection: incremental index of a folder, and answers from its chunks and triples."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalise_space, query_tokens, stem, strip
from ..operators import chunking, delta, documents, extraction, graph, search, tables
from ..sources import convert, files, store
from . import rewriting, vision
from .adaptive import Adaptive, reflect
from .config import Settings
from .providers import HashEmbedder, OverlapScorer, RuleExtractor, TemplateModel

log = logging.getLogger(__name__)
CHUNKS = T.StructType().add("id", "string").add("doc_id", "string").add("text", "string").add("vector", T.ArrayType(T.FloatType())).add("metadata", "string")
TRIPLES = T.StructType()
for _c in graph.STORED:
    TRIPLES = TRIPLES.add(_c, "double" if _c == "weight" else "string")
MANIFEST = T.StructType().add("name", "string").add("sha256", "string")
CACHE = T.StructType().add("name", "string").add("model", "string").add("dimension", T.IntegerType()).add("position", T.IntegerType()).add("chunk_hash", "string").add("text", "string").add("vector", T.ArrayType(T.FloatType())).add("metadata", "string")
#: What a chunk's metadata always has, what it has where the chunk does, and the answers where there is nothing.
ALWAYS = ("chunk_type", "page_number", "section_title", "language", "chunk_hash")
SOMETIMES = ("table_strategy", "entity_name", "entity_group", "sheet_name", "metric_keys", "comparison_scope")
NO_DOCUMENTS = "No documents indexed yet. Call index_documents() first."
NO_TRIPLES = "No graph triples found for this query."
NO_CONTEXT = "No relevant context found."
ANSWER = "Answer the question from the context alone; if the context doesn't hold the answer, say so.\n\nContext:\n{context}\n\nQuestion: {question}"


class NewDocuments(RuntimeError):
    """Files wait to be indexed."""


def metadata(source: Column, position: Column) -> Column:
    """A chunk's metadata as JSON: what every chunk has, nulls too, then what only some have."""
    always = F.to_json(F.struct(source.alias("source"), position.alias("chunk_index"), *ALWAYS), {"ignoreNullFields": "false"})
    more = F.to_json(F.struct(*SOMETIMES))
    return F.when(more == "{}", always).otherwise(F.concat(F.regexp_replace(always, r"\}$", ","), F.substring(more, 2, 1 << 30)))


@dataclass
class Collection:
    """Tables and state under root; models are offline unless others are given.

    converter reads the formats that need one, vision and entities are off unless given, model answers and rewrites, and the triples
    come by settings.extractor, where rules alone ask no model."""

    spark: SparkSession
    root: str
    data: str
    embedder: HashEmbedder = field(default_factory=HashEmbedder)
    model: TemplateModel = field(default_factory=TemplateModel)
    scorer: OverlapScorer | None = None
    settings: Settings = field(default_factory=lambda: Settings(extractor="rules"))
    converter: convert.Converter = field(default_factory=convert.OfficeConverter)
    rules: extraction.Extractor = field(default_factory=RuleExtractor)
    picture_model: vision.Model | None = None
    entities: Callable[[str], list[str]] | None = None
    transcribe: Callable[[Column, Column], Column] | None = None

    def __post_init__(self):
        named = (("documents", CHUNKS), ("graph_triples", TRIPLES), ("manifest", MANIFEST), ("embedded", CACHE))
        self.chunks, self.triples, self.manifest, self.embedded = (store.Table(self.spark, f"{self.root}/{n}", s) for n, s in named)
        self.state = store.State(self.spark, self.root)

    def status(self) -> str:
        """not_indexed, indexed or new_docs, by the files of the folder itself; what is below it or gone doesn't count."""
        disk = files.manifest(files.scan(self.spark, self.data, recursive=False))
        return delta.index_status(disk, self.manifest.read(), self.manifest.version() is not None).first()["index_status"]

    def document_count(self) -> int:
        """Supported files of the folder itself."""
        return files.scan(self.spark, self.data, recursive=False).count()

    def load(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chunks, errors) of files: documents.CHUNK with position, their order in the file, and (name, error)."""
        s = self.settings
        plain = documents.passthrough_chunks(files.texts(found, self.transcribe).select("name", "stem", "text"), s.size, s.overlap)
        parsed = store.settled(convert.elements(found, self.converter).withColumn("stem", stem(F.col("name"))))
        good = parsed.where("error is null")
        shown = vision.summaries(good, self.picture_model) if self.picture_model else None
        told = vision.narrator(self.picture_model) if self.picture_model else None
        chunks = documents.unified(documents.text_chunks(good, shown, s.size, s.overlap), tables.table_chunks(good, s.tables, told))
        every = plain.unionByName(chunks)
        w = F.row_number().over(Window.partitionBy("name").orderBy("source", "place")) - 1
        return every.withColumn("position", w), parsed.where("error is not null").select("name", "error")

    def index(self, mode: str = "all", force: bool = False) -> dict[str, int]:
        """Loads what is new or modified, purges what is modified or deleted, stores the manifest. What fails to load, blank files and
        formats without a reader among it, is counted as failed, stays out of the manifest and is tried again. force takes all files
        for modified; rows of files that are gone then stay."""
        if mode not in ("vector", "graph", "all"):
            raise ValueError(f"unknown mode {mode}")
        found = files.scan(self.spark, self.data)
        disk = files.manifest(found)
        changes = disk.select("name", F.lit("modified").alias("status")) if force else delta.delta(disk, self.manifest.read())
        changes = store.settled(changes.where("status <> 'unchanged'"))
        counts = {r["status"]: r["count"] for r in changes.groupBy("status").count().collect()}
        if not counts:
            return {}
        changed, gone = changes.where("status in ('new', 'modified')"), changes.where("status in ('modified', 'deleted')")
        chunks, errors = self.load(found.join(changed, "name", "left_semi"))
        chunks = store.settled(chunks)
        for r in errors.collect():
            log.warning("%s not loaded: %s", r["name"], r["error"])
        loaded = chunks.select("name").distinct()
        for r in changed.join(loaded, "name", "left_anti").groupBy("status").count().collect():
            counts[r["status"]] -= r["count"]
            counts["failed"] = counts.get("failed", 0) + r["count"]
        if mode in ("graph", "all"):
            self._index_graph(chunks, gone)
        if mode in ("vector", "all"):
            self._index_vectors(chunks, gone)
        self.manifest.replace(delta.next_manifest(disk, changes, loaded))
        self.state.set_flags(vector_indexed=True if mode != "graph" else None, graph_indexed=True if mode != "vector" else None)
        return {k: n for k, n in counts.items() if n}

    def _index_vectors(self, chunks: DataFrame, gone: DataFrame) -> None:
        """Embeds what the cache doesn't hold, stores the cache, and the rows of the changed files from it."""
        cached = self.embedded.read()
        hits = delta.cache_hits(cached.select("name", "chunk_hash"), chunks.select("name", "chunk_hash")).where("hit").select("name")
        fresh = chunks.join(hits, "name", "left_anti")
        said = F.when(F.col("chunk_text_embedded") != "", F.col("chunk_text_embedded")).otherwise(F.col("chunk_text_original"))
        told = {"model": F.lit(getattr(self.embedder, "name", type(self.embedder).__name__)), "dimension": F.lit(self.embedder.dimension), "text": said, "metadata": metadata(F.col("name"), F.col("position"))}
        rows = fresh.withColumns(told).withColumn("vector", self.embedder.column(F.col("text"))).select(*CACHE.names)
        self.embedded.replace(cached.join(fresh.select("name").distinct(), "name", "left_anti").unionByName(rows))
        now = self.embedded.read().join(chunks.select("name").distinct(), "name", "left_semi")
        kept = self.chunks.read().join(gone.select(F.col("name").alias("doc_id")), "doc_id", "left_anti")
        kept = kept.join(chunks.select(F.col("name").alias("doc_id")).distinct(), "doc_id", "left_anti")
        self.chunks.replace(kept.select(*CHUNKS.names).unionByName(self._rows(now)))

    @staticmethod
    def _rows(cached: DataFrame) -> DataFrame:
        """Rows of the chunk table from the cache."""
        return cached.select(F.concat_ws("#", "name", "position").alias("id"), F.col("name").alias("doc_id"), "text", "vector", "metadata")

    def _index_graph(self, chunks: DataFrame, gone: DataFrame) -> None:
        """Triples of each file's whole text, its chunks apart by blank lines."""
        spoken = chunks.where(strip(F.col("chunk_text_original")) != "")
        texts = spoken.groupBy(F.col("name").alias("source_doc")).agg(chunking.ordered_join("position", "chunk_text_original", "\n\n").alias("text"))
        method, extract = extraction.by_method(self.settings.extractor, self.rules, None if self.settings.extractor == "rules" else self.model.complete)
        steps = extraction.Pipeline(method, extract, self.settings.graph_size, self.settings.graph_overlap)
        kept = self.triples.read().join(gone.select(F.col("name").alias("source_doc")), "source_doc", "left_anti")
        self.triples.replace(steps.run(texts, kept)[0])

    def rebuild(self, prune: bool = False) -> int:
        """The chunk table anew from the cache, without embedding anything; how many files. An empty cache changes nothing. Files that
        are gone come back unless prune takes them out of the cache first."""
        cached = self.embedded.read()
        if prune:
            self.embedded.replace(cached.join(files.scan(self.spark, self.data).select("name"), "name", "left_semi"))
            cached = self.embedded.read()
        many = cached.select("name").distinct().count()
        if many:
            self.chunks.replace(self._rows(cached))
        return many

    def delete(self, name: str) -> int:
        """Takes a file's rows out of both tables; how many triples went."""
        triples = self.triples.read()
        before = triples.count()
        self.chunks.replace(self.chunks.read().where(F.col("doc_id") != name))
        self.triples.replace(graph.delete(triples, name))
        return before - self.triples.read().count()

    def document_chunks(self, name: str) -> DataFrame:
        """A file's chunks in order; broken metadata reads as none."""
        m = F.from_json("metadata", "struct<chunk_index:int,chunk_type:string,page_number:int,section_title:string,language:string>")
        rows = self.chunks.read().where(F.col("doc_id") == name).select("text", m.alias("m"))
        return rows.select(F.coalesce("m.chunk_index", F.lit(0)).alias("chunk_index"), "text", "m.chunk_type", "m.page_number", "m.section_title", "m.language").orderBy("chunk_index")

    def debug(self) -> dict:
        """Rows of the chunk table and its files, sorted."""
        if self.chunks.version() is None:
            return {"error": "table does not exist"}
        rows = self.chunks.read()
        return {"total_rows": rows.count(), "doc_ids": [r["doc_id"] for r in rows.select("doc_id").distinct().orderBy("doc_id").collect()]}

    def browse(self, **filters: str | None) -> DataFrame:
        return graph.nested(graph.filter_triples(self.triples.read(), **filters))

    def search_vector(self, vector: list[float], k: int | None = None) -> DataFrame:
        """The k nearest chunks to a vector of the caller's: more are fetched where there is a reranker, but none is reranked."""
        k = k or self.settings.top_k
        fetched = k if self.scorer is None else search.over_fetch(k, self.settings.factor, self.settings.most)
        return search.top_k(self.chunks.read(), F.lit([float(x) for x in vector]), fetched, "vector", "id").orderBy(F.desc("score"), "id").limit(k)

    def search(self, asked: str, k: int | None = None) -> DataFrame:
        k = k or self.settings.top_k
        q = F.lit([float(x) for x in self.embedder.embed([asked])[0]])
        if self.scorer is None:
            return search.top_k(self.chunks.read(), q, k, "vector", "id")
        c = search.top_k(self.chunks.read(), q, search.over_fetch(k, self.settings.factor, self.settings.most), "vector", "id")
        return search.rerank(c.withColumn("rank", -F.col("score")), self.scorer.column(asked, F.col("text")), k)

    def search_rewritten(self, r: rewriting.Rewrite, k: int | None = None) -> DataFrame:
        """By the passage's vector, or by all queries with each chunk once; up to k rows a query."""
        if r.mode == "hyde":
            return self.search_vector(self.embedder.embed([r.passage])[0], k)
        found = None
        for n, query in enumerate(r.queries):
            score = "score" if self.scorer is None else "reranker_score"
            one = self.search(query, k).withColumn("query_id", F.lit(n)).withColumn("rank", -F.col(score))
            found = one if found is None else found.unionByName(one)
        return rewriting.merged(found)

    def named(self, asked: str) -> DataFrame:
        """(pos, entity) of a question: what the recogniser names, then its longer words, each once."""
        known = [F.lit(e) for e in (self.entities(asked) if self.entities else [])]
        words = query_tokens(F.lit(asked))
        every = F.array_distinct(F.concat(F.transform(F.array(*known), normalise_space), F.transform(words, normalise_space))) if known else words
        return self.spark.range(1).select(F.posexplode(F.filter(every, lambda e: e != "")).alias("pos", "entity"))

    def graph_rows(self, asked: str) -> DataFrame:
        """Triples that name what the question names; where none does, those of the entities nearest to it."""
        triples = self.triples.read().withColumn("seq", F.xxhash64("triple_id"))
        rows = store.settled(graph.context_rows(self.named(asked), triples))
        if not rows.isEmpty():
            return rows
        names = graph.entity_names(triples).withColumn("vector", self.embedder.column(F.col("name")))
        near = graph.nearest_names(names, F.lit([float(x) for x in self.embedder.embed([asked])[0]]))
        return graph.context_rows(store.settled(near), triples)

    def graph_context(self, asked: str) -> str:
        rows = self.graph_rows(asked).orderBy("pos", "side", "seq")
        return "\n".join(r["line"] for r in rows.select(graph.format_triple().alias("line")).collect())

    def generate(self, asked: str, context: str) -> str:
        """The model's answer; nothing where it fails."""
        try:
            return self.model.complete(ANSWER.format(context=context, question=asked)) or ""
        except Exception as error:
            log.warning("no answer: %s", error)
            return ""

    @staticmethod
    def sources(rows: DataFrame) -> list[dict]:
        index = F.coalesce(F.get_json_object("metadata", "$.chunk_index").cast("int"), F.lit(0))
        score = F.col("reranker_score") if "reranker_score" in rows.columns else F.lit(None).cast("double")
        shown = rows.select("doc_id", index.alias("chunk_index"), F.substring("text", 1, 200).alias("excerpt"), F.col("text").alias("full_text"), score.alias("reranker_score"))
        return [r.asDict() for r in shown.collect()]

    @staticmethod
    def joined(vector: str, lines: str) -> str:
        parts = [f"Vector Search Results:\n{vector}"] * bool(vector) + [f"Graph Search Results:\n{lines}"] * bool(lines)
        return "\n\n".join(parts)

    def vector_search(self, asked: str, k: int | None = None) -> str:
        if self.chunks.version() is None:
            return NO_DOCUMENTS
        return self.generate(asked, "\n\n".join(s["full_text"] for s in self.sources(self.search(asked, k))))

    def global_search(self, asked: str) -> str:
        lines = self.graph_context(asked)
        return self.generate(asked, lines) if lines else NO_TRIPLES

    def hybrid_search(self, asked: str, k: int | None = None) -> str:
        context = self.joined("\n\n".join(s["full_text"] for s in self.sources(self.search(asked, k))), self.graph_context(asked))
        return self.generate(asked, context) if context else NO_CONTEXT

    def adaptive(self) -> Adaptive:
        def retrieve(asked: str, k: int) -> tuple[str, list[dict]]:
            found = self.sources(self.search(asked, k))
            return "\n\n".join(s["full_text"] for s in found), found

        return Adaptive(self.model.complete, retrieve, self.graph_context)

    def gather(self, asked: str, method: str = "hybrid", k: int | None = None, rewrite: str | None = None) -> dict:
        """What an answer rests on: sources, their texts, graph lines, and how the question was put. Raises while files wait."""
        if method not in ("vector", "graph", "hybrid"):
            raise ValueError(f"unknown method {method}")
        if self.status() == "new_docs":
            raise NewDocuments("the collection has new documents; index it first")
        r = rewriting.rewrite(asked, rewrite, self.model.complete) if rewrite and method != "graph" else None
        found = [] if method == "graph" else self.sources(self.search(asked, k) if r is None else self.search_rewritten(r, k))
        lines = None if method == "vector" else self.graph_context(asked)
        return {"sources": found, "context": "\n\n".join(s["full_text"] for s in found), "graph": lines, "rewrite": r}

    def answer(self, asked: str, method: str = "hybrid", k: int | None = None, rewrite: str | None = None, self_rag: bool = False) -> dict:
        """Context and answer; of a graph question the answer is the context. With self_rag the adaptive steps answer, and a rewrite is
        only reported."""
        if self_rag:
            if self.status() == "new_docs":
                raise NewDocuments("the collection has new documents; index it first")
            r = rewriting.rewrite(asked, rewrite, self.model.complete) if rewrite and method != "graph" else None
            return reflect(self.adaptive(), asked, method, k or self.settings.top_k) | {"rewrite": r}
        g = self.gather(asked, method, k, rewrite)
        if method == "graph":
            said = g["graph"]
        else:
            said = self.generate(asked, g["context"] if method == "vector" else self.joined(g["context"], g["graph"]))
        return {"answer": said, "sources": g["sources"], "graphrag_context": g["graph"], "rewrite": g["rewrite"]}
