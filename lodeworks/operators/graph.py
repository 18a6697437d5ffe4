"""Triples: rows, deduplication, filters, upserts and lookups by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import node_id, node_key, triple_id
from ..functions.text import normalise_space
from ..functions.vectors import cosine

TRIPLE = ("triple_id", "source_doc", "method", "subject_id", "subject_name", "subject_type", "predicate", "object_id", "object_name", "object_type", "weight")


def triple_rows(df: DataFrame, subject: Column, subject_type: str, predicate: str, obj: Column, object_type: str, weight: Column, source_doc: str, seq: Column, method: str = "tabular") -> DataFrame:
    """Rows of the triple table, with seq, the order in which they came."""
    s, o, st, ot = normalise_space(subject), normalise_space(obj), F.lit(subject_type), F.lit(object_type)
    sid, oid = node_id(subject, st), node_id(obj, ot)
    return df.select(
        triple_id(F.lit(method), sid, F.lit(predicate), oid).alias("triple_id"), F.lit(source_doc).alias("source_doc"), F.lit(method).alias("method"), sid.alias("subject_id"), s.alias("subject_name"), st.alias("subject_type"),
        F.lit(predicate).alias("predicate"), oid.alias("object_id"), o.alias("object_name"), ot.alias("object_type"), weight.cast("double").alias("weight"), seq.cast("long").alias("seq"),
    )


def sides(triples: DataFrame, *keep: str) -> DataFrame:
    """Nodes as they come: id, name, type, source_doc, specs, key, at, subjects before objects of the same triple."""
    specs = lambda x: F.col(f"{x}_specs") if f"{x}_specs" in triples.columns else F.lit(None).cast("map<string,string>")
    parts = [
        triples.select(*keep, F.col(f"{x}_id").alias("id"), F.col(f"{x}_name").alias("name"), F.col(f"{x}_type").alias("type"), "source_doc", specs(x).alias("specs"), (F.col("seq") * 2 + k).alias("at"))
        for k, x in enumerate(("subject", "object"))
    ]
    return parts[0].unionByName(parts[1]).withColumn("key", node_key(F.col("name"), F.col("type")))


def nodes(triples: DataFrame, *within: str) -> DataFrame:
    """One row per (name, type) key, for each value of within: the node seen first, all its sources, and of its specs the value seen
    first for each name."""
    both = sides(triples, *within)
    first = F.min_by(F.struct("id", "name", "type"), "at").alias("n")
    found = both.groupBy(*within, "key").agg(first, F.array_join(F.array_sort(F.collect_set("source_doc")), ",").alias("source_doc"), F.min("at").alias("at"))
    if not {"subject_specs", "object_specs"} & set(triples.columns):
        return found.select(*within, "key", "n.id", "n.name", "n.type", "source_doc", "at", F.lit(None).cast("map<string,string>").alias("specs"))
    said = both.where("specs is not null").select(*within, "key", "at", F.explode("specs").alias("spec", "value"))
    said = said.groupBy(*within, "key", "spec").agg(F.min_by("value", "at").alias("value"))
    said = said.groupBy(*within, "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("spec", "value")))).alias("specs"))
    found = found.join(said, [*within, "key"], "left")
    return found.select(*within, "key", "n.id", "n.name", "n.type", "source_doc", "at", "specs")


def canonical(triples: DataFrame, *within: str) -> DataFrame:
    """triples whose subjects and objects are the nodes that their keys were first seen as, with the specs of all that share the key."""
    known = nodes(triples, *within)
    out = triples
    for x in ("subject", "object"):
        named = known.select(*within, F.col("key").alias(f"{x}_key"), *(F.col(c).alias(f"new_{c}") for c in ("id", "name", "type", "specs")))
        out = out.withColumn(f"{x}_key", node_key(F.col(f"{x}_name"), F.col(f"{x}_type"))).join(named, [*within, f"{x}_key"])
        out = out.withColumns({f"{x}_{c}": F.col(f"new_{c}") for c in ("id", "name", "type", "specs")}).drop(f"{x}_key", *(f"new_{c}" for c in ("id", "name", "type", "specs")))
    return out


def dedup(triples: DataFrame, *within: str) -> DataFrame:
    """Canonical triples, of those with equal subject, predicate and object the heaviest, in the order in which each was first seen."""
    return dedup_edges(canonical(triples, *within), *within)


def dedup_edges(triples: DataFrame, *within: str) -> DataFrame:
    """Of each (subject, predicate, object) the heaviest row, the earliest of equals, by partial aggregation."""
    key = [*within, "subject_id", "predicate", "object_id"]
    rest = [c for c in triples.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct("weight", -F.col("seq"))).alias("best")
    found = triples.groupBy(*key).agg(best, F.min("seq").alias("first_seq"))
    return found.select(*key, *(F.col(f"best.{c}").alias(c) for c in rest), "first_seq")


def like(name: Column, pattern: str | Column) -> Column:
    """Case-insensitive LIKE; % and _ in the pattern keep their meaning."""
    if isinstance(pattern, str):
        return F.lower(normalise_space(name)).like("%" + " ".join(pattern.split()).lower() + "%")
    return F.like(F.lower(normalise_space(name)), F.concat(F.lit("%"), F.lower(normalise_space(pattern)), F.lit("%")))


def filter_triples(triples: DataFrame, source_doc: str | None = None, subject_name: str | None = None, subject_type: str | None = None, predicate: str | None = None, method: str | None = None, object_name: str | None = None) -> DataFrame:
    """All conditions that are given, a blank one counting as none."""
    if source_doc:
        triples = triples.where(F.col("source_doc") == source_doc)
    if method:
        triples = triples.where(F.col("method") == method)
    for column, value in (("subject_type", subject_type), ("predicate", predicate)):
        if value:
            triples = triples.where(F.lower(column) == value.lower())
    for column, value in (("subject_name", subject_name), ("object_name", object_name)):
        if value:
            triples = triples.where(like(F.col(column), value))
    return triples


def nested(triples: DataFrame) -> DataFrame:
    """Triples with subject and object as structs; specs come from their JSON, if stored."""

    def side(x: str) -> Column:
        specs = F.lit(None).cast("map<string,string>")
        if f"{x}_specs" in triples.columns:
            specs = F.from_json(f"{x}_specs", "map<string,string>") if dict(triples.dtypes)[f"{x}_specs"] == "string" else F.col(f"{x}_specs")
        return F.struct(F.col(f"{x}_id").alias("id"), F.col(f"{x}_name").alias("name"), F.col(f"{x}_type").alias("type"), F.col("source_doc"), specs.alias("specs"))

    return triples.select("triple_id", side("subject").alias("subject"), "predicate", side("object").alias("object"), "weight", "source_doc", F.coalesce("method", F.lit("unknown")).alias("method"))


#: The triple table at rest: specs are JSON.
STORED = (*TRIPLE, "subject_specs", "object_specs")


def stored(triples: DataFrame) -> DataFrame:
    """Triples as rows of the table: names with single spaces, ids, specs as JSON."""
    names = {f"{x}_name": normalise_space(F.col(f"{x}_name")) for x in ("subject", "object")}
    specs = {f"{x}_specs": F.to_json(F.col(f"{x}_specs")) if f"{x}_specs" in triples.columns else F.lit(None).cast("string") for x in ("subject", "object")}
    out = triples.withColumns(names | specs)
    return out.withColumn("triple_id", triple_id(F.coalesce("method", F.lit("unknown")), F.col("subject_id"), F.col("predicate"), F.col("object_id"))).select(*STORED)


def to_edges(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("subject_id").alias("source_id"), F.col("object_id").alias("target_id"), "predicate", "weight", "source_doc")


def upsert(existing: DataFrame, new: DataFrame, key: tuple[str, ...] = ("triple_id",)) -> DataFrame:
    return existing.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def delete(triples: DataFrame, source_doc: str, method: str | None = None) -> DataFrame:
    gone = F.col("source_doc").eqNullSafe(source_doc)
    return triples.where(~(gone if method is None else gone & F.col("method").eqNullSafe(method)))


def format_triple() -> Column:
    return F.format_string("%s [%s] —%s→ %s [%s] (weight=%.2f)", "subject_name", "subject_type", "predicate", "object_name", "object_type", F.coalesce("weight", F.lit(1.0)))


def context_rows(entities: DataFrame, triples: DataFrame, most: int = 10_000) -> DataFrame:
    """Triples whose subject or object name holds an entity (entity, pos): each once, ordered by entity, side and seq. The
    entities are a question's words; they are broadcast, and more than `most` of them are refused."""
    if entities.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} entities")
    few = F.broadcast(entities)
    found = [few.join(triples, like(F.col(f"{x}_name"), F.col("entity"))).withColumn("side", F.lit(k)) for k, x in enumerate(("subject", "object"))]
    first = Window.partitionBy("triple_id").orderBy("pos", "side", "seq")
    return found[0].unionByName(found[1]).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def entity_names(triples: DataFrame) -> DataFrame:
    """(name) of all subjects and objects, each once."""
    names = triples.select(F.col("subject_name").alias("name")).union(triples.select("object_name"))
    return names.where("name is not null").distinct()


def nearest_names(names: DataFrame, query: Column, vector: str = "vector", k: int = 5, least: float = 0.5) -> DataFrame:
    """(pos, entity) of the k names whose vectors are nearest to the query's by cosine, without those below least."""
    near = names.withColumn("sim", cosine(F.col(vector), query)).orderBy(F.desc("sim"), "name").limit(k).where(F.col("sim") >= least)
    return near.select((F.row_number().over(Window.orderBy(F.desc("sim"), "name")) - 1).alias("pos"), F.col("name").alias("entity"))
