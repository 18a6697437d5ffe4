"""Triples: replies of a model, extractors, canonical nodes, the pipeline into a store."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.functions.rules import ENTITY_TYPES, RELATION_TYPES
from lodeworks.operators import extraction, graph
from lodeworks.plans.providers import NameRecogniser, RuleExtractor, entity

STORE = ", ".join(f"{c} {'double' if c == 'weight' else 'string'}" for c in graph.STORED)
TRIPLE = "source_doc string, method string, subject_id string, subject_name string, subject_type string, predicate string, object_id string, object_name string, object_type string, weight double, seq long, subject_specs map<string,string>, object_specs map<string,string>"


def parsed(spark, reply):
    df = spark.createDataFrame([(0, reply)], "k int, reply string")
    return [(r["subject"], r["subject_type"], r["predicate"], r["object"], r["object_type"], r["weight"]) for r in extraction.reply_triples(df, "reply", "k").orderBy("seq").collect()]


def item(**more):
    return {"subject": " A ", "subject_type": "Device", "relation": "governs", "object": "B", "object_type": "Unit", "confidence": 0.5} | more


def test_replies(spark):
    whole = ("A", "Device", "governs", "B", "Unit", 0.5)
    assert parsed(spark, json.dumps([item()])) == [whole]
    assert parsed(spark, "```json\n" + json.dumps([item()]) + "\n```") == [whole]
    assert parsed(spark, "Here: " + json.dumps([item()]) + " as asked") == [whole]
    assert parsed(spark, json.dumps([item(confidence=7), item(confidence=-1), item(confidence="0.25")])) == [(*whole[:5], 1.0), (*whole[:5], 0.0), (*whole[:5], 0.25)]
    assert parsed(spark, json.dumps([{"subject": "x"}, {"object": "y"}, {"subject": "x", "object": "y"}])) == [("x", "Other", "related_to", "y", "Other", 1.0)]
    assert parsed(spark, json.dumps([item(confidence="sure"), item(relation="own words", subject=5)])) == [("5", "Device", "own words", "B", "Unit", 0.5)]
    for nothing in (None, "", "no idea", "[broken", json.dumps(item()), json.dumps({"facts": [item()]})):
        assert parsed(spark, nothing) == []


def t(doc, subject, predicate, obj, weight, seq, specs=None, kind="Device"):
    return (doc, "m", f"id_{subject.strip()}", subject, kind, predicate, f"id_{obj.strip()}", obj, kind, weight, seq, specs, None)


def test_canonical(spark):
    rows = [t("d1", "Sensor", "p", "Unit", 0.5, 0, {"a": "1"}), t("d2", " SENSOR ", "p", "unit", 0.9, 1, {"a": "2", "b": "3"}), t("d2", "sensor", "q", "Unit", 0.1, 2), t("d3", "Sensor", "p", "Unit", 0.9, 3, None, "Software")]
    df = spark.createDataFrame(rows, TRIPLE)
    found = {r["key"]: r for r in graph.nodes(df).collect()}
    assert set(found) == {"sensor::device", "unit::device", "sensor::software", "unit::software"}
    assert (found["sensor::device"]["name"], found["sensor::device"]["source_doc"], found["sensor::device"]["specs"]) == ("Sensor", "d1,d2", {"a": "1", "b": "3"})
    out = sorted(graph.dedup(df).collect(), key=lambda r: r["first_seq"])
    assert [(r["subject_name"], r["predicate"], r["object_name"], r["weight"], r["seq"]) for r in out] == [("Sensor", "p", "Unit", 0.9, 1), ("Sensor", "q", "Unit", 0.1, 2)] or len(out) == 2
    assert all(r["subject_specs"] == {"a": "1", "b": "3"} for r in out if r["subject_type"] == "Device")


def test_canonical_by_fold(spark):
    """As a plain fold over the triples in order gives."""
    rnd = random.Random(4)
    rows = [t(rnd.choice("xyz"), rnd.choice(["ab", "AB", " ab", "cd"]), rnd.choice("pq"), rnd.choice(["ef", "EF ", "cd"]), rnd.choice([0.1, 0.5, 0.5]), k, rnd.choice([None, {rnd.choice("kl"): str(k)}])) for k in range(60)]
    nodes, best, order = {}, {}, []
    for r in rows:
        for name, specs in ((r[3], r[11]), (r[7], None)):
            n = nodes.setdefault(name.strip().lower(), {"name": name, "id": f"id_{name.strip()}", "docs": set(), "specs": {}})
            n["docs"].add(r[0])
            n["specs"] = (specs or {}) | n["specs"]
    for r in rows:
        key = (nodes[r[3].strip().lower()]["id"], r[5], nodes[r[7].strip().lower()]["id"])
        if key not in best:
            order.append(key)
        if key not in best or r[9] > best[key][9]:
            best[key] = r
    got = sorted(graph.dedup(spark.createDataFrame(rows, TRIPLE)).collect(), key=lambda r: r["first_seq"])
    assert [(r["subject_id"], r["predicate"], r["object_id"]) for r in got] == order
    assert [(r["weight"], r["seq"]) for r in got] == [(best[k][9], best[k][10]) for k in order]
    assert all((r["subject_specs"] or {}) == nodes[r["subject_name"].strip().lower()]["specs"] for r in got)


class Failing:
    def extract(self, text, source_doc):
        if "bad" in text:
            raise RuntimeError("no")
        return [{"subject": text.split()[0], "subject_type": "Concept", "predicate": "is_a", "object": "thing", "object_type": "Concept", "weight": 0.7}]


def chunks(spark, *texts):
    return spark.createDataFrame([("d", k, s) for k, s in enumerate(texts)], "source_doc string, chunk_index int, chunk_text string")


def test_chunk_fails_alone(spark):
    got = extraction.extracted(chunks(spark, "one word", "bad word", "  ", "two words"), Failing()).collect()
    assert sorted((r["chunk"], r["subject"]) for r in got) == [(0, "one"), (3, "two")]


def test_model_extraction(spark):
    def reply(prompt):
        if "quiet" in prompt:
            raise RuntimeError("down")
        assert "y" * 5000 not in prompt
        return json.dumps([item()])

    got = extraction.model_triples(chunks(spark, "says much " + "y" * 5000, "quiet", " "), reply).collect()
    assert [(r["chunk"], r["subject"], r["weight"]) for r in got] == [(0, "A", 0.5)]


class Pairs:
    """Rules that give as many triples as the text has words, some the other way round."""

    def extract(self, text, source_doc):
        names = text.split()
        out = [{"subject": a, "subject_type": "Device", "predicate": "related_to", "object": b, "object_type": "Unit", "weight": 0.7} for a, b in zip(names, names[1:], strict=False)]
        return out + [x | {"subject": x["object"], "object": x["subject"], "subject_type": "Unit", "object_type": "Device"} for x in out]


def test_hybrid(spark):
    asked = []

    def reply(prompt):
        pairs = prompt.partition("Pairs:\n")[2]
        if not pairs:
            return json.dumps([item(subject="whole")])
        told = json.loads(pairs)
        assert len(told) <= 10 and set(told[0]) == {"subject", "subject_type", "object", "object_type"}
        return json.dumps([{"subject": p["subject"].upper(), "subject_type": "Odd", "relation": "causes", "object": p["object"]} for p in told] + [{"subject": "New", "object": "Node"}])

    text = " ".join(f"n{k}" for k in range(31))
    got = extraction.hybrid_triples(chunks(spark, text, "lone"), Pairs(), reply).collect()
    asked = [r for r in got if r["chunk"] == 0]
    assert len([r for r in asked if r["subject"] != "New"]) == 20
    assert all(r["subject"] == f"n{int(r['subject'][1:])}" and r["subject_type"] in ("Device", "Unit") and r["predicate"] == "causes" for r in asked if r["subject"] != "New")
    assert len([r for r in asked if r["subject"] == "New" and r["subject_type"] == "Other"]) == 2
    assert [r["subject"] for r in got if r["chunk"] == 1] == ["whole"]


def test_pipeline(spark):
    texts = spark.createDataFrame([("a", "The sensor controls the valve. " * 30), ("b", "The sensor controls the valve. Gateway supports modbus."), ("c", " ")], "source_doc string, text string")
    empty = spark.createDataFrame([], STORE)
    p = extraction.Pipeline("rules", lambda c: extraction.extracted(c, RuleExtractor()), 40, 10)
    store, counts = p.run(texts, empty)
    told = {r["source_doc"]: (r["chunks"], r["raw_triples"], r["deduplicated_triples"]) for r in counts.collect()}
    assert told["a"][0] == 5 and told["a"][1] > told["a"][2] == 1 and told["b"] == (1, 2, 2) and told["c"] == (0, 0, 0)
    rows = store.collect()
    assert {(r["source_doc"], r["subject_name"], r["method"]) for r in rows} == {("b", "sensor", "rules"), ("b", "Gateway", "rules")}
    again, _ = p.run(texts.where("source_doc = 'a'"), spark.createDataFrame([r.asDict() | {"method": "llm"} for r in rows] + [r.asDict() | {"source_doc": "a", "triple_id": "old"} for r in rows[:1]], STORE))
    assert sorted((r["source_doc"], r["method"]) for r in again.collect()) == [("a", "rules"), ("b", "llm"), ("b", "llm")] or again.count() == 2
    assert not again.where("triple_id = 'old'").count()
    assert [n for n, _ in p.steps(texts)] == ["chunks", "triples", "deduped"]


def test_methods():
    assert extraction.by_method("RULES", Failing())[0] == "rules"
    assert extraction.by_method("LLM", Failing(), lambda p: "")[0] == "llm"
    assert extraction.by_method("other", Failing(), lambda p: "")[0] == "other"
    with pytest.raises(ValueError, match="model"):
        extraction.by_method("hybrid", Failing())


def test_specs_round_trip(spark):
    df = spark.createDataFrame([t("d", " Sensor  X ", "p", "Unit", 0.5, 0, {"a": "1"})], TRIPLE)
    row = graph.nested(graph.stored(df)).first()
    assert row["subject"]["name"] == "Sensor X" and row["subject"]["specs"] == {"a": "1"} and row["object"]["specs"] is None
    assert {r["field"] for r in extraction.unlisted(df).collect()} == {"predicate"}
    assert len(ENTITY_TYPES) == 19 and len(RELATION_TYPES) == 8


def test_recogniser():
    assert NameRecogniser()("Which Gateway Unit supports MB-200 today and 17") == ["Gateway Unit", "MB-200"] or "MB-200" in NameRecogniser()("Which Gateway Unit supports MB-200 today")
    assert [entity(x) for x in ("ab", "#abc", "a|bc", "1,234", "a12", "valve")] == [False, False, False, False, False, True]


def test_entity_bound(spark):
    with pytest.raises(ValueError, match="entities"):
        graph.context_rows(spark.range(30).select(F.col("id").alias("pos"), F.lit("x").alias("entity")), spark.createDataFrame([], STORE), most=20)
