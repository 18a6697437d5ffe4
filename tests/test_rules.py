"""Rules of chunkers, tables and graphs against plain statements of them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import ids, rules, tables, text
from lodeworks.operators import chunking, graph, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_golden_ids(spark):
    assert one(spark, ids.node_id(F.lit("SensorA"), F.lit("Device"))) == "847d1696efed474a"
    assert one(spark, ids.node_id(F.lit(" unit "), F.lit("Component"))) == "871c2acb242530ce"
    a, b = ids.node_id(F.lit("SensorA"), F.lit("Device")), ids.node_id(F.lit("Unit"), F.lit("Component"))
    assert one(spark, ids.triple_id(F.lit("unknown"), a, F.lit("part_of"), b)) == "4767c70afe3974417ff4fdc4"


@pytest.mark.parametrize(("n", "size", "overlap", "want"), [(220, 50, 15, 6), (360, 100, 10, 4), (150, 50, 10, 4), (320, 50, 5, 7), (7, 200, 20, 1), (0, 50, 5, 0)])
def test_word_windows(spark, n, size, overlap, want):
    assert len(one(spark, chunking.word_windows(F.lit(" ".join(f"w{i}" for i in range(n))), size, overlap))) == want


def test_window_arguments():
    with pytest.raises(ValueError, match="overlap"):
        chunking.char_windows(F.lit("x"), 10, 10)


def test_table_split(spark):
    head, rule, rows = "| " + "h" * 18 + " |", "| --------- |", ["| " + str(i) * 60 + " |" for i in range(6)]
    parts = one(spark, tables.split_rows(F.lit("\n".join([head, rule, *rows])), 180))
    assert len(parts) == 3
    assert all(p.startswith(f"{head}\n{rule}\n") for p in parts)
    assert one(spark, F.size(tables.split_rows(F.lit("| a |\n| - |"), 5))) == 1


def test_short_merge(spark):
    rnd = random.Random(4)
    rows = [(i // 40, i, "x" * rnd.choice([5, 30, 79, 80, 120]), rnd.choice("ab")) for i in range(200)]
    got = {(r["doc"], r["first"]): (r["text"], r["merged"]) for r in chunking.merge_short(spark.createDataFrame(rows, "doc long, at long, t string, s string"), "doc", "at", "t", "s").collect()}
    want, i = {}, 0
    while i < len(rows):
        doc, at, t, s = rows[i]
        group = [t]
        i += 1
        while len(t) < 80 and i < len(rows) and rows[i][0] == doc and rows[i][3] == s and len(rows[i][2]) < 80 and sum(map(len, group)) + 3 * len(group) + len(rows[i][2]) < 400:
            group.append(rows[i][2])
            i += 1
        want[doc, at] = (" | ".join(group), len(group))
    assert got == want


def test_table_rules(spark):
    assert one(spark, rules.difficulty(F.lit(16), F.lit(2))) == "HARD"
    assert one(spark, rules.difficulty(F.lit(3), F.lit(4))) == "MEDIUM"
    assert one(spark, tables.faq_text(F.array(F.lit("Answer"), F.lit("Question")), F.array(F.lit("a"), F.lit("q")))) == "Q: q\nA: a"
    assert one(spark, rules.caption_type(F.lit("A photograph"))) == "chart"
    assert one(spark, rules.relation_of(F.lit("Contain"))) == "part_of"
    assert one(spark, rules.entity_type_of(F.lit("NOPE"))) == "Other"
    assert one(spark, text.is_garbage_entity(F.lit("1,234")))
    assert not one(spark, text.is_garbage_entity(F.lit("Sensor")))


def test_graph_rules(spark):
    cols = "subject_id string, predicate string, object_id string, weight double, seq long"
    d = spark.createDataFrame([("a", "p", "b", 0.5, 0), ("a", "p", "b", 0.9, 1), ("a", "p", "b", 0.9, 2), ("a", "q", "b", 0.1, 3)], cols)
    assert {(r["predicate"], r["weight"], r["seq"], r["first_seq"]) for r in graph.dedup_edges(d).collect()} == {("p", 0.9, 1, 0), ("q", 0.1, 3, 3)}


def test_rerank(spark):
    c = spark.createDataFrame([(0, "low", 0.1), (1, "high", 0.9), (2, "mid", 0.5), (3, "tie", 0.5)], "rank long, text string, s double")
    assert [r["text"] for r in search.rerank(c, F.col("s"), 3).collect()] == ["high", "mid", "tie"]
    assert search.over_fetch(5) == 15
    assert search.over_fetch(30) == 50
    assert math.isclose(one(spark, rules.clamp(F.lit(1.7))), 1.0)


def test_batch_top_k(spark):
    """Many queries are split into parts; each has its k nearest all the same."""
    import numpy as np

    x = np.random.default_rng(2).standard_normal((120, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in search.batch_top_k(asked, df, 3, block=50, most_queries=40).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert all([got[i][k] for k in (1, 2, 3)] == sorted(range(120), key=lambda j: (-float(x[i] @ x[j]), j))[:3] for i in range(120))
    assert search.batch_top_k(asked.limit(0), df).count() == 0


def test_time_grows_with_length(spark):
    """Windows, stripped lines and preambles of a text four times as long take far less than sixteen times as long."""
    import time

    def took(column, n):
        df = spark.createDataFrame([("word " * n,)], "t string")
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            df.select(F.xxhash64(column)).collect()
            runs.append(time.perf_counter() - start)
        return min(runs)

    for column in (chunking.word_windows(F.col("t"), 400, 80), chunking.char_windows(text.strip(F.col("t"))), text.dedup_lines(F.regexp_replace("t", " ", "\n"))):
        assert took(column, 160_000) < 10 * took(column, 40_000) + 0.5
