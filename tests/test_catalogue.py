"""Every query that SQL can express gives the rows of its SQL."""

import re

import duckdb
import oracle
import pytest

from lodeworks.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, con, name):
    assert not oracle.differ(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], con)


def test_rest():
    """What SQL doesn't state is held against plain statements: here, in test_documents, test_extraction, test_answers."""
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"chunk_separator_window", "detected_languages", "document_chunks_unified", "graph_context_fallback", "rule_graph_pipeline", "rule_svo_triples"}


def test_separator_window(spark):
    from lodeworks.operators.chunking import cut_at_separators

    want = sorted((r["doc_id"], k, p) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"] for k, p in enumerate(cut_at_separators(r["text"], 800, 80)))
    assert sorted(map(tuple, catalogue.QUERIES["chunk_separator_window"](spark, SF).collect())) == want


def test_rule_triples(spark):
    from lodeworks.plans.providers import RuleExtractor

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((str(r["doc_id"]), x["subject"], x["predicate"], x["object"]) for r in docs for x in RuleExtractor().extract(r["text"]))
    got = catalogue.QUERIES["rule_svo_triples"](spark, SF).collect()
    assert want and sorted((r["source_doc"], r["subject"], r["predicate"], r["object"]) for r in got) == want
    counts = {r["source_doc"]: r for r in catalogue.QUERIES["rule_graph_pipeline"](spark, SF).collect()}
    assert len(counts) == len({r["doc_id"] for r in docs}) and all(r["deduplicated_triples"] <= r["raw_triples"] for r in counts.values())


def test_languages(spark):
    """The guess agrees with the table's language for most documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 200").select("doc_id", "lang")
    got = catalogue.QUERIES["detected_languages"](spark, SF).join(docs, "doc_id").collect()
    assert sum(r["language"].lower() == (r["lang"] or "en") for r in got) >= 0.9 * len(got)


def test_unified(spark):
    """Every question of a table is a chunk, and every word of a paragraph is in some chunk of its conversation."""
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = catalogue.QUERIES["document_chunks_unified"](spark, SF).collect()
    by = {}
    for r in got:
        by.setdefault(r["name"], []).append(r)
    for r in rows:
        chunks = by.get(f"conv_{r['conv_id']}.docx", [])
        if r["turn"] % 6 not in (0, 5):
            assert set(re.findall(r"\w+", r["text"])) <= {w for c in chunks for w in re.findall(r"\w+", c["chunk_text_original"])}
        if r["turn"] % 6 == 5 and r["text"].strip():
            assert any(c["chunk_text_original"].startswith(f"Q: {r['role']}\nA: ") for c in chunks if c["source"] == "table")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_short_chunk_merge(spark):
    """Whole texts, as a plain fold in Python merges them."""
    want = []
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    for conv in {r["conv_id"] for r in rows}:
        now = None
        for r in sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["turn"]):
            text = r["text"].strip()
            short = len(text) < 80 and "\n" not in text
            if short and now and now["short"] and now["role"] == r["role"] and now["total"] + 3 * now["merged"] + len(text) < 400:
                now["text"], now["merged"], now["total"] = now["text"].strip() + " | " + text, now["merged"] + 1, now["total"] + len(text)
                continue
            now = {"conv": conv, "first": r["turn"], "text": r["text"], "merged": 1, "total": len(text), "role": r["role"], "short": short}
            want.append(now)
    got = catalogue.QUERIES["short_chunk_merge"](spark, SF).collect()
    assert max(len(r["text"]) for r in got) > 400
    assert sorted(map(tuple, got)) == sorted((w["conv"], w["first"], w["text"], w["merged"]) for w in want)


def test_table_split_longer_keys(spark, tmp_path):
    """Keys of four digits: a part's last row fits by the table's own length, but not by the SQL's count of the header."""
    spark.range(120).selectExpr("id + 1000 as s_suppkey", "format_string('Supplier#%09d', id) as s_name", "cast(id % 2 * (id % 40 + 1) as int) as s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert not oracle.differ(catalogue.QUERIES["table_split_rows"](spark, str(tmp_path)), catalogue.ORACLES["table_split_rows"], con)
