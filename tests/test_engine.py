"""A collection from a folder of files: index, change, answer."""

from pyspark.sql import functions as F

from lodeworks.operators import graph
from lodeworks.plans.engine import TRIPLES, Collection
from lodeworks.sources import convert, files


def test_collection(spark, tmp_path):
    data, root = tmp_path / "data", tmp_path / "root"
    (data / "sub").mkdir(parents=True)
    (data / "a.txt").write_text("The sensor controls the valve. " * 60)
    (data / "sub" / "b.html").write_text("<p>Gateway supports modbus links.</p><script>x</script>")
    (data / "skip.bin").write_text("no")
    c = Collection(spark, f"file://{root}", f"file://{data}")
    assert c.status() == "not_indexed"
    assert c.index() == {"new": 2}
    assert c.status() == "indexed"
    assert c.index() == {}
    assert c.chunks.read().count() == 4
    assert "governs" in c.graph_context("which sensor")
    (data / "a.txt").write_text("Short text.")
    (data / "sub" / "b.html").unlink()
    assert c.status() == "new_docs"
    assert c.index() == {"modified": 1, "deleted": 1}
    assert [r["doc_id"] for r in c.chunks.read().collect()] == ["a.txt"]
    assert c.state.flags() == {"vector_indexed": True, "graph_indexed": True}
    assert c.answer("short text", "vector")["sources"][0]["doc_id"] == "a.txt"


def test_csv(spark, tmp_path):
    (tmp_path / "massive.csv").write_text("Metric;A;B\nx; 1 ;2\n\ny;3;4\n")
    rows = convert.elements(files.scan(spark, f"file://{tmp_path}")).orderBy("seq").collect()
    assert [r["type"] for r in rows] == ["heading", "table"]
    assert rows[1]["table_rows"] == [["Metric", "A", "B"], ["x", "1", "2"], ["y", "3", "4"]]


def test_index_failed(spark, tmp_path):
    """CSV files are indexed; what gives no text is tried again."""
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.txt").write_text("Short text.")
    (data / "t.csv").write_text("pump;speed\nalpha;17\nbeta;19\n")
    (data / "blank.txt").write_text("  ")
    (data / "p.pdf").write_bytes(b"%PDF")
    c = Collection(spark, f"file://{tmp_path}/root", f"file://{data}")
    assert c.index() == {"new": 2, "failed": 2}
    rows = {r["doc_id"]: r for r in c.chunks.read().collect()}
    assert set(rows) == {"a.txt", "t.csv"}
    assert all(x in rows["t.csv"]["text"] for x in ("pump", "beta", "19")) and '"parts_table"' in rows["t.csv"]["metadata"]
    assert sorted(r["name"] for r in c.manifest.read().collect()) == ["a.txt", "t.csv"]
    assert c.index() == {"failed": 2}
    (data / "blank.txt").write_text("Not blank.")
    assert c.index() == {"new": 1, "failed": 1}
    assert c.chunks.read().count() == 3


def test_graph_context_whole(spark, tmp_path):
    """Every triple that matches is in the context."""
    c = Collection(spark, f"file://{tmp_path}/root", f"file://{tmp_path}")
    n = F.col("id").cast("string")
    rows = spark.range(300).select(*({"triple_id": n, "subject_name": F.concat(F.lit("sensor "), n), "predicate": F.lit("has"), "object_name": F.concat(F.lit("x"), n), "weight": F.lit(1.0)}.get(f.name, F.lit("c")).cast(f.dataType).alias(f.name) for f in TRIPLES))
    c.triples.replace(rows.select(*graph.STORED))
    assert len(c.graph_context("which sensor").split("\n")) == 300
