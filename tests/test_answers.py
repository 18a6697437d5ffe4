"""Answers: rewriting, the adaptive steps, reranking, collections with caches, settings, the service."""

import io
import json

import office_files
import pytest
from pyspark.sql import functions as F

from lodeworks.operators import search
from lodeworks.plans import config, engine, evaluation, rewriting, service
from lodeworks.plans.adaptive import Adaptive, State, reflect
from lodeworks.plans.providers import HashEmbedder, ModelScorer, NameRecogniser, OverlapScorer, TemplateModel


def down(prompt):
    raise RuntimeError("down")


def test_rewriting():
    assert rewriting.rewrite("q", "hyde", lambda p: "a passage") == rewriting.Rewrite("hyde", "q", ["a passage"], "a passage")
    assert rewriting.rewrite("q", "hyde", down).passage == "q"
    assert rewriting.rewrite("q", "multi_query", lambda p: " one \n\ntwo\nthree\nfour").queries == ["q", "one", "two", "three"]
    assert rewriting.rewrite("q", "multi_query", down).queries == ["q"]
    assert rewriting.rewrite("q", "step_back", lambda p: " wide ").queries == ["q", "wide"]
    assert rewriting.rewrite("q", "step_back", down).queries == ["q", "q"]
    with pytest.raises(ValueError, match="mode"):
        rewriting.rewrite("q", "other", down)


def steps(s):
    return [t["node"] for t in s.trace]


@pytest.mark.parametrize(("method", "context", "reply", "want"), [
    ("hybrid", "c", "yes", ["vector_retrieve", "evaluate_context", "generate_answer"]), ("vector", "c", " no, it lacks", ["vector_retrieve", "evaluate_context", "graph_retrieve", "generate_answer"]),
    ("hybrid", " ", "yes", ["vector_retrieve", "evaluate_context", "graph_retrieve", "generate_answer"]), ("graph", "c", "yes", ["graph_retrieve", "generate_answer"]),
])
def test_adaptive(method, context, reply, want):
    prompts = []

    def say(prompt):
        prompts.append(prompt)
        return reply

    s = Adaptive(say, lambda q, k: (context, [{"doc_id": "d"}] * k), lambda q: "lines").run(State("why", method, 3))
    assert steps(s) == want
    assert ("Graph context:\nlines" in prompts[-1]) == ("graph_retrieve" in want)
    assert s.iterations == 1 and s.trace[-1]["detail"] == f"{len(reply)} chars"


def test_adaptive_failures():
    s = Adaptive(down, lambda q, k: ("c", []), down).run(State("why"))
    assert steps(s) == ["vector_retrieve", "evaluate_context", "generate_answer"] and s.answer == ""
    s = Adaptive(lambda p: p, lambda q, k: ("", []), down).run(State("why"))
    assert "No context available." in s.answer and s.trace[2]["detail"] == "0 chars of graph context"
    out = reflect(Adaptive(down, lambda q, k: 1 / 0, down), "why")
    assert out["self_rag_meta"]["process_log"][0]["step"] == "error" and out["answer"] == ""
    out = reflect(Adaptive(lambda p: "YES", lambda q, k: ("c", [{}]), down), "why")
    assert [p["label"] for p in out["self_rag_meta"]["process_log"]] == ["Vector Retrieve", "Evaluate Context", "Generate Answer"] and out["self_rag_meta"]["relevant_chunks"] == 1


def test_reranker(spark):
    c = spark.createDataFrame([(0, "low"), (1, "high"), (2, "mid"), (3, "mid")], "rank long, text string")
    score = lambda s: [r["text"] for r in search.rerank(c, s.column("q", F.col("text")), 3).collect()]
    assert score(ModelScorer(lambda: lambda pairs: [{"low": 0.1, "mid": 0.5, "high": 0.9}[p] for _, p in pairs])) == ["high", "mid", "mid"]
    assert score(ModelScorer(lambda: 1 / 0)) == ["low", "high", "mid"]
    assert score(ModelScorer(lambda: lambda pairs: 1 / 0)) == ["low", "high", "mid"]
    assert c.columns == ["rank", "text"]
    loads = []
    s = ModelScorer(lambda: loads.append(1) or 1 / 0)
    s.score("q", ["a"])
    s.score("q", ["a"])
    assert len(loads) == 2
    assert OverlapScorer().score("a b", ["a", "b a", ""]) == [0.5, 1.0, 0.0]


@pytest.fixture
def folder(tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.txt").write_text("The sensor controls the valve. " * 40)
    (data / "b.docx").write_bytes(office_files.docx([("Heading1", "Pumps"), ("", "Gateway supports modbus links."), ("table", "Question|Answer\nWho|Me")]))
    (data / "t.xlsx").write_bytes(office_files.xlsx({"Data": [["Data sheet", None, None, None], [None, "Alpha", "Beta", "Gamma"], *[[f"metric {k}", k, k + 1, k + 2] for k in range(7)]]}))
    (data / "bad.pdf").write_bytes(b"%PDF")
    (data / "deep").mkdir()
    (data / "deep" / "c.md").write_text("Deep words.")
    return tmp_path


def collection(spark, folder, **more):
    return engine.Collection(spark, f"file://{folder}/root", f"file://{folder}/data", **more)


def test_collection_of_all_kinds(spark, folder):
    settings = config.Settings.read({"ENABLE_MASSIVE_TABLE_STRATEGY": "on", "GRAPH_EXTRACTOR": "rules"})
    c = collection(spark, folder, settings=settings, entities=NameRecogniser())
    assert c.status() == "not_indexed" and c.document_count() == 4
    assert c.vector_search("x") == engine.NO_DOCUMENTS and c.debug() == {"error": "table does not exist"}
    assert c.index() == {"new": 4, "failed": 1}
    rows = {r["id"]: json.loads(r["metadata"]) for r in c.chunks.read().collect()}
    kinds = {(m["source"], m["chunk_type"]) for m in rows.values()}
    assert {("a.txt", "text"), ("b.docx", "text"), ("b.docx", "parts_table"), ("t.xlsx", "entity_profile"), ("t.xlsx", "table_comparison"), ("c.md", "text")} <= kinds
    profile = next(m for m in rows.values() if m["chunk_type"] == "entity_profile")
    assert profile["sheet_name"] == "Data" and len(profile["metric_keys"]) == 7 and profile["page_number"] is None
    assert "sheet_name" not in rows["a.txt#0"] and rows["a.txt#0"]["section_title"] is None
    assert c.debug()["doc_ids"] == ["a.txt", "b.docx", "c.md", "t.xlsx"]
    assert [r["chunk_index"] for r in c.document_chunks("a.txt").collect()] == [0, 1]
    triples = {(r["subject_name"], r["predicate"], r["object_name"]) for r in c.triples.read().collect()}
    assert ("Gateway", "supports_protocol", "modbus") in triples
    assert "supports_protocol" in c.graph_context("the Gateway") and c.browse(predicate="SUPPORTS_PROTOCOL").count() == 1
    assert c.global_search("zzz") == engine.NO_TRIPLES
    assert c.status() == "new_docs"
    with pytest.raises(engine.NewDocuments):
        c.answer("sensor")
    (folder / "data" / "bad.pdf").unlink()
    assert c.status() == "indexed"
    out = c.answer("which Gateway supports modbus", "hybrid", 2)
    assert len(out["sources"]) == 2 and "Gateway" in out["graphrag_context"] and set(out["sources"][0]) == {"doc_id", "chunk_index", "excerpt", "full_text", "reranker_score"}
    assert c.answer("which Gateway", "graph")["answer"] == out["graphrag_context"]
    assert c.delete("b.docx") >= 1 and "b.docx" not in c.debug()["doc_ids"]


class Counting(HashEmbedder):
    """Other vectors than HashEmbedder's, to tell what was embedded anew."""

    def embed(self, texts):
        return -super().embed(texts)


def test_cache_and_rebuild(spark, folder):
    c = collection(spark, folder)
    c.index()
    before = {r["id"]: r["vector"] for r in c.chunks.read().collect()}
    (folder / "data" / "a.txt").write_text("Other words now.")
    other = collection(spark, folder, embedder=Counting())
    other.index(force=True)
    after = {r["id"]: r["vector"] for r in other.chunks.read().collect()}
    assert after["c.md#0"] == before["c.md#0"]  # the same chunks: from the cache
    assert [-x for x in after["a.txt#0"]] == [float(x) for x in HashEmbedder().embed(["[Document: a]\nOther words now."])[0]]
    other.chunks.replace(other.chunks.read().limit(0))
    assert other.rebuild() == 4 and {r["id"] for r in other.chunks.read().collect()} == set(after)
    (folder / "data" / "a.txt").unlink()
    other.index()
    assert other.rebuild() == 4 and other.rebuild(prune=True) == 3
    assert collection(spark, folder / "none", embedder=Counting()).rebuild() == 0


def test_search_modes(spark, folder):
    (folder / "data" / "bad.pdf").unlink()
    c = collection(spark, folder, scorer=OverlapScorer(), model=TemplateModel(lambda p: "sensor valve\nmodbus links" if "other ways" in p else "Gateway supports modbus"))
    c.index()
    rows = c.search("Gateway supports modbus", 2).collect()
    assert len(rows) == 2 and rows[0]["doc_id"] == "b.docx" and rows[0]["reranker_score"] >= rows[1]["reranker_score"]
    out = c.answer("what", "vector", 2, "hyde")
    assert out["rewrite"].mode == "hyde" and out["sources"][0]["doc_id"] == "b.docx" and out["sources"][0]["reranker_score"] is None
    out = c.answer("what", "vector", 2, "multi_query")
    keys = [(s["doc_id"], s["chunk_index"]) for s in out["sources"]]
    assert len(keys) == len(set(keys)) and len(out["rewrite"].queries) == 3 and 2 <= len(keys) <= 6
    out = c.answer("Gateway", "hybrid", 2, "step_back", self_rag=True)
    assert out["self_rag_meta"]["relevant_chunks"] == 2 and out["rewrite"].mode == "step_back"
    assert c.hybrid_search("Gateway", 2) and collection(spark, folder / "none").hybrid_search("zzz") == engine.NO_CONTEXT
    assert c.generate("q", "c") and collection(spark, folder, model=TemplateModel(down)).generate("q", "c") == ""
    near = c.graph_rows("gatewayy gatewai").collect()
    assert not near or near[0]["pos"] is not None
    q = spark.createDataFrame([("what supports modbus", "Gateway", "")], "question string, ground_truth string, category string")
    found = evaluation.samples(c, q, 2)
    judged = evaluation.judged(found, {"recall": evaluation.word_recall, "broken": lambda s: 1 / 0})
    assert judged[0]["recall"] == 1.0 and judged[0]["broken"] is None and "_broken_error" in judged[0]
    m = evaluation.means(spark.createDataFrame([(1.0, None), (0.0, None)], "a double, b double"), "a", "b").first()
    assert (m["a"], m["b"]) == (0.5, None)


def test_fallback_names(spark):
    """The fallback finds the names that a plain search over all of them finds."""
    import numpy as np

    from lodeworks.plans import catalogue

    sf = "/root/testdata/sf0.001"
    got = {r["triple_id"] for r in catalogue.QUERIES["graph_context_fallback"](spark, sf).collect()}
    triples = catalogue.star_triples(spark, sf).collect()
    names = sorted({r["subject_name"] for r in triples} | {r["object_name"] for r in triples})
    e = HashEmbedder()
    q, v = e.embed([catalogue.FALLBACK])[0].astype(float), e.embed(names).astype(float)
    sim = v @ q / (np.linalg.norm(v, axis=1) * np.linalg.norm(q) + 1e-9)
    near = [n for s, n in sorted(zip(-sim, names, strict=True))[:5] if -s >= 0.5]
    want = {r["triple_id"] for r in triples if any(n.lower() in r[f"{x}_name"].lower() for n in near for x in ("subject", "object"))}
    assert near and got == want


def test_questions(spark, tmp_path):
    (tmp_path / "c_2.json").write_text(json.dumps([{"user_input": " b? ", "reference": "r", "子分類": "k"}]))
    (tmp_path / "c_1.json").write_text(json.dumps([{"user_input": "a?"}, {"user_input": " "}]))
    (tmp_path / "other_1.json").write_text("[]")
    rows = evaluation.load_questions(spark, f"file://{tmp_path}", "c").collect()
    assert [(r["question"], r["ground_truth"], r["category"]) for r in rows] == [("a?", "", ""), ("b?", "r", "k")]
    long = evaluation.shortened({"user_input": "q", "response": "x" * 2000, "retrieved_contexts": ["y" * 2000] * 5, "reference": ""})
    assert len(long["response"]) == 1200 and [len(c) for c in long["retrieved_contexts"]] == [1200] * 3


def test_settings():
    assert len(config.DEFAULTS) == 36
    s = config.Settings.read({})
    assert (s.size, s.overlap, s.graph_size, s.graph_overlap, s.top_k, s.rerank, s.extractor, s.tables.massive) == (800, 80, 400, 80, 5, False, "hybrid", False)
    assert config.Settings.read({"CHUNK_SIZE": "100", "ENABLE_RERANKER": "yes", "MASSIVE_COMPARISON_WINDOW": "1"}).tables.window == 2
    assert [config.switch(v) for v in ("1", "ON", "yes ", "no", None)] == [True, True, True, False, False]
    assert not config.switch("on", on=False)
    assert [config.bearer(x) for x in ("abc", "Bearer abc", " bearer  abc ", "", None)] == ["Bearer abc"] * 3 + ["", ""]
    shown = {x["key"]: x for x in config.listing({"OLLAMA_BEARER": "secret", "TOP_K": "7"})}
    assert shown["OLLAMA_BEARER"]["value"] == "***" and shown["TOP_K"] == {"key": "TOP_K", "value": "7", "set": True, "default": "5"}


def call(s, method, path, body=b"", kind="application/json", query=""):
    told = {}

    def start(status, headers):
        told["status"], told["kind"] = int(status.split()[0]), headers[0][1]

    body = json.dumps(body).encode() if isinstance(body, dict) else body
    env = {"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_TYPE": kind, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}
    out = b"".join(s(env, start))
    return told["status"], json.loads(out) if told["kind"] == "application/json" and out else out


def form(name, content):
    body = f'--edge\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\n\r\n'.encode() + content + b"\r\n--edge--\r\n"
    return body, "multipart/form-data; boundary=edge"


def test_service(spark, tmp_path):
    s = service.Service(spark, f"file://{tmp_path}")
    assert call(s, "GET", "/collections") == (200, [])
    assert call(s, "POST", "/collections", {"name": "bad name"})[0] == 422
    status, info = call(s, "POST", "/collections", {"name": "one"})
    assert status == 201 and info == {"name": "one", "doc_count": 0, "index_status": "not_indexed", "vector_indexed": False, "graph_indexed": False}
    assert call(s, "POST", "/collections", {"name": "one"})[0] == 409
    assert call(s, "POST", "/collections/one/documents", *form("x.exe", b"no"))[0] == 422
    assert call(s, "POST", "/collections/one/documents", *form("../a.txt", b"Gateway supports modbus links.")) == (201, {"filename": "a.txt", "size_bytes": 30})
    assert call(s, "GET", "/collections/one/documents") == (200, [{"filename": "a.txt", "size_bytes": 30}])
    assert call(s, "GET", "/collections/one/documents/a.txt/download") == (200, b"Gateway supports modbus links.")
    assert call(s, "GET", "/collections/one/documents/b.txt/download")[0] == 404
    assert call(s, "GET", "/collections/one/documents/..%5Ca.txt/download")[0] == 400
    assert call(s, "GET", "/collections/none/documents")[0] == 404
    assert call(s, "GET", "/collections/one/documents/a.txt/embedded")[0] == 404
    status, task = call(s, "POST", "/collections/one/index", {"mode": "all"})
    assert status == 202 and task["status"] == "pending"
    s.tasks.wait()
    assert call(s, "GET", f"/collections/one/index/{task['task_id']}")[1]["status"] == "done"
    assert call(s, "GET", "/tasks") == (200, [])
    assert call(s, "GET", "/collections/one/index/none")[0] == 404
    assert call(s, "POST", "/collections/one/index", {"mode": "odd"})[0] == 422
    assert call(s, "GET", "/collections/one/debug/table") == (200, {"total_rows": 1, "doc_ids": ["a.txt"]})
    assert call(s, "GET", "/collections/one/documents/a.txt/chunks")[1][0]["text"].endswith("Gateway supports modbus links.")
    assert call(s, "GET", "/collections/one/documents/a.txt/embedded")[1]["dimension"] == 64
    assert call(s, "GET", "/collections/one/graph/stats") == (200, {"triple_count": 1})
    assert call(s, "GET", "/collections/one/graph", query="predicate=supports_protocol")[1][0]["subject"]["name"] == "Gateway"
    assert call(s, "GET", "/collections/one/graph", query="predicate=none") == (200, [])
    status, out = call(s, "POST", "/collections/one/query", {"query": "Gateway", "method": "hybrid"})
    assert status == 200 and out["sources"][0]["doc_id"] == "a.txt" and "supports_protocol" in out["graphrag_context"] and out["image_used"] is False
    status, out = call(s, "POST", "/collections/one/query", {"query": "Gateway", "method": "vector", "self_rag": True, "rewrite": "hyde"})
    assert out["self_rag_meta"]["iterations"] == 1 and out["rewrite_meta"]["mode"] == "hyde"
    status, out = call(s, "POST", "/collections/one/query", {"query": "Gateway", "stream": True, "rewrite": "step_back"})
    names = [x.split("\n")[0][7:] for x in out.decode().split("\n\n") if x]
    assert names[:3] == ["rewrite_meta", "chunks", "graphrag"] and names[-2:] == ["sources", "done"] and names.count("node_enter") == names.count("node_complete") == 4 and "routing_decision" in names and "token" in names
    status, out = call(s, "POST", "/collections/one/query", {"query": "Gateway", "stream": True, "method": "graph"})
    names = [x.split("\n")[0][7:] for x in out.decode().split("\n\n") if x]
    assert names == ["graphrag", "node_enter", "node_complete", "routing_decision", "node_enter", "token", "node_complete", "done"]
    assert call(s, "POST", "/collections/one/query", {"method": "odd"})[0] == 422
    call(s, "POST", "/collections/one/documents", *form("b.txt", b"More."))
    assert call(s, "POST", "/collections/one/query", {"query": "Gateway"})[0] == 409
    assert call(s, "PATCH", "/collections/one", {"new_name": "two"})[1]["doc_count"] == 2
    assert sorted(service.Service(spark, f"file://{tmp_path}").collections) == ["two"]
    assert call(s, "DELETE", "/collections/two/documents/b.txt")[0] == 204
    status, task = call(s, "POST", "/collections/two/rebuild")
    s.tasks.wait()
    assert s.tasks.known[task["task_id"]].detail == "rebuilt from 1 files"
    assert len(call(s, "GET", "/api/env")[1]) == 36 and call(s, "GET", "/")[1] == {"collections": ["two"]}
    assert call(s, "PUT", "/collections")[0] == 405 and call(s, "GET", "/nowhere")[0] == 404
    assert call(s, "DELETE", "/collections/two")[0] == 204 and call(s, "GET", "/collections") == (200, [])


def test_task_error(spark):
    tasks = service.Tasks()
    t = tasks.start("c", lambda: 1 / 0)
    tasks.wait()
    assert t.status == "error" and "ZeroDivisionError" in t.detail and " in " in t.detail


def test_token_stream_error(spark, folder):
    out = list(service.token_stream(collection(spark, folder), "q", "odd"))
    assert len(out) == 1 and out[0].startswith("event: error")
