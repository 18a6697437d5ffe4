"""Models behind HTTP, against a server of the test's own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.plans import remote
from lodeworks.plans.vision import CALLS
from lodeworks.sources.convert import HttpConverter, elements_of


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            if self.path == "/api/chat":
                asked = json.loads(body)
                told = {"auth": self.headers.get("Authorization"), "options": asked["options"], "images": len(asked["messages"][0].get("images", []))}
                out = {"message": {"content": "" if "quiet" in asked["messages"][0]["content"] else json.dumps(told)}}
            elif self.path == "/api/embed":
                out = {"embeddings": [[3.0, 4.0 * (t != "zero"), 0.0] if t != "none" else [0.0] * 3 for t in json.loads(body)["input"]]}
            else:
                out = {"document": {"json_content": {"texts": [{"label": "text", "text": "read" if b"%PDF" in body else "no"}], "body": {"children": [{"$ref": "#/texts/0"}]}}}}
            data = json.dumps(out).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_chat(server):
    m = remote.HttpModel(server, "m", "Bearer t")
    assert json.loads(m.complete("hello")) == {"auth": "Bearer t", "options": {"temperature": 0.0}, "images": 0}
    assert json.loads(m("look", "cGlj", CALLS["caption"]))["options"] == {"temperature": 0.0, "num_predict": 80}
    assert json.loads(m("look", "cGlj", CALLS["caption"]))["images"] == 1 and m.complete("quiet") == ""
    with pytest.raises(ValueError, match="server"):
        remote.HttpModel("", "m")
    with pytest.raises(OSError):
        remote.HttpModel("http://127.0.0.1:9", "m", timeout=1).complete("x")


def test_embeddings(spark, server):
    e = remote.HttpEmbedder(server, "m")
    assert e.dimension == 3 and e.embed([]).shape == (0, 3)
    assert np.allclose(e.embed(["a", "zero", "none"]), [[0.6, 0.8, 0], [1, 0, 0], [0, 0, 0]])
    got = spark.createDataFrame([("a",), ("zero",)], "t string").select(e.column(F.col("t")).alias("v")).collect()
    assert sorted(round(r["v"][0], 3) for r in got) == [0.6, 1.0]


def test_converter(server):
    assert [e["text"] for e in elements_of(HttpConverter(server).convert("a.pdf", b"%PDF"))] == ["read"]


def test_collection(spark, server, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "p.pdf").write_bytes(b"%PDF")
    env = {"OLLAMA_INDEX_URL": server, "EMBEDDING_MODEL": "e", "OLLAMA_CHAT_URL": server, "CHAT_MODEL": "c", "DOCLING_URL": server, "GRAPH_EXTRACTOR": "rules"}
    c = remote.collection(spark, f"file://{tmp_path}/root", f"file://{tmp_path}/data", env)
    assert c.index() == {"new": 1}
    assert [(r["doc_id"], len(r["vector"])) for r in c.chunks.read().collect()] == [("p.pdf", 3)]
    assert c.answer("what", "vector")["answer"].startswith('{"auth"')
    plain = remote.collection(spark, f"file://{tmp_path}/root2", f"file://{tmp_path}/data", {})
    assert plain.settings.extractor == "rules" and plain.index() == {"failed": 1}
