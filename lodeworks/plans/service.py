"""Collections over HTTP: a WSGI application of the standard library around the engine."""

from __future__ import annotations

import json
import re
import threading
import time
import traceback
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from email import message_from_bytes
from urllib.parse import parse_qs, unquote

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import files, store
from . import config
from .engine import Collection, NewDocuments

NAME = re.compile(r"[a-zA-Z0-9_-]+")
STATUS = {200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 400: "Bad Request", 404: "Not Found", 405: "Method Not Allowed", 409: "Conflict", 422: "Unprocessable Entity", 500: "Internal Server Error"}


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        self.status, self.detail = status, detail
        super().__init__(detail)


def origin(error: Exception) -> str:
    """Where an error came from."""
    steps = traceback.extract_tb(error.__traceback__)
    return f"{steps[-1].filename}:{steps[-1].lineno} in {steps[-1].name}" if steps else "unknown location"


@dataclass
class Task:
    task_id: str
    collection: str
    status: str = "pending"
    detail: str | None = None


class Tasks:
    """Work in the background: pending, running, then done or error with where it came from."""

    def __init__(self):
        self.known: dict[str, Task] = {}
        self.threads: list[threading.Thread] = []

    def start(self, collection: str, work: Callable[[], str | None]) -> Task:
        task = self.known.setdefault(key := str(uuid.uuid4()), Task(key, collection))

        def run() -> None:
            task.status = "running"
            try:
                task.detail = work()
                task.status = "done"
            except Exception as error:
                task.detail = f"{type(error).__name__}: {error} (at {origin(error)})"
                task.status = "error"

        thread = threading.Thread(target=run, daemon=True)
        self.threads.append(thread)
        thread.start()
        return task

    def open(self) -> list[Task]:
        return [t for t in self.known.values() if t.status in ("pending", "running")]

    def wait(self) -> None:
        for t in self.threads:
            t.join()


def event(name: str, data) -> str:
    return f"event: {name}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"


def token_stream(c: Collection, asked: str, method: str = "hybrid", k: int | None = None, rewrite: str | None = None, tokens: Callable[[str], Iterator[str | tuple[str, str]]] | None = None) -> Iterator[str]:
    """An answer as server-sent events: the rewrite, what was found, each step, the tokens, the sources, done. tokens gives the pieces of a
    reply, thoughts as ("think", text); without it the whole answer is one token. A failure ends the stream with an error event."""

    def step(node: str, work: Callable[[], None] = lambda: None) -> Iterator[str]:
        began = time.time()
        yield event("node_enter", {"node": node, "timestamp": began})
        work()
        yield event("node_complete", {"node": node, "duration_ms": int((time.time() - began) * 1000)})

    try:
        g = c.gather(asked, method, k, rewrite)
        if g["rewrite"] is not None:
            yield event("rewrite_meta", asdict(g["rewrite"]))
        if method != "graph":
            yield event("chunks", g["sources"])
        if g["graph"] is not None:
            yield event("graphrag", g["graph"])
        graph = method != "vector"
        if method == "graph":
            yield from step("graph_retrieve")
        else:
            yield from step("vector_retrieve")
            yield from step("evaluate_context")
        yield event("routing_decision", {"needs_graph": graph})
        if method == "hybrid":
            yield from step("graph_retrieve")
        began = time.time()
        yield event("node_enter", {"node": "generate_answer", "timestamp": began})
        if method == "graph":
            pieces: Iterator = iter([g["graph"] or c.global_search(asked)])
        else:
            context = g["context"] if method == "vector" else c.joined(g["context"], g["graph"])
            pieces = tokens(f"Context:\n{context}\n\nQuestion: {asked}") if tokens else iter([c.generate(asked, context)])
        for p in pieces:
            kind, text = p if isinstance(p, tuple) else ("token", p)
            if text:
                yield event(kind, text)
        yield event("node_complete", {"node": "generate_answer", "duration_ms": int((time.time() - began) * 1000)})
        if method != "graph":
            yield event("sources", g["sources"])
        yield event("done", "")
    except Exception as error:
        yield event("error", {"detail": str(error), "type": type(error).__name__, "location": origin(error)})


@dataclass
class Service:
    """All collections below root: files in data/, tables in ragdata/. make builds a collection from (spark, tables, files)."""

    spark: SparkSession
    root: str
    make: Callable[[SparkSession, str, str], Collection] = Collection
    collections: dict[str, Collection] = field(default_factory=dict)
    tasks: Tasks = field(default_factory=Tasks)

    def __post_init__(self):
        for name, _ in self.folder("ragdata").list(folders=True):
            if NAME.fullmatch(name):
                self.collections[name] = self.open(name)

    def folder(self, *parts: str) -> store.Files:
        return store.Files(self.spark, "/".join((self.root, *parts)))

    def open(self, name: str) -> Collection:
        for kind in ("data", "ragdata"):
            self.folder(kind, name).make()
        return self.make(self.spark, f"{self.root}/ragdata/{name}", f"{self.root}/data/{name}")

    def of(self, name: str) -> Collection:
        if name not in self.collections:
            raise Refused(404, f"Collection '{name}' not found")
        return self.collections[name]

    def fresh(self, name: str) -> str:
        if not NAME.fullmatch(name or ""):
            raise Refused(422, "a name has letters, digits, _ and - only")
        if name in self.collections:
            raise Refused(409, f"Collection '{name}' already exists")
        return name

    def file(self, name: str, file: str) -> store.Files:
        """The folder of a collection's files, for a file that is there."""
        if "/" in file or "\\" in file or ".." in file:
            raise Refused(400, "Invalid filename")
        there = self.folder("data", name)
        if not there.exists(file):
            raise Refused(404, f"Document '{file}' not found")
        return there

    def supported(self, name: str) -> list[tuple[str, int]]:
        return [(f, n) for f, n in self.folder("data", name).list() if f.lower().endswith(files.SUPPORTED)]

    def info(self, name: str) -> dict:
        c = self.of(name)
        status = c.status() if self.supported(name) else "not_indexed" if c.manifest.version() is None else "indexed"
        return {"name": name, "doc_count": len(self.supported(name)), "index_status": status, **c.state.flags()}

    def __call__(self, env: dict, start: Callable) -> Iterator[bytes]:
        """The WSGI entry."""
        path, method = env.get("PATH_INFO", "/"), env["REQUEST_METHOD"]
        try:
            handler, found = self.route(method, path)
            body = env["wsgi.input"].read(int(env.get("CONTENT_LENGTH") or 0)) if env.get("wsgi.input") else b""
            query = {k: v[-1] for k, v in parse_qs(env.get("QUERY_STRING", "")).items()}
            status, out = handler(self, Request(body, env.get("CONTENT_TYPE", ""), query), *map(unquote, found))
        except Refused as r:
            status, out = r.status, {"detail": r.detail}
        except Exception as error:
            status, out = 500, {"detail": str(error), "type": type(error).__name__, "location": origin(error)}
        if isinstance(out, bytes):
            kind, data = "application/octet-stream", [out]
        elif isinstance(out, Iterator):
            kind, data = "text/event-stream", (x.encode() for x in out)
        else:
            kind, data = "application/json", [b"" if out is None else json.dumps(out, ensure_ascii=False, default=str).encode()]
        start(f"{status} {STATUS[status]}", [("Content-Type", kind)])
        return data

    @staticmethod
    def route(method: str, path: str):
        fits = [(m, f, x) for m, p, f in ROUTES if (x := p.fullmatch(path))]
        if not fits:
            raise Refused(404, "Not Found")
        for m, f, x in fits:
            if m == method:
                return f, x.groups()
        raise Refused(405, "Method Not Allowed")


@dataclass
class Request:
    body: bytes
    kind: str
    query: dict[str, str]

    def json(self) -> dict:
        try:
            out = json.loads(self.body or b"{}")
        except ValueError:
            raise Refused(422, "the body is no JSON") from None
        if not isinstance(out, dict):
            raise Refused(422, "the body is no object")
        return out

    def upload(self) -> tuple[str, bytes]:
        """Name and content of the one file of a multipart form."""
        form = message_from_bytes(f"Content-Type: {self.kind}\r\n\r\n".encode() + self.body)
        for part in form.walk():
            if part.get_filename():
                return part.get_filename().replace("\\", "/").rpartition("/")[2], part.get_payload(decode=True)
        raise Refused(422, "no file in the form")


ROUTES: list[tuple[str, re.Pattern, Callable]] = []


def route(method: str, path: str):
    def add(f):
        ROUTES.append((method, re.compile(re.sub(r"\{\w+\}", "([^/]+)", path)), f))
        return f

    return add


@route("GET", "/")
def front(s: Service, r: Request):
    return 200, {"collections": sorted(s.collections)}


@route("GET", "/collections")
def list_collections(s: Service, r: Request):
    return 200, [s.info(n) for n in sorted(s.collections)]


@route("POST", "/collections")
def create(s: Service, r: Request):
    name = s.fresh(r.json().get("name"))
    s.collections[name] = s.open(name)
    return 201, s.info(name)


@route("PATCH", "/collections/{name}")
def rename(s: Service, r: Request, name: str):
    s.of(name)
    new = s.fresh(r.json().get("new_name"))
    for kind in ("data", "ragdata"):
        s.folder(kind, name).move(f"{s.root}/{kind}/{new}")
    del s.collections[name]
    s.collections[new] = s.open(new)
    return 200, s.info(new)


@route("DELETE", "/collections/{name}")
def drop(s: Service, r: Request, name: str):
    s.of(name)
    del s.collections[name]
    for kind in ("data", "ragdata"):
        s.folder(kind, name).remove()
    return 204, None


@route("GET", "/collections/{name}/documents")
def list_documents(s: Service, r: Request, name: str):
    s.of(name)
    return 200, [{"filename": f, "size_bytes": n} for f, n in s.supported(name)]


@route("POST", "/collections/{name}/documents")
def upload(s: Service, r: Request, name: str):
    s.of(name)
    file, content = r.upload()
    if not file.lower().endswith(files.SUPPORTED) or ".." in file:
        raise Refused(422, f"Unsupported file '{file}'. Allowed: {sorted(files.SUPPORTED)}")
    s.folder("data", name).write(file, content)
    return 201, {"filename": file, "size_bytes": len(content)}


@route("GET", "/collections/{name}/documents/{file}/download")
def download(s: Service, r: Request, name: str, file: str):
    s.of(name)
    return 200, s.file(name, file).read_bytes(file)


@route("GET", "/collections/{name}/documents/{file}/embedded")
def embedded(s: Service, r: Request, name: str, file: str):
    c = s.of(name)
    if "/" in file or "\\" in file or ".." in file:
        raise Refused(400, "Invalid filename")
    rows = [x.asDict() for x in c.embedded.read().where(F.col("name") == file).orderBy("position").collect()]
    if not rows:
        raise Refused(404, f"nothing embedded of '{file}'")
    chunks = [{k: x[k] for k in ("position", "chunk_hash", "text", "vector", "metadata")} for x in rows]
    return 200, {"model": rows[0]["model"], "dimension": rows[0]["dimension"], "filename": file, "doc_stem": file.rpartition(".")[0], "chunks": chunks}


@route("DELETE", "/collections/{name}/documents/{file}")
def delete_document(s: Service, r: Request, name: str, file: str):
    s.of(name)
    s.file(name, file).delete(file)
    return 204, None


@route("GET", "/collections/{name}/documents/{file}/chunks")
def chunks(s: Service, r: Request, name: str, file: str):
    c = s.of(name)
    if "/" in file or "\\" in file or ".." in file:
        raise Refused(400, "Invalid filename")
    return 200, [x.asDict() for x in c.document_chunks(file).collect()]


@route("GET", "/collections/{name}/debug/table")
def debug_table(s: Service, r: Request, name: str):
    return 200, s.of(name).debug()


@route("POST", "/collections/{name}/index")
def index(s: Service, r: Request, name: str):
    c, body = s.of(name), r.json()
    mode = body.get("mode") or "all"
    if mode not in ("vector", "graph", "all"):
        raise Refused(422, f"unknown mode {mode}")
    task = s.tasks.start(name, lambda: json.dumps(c.index(mode, bool(body.get("force")))))
    return 202, {"collection": name, "status": "pending", "task_id": task.task_id}


@route("GET", "/tasks")
def open_tasks(s: Service, r: Request):
    return 200, [asdict(t) for t in s.tasks.open()]


@route("GET", "/collections/{name}/index/{task}")
def task_status(s: Service, r: Request, name: str, task: str):
    s.of(name)
    if task not in s.tasks.known:
        raise Refused(404, f"Task '{task}' not found")
    return 200, asdict(s.tasks.known[task])


@route("POST", "/collections/{name}/rebuild")
def rebuild(s: Service, r: Request, name: str):
    c = s.of(name)
    task = s.tasks.start(name, lambda: f"rebuilt from {c.rebuild()} files")
    return 202, {"collection": name, "status": "pending", "task_id": task.task_id}


@route("POST", "/collections/{name}/query")
def query(s: Service, r: Request, name: str):
    c, body = s.of(name), r.json()
    method, rewrite = body.get("method") or "hybrid", body.get("rewrite")
    if not isinstance(body.get("query"), str) or method not in ("vector", "graph", "hybrid") or rewrite not in (None, "hyde", "multi_query", "step_back"):
        raise Refused(422, "query, method and rewrite must be given rightly")
    k = int(body.get("top_k") or c.settings.top_k)
    try:
        if body.get("stream") and not body.get("self_rag"):
            if c.status() == "new_docs":
                raise NewDocuments("the collection has new documents; index it first")
            return 200, token_stream(c, body["query"], method, k, rewrite)
        reply = c.answer(body["query"], method, k, rewrite, bool(body.get("self_rag")))
    except NewDocuments as error:
        raise Refused(409, str(error)) from None
    r_ = reply.pop("rewrite", None)
    return 200, {"collection": name, "method": method, **reply, "rewrite_meta": None if r_ is None else asdict(r_), "image_used": body.get("image_base64") is not None}


@route("GET", "/collections/{name}/graph/stats")
def graph_stats(s: Service, r: Request, name: str):
    return 200, {"triple_count": s.of(name).triples.read().count()}


@route("GET", "/collections/{name}/graph")
def graph_rows(s: Service, r: Request, name: str):
    wanted = {k: r.query.get(k) or None for k in ("source_doc", "subject_type", "predicate")}
    return 200, [x.asDict(True) for x in s.of(name).browse(**wanted).collect()]


@route("GET", "/api/env")
def environment(s: Service, r: Request):
    return 200, config.listing()
