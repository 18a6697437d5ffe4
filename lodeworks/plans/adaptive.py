"""The adaptive answer: search, ask whether that is enough, look into the graph if not, then answer."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

#: Characters of the context that the gate reads, and what stands for none.
READ, NONE = 2000, "No context available."
ENOUGH = "Is the context enough to answer the question, without facts from a knowledge graph? Reply with YES or NO alone.\n\nContext:\n{context}\n\nQuestion: {question}"
ANSWER = "Answer the question from the context alone; if the context doesn't hold the answer, say so.\n\nContext:\n{context}\n\nQuestion: {question}"


@dataclass
class State:
    question: str
    method: str = "hybrid"
    top_k: int = 5
    context: str = ""
    sources: list[dict] = field(default_factory=list)
    graph: str = ""
    needs_graph: bool = False
    answer: str = ""
    iterations: int = 0
    trace: list[dict] = field(default_factory=list)


@dataclass
class Adaptive:
    """The steps over what a collection offers: retrieve(question, k) -> (context, sources), graph(question) -> text, and a model."""

    complete: Callable[[str], str]
    retrieve: Callable[[str, int], tuple[str, list[dict]]]
    graph: Callable[[str], str]

    def vector_retrieve(self, s: State) -> str:
        s.context, s.sources = self.retrieve(s.question, s.top_k)
        return f"{len(s.sources)} chunks retrieved"

    def evaluate_context(self, s: State) -> str:
        """Without a context the graph is needed; where the model fails it is not."""
        s.needs_graph = not s.context.strip()
        if not s.needs_graph:
            try:
                reply = self.complete(ENOUGH.format(context=s.context[:READ], question=s.question))
                s.needs_graph = (reply or "").strip().upper().startswith("NO")
            except Exception:
                s.needs_graph = False
        return "Graph needed" if s.needs_graph else "Context sufficient"

    def graph_retrieve(self, s: State) -> str:
        try:
            s.graph = self.graph(s.question)
        except Exception:
            s.graph = ""
        return f"{len(s.graph)} chars of graph context"

    def generate_answer(self, s: State) -> str:
        parts = [s.context] * bool(s.context) + [f"Graph context:\n{s.graph}"] * bool(s.graph)
        s.iterations += 1
        try:
            s.answer = self.complete(ANSWER.format(context="\n\n".join(parts) or NONE, question=s.question)) or ""
        except Exception:
            s.answer = ""
        return f"{len(s.answer)} chars"

    def path(self, s: State) -> Iterator[Callable[[State], str]]:
        """The steps in turn; which comes next may hang on what the last one found."""
        if s.method.lower() == "graph":
            yield self.graph_retrieve
        else:
            yield self.vector_retrieve
            yield self.evaluate_context
            if s.needs_graph:
                yield self.graph_retrieve
        yield self.generate_answer

    def run(self, s: State) -> State:
        for step in self.path(s):
            began = time.time()
            detail = step(s)
            s.trace.append({"node": step.__name__, "started_at": began, "duration_ms": int((time.time() - began) * 1000), "detail": detail})
        return s


def reflect(graph: Adaptive, question: str, method: str = "hybrid", top_k: int = 5) -> dict:
    """The outcome of a run as a reply: answer, sources, graph context, and a log of its steps. A run that fails is one failed step."""
    try:
        s = graph.run(State(question, method, top_k))
    except Exception as error:
        step = {"step": "error", "label": "QueryGraph error", "detail": str(error), "result": "Failed", "ok": False}
        meta = {"needed": True, "relevant_chunks": 0, "grounded": False, "iterations": 1, "process_log": [step]}
        return {"answer": "", "sources": None, "graphrag_context": None, "self_rag_meta": meta}
    steps = [{"step": t["node"], "label": t["node"].replace("_", " ").title(), "detail": t["detail"], "result": f"{t['duration_ms']} ms", "ok": True} for t in s.trace]
    meta = {"needed": True, "relevant_chunks": len(s.sources), "grounded": True, "iterations": s.iterations or 1, "process_log": steps}
    return {"answer": s.answer, "sources": s.sources or None, "graphrag_context": s.graph or None, "self_rag_meta": meta}
