"""Settings of a collection from environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from ..operators.tables import TableOptions

#: The settings that a deployment may give, and their defaults; None must be given where it is used.
DEFAULTS: dict[str, str | None] = {
    "OLLAMA_INDEX_URL": None,
    "OLLAMA_CHAT_URL": None,
    "OLLAMA_BEARER": "",
    "OLLAMA_TIMEOUT": "1800",
    "CHAT_MODEL": None,
    "CHAT_MODEL_THINK": "",
    "EMBEDDING_MODEL": None,
    "INDEX_MODEL": "",
    "INDEX_TEMPERATURE": "0.1",
    "VLM_MODEL": None,
    "VLM_TIMEOUT": "180",
    "VLM_TEMPERATURE": "0.2",
    "VLM_SYNTHESIS_TEMPERATURE": "0.15",
    "VLM_CAPTION_MAX_TOKENS": "80",
    "VLM_STRUCTURED_MAX_TOKENS": "2600",
    "VLM_SYNTHESIS_MAX_TOKENS": "1200",
    "DOCLING_URL": "http://localhost:5001",
    "CHUNK_SIZE": "800",
    "CHUNK_OVERLAP": "80",
    "TABLE_CHUNK_SIZE": "0",
    "ENABLE_MASSIVE_TABLE_STRATEGY": "false",
    "MASSIVE_ENTITY_METRICS_PER_CHUNK": "40",
    "MASSIVE_COMPARISON_WINDOW": "4",
    "MASSIVE_COMPARISON_OVERLAP": "1",
    "MASSIVE_COMPARISON_MAX_METRICS": "36",
    "GRAPH_EXTRACTOR": "hybrid",
    "EXTRACT_MODEL": "",
    "GRAPH_CHUNK_SIZE": "400",
    "GRAPH_CHUNK_OVERLAP": "80",
    "TOP_K": "5",
    "ENABLE_RERANKER": "false",
    "RERANKER_MODEL": "BAAI/bge-reranker-v2-m3",
    "RERANKER_OVERFETCH_FACTOR": "3.0",
    "RERANKER_MAX_CANDIDATES": "50",
    "RERANKER_DEVICE": "auto",
    "RERANKER_BATCH_SIZE": "16",
}
SECRET = "***"


def switch(value: str | None, on: bool = True) -> bool:
    """Whether a value says yes; of the switches of the reranker and of thinking the word on says nothing (on=False)."""
    return (value or "").strip().lower() in ({"1", "true", "yes", "on"} if on else {"1", "true", "yes"})


def bearer(token: str | None) -> str:
    """A token with its scheme, once; blank stays blank."""
    words = (token or "").split()
    if words and words[0].lower() == "bearer":
        words = words[1:]
    return f"Bearer {' '.join(words)}" if words else ""


@dataclass(frozen=True)
class Settings:
    """What the engine reads of its environment."""

    size: int = 800
    overlap: int = 80
    tables: TableOptions = field(default_factory=lambda: TableOptions(massive=False))
    extractor: str = "hybrid"
    graph_size: int = 400
    graph_overlap: int = 80
    top_k: int = 5
    rerank: bool = False
    factor: float = 3.0
    most: int = 50

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        given = os.environ if env is None else env
        of = lambda key: given.get(key) or DEFAULTS[key]
        number = lambda key: int(of(key))
        table = TableOptions(
            size=number("TABLE_CHUNK_SIZE"), massive=switch(of("ENABLE_MASSIVE_TABLE_STRATEGY")), profile=number("MASSIVE_ENTITY_METRICS_PER_CHUNK"),
            window=number("MASSIVE_COMPARISON_WINDOW"), overlap=number("MASSIVE_COMPARISON_OVERLAP"), metrics=number("MASSIVE_COMPARISON_MAX_METRICS"),
        )
        return cls(
            number("CHUNK_SIZE"), number("CHUNK_OVERLAP"), table, of("GRAPH_EXTRACTOR"), number("GRAPH_CHUNK_SIZE"), number("GRAPH_CHUNK_OVERLAP"), number("TOP_K"),
            switch(of("ENABLE_RERANKER"), on=False), float(of("RERANKER_OVERFETCH_FACTOR")), number("RERANKER_MAX_CANDIDATES"),
        )


def listing(env: Mapping[str, str] | None = None) -> list[dict]:
    """Each setting with its value, whether it is set, and its default. What could be a credential is not shown."""
    given = os.environ if env is None else env
    hidden = lambda key, value: SECRET if value and "BEARER" in key else value
    return [{"key": k, "value": hidden(k, given.get(k, d)), "set": k in given, "default": d} for k, d in DEFAULTS.items()]
