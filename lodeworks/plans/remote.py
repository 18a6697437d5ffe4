"""Models behind HTTP: chat, vision and embeddings of a server with a chat and an embed route; collections set up from the environment."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.convert import HttpConverter, OfficeConverter
from .config import DEFAULTS, Settings, bearer, switch
from .engine import Collection
from .providers import ModelScorer, NameRecogniser
from .vision import Ask


def post(url: str, body: dict, token: str = "", timeout: float = 120.0) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": bearer(token)} if bearer(token) else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head, method="POST"), timeout=timeout) as reply:
        return json.loads(reply.read())


class HttpModel:
    """A chat model; without a server it raises when it is made, a call that fails raises when it is made."""

    def __init__(self, url: str, model: str, token: str = "", timeout: float = 120.0, temperature: float = 0.0, think: bool = False):
        if not url or not model:
            raise ValueError("a chat model needs a server and a name")
        self.url, self.model, self.token, self.timeout, self.temperature, self.think = url.rstrip("/"), model, token, timeout, temperature, think

    def _chat(self, prompt: str, picture: str | None, options: dict) -> str:
        message = {"role": "user", "content": prompt} | ({"images": [picture]} if picture else {})
        body = {"model": self.model, "messages": [message], "stream": False, "options": options} | ({"think": True} if self.think else {})
        return (post(f"{self.url}/api/chat", body, self.token, self.timeout).get("message") or {}).get("content") or ""

    def complete(self, prompt: str) -> str:
        return self._chat(prompt, None, {"temperature": self.temperature})

    def __call__(self, prompt: str, picture: str | None, how: Ask) -> str:
        """As a vision model."""
        return self._chat(prompt, picture, {"temperature": how.temperature, "num_predict": how.tokens})


class HttpEmbedder:
    """Embeddings of a server, normalised; the dimension is that of the first reply unless it is given."""

    def __init__(self, url: str, model: str, token: str = "", timeout: float = 120.0, dimension: int | None = None):
        self.url, self.name, self.token, self.timeout, self._dimension = url.rstrip("/"), model, token, timeout, dimension

    @property
    def dimension(self) -> int:
        if self._dimension is None:
            self._dimension = self.embed(["x"]).shape[1]
        return self._dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self._dimension or 0), np.float32)
        out = np.array(post(f"{self.url}/api/embed", {"model": self.name, "input": list(texts)}, self.token, self.timeout)["embeddings"], np.float32)
        self._dimension = out.shape[1]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)

    def column(self, c: Column) -> Column:
        this = self

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(list(this.embed(s.tolist())), dtype=object)

        return run(c)


def collection(spark: SparkSession, root: str, data: str, env: Mapping[str, str] | None = None, scorer: ModelScorer | None = None) -> Collection:
    """A collection with the servers and models that the environment names, offline stand-ins for those that it doesn't. Extraction
    asks a model only where one is named; scorer is used where the reranker is switched on."""
    given = os.environ if env is None else env
    of = lambda key: given.get(key) or DEFAULTS[key] or ""
    settings = Settings.read(given)
    more: dict = {"settings": settings, "entities": NameRecogniser()}
    if of("OLLAMA_INDEX_URL") and of("EMBEDDING_MODEL"):
        more["embedder"] = HttpEmbedder(of("OLLAMA_INDEX_URL"), of("EMBEDDING_MODEL"), of("OLLAMA_BEARER"))
    if of("OLLAMA_CHAT_URL") and of("CHAT_MODEL"):
        more["model"] = HttpModel(of("OLLAMA_CHAT_URL"), of("CHAT_MODEL"), of("OLLAMA_BEARER"), think=switch(of("CHAT_MODEL_THINK"), on=False))
    elif settings.extractor != "rules":
        more["settings"] = Settings(**(settings.__dict__ | {"extractor": "rules"}))
    if of("OLLAMA_INDEX_URL") and of("VLM_MODEL"):
        more["picture_model"] = HttpModel(of("OLLAMA_INDEX_URL"), of("VLM_MODEL"), of("OLLAMA_BEARER"), float(of("VLM_TIMEOUT")))
    more["converter"] = HttpConverter(given["DOCLING_URL"]) if given.get("DOCLING_URL") else OfficeConverter()
    return Collection(spark, root, data, scorer=scorer if settings.rerank else None, **more)
