"""Model boundaries: protocols, and offline providers that give the same results everywhere.

Offline results are not those of a trained model and must not be presented as such."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rules import RELATION_OF_VERB, SKIPPED_LABELS, TYPE_OF_LABEL


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class TextModel(Protocol):
    def complete(self, prompt: str) -> str: ...


class Scorer(Protocol):
    def score(self, query: str, passages: list[str]) -> list[float]: ...


class HashEmbedder:
    """Signed hashes of words and letter triples, summed and normalised."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for k, s in enumerate(texts):
            for w in (s or "").lower().split():
                for g in (w, *(w[i : i + 3] for i in range(len(w) - 2))):
                    h = xxhash.xxh64_intdigest(g)
                    out[k, h % self.dimension] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    def column(self, c: Column) -> Column:
        this = self

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(list(this.embed(s.tolist())))

        return run(c)


class OverlapScorer:
    """Share of a query's words that a passage holds."""

    def score(self, query: str, passages: list[str]) -> list[float]:
        q = set(query.lower().split())
        return [len(q & set(p.lower().split())) / max(1, len(q)) for p in passages]

    def column(self, query: str, passage: Column) -> Column:
        words = F.array(*(F.lit(w) for w in sorted(set(query.lower().split()))))
        return F.size(F.array_intersect(words, F.split(F.lower(passage), r"\s+"))) / F.greatest(F.size(words), F.lit(1))


class ModelScorer:
    """Scores by a model that each worker loads when it is first needed. Where loading or scoring fails all scores are 0, which keeps
    the order of the candidates; a failed load is tried again with the next batch."""

    def __init__(self, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 16):
        self.load, self.batch = load, batch

    def score(self, query: str, passages: list[str]) -> list[float]:
        try:
            known = self.known = getattr(self, "known", None) or self.load()
            pairs = [(query, p) for p in passages]
            out = [float(s) for at in range(0, len(pairs), self.batch) for s in known(pairs[at : at + self.batch])]
        except Exception:  # neutral scores rather than no answer
            return [0.0] * len(passages)
        return out

    def column(self, query: str, passage: Column) -> Column:
        this = self

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(this.score(query, s.tolist()), dtype=float)

        return run(passage)


class TemplateModel:
    """Replies made from the prompt itself; a callable may stand in for a real model."""

    def __init__(self, reply: Callable[[str], str] | None = None):
        self.reply = reply

    def complete(self, prompt: str) -> str:
        return self.reply(prompt) if self.reply else prompt.strip().splitlines()[-1]


def forms(verb: str) -> set[str]:
    return {verb, verb + "s", verb + "es", verb + "d", verb + "ed", verb[:-1] + "ies", verb[:-1] + "ied"}


LEMMAS = {form: (verb, rel) for verb, rel in RELATION_OF_VERB.items() for form in forms(verb)} | {w: ("be", "is_a") for w in ("is", "are", "was", "were")}
SENTENCE, WORD = re.compile(r"(?<=[.!?])\s+"), re.compile(r"[^\W_][\w\-]*")


LEAST = 3


def entity(name: str) -> bool:
    """Whether a name can be an entity: long enough, no markup, letters in it, not just a number."""
    s = name.strip()
    letters = sum(c.isalpha() for c in s)
    return len(s) >= LEAST and not s.startswith("#") and "|" not in s and "\n" not in s and letters >= 2 and not re.sub(r"[,.\-]", "", s).isdigit()


class NameRecogniser:
    """Entities of a question by their spelling: runs of words with a capital inside the text, and words with digits. A stand-in for a
    trained recogniser; labels are those that such a one would give."""

    RUN = re.compile(r"[A-Z][\w\-]*(?:\s+[A-Z][\w\-]*)*|[A-Za-z]+[_\-]?\d[\w\-]*")

    def spans(self, text: str) -> list[tuple[str, str]]:
        found = [m[0] for m in self.RUN.finditer(text or "") if m.start() or not m[0].isalpha()]
        return [(s, "PRODUCT" if any(c.isdigit() for c in s) else "ORG") for s in found]

    def entities(self, text: str) -> list[tuple[str, str]]:
        """(name, type) of the spans that can be entities, labels that are none left out, each key once."""
        out = {}
        for name, label in self.spans(text):
            if label not in SKIPPED_LABELS and entity(name):
                out.setdefault(name.lower(), (name, TYPE_OF_LABEL.get(label, "Other")))
        return list(out.values())

    def __call__(self, text: str) -> list[str]:
        return [name for name, _ in self.entities(text)]


class RuleExtractor:
    """Subject, verb and object by position: the words before and after the first known verb of a sentence."""

    weight = 0.7

    def extract(self, text: str, source_doc: str = "") -> list[dict]:
        out = []
        for sentence in SENTENCE.split(text or ""):
            w = WORD.findall(sentence)
            k = next((i for i, x in enumerate(w) if x.lower() in LEMMAS), None)
            if not k or k + 1 >= len(w) or w[k - 1].lower() == w[k + 1].lower() or not (entity(w[k - 1]) and entity(w[k + 1])):
                continue
            out.append({"subject": w[k - 1], "subject_type": "Concept", "predicate": LEMMAS[w[k].lower()][1], "object": w[k + 1], "object_type": "Concept", "weight": self.weight})
        return out
