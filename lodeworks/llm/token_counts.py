"""Greedy word-piece counts by a linear longest-match automaton, without building pieces."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import split_words, text_slices, word_codes

#: Runs of letters, single numbers, runs of anything else: what pieces never cross.
RUNS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in the vocabulary file: printable ones for themselves, others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)}


class Automaton:
    """A trie of the vocabulary whose nodes know, if no child fits, how many pieces the longest matches pop (popped) and
    the node of what is left (fail). Every text is then counted in one pass, each character moving on once."""

    def __init__(self, pieces: set[str]):
        self.child: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in sorted(pieces):
            at = 0
            for c in piece:
                nxt = self.child[at].get(c)
                if nxt is None:
                    nxt = self.child[at][c] = len(self.child)
                    self.child.append({})
                    ends.append(False)
                at = nxt
            ends[at] = True
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        queue = [(0, c, n) for c, n in self.child[0].items()]
        for parent, c, node in queue:  # breadth first: fail links point to shallower nodes
            if ends[node]:
                self.fail[node], self.popped[node] = 0, 1
            else:
                z, count = self.fail[parent], self.popped[parent]
                while z >= 0 and c not in self.child[z]:
                    count += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[node], self.popped[node] = self.child[z][c], count
            queue += [(node, x, n) for x, n in self.child[node].items()]

    def count(self, text: str) -> int:
        """Pieces of text; a character that no piece starts with counts as one."""
        child, fail, popped = self.child, self.fail, self.popped
        at = total = 0
        for c in text:
            nxt = child[at].get(c)
            while nxt is None and at >= 0:
                if at == 0:
                    total += 1  # unknown character
                    break
                total += popped[at]
                at = fail[at]
                nxt = child[at].get(c) if at >= 0 else None
            at = nxt if nxt is not None else max(at, 0)
        while at > 0:
            total += popped[at]
            at = fail[at]
        return total


def load(path: str) -> Automaton:
    """Pieces are the vocabulary's strings; the mark of a word's end is no part of them."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return Automaton({t.removesuffix("</w>") for t in vocabulary})


class WordCounts:
    def __init__(self, path: str, limit: int = 700_000):
        self.automaton, self.limit, self.known, self.letters = load(path), limit, {}, byte_letters()

    def word(self, word: str) -> int:
        if word.isascii():
            runs = RUNS.findall(word.lower())
        else:
            runs = [r.encode().decode("latin-1").translate(self.letters) for r in RUNS.findall(unicodedata.normalize("NFC", word).lower())]
        return sum(map(self.automaton.count, runs))

    def of(self, distinct: list[str]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        known, out = self.known, np.zeros(len(distinct), np.int64)
        for k, w in enumerate(distinct):
            n = known.get(w)
            if n is None:
                n = known[w] = self.word(w)
            out[k] = n
        return out


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens (greedy longest-match pieces of the lower-cased text).

    Null and empty texts count 0; texts of any length are read whole; rows that repeat are counted each."""

    def run(batches):
        counts_of = WordCounts(vocabulary)
        for batch in batches:
            for part in text_slices(batch):
                words, counts = split_words(part.column("text"), lower=False)
                codes, distinct = word_codes(words)
                total = np.concatenate([[0], np.cumsum(counts_of.of(distinct)[codes])])
                ends = np.cumsum(counts)
                pieces = (total[ends] - total[ends - counts]).astype(np.int64)
                cols = [part.column("doc_id").cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(pieces)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
