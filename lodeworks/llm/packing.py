"""Packing documents into training sequences by an order-preserving dynamic program."""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import split_words, text_slices, word_codes

#: Words made of these characters alone need no Unicode normalisation and lower-case character by character.
PLAIN = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+")
#: How the vocabulary's file cuts a lower-cased word (fixed by that file).
CUTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
END_ID = 1
#: Sequences of tokens that are packed together; a task's rows are packed in blocks of so many tokens.
BLOCK_TOKENS = 1 << 21


class WordIds:
    """Token ids of words by the vocabulary file, each distinct word encoded once while it stays in the cache.

    The file's rules treat white space only as a border, so the ids of a text are those of its words in a row. Plain
    words go straight to the tokenizer's model; all others through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model, self.limit, self.known = self.whole.model, limit, {}
        table = {p: c for p, c in enumerate(self._alphabet(pre_tokenizers))}
        self.bytes_to_chars = str.maketrans(table)
        self.stops = np.zeros(self.whole.get_vocab_size() + 1, bool)
        for token, i in self.whole.get_vocab().items():
            if token.endswith("</w>") and token[:-4][-1:] in (".", "!", "?"):
                self.stops[i] = True

    @staticmethod
    def _alphabet(pre_tokenizers) -> list[str]:
        """The characters that stand for the 256 bytes: printable ones for themselves, the others from 256 on."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        chars = [chr(b) if b in own else chr(next(spare)) for b in range(256)]
        assert sorted(chars) == sorted(pre_tokenizers.ByteLevel.alphabet())
        return chars

    def encode(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            ids = []
            for part in CUTS.findall(word.lower()):
                if not part.isascii():
                    part = part.encode().decode("latin-1").translate(self.bytes_to_chars)
                ids += [t.id for t in self.model.tokenize(part)]
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        return np.array(ids, np.uint32).tobytes()

    def of(self, words: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        out, known = [], self.known
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = self.encode(w)
            out.append(ids)
        return out


@dataclass(frozen=True)
class Costs:
    """Prices in padding tokens: a cut at a sentence's end, a cut inside one, and each token that a sequence of a power of two
    lacks (it needs no padding, but many short sequences are no use)."""

    window: int = 2048
    sentence: float = 24.0
    inside: float = 96.0
    short: float = 0.1


def window_cuts(length: int, doc_ends: np.ndarray, stops: np.ndarray, costs: Costs = Costs()) -> np.ndarray:
    """Ends of the windows over tokens 0..length: the cheapest choice among document and sentence ends.

    f(j) = min over i in [j - window, j) of f(i) + padding(j - i) + price(j). padding is window - (j - i), so
    f(i) + i is kept in a monotone queue; lengths that are powers of two have no padding and are tried besides. Where
    two ends lie more than a window apart, dear cuts inside the sentence stand between them.
    """
    w = costs.window
    ends = np.unique(np.concatenate([doc_ends, stops, [length]]))
    ends = ends[(ends > 0) & (ends <= length)]
    gaps = np.diff(np.concatenate([[0], ends]))
    extra = [np.arange(e - g + w, e, w) for e, g in zip(ends[gaps > w], gaps[gaps > w], strict=True)]
    inside = np.concatenate(extra) if extra else np.zeros(0, np.int64)
    ends = np.unique(np.concatenate([ends, inside])).astype(np.int64)
    price = np.full(len(ends), costs.sentence)
    price[np.isin(ends, inside)] = costs.inside
    price[np.isin(ends, doc_ends)] = 0.0
    at, fee = [0, *ends.tolist()], [0.0, *price.tolist()]
    place = {p: k for k, p in enumerate(at)}
    powers = [(1 << b, costs.short * (w - (1 << b))) for b in range(6, w.bit_length() - 1)]
    best, come = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0]] < p - w:
            queue.popleft()
        i = queue[0]
        f = best[i] + at[i] + w - p
        for size, lack in powers:
            k = place.get(p - size)
            if k is not None and best[k] + lack < f:
                f, i = best[k] + lack, k
        f += fee[j]
        best[j], come[j] = f, i
        key = f + p
        while queue and best[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = come[j]
    return np.array(cuts[::-1], np.int64)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


class Block:
    """Documents whose tokens wait to be packed."""

    def __init__(self, costs: Costs):
        self.costs, self.ids, self.tokens, self.stops, self.size = costs, [], [], [], 0

    def add(self, doc_id, tokens: np.ndarray, stops: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.tokens.append(tokens)
        self.stops.append(self.size + np.flatnonzero(stops) + 1)
        self.size += len(tokens)

    def pack(self, first: int) -> tuple[pa.RecordBatch, int]:
        """Rows of the pieces, and the next free sequence number."""
        sizes = np.array([len(t) for t in self.tokens], np.int64)
        doc_ends = np.cumsum(sizes)
        cuts = window_cuts(self.size, doc_ends, np.concatenate(self.stops), self.costs)
        ends = np.union1d(doc_ends, cuts)
        starts = np.concatenate([[0], ends[:-1]])
        doc = np.searchsorted(doc_ends, starts, side="right")
        seq = np.searchsorted(cuts, starts, side="right")
        doc_start, seq_start = (doc_ends - sizes)[doc], np.concatenate([[0], cuts[:-1]])[seq]
        data = np.concatenate(self.tokens).astype("<u4").data.cast("B")
        crc = np.fromiter((zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(ends))
        ids = pa.array(self.ids, pa.int64()).take(pa.array(doc))
        cols = [ids, *(pa.array(c.astype(np.int64)) for c in (starts - doc_start, ends - starts, crc, sizes[doc], first + seq, starts - seq_start))]
        return pa.RecordBatch.from_arrays(cols, names=NAMES), first + len(cuts)


def pack_documents(docs: DataFrame, vocabulary: str, costs: Costs = Costs(), block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packs the documents (doc_id, text) into sequences, in the order in which they stand; a row per piece.

    Each task packs the rows it reads, in blocks, so nothing is shuffled and memory is bounded by a block and the
    longest text. A sequence number is the task's partition in its high bits and a count in its low ones. Null and
    empty texts are one end id; rows that repeat are documents of their own; no rows give no rows.
    """

    def run(batches):
        word_ids = WordIds(vocabulary)
        nxt = TaskContext.get().partitionId() << 40
        block = Block(costs)
        for batch in batches:
            for part in text_slices(batch):
                words, counts = split_words(part.column("text"), lower=False)
                codes, distinct = word_codes(words)
                encoded = word_ids.of(distinct)
                ends = np.concatenate([[0], np.cumsum(counts)])
                for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    tokens = np.frombuffer(b"".join([encoded[c] for c in codes[ends[k] : ends[k + 1]].tolist()]), np.uint32)
                    stops = np.append(word_ids.stops[tokens], True)
                    block.add(doc_id, np.append(tokens, np.uint32(END_ID)), stops)
                    if block.size >= block_tokens:
                        rows, nxt = block.pack(nxt)
                        yield rows
                        block = Block(costs)
        if block.size:
            yield block.pack(nxt)[0]

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
