"""Language-model scores from an n-gram trie in Elias-Fano coded, memory-mapped levels."""

from __future__ import annotations

import io
import os
import uuid
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, dealt, hashes_of, input_bytes, shared_dir, split_words, text_slices
from .ngram_join import packed, unpacked

#: The end of a text is a token of its own; no word has a space in it.
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(" end"))
#: What each count of a pair or triple is lowered by; those seen once are kept, so it is less than 1.
DISCOUNT = 0.6
#: Bytes of shards that a worker holds where they can't be mapped.
READ_BYTES = 256 << 20
ONE = np.uint64(1)
#: One in every byte, the high bit of every byte, and the place of the r-th one of each byte at 8 * byte + r.
BYTES, HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
SELECT = np.array([([k for k in range(8) if byte >> k & 1] + [0] * 8)[r] for byte in range(256) for r in range(8)], np.int64)


class Store:
    """Arrays in the shared folder. Local files are memory-mapped; those of another file system are read whole."""

    def __init__(self, uri: str):
        self.uri, parsed = uri, urlparse(uri)
        self.path = parsed.path if parsed.scheme in ("", "file") else None

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def put(self, name: str, array: np.ndarray) -> None:
        """Written beside its place and moved there, so that a task run again or killed leaves nothing half done."""
        data = io.BytesIO()
        np.save(data, array)
        spare = f"{name}.{uuid.uuid4().hex}"
        if self.path is not None:
            os.makedirs(self.path, exist_ok=True)
            with open(f"{self.path}/{spare}", "wb") as f:
                f.write(data.getbuffer())
            os.replace(f"{self.path}/{spare}", f"{self.path}/{name}.npy")
            return
        system, root = self._remote()
        system.create_dir(root)
        with system.open_output_stream(f"{root}/{spare}") as f:
            f.write(data.getbuffer())
        system.move(f"{root}/{spare}", f"{root}/{name}.npy")

    def get(self, name: str) -> np.ndarray:
        if self.path is not None:
            return np.load(f"{self.path}/{name}.npy", mmap_mode="r").view(np.ndarray)
        system, root = self._remote()
        with system.open_input_file(f"{root}/{name}.npy") as f:
            return np.load(io.BytesIO(f.read()))


class EliasFano:
    """A rising sequence of n numbers: low bits packed, high bits in unary, with the count of ones before each 64-bit word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.bits, self.low, self.high, self.before = n, bits, low, high, before
        self.zeros = np.arange(len(before)) * 64 - before  # before each word

    @classmethod
    def of(cls, x: np.ndarray) -> "EliasFano":
        x = x.astype(np.uint64)
        n = len(x)
        bits = max(0, int(x[-1] // np.uint64(n)).bit_length() - 1) if n else 0
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        value = x & ((ONE << np.uint64(bits)) - ONE)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(low, word, value << shift)
        over = shift + np.uint64(bits) > 64
        np.bitwise_or.at(low, word[over] + 1, value[over] >> (np.uint64(64) - shift[over]))
        ones = (x >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) if n else 0) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, ones >> 6, ONE << (ones & 63).astype(np.uint64))
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(n, bits, low, high, before)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"shape": np.array([self.n, self.bits]), "low": self.low, "high": self.high, "before": self.before}

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift
        over = np.flatnonzero(shift + np.uint64(self.bits) > 64)
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & ((ONE << np.uint64(self.bits)) - ONE)

    @staticmethod
    def _nth(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one of each word: first its byte, by the ones of all bytes up to each, then a table."""
        x = word - ((word >> ONE) & np.uint64(0x5555555555555555))
        x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
        upto = ((x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * BYTES
        k = k.astype(np.uint64)
        shift = np.bitwise_count((k * BYTES | HIGHS) - upto & HIGHS).astype(np.uint64) << np.uint64(3)
        rest = k - ((upto << np.uint64(8)) >> shift & np.uint64(255))
        return shift.astype(np.int64) + SELECT[(word >> shift & np.uint64(255)) << np.uint64(3) | rest]

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, i, side="right") - 1
        bit = word * 64 + self._nth(self.high[word], i - self.before[word])
        return ((bit - i).astype(np.uint64) << np.uint64(self.bits)) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x, -1 where it isn't there: a successor search among the numbers with x's high bits. Rising x are fastest."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        top = (x >> np.uint64(self.bits)).astype(np.int64)
        live = np.flatnonzero(top < self.zeros[-1])
        t = top[live]
        before = np.where(t > 0, self._zero(np.maximum(t - 1, 0)), -1)  # the zero that ends what has smaller high bits
        lo = before + 1 - t
        end = lo + self._ones(before + 1, t)
        want = x[live] & ((ONE << np.uint64(self.bits)) - ONE)
        hi, busy = end.copy(), np.flatnonzero(lo < end)
        while len(busy):
            mid = (lo[busy] + hi[busy]) >> 1
            less = self.lows(mid) < want[busy]
            lo[busy] = np.where(less, mid + 1, lo[busy])
            hi[busy] = np.where(less, hi[busy], mid)
            busy = busy[lo[busy] < hi[busy]]
        there = np.flatnonzero(lo < end)
        there = there[self.lows(lo[there]) == want[there]]
        out[live[there]] = lo[there]
        return out

    def _zero(self, t: np.ndarray) -> np.ndarray:
        """Place of the t-th zero."""
        word = np.searchsorted(self.zeros, t, side="right") - 1
        return word * 64 + self._nth(~self.high[word], t - self.zeros[word])

    def _ones(self, bit: np.ndarray, t: np.ndarray) -> np.ndarray:
        """How many ones stand in a row from a bit on; the t-th zero ends them."""
        part = self.high[bit >> 6] >> (bit & 63).astype(np.uint64)
        run = np.bitwise_count(part ^ (part + ONE)).astype(np.int64) - 1
        over = np.flatnonzero((bit & 63) + run >= 64)  # the row goes on in the next word
        run[over] = self._zero(t[over]) - bit[over]
        return run


def quantised(x: np.ndarray, codes: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Codes of one byte, and the means of x for each: bins of equal numbers of values."""
    edges = np.unique(np.quantile(x, np.linspace(0, 1, codes + 1)[1:-1])) if len(x) else np.zeros(0)
    code = np.searchsorted(edges, x).astype(np.uint8)
    total = np.bincount(code, x, codes)
    return code, (total / np.maximum(1, np.bincount(code, minlength=codes))).astype(np.float32)


def write_level(store: Store, name: str, keys: np.ndarray, counts: np.ndarray, contexts: int, span: int, context_counts: np.ndarray, keep_counts: bool = False) -> None:
    """One shard of a level: keys context * span + successor, rising; pointers to each context's first successor; discounted
    probabilities, and what each context leaves to the lower order; the counts if the next level needs them."""
    ctx = (keys // np.uint64(span)).astype(np.int64)
    share = (counts - DISCOUNT) / context_counts[ctx]
    left = 1 - np.bincount(ctx, share, contexts)
    pointers = np.concatenate([[0], np.cumsum(np.bincount(ctx, minlength=contexts))])
    code, book = quantised(np.log10(share))
    left_code, left_book = quantised(np.log10(np.clip(left, 1e-9, 1)))
    parts = {f"keys.{k}": v for k, v in EliasFano.of(keys).arrays().items()} | {f"pointers.{k}": v for k, v in EliasFano.of(pointers).arrays().items()}
    parts |= {"code": code, "book": book, "left_code": left_code, "left_book": left_book}
    if keep_counts:
        parts["counts"] = counts.astype(np.min_scalar_type(counts.max(initial=0)))
    for k, v in parts.items():
        store.put(f"{name}.{k}", v)


class Shard:
    def __init__(self, store: Store, name: str):
        def coded(what: str) -> EliasFano:
            n, bits = store.get(f"{name}.{what}.shape").tolist()
            return EliasFano(n, bits, *(store.get(f"{name}.{what}.{k}") for k in ("low", "high", "before")))

        self.keys, self.pointers = coded("keys"), coded("pointers")
        self.code, self.left_code = (store.get(f"{name}.{k}") for k in ("code", "left_code"))
        self.book, self.left_book = (10.0 ** store.get(f"{name}.{k}").astype(np.float64) for k in ("book", "left_book"))
        self.bytes = sum(a.nbytes for e in (self.keys, self.pointers) for a in (e.low, e.high, e.before)) + self.code.nbytes + self.left_code.nbytes


@dataclass(frozen=True)
class Levels:
    """What finds the shards: first ids of the word shards, of the bigrams' shards; sizes."""

    uri: str
    buckets: int
    words: tuple[int, ...] = ()  # id before each word shard
    tokens: int = 0
    pairs: tuple[int, ...] = ()  # number of the first bigram of each shard
    span: int = 0  # bound of a context-relative successor

    @property
    def vocabulary(self) -> int:
        return self.words[-1]


@lru_cache(maxsize=64)
def opened_words(uri: str, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    store = Store(uri)
    return store.get(f"1-{bucket}.hash"), store.get(f"1-{bucket}.count")


class Reader:
    """The levels as one worker sees them."""

    def __init__(self, levels: Levels):
        self.at, self.shards, self.store = levels, {}, Store(levels.uri)

    def shard(self, level: int, bucket: int) -> Shard:
        """A shard, read or mapped when it is first asked for. What is read whole (READ_BYTES at most) goes, oldest use first."""
        key = (level, bucket)
        found = self.shards.pop(key, None) or Shard(self.store, f"{level}-{bucket}")
        self.shards[key] = found
        if self.store.path is None:
            while len(self.shards) > 1 and sum(s.bytes for s in self.shards.values()) > READ_BYTES:
                self.shards.pop(next(iter(self.shards)))
        return found

    def word_ids(self, rising: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of words by their rising hashes."""
        ids, counts = np.full(len(rising), -1, np.int64), np.zeros(len(rising), np.int64)
        edges = np.searchsorted(hash_bucket(rising, self.at.buckets), np.arange(self.at.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            if self.at.words and self.at.words[b + 1] > self.at.words[b]:
                rows = slice(edges[b], edges[b + 1])
                known, count = opened_words(self.at.uri, b)
                i = np.minimum(np.searchsorted(known, rising[rows]), len(known) - 1)
                hit = known[i] == rising[rows]
                ids[rows] = np.where(hit, self.at.words[b] + i, -1)
                counts[rows] = np.where(hit, count[i], 0)
        return ids, counts

    @staticmethod
    def distinct(first: np.ndarray, second: np.ndarray, span: int):
        """Distinct pairs in rising order (second may be -1), and where each given one is among them."""
        key, place = np.unique(first * (span + 1) + (second + 1), return_inverse=True)
        return key // (span + 1), key % (span + 1) - 1, place

    @staticmethod
    def runs(starts: tuple[int, ...], rising: np.ndarray):
        """(k, slice) of the rising numbers from starts[k] up to starts[k + 1]."""
        edges = np.searchsorted(rising, np.array(starts))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            yield k, slice(int(edges[k]), int(edges[k + 1]))

    def found(self, k: int, ctx: np.ndarray, nxt: np.ndarray):
        """Of rising contexts and successors of one shard those that are there: which, their places, and places behind the pointer."""
        s, known = self.shard(2, k), np.flatnonzero(nxt >= 0)
        i = s.keys.find((ctx[known] * self.at.vocabulary + nxt[known]).astype(np.uint64))
        known, i = known[i >= 0], i[i >= 0]
        owner, back = np.unique(ctx[known], return_inverse=True)
        return known, i, i - s.pointers.get(owner).astype(np.int64)[back]

    def numbers(self, a: np.ndarray, b: np.ndarray):
        """Of word pairs with a known: number of the bigram (-1: none), and its place behind its context's pointer."""
        a, b, place = self.distinct(a, b, self.at.vocabulary)
        number, relative = np.full(len(a), -1, np.int64), np.full(len(a), -1, np.int64)
        for k, rows in self.runs(self.at.words, a):
            known, i, behind = self.found(k, a[rows] - self.at.words[k], b[rows])
            number[known + rows.start], relative[known + rows.start] = self.at.pairs[k] + i, behind
        return number[place], relative[place]

    def pairs(self, a: np.ndarray, b: np.ndarray):
        """As numbers, with the bigram's probability and what the context leaves. Each distinct pair is looked up once, in the order
        of the keys."""
        a, b, place = self.distinct(a, b, self.at.vocabulary)
        number, relative = np.full(len(a), -1, np.int64), np.full(len(a), -1, np.int64)
        share, left = np.zeros(len(a)), np.ones(len(a))
        for k, rows in self.runs(self.at.words, a):
            s, ctx = self.shard(2, k), a[rows] - self.at.words[k]
            left[rows] = s.left_book[s.left_code[ctx]]
            known, i, behind = self.found(k, ctx, b[rows])
            at = known + rows.start
            number[at], relative[at], share[at] = self.at.pairs[k] + i, behind, s.book[s.code[i]]
        return number[place], relative[place], share[place], left[place]

    def triples(self, pair: np.ndarray, relative: np.ndarray):
        """Of bigrams followed by a context-relative successor (-1: none): probability, and what the bigram leaves."""
        pair, relative, place = self.distinct(pair, relative, self.at.span)
        share, left = np.zeros(len(pair)), np.ones(len(pair))
        for k, rows in self.runs(self.at.pairs, pair):
            s, ctx, nxt = self.shard(3, k), pair[rows] - self.at.pairs[k], relative[rows]
            left[rows] = s.left_book[s.left_code[ctx]]
            known = np.flatnonzero(nxt >= 0)
            i = s.keys.find((ctx[known] * self.at.span + nxt[known]).astype(np.uint64))
            share[known[i >= 0] + rows.start] = s.book[s.code[i[i >= 0]]]
        return share[place], left[place]


def hash_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def with_ends(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, and the number of the text of each."""
    ends = np.cumsum(counts)
    return np.insert(hashes, ends, END_HASH), np.repeat(np.arange(len(counts)), counts + 1)


def tokens_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words, counts = split_words(part.column("text"))
    return with_ends(hashes_of(words), counts)


COUNTED = "bucket int, slot int, keys binary, counts binary"
COUNTED_ARROW = pa.schema([("bucket", pa.int32()), ("slot", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
#: A bucket's keys are first merged in so many parts, so that a frequent context is never gathered from all slices in one task.
SLOT_BITS = 2
SLOTS = 1 << SLOT_BITS


def small(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u8").tobytes())


def large(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u8")


def counted(keys: np.ndarray, bucket_of, local) -> pa.RecordBatch:
    """Distinct keys of a slice with counts, by bucket and slot. bucket_of rises with the keys; local gives a bucket's own keys."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(keys))).astype(np.uint64)
    keys = keys[new]
    bucket = bucket_of(keys)
    rows = []
    for at in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(bucket)) + 1) if len(keys) else []:
        b, own, many = int(bucket[at[0]]), local(keys[at], int(bucket[at[0]])).astype(np.uint64), count[at]
        slot = own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)
        for k in range(SLOTS):
            here = slot == k
            if here.any():
                rows.append((b, k, packed(own[here], 8), small(many[here])))
    cols = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, COUNTED_ARROW.types, strict=True)], schema=COUNTED_ARROW)


def placed(starts: tuple[int, ...], span: int):
    """bucket_of and local for keys context * span + successor, where bucket k has the contexts from starts[k] on."""
    first = np.array(starts, np.int64)
    return lambda keys: np.searchsorted(first, keys // span, side="right") - 1, lambda keys, b: keys - first[b] * span


def merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([unpacked(k, 8) for k in group.column("keys").to_pylist()])
    counts = np.concatenate([large(c) for c in group.column("counts").to_pylist()])
    keys, inverse = np.unique(keys, return_inverse=True)
    counts = np.bincount(inverse, counts, len(keys)).astype(np.int64)
    return keys, counts


def merge(group: pa.Table) -> pa.Table:
    keys, counts = merged(group)
    return pa.table([group.column("bucket")[:1], group.column("slot")[:1], pa.array([packed(keys, 8)], pa.binary()), pa.array([small(counts)], pa.binary())], schema=COUNTED_ARROW)


def learn(docs: DataFrame, bucket_bytes: int = 16 << 20) -> Levels:
    """The trie of words, pairs and triples of all texts of docs (null: empty), in a new folder under the shared one.

    Each level is counted in all texts by slices, merged by bucket and written by the bucket's task; the driver holds a
    few numbers for each bucket. No texts give a trie without words.
    """
    spark = docs.sparkSession
    buckets = bucket_count(input_bytes(docs), bucket_bytes, 16)
    levels = Levels(f"{shared_dir(spark).rstrip('/')}/trie-{uuid.uuid4().hex}", buckets)
    texts = docs.select("text")

    def count_words(batches):
        for batch in batches:
            for part in text_slices(batch):
                hashes, _ = tokens_of(part)
                yield counted(hashes, lambda keys: hash_bucket(keys, buckets), lambda keys, b: keys)

    def write_words(group: pa.Table) -> pa.Table:
        keys, counts = merged(group)
        b, store = group.column("bucket")[0].as_py(), Store(levels.uri)
        store.put(f"1-{b}.hash", keys)
        store.put(f"1-{b}.count", counts)
        return pa.table({"bucket": [b], "n": [len(keys)], "total": [int(counts.sum())], "most": [0]}, schema=DONE)

    def merged_counts(counts: DataFrame) -> DataFrame:
        """Counts of all slices, merged by bucket and slot."""
        whole = counts.withColumn("place", F.col("bucket") * SLOTS + F.col("slot"))
        return dealt(whole, "place", buckets * SLOTS).groupBy("place").applyInArrow(merge, COUNTED)

    def by_bucket(counts: DataFrame, write) -> DataFrame:
        return dealt(counts, "bucket", buckets).groupBy("bucket").applyInArrow(write, DONE_DDL)

    def offsets(done: dict[int, int]) -> tuple[int, ...]:
        return tuple(np.concatenate([[0], np.cumsum([done.get(b, 0) for b in range(buckets)])]).tolist())

    def collect(df: DataFrame) -> list:
        return df.groupBy("bucket").agg(F.max("n").alias("n"), F.max("total").alias("total"), F.max("most").alias("most")).collect()

    words = collect(by_bucket(merged_counts(texts.mapInArrow(count_words, COUNTED)), write_words))
    levels = Levels(levels.uri, buckets, offsets({r["bucket"]: r["n"] for r in words}), sum(r["total"] for r in words))
    if not levels.tokens:
        return levels

    def count_pairs(batches):
        reader = Reader(levels)
        for batch in batches:
            for part in text_slices(batch):
                ids, doc = known_ids(reader, part)
                same = doc[1:] == doc[:-1]
                yield counted(ids[:-1][same] * levels.vocabulary + ids[1:][same], *placed(levels.words, levels.vocabulary))

    def write_pairs(group: pa.Table) -> pa.Table:
        keys, counts = merged(group)
        b, first = group.column("bucket")[0].as_py(), levels.words
        contexts = first[b + 1] - first[b]
        write_level(Store(levels.uri), f"2-{b}", keys, counts, contexts, levels.vocabulary, np.asarray(opened_words(levels.uri, b)[1], float), True)
        most = np.bincount((keys // np.uint64(levels.vocabulary)).astype(np.int64), minlength=1).max() if len(keys) else 0
        return pa.table({"bucket": [b], "n": [len(keys)], "total": [0], "most": [int(most)]}, schema=DONE)

    # every bucket with words has a shard, if an empty one
    none = spark.createDataFrame([(b, 0, packed(np.zeros(0, np.uint64), 8), small(np.zeros(0))) for b in range(buckets) if levels.words[b + 1] > levels.words[b]], COUNTED)
    pairs = collect(by_bucket(merged_counts(texts.mapInArrow(count_pairs, COUNTED)).unionByName(none), write_pairs))
    levels = Levels(levels.uri, buckets, levels.words, levels.tokens, offsets({r["bucket"]: r["n"] for r in pairs}), 1 + max(r["most"] for r in pairs))

    def count_triples(batches):
        reader = Reader(levels)
        for batch in batches:
            for part in text_slices(batch):
                ids, doc = known_ids(reader, part)
                same = np.flatnonzero(doc[1:] == doc[:-1])
                number, relative = reader.numbers(ids[same], ids[same + 1])
                follow = np.flatnonzero((np.diff(same) == 1) & (number[:-1] >= 0) & (relative[1:] >= 0))
                yield counted(number[follow] * levels.span + relative[follow + 1], *placed(levels.pairs, levels.span))

    def write_triples(group: pa.Table) -> pa.Table:
        keys, counts = merged(group)
        b = group.column("bucket")[0].as_py()
        pair_counts = np.asarray(Store(levels.uri).get(f"2-{b}.counts"), float)
        write_level(Store(levels.uri), f"3-{b}", keys, counts, len(pair_counts), levels.span, pair_counts)
        return pa.table({"bucket": [b], "n": [len(keys)], "total": [0], "most": [0]}, schema=DONE)

    collect(by_bucket(merged_counts(texts.mapInArrow(count_triples, COUNTED)).unionByName(none), write_triples))
    return levels


DONE = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("most", pa.int64())])
DONE_DDL = "bucket int, n long, total long, most long"


def known_ids(reader: Reader, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids, _, doc = ids_and_counts(reader, part)
    return ids, doc


def ids_and_counts(reader: Reader, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and counts of all tokens, ends among them, and the text of each."""
    hashes, doc = tokens_of(part)
    distinct, codes = np.unique(hashes, return_inverse=True)
    ids, seen = reader.word_ids(distinct)
    return ids[codes], seen[codes], doc


def score(docs: DataFrame, levels: Levels, held_out: Column) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    base_score is that of the add-one word model; score interpolates triples, pairs and words with absolute discounts. Null
    and empty texts are one end token; texts of any length are scored whole; rows that repeat are scored each.
    """

    def run(batches):
        reader = Reader(levels)
        n, v = levels.tokens, levels.vocabulary
        for batch in batches:
            for part in text_slices(batch):
                ids, seen, doc = ids_and_counts(reader, part)
                word = (seen + 1.0) / (n + v + 1.0)
                p = word.copy()
                if n:
                    at = np.flatnonzero((doc[1:] == doc[:-1]) & (ids[:-1] >= 0))
                    number, relative, share, left = reader.pairs(ids[at], ids[at + 1])
                    p[at + 1] = share + left * p[at + 1]
                    follow = np.flatnonzero((np.diff(at) == 1) & (number[:-1] >= 0))
                    share, left = reader.triples(number[follow], relative[follow + 1])
                    to = at[follow + 1] + 1
                    p[to] = share + left * p[to]
                many = len(part)
                cols = [np.bincount(doc, minlength=many), np.bincount(doc, seen > 0, many).astype(np.int64)]
                sums = [np.bincount(doc, np.log10(x), many) for x in (word, p)]
                told = [part.column("doc_id").cast(pa.int64()), part.column("held_out")]
                numbers = [*(c.astype(np.int64) for c in cols), np.full(many, n, np.int64), *sums]
                yield pa.RecordBatch.from_arrays([*told, *map(pa.array, numbers)], names=SCORED)

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def learn_and_score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of all docs by the trie of those that held_out is not true for; the written trie is what the scores are read from."""
    levels = learn(docs.where(~held_out))
    return score(docs, levels, held_out)
