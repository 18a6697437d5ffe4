"""Toxicity of texts: a noisy-channel decoder restores disguised words, then learned word evidence is scored."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, hashes_of, mix, split_words, text_slices, word_codes, written
from .ngram_join import SALTS, shingle_codes

#: What a disguised character may stand for, besides itself (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Channel costs in nats: a stand-in, a symbol put between letters (one that could stand for a letter costs more), a letter
#: said twice or more often.
STAND_IN, INSERTED, LOST, REPEATED = 0.6, 0.7, 4.0, 0.5
START, END = "\x02", "\x03"
#: Numbers of evidence of a text, see text_evidence.
EVIDENCE = ["top", "second", "many", "size"]
#: Bytes of text whose features a worker counts at a time, and rows of evidence in a task of the regression.
FIT_BYTES, STEP_ROWS = 3 << 20, 500_000
#: Letters at the start of a word that are features, and the beam of the decoder.
PREFIXES, BEAM, BEST = (3, 4, 5, 6), 16, 5
MASKED = re.compile(r"[^\w\s]|[\d_]|(\w)\1\1")
NOISE = re.compile(r"([^\w\s])\1{2,}")
PARTS = re.compile(r"[^\W_]+|[\W_]")
DOUBLE = re.compile(r"(.)\1")
EDGE = ".,;:?!\"'()[]{}<>|%#&*~`^=/\\-_…«»„“”‘’"
#: Edges that stand for no letter.
OUTER = EDGE.replace("!", "").replace("|", "").replace("(", "")
#: Readings of a character inside a spelled word.
SPELLED = {c: [(x, STAND_IN) for x in letters] for c, letters in LEET.items()}


@dataclass
class Model:
    """weights: log odds of word features; trigrams: log10-free character model; logit: of the evidence of a text."""

    weights: dict[str, float]
    trigrams: dict[str, float]
    logit: np.ndarray | None = None

    def char(self, a: str, b: str, c: str) -> float:
        t = self.trigrams
        return t.get(a + b + c) or t.get(b + c, -9.0) - 1.5


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def lattice(word: str) -> Iterator[list[tuple[str, float]]]:
    """For each run of a character its readings, (letters, cost)."""
    i = 0
    while i < len(word):
        c, j = word[i], i
        while j < len(word) and word[j] == c:
            j += 1
        n, i = j - i, j
        reads = [] if not c.isalpha() else [(c, 0.0 if n == 1 else REPEATED)] + ([(c + c, 0.0 if n == 2 else REPEATED)] if n > 1 else [])
        for x in LEET.get(c, ""):
            reads += [(x, STAND_IN)] if n == 1 else [(x, STAND_IN + REPEATED), (x + x, STAND_IN * 2)]
        if not c.isalpha():
            reads.append(("", LOST * n if c in LEET else INSERTED * min(n, 3)))
        yield reads


def decode(word: str, model: Model, beam: int = BEAM, best: int = BEST) -> list[str]:
    """The best readings of a disguised word: list Viterbi over the lattice. A state is the last two letters; each keeps its
    BEST cheapest readings, and the cheapest states stay in the beam. Every 64 runs the letters so far are put aside under a
    number, so that time grows with the length alone."""
    aside: list[str] = []
    paths: dict[tuple[str, str], list[tuple[float, str]]] = {(START, START): [(0.0, "")]}
    for k, reads in enumerate(lattice(word)):
        if k and k % 64 == 0:
            for kept in paths.values():
                for j, (cost, text) in enumerate(kept):
                    aside.append(text)
                    kept[j] = (cost, f"\0{len(aside) - 1}\0")
        nxt: dict[tuple[str, str], list[tuple[float, str]]] = {}
        for (a, b), kept in paths.items():
            for letters, fee in reads:
                x, y = a, b
                for c in letters:
                    fee -= model.char(x, y, c)
                    x, y = y, c
                nxt.setdefault((x, y), []).extend((cost + fee, text + letters) for cost, text in kept)
        cheapest = ((key, sorted(set(kept))[:best]) for key, kept in nxt.items())
        paths = dict(sorted(cheapest, key=lambda p: p[1][0])[:beam])
    done = sorted((cost - model.char(a, b, END), text) for (a, b), kept in paths.items() for cost, text in kept)
    return [t for t in (whole(text, aside) for _, text in done[: 2 * best]) if t]


def whole(text: str, aside: list[str]) -> str:
    """text with the letters that were put aside in place of their numbers."""
    tails = []
    while text.startswith("\0"):
        number, tail = text[1:].split("\0", 1)
        tails.append(tail)
        text = aside[int(number)]
    return text + "".join(reversed(tails))


def readings(raw: str, model: Model) -> list[str]:
    """The words that a raw lower-case word may stand for: itself without its edges, and what the decoder restores."""
    word = NOISE.sub("", raw)
    core = word.strip(EDGE)
    out = [core] if core else []
    if len(word) >= 3 and MASKED.search(core if not (set(word) - set(core)) & LEET.keys() else word) and any(c.isalpha() for c in word):
        out += [t for t in decode(word.strip(OUTER), model) if t not in out]
    return out


class Evidence:
    """Weight of each raw word: the largest of its readings' features. Words and runs of pieces stay in a bounded cache."""

    def __init__(self, model: Model, limit: int = 700_000):
        self.model, self.limit, self.known, self.parts, self.runs = model, limit, {}, {}, {}
        known = [f[1:] for f, w in model.weights.items() if f[0] == "=" and w > 0 and len(f) > 3]
        self.heads = {w[:k] for w in known for k in range(1, len(w) + 1)}
        self.inner = {w[a:b] for w in known for a in range(len(w)) for b in range(a, len(w) + 1)}
        self.begin = {f[1 : 1 + PREFIXES[0]] for f in model.weights}

    def word(self, text: str) -> float:
        if text[: PREFIXES[0]] not in self.begin:
            return 0.0
        get = self.model.weights.get
        return max(get(f, 0.0) for f in features(text))

    def of(self, distinct: list[str]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
            self.parts.clear()
        known, out = self.known, list(map(self.known.get, distinct))
        for k, w in enumerate(out):
            if w is None:
                out[k] = known[distinct[k]] = self.weigh(distinct[k])
        return np.array(out, float)

    def weigh(self, raw: str) -> float:
        """The weight of a raw word; also notes whether it may be a piece of another one where that is as easily told."""
        low = raw.lower()
        core = low.strip(EDGE)
        plain = core.isalpha()
        if plain and not DOUBLE.search(core) and low.strip(OUTER) == core:  # is read as itself alone
            self.parts[raw] = core in self.inner
            return self.word(core)
        w = max((self.word(t) for t in readings(low, self.model)), default=0.0)
        pieces = [] if plain else PARTS.findall(low)
        if len(pieces) > 2:  # words joined by symbols
            w = max(w, max((x for _, _, x in self.spelled(pieces, 1)), default=0.0))
        return w

    def part(self, raw: str) -> bool:
        """Whether a raw word, or some reading of it, may be a piece of a word that weighs something."""
        known = self.parts.get(raw)
        if known is None:
            alive = {""}
            for reads in lattice(NOISE.sub("", raw.lower().strip(OUTER))):
                alive = {t + x for t in alive for x, _ in reads if t + x in self.inner}
                if not alive:
                    break
            known = self.parts[raw] = bool(alive)
        return known

    def run(self, pieces: tuple[str, ...]) -> list[tuple[int, int, float]]:
        """spelled of neighbouring words."""
        found = self.runs.get(pieces)
        if found is None:
            if len(self.runs) > self.limit // 8:
                self.runs.clear()
            found = self.spelled(pieces)
            if len(pieces) <= 8:
                self.runs[pieces] = found
        return found

    def spelled(self, pieces: Sequence[str], least: int = 2) -> list[tuple[int, int, float]]:
        """Words that weigh something and that at least `least` neighbouring pieces spell together: first piece, last piece, weight.

        The lattice runs over the pieces with nothing between them. A walk keeps for each start of a known word the cheapest
        way there, so its time is linear in the pieces; what costs more than a nat a letter must be a reading of decode too."""
        found, last, heads = [], "", self.heads
        alive: dict[tuple[str, bool], tuple[float, int]] = {}  # (start of a word, whether the last character was read as its end): cost, first piece
        for k, piece in enumerate(pieces):
            alive[("", False)] = (0.0, k)
            for c in piece:
                nxt: dict[tuple[str, bool], tuple[float, int]] = {}
                reads = [(c, 0.0), *SPELLED.get(c, ())] if c.isalpha() else SPELLED.get(c, ())
                for (text, read), (cost, first) in alive.items():
                    to = [((text + x, True), cost + fee) for x, fee in reads if text + x in heads]
                    if text and read and c == last:
                        to.append(((text, True), cost + REPEATED))
                    elif text and not c.isalpha():
                        to.append(((text, False), cost + (LOST if c in LEET else INSERTED)))
                    for key, paid in to:
                        if key not in nxt or (paid, -first) < (nxt[key][0], -nxt[key][1]):
                            nxt[key] = (paid, first)
                alive, last = nxt, c
                if not alive:
                    last = piece[-1]
                    break
            for (text, read), (cost, first) in alive.items():
                weight = self.model.weights.get("=" + text, 0.0) if len(text) >= 3 else 0.0
                if weight > 0 and read and k - first + 1 >= least:
                    run = pieces[first : k + 1]
                    if cost <= len(text) or any(text in decode(w, self.model) for w in dict.fromkeys(("".join(run), "".join(p.strip(EDGE) for p in run)))):
                        found.append((first, k, weight))
        return found


def text_evidence(part: pa.RecordBatch, evidence: Evidence) -> np.ndarray:
    """Per text: the largest weight of a word, the second largest, and how many words weigh something (at most 5), log size."""
    words, counts = split_words(part.column("text"))
    codes, distinct = word_codes(words)
    weight = evidence.of(distinct)[codes]
    out = np.zeros((len(counts), 4))
    starts = np.cumsum(counts) - counts
    part = list(map(evidence.parts.get, distinct))
    part = np.fromiter((evidence.part(w) if p is None else p for w, p in zip(distinct, part, strict=True)), bool, len(distinct))[codes]
    if part.any():  # neighbouring pieces may spell a word
        doc = np.repeat(np.arange(len(counts)), counts)
        run = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])]))
        size = np.diff(np.append(run, len(part)))
        for a, n in zip(run[part[run] & (size > 1)].tolist(), size[part[run] & (size > 1)].tolist(), strict=True):
            for first, last, w in evidence.run(tuple(distinct[c].lower().strip(OUTER) for c in codes[a : a + n].tolist())):
                if w > weight[a + first : a + last + 1].max():
                    weight[a + first] = w
    heavy = np.flatnonzero(weight > 0)
    doc = np.searchsorted(starts, heavy, side="right") - 1
    # an empty text starts where the next one does; the last start is the right one, as searchsorted gives
    order = np.lexsort((-weight[heavy], doc))
    heavy, doc = heavy[order], doc[order]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    out[doc[first], 0] = weight[heavy[first]]
    many = np.diff(np.append(first, len(doc)))
    second = first[many > 1]
    out[doc[second], 1] = weight[heavy[second + 1]]
    out[doc[first], 2] = np.minimum(many, 5)
    out[:, 3] = np.log1p(counts)
    return out


def _feature_counts(batches):
    """Of a slice: texts of each class that have a feature, and how often a word is said."""
    for batch in batches:
        for part in text_slices(batch, limit=FIT_BYTES):
            words, counts = split_words(part.column("text"))
            if not len(words):
                continue
            codes, distinct = word_codes(words)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False) == 1
            lowered = [w.lower().strip(EDGE) for w in distinct]
            cores = sorted(set(lowered))  # words that begin alike stand together
            place = {c: k for k, c in enumerate(cores)}
            code = np.fromiter((place[c] for c in lowered), np.int64, len(lowered))[codes]
            said = np.bincount(code, minlength=len(cores))
            doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
            doc, code = np.divmod(np.unique(doc * len(cores) + code), len(cores))
            for size in (0, *PREFIXES):
                long = [k for k, c in enumerate(cores) if len(c) >= max(1, size)]
                heads = [cores[k][:size] if size else cores[k] for k in long]
                names = list(dict.fromkeys(heads))
                number = np.full(len(cores), -1, np.int64)
                number[long] = np.cumsum([0, *(a != b for a, b in zip(heads, heads[1:], strict=False))])[: len(long)]
                feat = number[code]
                has = feat >= 0
                d, f = doc[has], feat[has]
                first = (np.diff(d, prepend=-1) != 0) | (np.diff(f, prepend=-1) != 0)
                d, f = d[first], f[first]
                pos, every = np.bincount(f[toxic[d]], minlength=len(names)), np.bincount(f, minlength=len(names))
                times = np.zeros(len(names), np.int64) if size else said[long]
                marked = pa.array([("^" if size else "=") + x for x in names], pa.string())
                yield pa.RecordBatch.from_arrays([marked, pa.array(pos), pa.array(every - pos), pa.array(times)], names=["feature", "pos", "neg", "said"])


def _witnesses(known: frozenset[str]):
    """Which of the known features each text has, with two hashes: the least one of the five words around where it has it, and that
    of the text's least shingle. Copies have equal ones; near copies have few of the latter, texts that share a passage many of the
    former."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, limit=FIT_BYTES):
                words, counts = split_words(part.column("text"))
                if not len(words):
                    continue
                codes, distinct = word_codes(words)
                names: dict[str, int] = {}
                of = np.full((len(distinct), 1 + len(PREFIXES)), -1, np.int64)
                for k, w in enumerate(distinct):
                    core = w.lower().strip(EDGE)
                    for j, f in enumerate(features(core) if core else []):
                        if f in known:
                            of[k, j] = names.setdefault(f, len(names))
                doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
                h = hashes_of(words)
                code, of_text = shingle_codes(h, counts, 5)
                least = np.zeros(len(counts), np.int64)
                begin = np.flatnonzero(np.diff(of_text.astype(np.int64), prepend=-1))
                least[of_text[begin].astype(np.int64)] = np.minimum.reduceat(code, begin).astype(np.int64)
                around = mix(h + SALTS[2])
                for d in (1, 2):
                    same = doc[d:] == doc[:-d]
                    around[:-d] += np.where(same, mix(h[d:] + SALTS[2 + d]), np.uint64(0))
                    around[d:] += np.where(same, mix(h[:-d] + SALTS[2 - d]), np.uint64(0))
                at, slot = np.nonzero(of[codes] >= 0)
                f, d, a = of[codes[at], slot], doc[at], mix(around[at]).view(np.int64)
                order = np.lexsort((a, d, f))
                f, d, a = f[order], d[order], a[order]
                first = (np.diff(f, prepend=-1) != 0) | (np.diff(d, prepend=-1) != 0)
                told = pa.array(list(names), pa.string()).take(pa.array(f[first]))
                yield pa.RecordBatch.from_arrays([told, pa.array(a[first]), pa.array(least[d[first]])], names=["feature", "around", "least"])

    return run


def _trigram_counts(batches):
    """Of a batch of words and how often each is said: how often three characters stand together."""
    for batch in batches:
        grams: dict[str, int] = {}
        for f, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if f[1:].isalpha() and len(f) <= 25:
                s = START + START + f[1:] + END
                for i in range(2, len(s)):
                    grams[s[i - 2 : i + 1]] = grams.get(s[i - 2 : i + 1], 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])


def likely(docs: DataFrame, ids: DataFrame, many: int) -> DataFrame:
    """docs without most of those whose doc_id isn't among the `many` ids: bits of hashed ids, 16 an id and 8 MB at most, are broadcast,
    so that few other texts are read or shuffled. An exact join must follow."""
    key = "xxhash64(cast(doc_id as long))"
    word, bit = F.expr(f"pmod({key} div 64, {max(1, min(1 << 20, many // 4))}L)"), F.expr(f"cast(pmod({key}, 64) as int)")
    bits = ids.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))")).alias("bits"))
    near = docs.join(F.broadcast(bits), word == F.col("word")).where(F.getbit("bits", bit) == 1)
    return near.select(*docs.columns)


def among(docs: DataFrame, ids: DataFrame, many: int) -> DataFrame:
    """docs of a doc_id that is among the `many` ids, with the columns of both. The join is one by sorting at any size."""
    return likely(docs, ids, many).join(ids.hint("merge"), "doc_id")


def words_of(docs: DataFrame, labels: DataFrame, most_features: int = 20_000, most_trigrams: int = 200_000, least_texts: int = 6) -> tuple[Model, DataFrame, int]:
    """A model without its logit, from all labelled texts; the labels (doc_id, toxic), and how many texts have one.

    Every row counts, copies too. A word feature must be said by least_texts different toxic texts: each time between other words in a
    text of another least shingle (exact copies aside), or nearly always between other words. Of these the most_features that tell
    most stay, and of the trigrams the most_trigrams most frequent, each kind by its own limit; a warning tells where one binds. Rows
    without a label or an id teach nothing; without labelled rows of both kinds every score is the share of toxic ones.
    """
    picked = written(labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")))
    texts, many = docs.select("doc_id", "text"), picked.count()
    n, p = map(int, among(docs.select("doc_id"), picked, many).agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first())
    base = (p + 0.5) / (n + 1)
    if not 0 < p < n:
        return Model({}, {}, np.array([log(base / (1 - base)), 0.0, 0.0, 0.0, 0.0])), picked, n
    counts = among(texts, picked, many).mapInArrow(_feature_counts, "feature string, pos long, neg long, said long")
    counts = counts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("said").alias("said"))
    # a lower bound of the share among toxic texts against an upper bound of that among the others
    gain = F.log(((F.col("pos") - F.sqrt("pos")) / p) / ((F.col("neg") + F.lit(2) + F.sqrt("neg")) / (n - p)))
    counts = written(counts)
    kept = counts.withColumn("gain", gain).where((F.col("pos") >= least_texts) & (F.col("gain") > 0.7))
    # copies count as often as they are, but copies of one text alone, edited or not, teach none of its words
    known = frozenset(r["feature"] for r in kept.select("feature").collect())
    told = among(texts, picked.where("toxic = 1").select("doc_id"), p).select("text").mapInArrow(_witnesses(known), "feature string, around long, least long")
    told = told.groupBy("feature", "around", "least").agg(F.count("*").alias("have"))
    alike = {c: F.count("*").over(Window.partitionBy("feature", c)) for c in ("around", "least")}
    alone, own = (alike["around"] == 1) & (alike["least"] == 1), (alike["around"] == 1) & (F.col("have") == 1)
    told = told.select("feature", "have", alone.cast("long").alias("alone"), own.cast("long").alias("own"))
    told = told.groupBy("feature").agg(F.sum("have").alias("have"), F.sum("alone").alias("alone"), F.sum("own").alias("own"))
    told = told.where((F.col("alone") >= least_texts) | ((F.col("own") >= least_texts) & (10 * F.col("own") >= 9 * F.col("have"))))
    words = kept.join(told, "feature", "left_semi").orderBy(F.desc("gain"), F.desc("neg"), "feature").limit(most_features + 1).toPandas()
    found = counts.where("said > 0").select("feature", "said").mapInArrow(_trigram_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = found.orderBy(F.desc("n"), "gram").limit(most_trigrams + 1).toPandas()
    for what, have, most in (("word features", words, most_features), ("trigrams", found, most_trigrams)):
        if len(have) > most:
            warnings.warn(f"toxicity: more than {most} {what}; the rest is left out", stacklevel=2)
    words, found = words[:most_features], found[:most_trigrams]
    grams = dict(zip(found["gram"], found["n"].tolist(), strict=True))
    pairs: dict[str, int] = {}
    singles: dict[str, int] = {}
    for g, c in grams.items():
        pairs[g[:2]] = pairs.get(g[:2], 0) + c
        singles[g[1:]] = singles.get(g[1:], 0) + c
    heads: dict[str, int] = {}
    for g, c in singles.items():
        heads[g[0]] = heads.get(g[0], 0) + c
    trigrams = {g: log(c / pairs[g[:2]]) - 1e-9 for g, c in grams.items()}
    trigrams |= {g: log(c / heads[g[0]]) - 1e-9 for g, c in singles.items()}
    return Model(dict(zip(words["feature"], words["gain"].astype(float), strict=True)), trigrams), picked, n


def fit(docs: DataFrame, labels: DataFrame, **limits: int) -> Model:
    """A model from all labelled texts; limits: those of words_of."""
    model, picked, n = words_of(docs, labels, **limits)
    if model.logit is None:
        told = evidence_of(among(docs.select("doc_id", "text"), picked, n), model, ["toxic"])
        model.logit = logistic(told, n)
    return model


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of each row of docs by a model of its labelled texts: fit and score_texts with one pass for the evidence."""
    model, picked, n = words_of(docs, labels)
    if model.logit is not None:
        return score_texts(docs, model)
    told = written(evidence_of(docs.select("doc_id", "text"), model, ["doc_id"]))
    model.logit = logistic(told.join(picked, "doc_id"), n)
    z = sum((F.col(c) * float(w) for c, w in zip(EVIDENCE, model.logit[1:], strict=True)), F.lit(float(model.logit[0])))
    return told.select("doc_id", (1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))).alias("score"))


def _slopes(w: np.ndarray):
    """Of the rows of a partition: slope and curvature of a logistic regression's likelihood at w."""

    def run(batches):
        slope, curve = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), *(batch.column(c).to_numpy(zero_copy_only=False) for c in EVIDENCE)])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope += x.T @ (batch.column("toxic").to_numpy(zero_copy_only=False) - p)
            curve += x.T @ (x * (p * (1 - p))[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([slope.tolist()]), pa.array([curve.ravel().tolist()])], names=["slope", "curve"])

    return run


def logistic(told: DataFrame, many: int, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Newton's method for a ridge logistic regression of toxic on the evidence of about `many` rows; the first weight is the constant.
    The rows stay where they are: each partition sends the sums of a step."""
    told = cut(told.select("toxic", *EVIDENCE)).coalesce(-(-many // STEP_ROWS))
    w, keep = np.zeros(len(EVIDENCE) + 1), ridge * np.eye(len(EVIDENCE) + 1)
    keep[0, 0] = 1e-6
    for _ in range(steps):
        sums = told.mapInArrow(_slopes(w), "slope array<double>, curve array<double>").collect()
        slope, curve = (np.sum([r[k] for r in sums], axis=0) for k in ("slope", "curve"))
        move = np.linalg.solve(curve.reshape(len(w), len(w)) + keep, slope - keep @ w)
        w = w + move
        if np.abs(move).max() < 1e-12:
            break
    return w


def evidence_of(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns named in keep and the evidence of each row's text."""

    def run(batches):
        evidence = Evidence(model)
        for batch in batches:
            for part in text_slices(batch):
                x = text_evidence(part, evidence)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x[:, k]) for k in range(len(EVIDENCE)))], names=[*keep, *EVIDENCE])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.DoubleType()) for c in EVIDENCE)]))


def score_texts(docs: DataFrame, model: Model, extra: list[str] | None = None) -> DataFrame:
    """The columns named in extra (doc_id unless told otherwise) with score in [0, 1], one row per row of docs.

    Null and empty texts have no evidence and get the score of that; any length is scored whole; rows that repeat score alike."""
    keep = extra or ["doc_id"]
    taken = docs.select(*([] if "text" in keep else ["text"]), *keep)

    def run(batches):
        evidence = Evidence(model)
        for batch in batches:
            for part in text_slices(batch):
                z = np.column_stack([np.ones(len(part)), text_evidence(part, evidence)]) @ model.logit
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*keep, "score"])

    return taken.mapInArrow(run, T.StructType([*(taken.schema[c] for c in keep), T.StructField("score", T.DoubleType())]))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs, with their columns, without those that score threshold or more. Columns may have any names; null texts stay null."""
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(F.col("text").isNull().alias("lost"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))
    kept = score_texts(docs.select("text", rest.alias("rest")), model, ["text", "rest"]).where(F.col("score") < threshold)
    back = {c: F.col(f"rest.c{k}") for k, c in enumerate(others)} | {"text": F.when(~F.col("rest.lost"), F.col("text"))}
    return kept.select(*(back[c].alias(c) for c in docs.columns))
