"""Queries and stages against plain statements of what they must give."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import ngram_join, packing, queries, source_mixing, token_counts, toxicity

SF = "/root/testdata/sf0.001"


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))


def test_token_count_query(spark):
    """Every document's count is that of greedy longest matches, tried one by one."""
    import json

    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        pieces = {t.removesuffix("</w>") for t in json.load(f)["model"]["vocab"]}
    longest, letters, known = max(map(len, pieces)), token_counts.byte_letters(), {}

    def count(run):
        s = run if run.isascii() else run.encode().decode("latin-1").translate(letters)
        n = at = 0
        while at < len(s):
            at, n = next((e for e in range(min(len(s), at + longest), at, -1) if s[at:e] in pieces), at + 1), n + 1
        return n

    def tokens(text):
        total = 0
        for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
            if w not in known:
                import unicodedata

                known[w] = sum(map(count, token_counts.RUNS.findall(unicodedata.normalize("NFC", w).lower())))
            total += known[w]
        return total

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (None, "a b"), (-3, "x" * 300_000)], "doc_id long, text string")
    every = docs.unionByName(more)
    want = sorted(((r["doc_id"], len(words(r["text"])), tokens(r["text"])) for r in every.collect()), key=repr)
    got = token_counts.count_tokens(every, queries.vocabulary("word_bpe_49k.json")).collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_packing_powers():
    """Sequences of a power of two need no padding: the program takes one where that is cheapest, as trying all choices shows."""
    rnd = random.Random(9)
    for _ in range(40):
        n = rnd.randint(60, 500)
        costs = packing.Costs(window=256, sentence=3.0, inside=9.0, short=0.05)
        ends = np.array(sorted({*rnd.choices([64, 128, 192, 200, n // 2], k=2), n} & set(range(1, n + 1))))
        stops = np.array(sorted(rnd.sample(range(1, n + 1), min(n, 30))))
        got = packing.window_cuts(n, ends, stops, costs)
        allowed = sorted({*ends.tolist(), *stops.tolist()})
        if max(np.diff([0, *allowed])) > 256:
            continue
        pad = lambda size: min(256 - size, costs.short * (256 - size)) if size in (64, 128) else 256 - size
        best = {0: 0.0}
        for p in allowed:
            best[p] = min((best[q] + pad(p - q) for q in best if p - 256 <= q < p), default=math.inf) + (0 if p in ends else 3.0)
        price = sum(pad(b - a) + (0 if b in ends else 3.0) for a, b in zip([0, *got[:-1]], got, strict=True))
        assert math.isclose(price, best[n])


def test_decoder():
    """With room for all states the decoder's best reading is the cheapest of all readings of the lattice, tried one by one."""
    import itertools

    rnd = random.Random(10)
    grams = {a + b + c: -rnd.uniform(0.5, 6) for a in "\x02ios" for b in "\x02iost" for c in "iost\x03" if rnd.random() < 0.7}
    model = toxicity.Model({}, grams)
    for _ in range(60):
        word = "".join(rnd.choice("io0$t!1.ss") for _ in range(rnd.randint(1, 6)))
        cost = {}
        for choice in itertools.product(*toxicity.lattice(word)):
            text = "".join(x for x, _ in choice)
            letters = toxicity.START * 2 + text + toxicity.END
            total = sum(fee for _, fee in choice) - sum(model.char(*letters[k - 2 : k + 1]) for k in range(2, len(letters)))
            cost[text] = min(total, cost.get(text, math.inf))
        ranked = [t for t in sorted(cost, key=lambda t: (cost[t], t)) if t]
        got = toxicity.decode(word, model, beam=10_000, best=1000)
        if ranked:
            assert got and math.isclose(cost[got[0]], cost[ranked[0]], abs_tol=1e-9)


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage of the pipeline gives, one after the other."""
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        out.append((docs, rows := spark.createDataFrame(rows.collect(), rows.schema)))
        docs = rows
    return out


def test_toxicity_stage_learns_from_all(spark, tmp_path):
    """A word that only six labelled texts say counts, though over 20,000 other labels come before them by the hash of doc_id."""
    import corpus_pipeline

    ids = [r["doc_id"] for r in spark.range(27_400).select(F.col("id").alias("doc_id")).where(queries.fold(4) != 2).orderBy(F.xxhash64("doc_id")).collect()]
    assert len(ids) > 20_100
    last = set(ids[-6:])
    rows = [(k, f"plain w{k} x{k % 997} y{k % 13}" + (" grobian" if k in last else " idiot" if k % 10 == 0 else ""), int(k in last or k % 10 == 0)) for k in ids]
    more = [(-1, "no label and a grobian here", None), (-2, "no label here", None)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, toxic int")
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    docs.where("toxic is not null").select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.toxicity_stage(spark, queries.table(spark, str(tmp_path), "documents"), str(tmp_path))
    assert [r["doc_id"] for r in kept.where("doc_id < 0").collect()] == [-2]


def test_toxicity_stage_learns_from_near_copies(spark, tmp_path):
    """Texts that share a long passage all teach: a word that tells the toxic ones among them is learnt, copies count as often as they are."""
    import corpus_pipeline

    passage = " ".join(f"w{k}" for k in range(300))
    ids = [r["doc_id"] for r in spark.range(400).select(F.col("id").alias("doc_id")).where(queries.fold(4) != 2).collect()]
    rows = [(k, f"{passage} {'grobian' if k % 10 == 0 else 'gentle'} n{k}", int(k % 10 == 0)) for k in ids]
    more = [(-1, "no label and a grobian here", None), (-2, "no label here", None)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, toxic int")
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    docs.where("toxic is not null").select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    documents, labels = queries.table(spark, str(tmp_path), "documents"), queries.toxicity_labels(spark, str(tmp_path))
    kept = corpus_pipeline.toxicity_stage(spark, documents, str(tmp_path))
    assert [r["doc_id"] for r in kept.where("doc_id < 0").collect()] == [-2]
    _, known, many = toxicity.words_of(documents.union(documents.where("doc_id >= 0")), labels)
    assert (known.count(), many) == (len(ids), 2 * len(ids))


def test_toxicity_stage(spark):
    """What op4 predicts to be toxic goes, all else stays as it was. On sf0.01, as sf0.001 has too few labels to learn from."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.toxicity_stage(spark, docs, sf)
    bad = {r["doc_id"] for r in queries.op4_toxicity(spark, sf).collect() if r["predicted"]}
    assert bad and kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if r["doc_id"] not in bad)


def test_join_stage(stages):
    docs, kept = stages[1]
    sets = {r["doc_id"]: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := words(r["text"])) >= 5 else {tuple(w)} - {()} for r in docs.collect()}
    ids, up = sorted(sets), {i: i for i in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 0.79 < len(x) / len(y) < 1.26 and 100 * len(x & y) >= 80 * len(x | y):
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in ids if root(i) == i]
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_mixing_stage(stages):
    docs, mixed = stages[2]
    plan, taken = source_mixing.mix_sources(docs).collect(), {}
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
    assert mixed.columns == docs.columns
    assert taken == {r["source"]: math.floor(r["target"]) for r in plan if r["target"] >= 1}
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in mixed.collect():
        assert words(whole[r["doc_id"]])[: len(words(r["text"]))] == words(r["text"])


def test_packing_stage(stages):
    docs, pieces = stages[3]
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    rows, lengths = pieces.collect(), {}
    for r in rows:
        lengths.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(vocabulary.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    for parts in lengths.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_components_ids(spark):
    """op9's rows at this size, as comparing all pairs gives."""
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all(got[c] == c and c <= i for i, c in got.items())
