"""The training-data operators against brute force, on small inputs with nulls, empty and repeated rows."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import common, html_extraction, ngram_join, ngram_lm, packing, queries, source_mixing, token_counts, toxicity, url_filter, vector_dedup, vector_search

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    base = [" ".join(rnd.choice(vocab) for _ in range(n)) for n in (0, 1, 4, 5, 6, 30, 60, 200)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (None, "no id " * 9)]
    for k in range(120):
        t = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 0, 1, 2])):
            t[rnd.randrange(len(t))] = "Zz"
        rows.append((3 + k, " ".join(t)))
    rows += [(50, rows[54][1]), (122, "A b\x0bc d É e")]
    return spark.createDataFrame([(i, t, "en", rnd.choice(["a", "b", None]), len(t or "")) for i, t in rows], DOCS)


def component(n, links):
    up = list(range(n))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return [root(a) for a in range(n)]


def test_near_duplicates(spark, docs):
    rows = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for _, w in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = component(len(rows), links)
    low = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    want = sorted(((i, len(s), None if i is None else low[c]) for (i, _), s, c in zip(rows, sets, comp, strict=True)), key=repr)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()), key=repr)
    assert got == want
    kept = [r["doc_id"] for r in ngram_join.keep_one(docs).collect()]
    assert len([k for k in kept if k is not None]) == len({c for i, _, c in want if i is not None})


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert ngram_join.near_duplicates(none).count() == 0
    assert source_mixing.mix_sources(none).count() == 0
    assert packing.pack_documents(none, queries.vocabulary("word_bpe_49k.json")).count() == 0
    assert ngram_lm.learn_and_score(none, F.lit(False)).count() == 0


def test_mixing(spark, docs):
    got = source_mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        t = by.setdefault(r["source"], [0, r["source_size"], r["target"], 0])
        t[0] += r["size"]
        t[3] += r["taken"]
    assert all(size == total and taken == math.floor(target) for size, total, target, taken in by.values())
    assert got == source_mixing.mix_sources(docs).collect() or sorted(map(repr, got)) == sorted(map(repr, source_mixing.mix_sources(docs).collect()))
    mixed = source_mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert abs(sum(len(words(r["text"])) for r in mixed.collect()) - sum(t[3] for t in by.values())) <= 3


def test_mixing_sql(spark):
    import oracle

    assert not oracle.differ(queries.op2_source_mixing(spark, SF), queries.ORACLES["op2_source_mixing"], oracle.connect(SF))


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    whole, text = Tokenizer.from_file(path), {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in (None, 50, 122)}
    pieces, lengths = {}, {}
    for r in packing.pack_documents(docs, path, block_tokens=3000).collect():
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in text.items():
        ids, at = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    assert max(lengths.values()) <= 2048


def test_window_cuts():
    """The dynamic program finds what trying all choices finds."""
    rnd = random.Random(2)
    for _ in range(60):
        n = rnd.randint(1, 40)
        costs = packing.Costs(window=16, sentence=2.0, inside=6.0)
        ends = np.array(sorted({*rnd.sample(range(1, n + 1), rnd.randint(1, min(n, 4))), n}))
        stops = np.array(sorted(set(rnd.sample(range(1, n + 1), rnd.randint(1, min(n, 6))))))
        got = packing.window_cuts(n, ends, stops, costs)
        allowed = sorted({*ends.tolist(), *stops.tolist()})
        if max(np.diff([0, *allowed])) > 16:
            continue
        best = {0: 0.0}
        for p in allowed:
            best[p] = min((best[q] + 16 - (p - q) for q in best if p - 16 <= q < p), default=math.inf) + (0 if p in ends else 2.0)
        price = sum(16 - (b - a) + (0 if b in ends else 2.0) for a, b in zip([0, *got[:-1]], got, strict=True))
        assert math.isclose(price, best[n])


def test_language_model(spark, docs):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7, F.lit(0)) == 2
    text = docs.collect()
    count, total = {}, 0
    for r in text:
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            for w in [*words(r["text"]), " end"]:
                count[w] = count.get(w, 0) + 1
                total += 1
    got = sorted(ngram_lm.learn_and_score(docs, held).collect(), key=repr)
    want = {}
    for r in text:
        w = [*words(r["text"]), " end"]
        want.setdefault(r["doc_id"], []).append((len(w), sum(x in count for x in w), sum(math.log10((count.get(x, 0) + 1) / (total + len(count) + 1)) for x in w)))
    for r in got:
        assert r["train_tokens"] == total
        assert any(n == r["n_tokens"] and k == r["n_known"] and math.isclose(b, r["base_score"], rel_tol=1e-9) for n, k, b in want[r["doc_id"]])
        assert r["score"] < 0


def test_language_model_counts_all(spark):
    """Pairs and triples seen once count too: the score is that of discounted counts of all n-grams."""
    train = [(0, "a b c d"), (1, "a b d c a"), (2, "x y z")]
    rows = spark.createDataFrame([*train, (10, "a b c"), (11, "x y z"), (12, "y q a")], "doc_id long, text string")
    seen = [{}, {}, {}]
    for _, t in train:
        w = [*t.split(), " end"]
        for k in range(3):
            for j in range(len(w) - k):
                g = tuple(w[j : j + k + 1])
                seen[k][g] = seen[k].get(g, 0) + 1
    n, v = sum(seen[0].values()), len(seen[0])

    def prob(g):
        if len(g) == 1:
            return (seen[0].get(g, 0) + 1) / (n + v + 1)
        lower, context = prob(g[1:]), seen[len(g) - 2].get(g[:-1], 0)
        if not context:
            return lower
        after = [c for h, c in seen[len(g) - 1].items() if h[:-1] == g[:-1]]
        return max(0, seen[len(g) - 1].get(g, 0) - ngram_lm.DISCOUNT) / context + (1 - sum(c - ngram_lm.DISCOUNT for c in after) / context) * lower

    for r in ngram_lm.learn_and_score(rows, F.col("doc_id") >= 10).collect():
        w = [*dict(train + [(10, "a b c"), (11, "x y z"), (12, "y q a")])[r["doc_id"]].split(), " end"]
        assert math.isclose(r["score"], sum(math.log10(prob(tuple(w[max(0, j - 2) : j + 1]))) for j in range(len(w))), abs_tol=1e-3)


def test_elias_fano():
    rng = np.random.default_rng(0)
    for most in (100, 10**6, 10**12):
        x = np.unique(rng.integers(0, most, 2000))
        e = ngram_lm.EliasFano.of(x)
        assert (e.get(np.arange(len(x))) == x).all()
        asked = np.concatenate([x, rng.integers(0, most, 2000)]).astype(np.uint64)
        i = np.searchsorted(x, asked)
        assert (e.find(asked) == np.where((i < len(x)) & (x[np.minimum(i, len(x) - 1)] == asked), i, -1)).all()


def test_toxicity(spark):
    got = queries.op4_toxicity(spark, "/root/testdata/sf0.01").toPandas().merge(queries.table(spark, "/root/testdata/sf0.01", "labels").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert got["score"].between(0, 1).all()
    assert held[held["toxic"] == 1]["score"].mean() > 2 * held[held["toxic"] == 0]["score"].mean()
    model = toxicity.Model({"=idiot": 5.0}, {}, np.array([-3.0, 1, 0, 0, 0]))
    assert toxicity.Evidence(model).of(["idiot", "idiooot", "i.d.i.o.t", "plain"]).tolist() == [5.0, 5.0, 5.0, 0.0]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "i d i o t"), (None, "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["score"] > 0.5 for r in toxicity.score_texts(docs, model).collect()} == {1: False, 2: False, 3: True, None: False}


def test_toxicity_spaced():
    """Spacing is decoded together with stand-ins, repetition and noise."""
    evidence = toxicity.Evidence(toxicity.Model({"=idiot": 5.0, "=stupid": 4.0}, {}))
    texts = ["you 1 d 1 0 t now", "i d d i i o t", "an id iot, he", "st up id", "i . d ! o t", "is stu pid", "i i d i o t s", "is id", "this idea", "i d e a", ""]
    got = [toxicity.text_evidence(pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]), evidence)[0] for t in texts]
    assert [g[0] for g in got] == [5.0, 5.0, 5.0, 4.0, 5.0, 4.0, 5.0, 0.0, 0.0, 0.0, 0.0]
    assert all(g[2] == (g[0] > 0) for g in got)


def test_toxicity_long_words():
    """Words of any length are decoded, those joined by symbols too."""
    model = toxicity.Model({"=idiot": 5.0}, {})
    words_ = ["idi" + "o" * 40 + "t", "y.o.u._.a.r.e._.a.n._.i.d.i.o.t._.a.n.d._.s.o.o.n", "you_are_an_idiot_and_that_is_all_there_is_to_say", "b3d5" * 30]
    assert toxicity.Evidence(model).of(words_).tolist() == [5.0, 5.0, 5.0, 0.0]
    letters = "abcde" * 60
    assert letters in toxicity.decode(letters + ".", model)


def test_html():
    page = '<html><head><title>x</title></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">Buy</div><article><h1>Title here</h1><p>One  &amp; two,\nthree words of prose that go on for a while.<p>More of it, and then some more of the same.</article><footer>&copy; f</footer></body></html>'
    nodes = html_extraction.walk(html_extraction.parse(page))
    state = html_extraction.decode(nodes, html_extraction.train().logits(html_extraction.features(nodes)))
    assert html_extraction.blocks(nodes, state) == "Title here\n\nOne & two, three words of prose that go on for a while.\n\nMore of it, and then some more of the same."
    for k, n in enumerate(nodes):
        if n.parent and state[n.parent.place] == html_extraction.OUT:
            assert state[k] == html_extraction.OUT


def test_html_nulls(spark):
    p = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "v", "<p"), (None, "w", "<b>x</i>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extraction.extract(p).collect()}
    assert got[1]["text"] == got[2]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 8))
    x[200:300] = x[:100] + 0.1 * rng.standard_normal((100, 8))
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0, None] * 4, 1), (904, x[0].tolist(), None), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    links = [(a, b) for a in range(400) for b in range(a) if a % 3 == b % 3 and u[a] @ u[b] >= 0.93]
    comp = component(400, links)
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicate_vectors(df, block_rows=16, salt_rows=50).collect()}
    assert len(got) == 406
    for i in range(400):
        assert (got[i]["component_id"], got[i]["n_links"]) == (comp[i], sum(i in p for p in links))
    assert all(got[i]["n_links"] == 0 for i in (900, 901, 902, 903, 904, None))
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_search.search(df, asked, block_rows=30, query_rows=8).collect()
    every, hit = {**{i: x[i].astype(np.float64) for i in range(400)}, 904: x[0].astype(np.float64)}, 0
    for q in (i for i in every if i % 20 == 0):
        order = sorted((i for i in every if i != q), key=lambda i: (-float(every[q] @ every[i]), i))[:20]
        hit += len(set(order) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hit >= 0.9 * 20 * 20
    assert all(math.isclose(r["score"], float(every[r["query_id"]] @ every[r["vec_id"]]), abs_tol=1e-9) for r in found)


@pytest.mark.parametrize("rows", [None, 6000])
def test_search_recall(spark, rows):
    """With the registered parameters at least 0.9 of the true neighbours are found, on sf0.1 and on random vectors."""
    if rows is None:
        sf = "/root/testdata/sf0.1"
        vectors, found = queries.table(spark, sf, "embeddings"), queries.op6_ann_search(spark, sf)
    else:
        x = np.random.default_rng(rows).standard_normal((rows, 64))
        x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
        vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
        found = vector_search.search(vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
    have = vectors.toPandas().sort_values("vec_id")
    ids, m = have["vec_id"].to_numpy(), np.array(have["embedding"].to_list(), np.float64)
    got, hit, total = {}, 0, 0
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for at in np.flatnonzero(ids % 20 == 0):
        score = m @ m[at]
        score[at] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hit, total = hit + len(best & got[ids[at]]), total + len(best)
    print(rows, "recall", hit / total)
    assert hit >= 0.9 * total


def test_urls(spark):
    urls = ["http://A.example.org/es/1", "https://x.example.org/en/12?q", "http://b.com/de/9", "http://b.com/fr/9#x", "ftp://c.net", None, "none", "http://d.org", "http://org/x", "http://b.com/de/10/x", "http://b.com/xx/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("x.example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][2:] == ("com/fr/", "allow")
    assert got[5][:3] == ("", "", None) == got[6][:3]
    assert got[7][:3] == ("d.org", "", None)
    assert got[8][2] == "org/"
    assert len(got) == len(urls)


def test_token_counts():
    pieces = {"a", "b", "c", "ab", "abc", "abcd", "cd", "bcde", "e", "d", "cde"}
    a, rnd = token_counts.Automaton(pieces), random.Random(3)
    for _ in range(500):
        s, i, n = "".join(rnd.choice("abcdex") for _ in range(rnd.randint(0, 12))), 0, 0
        while i < len(s):
            i, n = next((j for j in range(len(s), i, -1) if s[i:j] in pieces), i + 1), n + 1
        assert a.count(s) == n, s


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["node"]: r["comp"] for r in common.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    comp = component(1200, [e for e in edges if e[0] != e[1]])
    assert all(comp[n] == c for n, c in got.items())


def test_pipeline(spark):
    """run() gives the pieces of what its stages give; tests of each stage are in test_queries."""
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, SF).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "source_mixing", "packing"]
    assert all(0 < r["length"] <= 2048 and r["start"] + r["length"] <= r["doc_tokens"] for r in pieces)
    ids = {r["doc_id"] for r in pieces}
    assert ids <= {r["doc_id"] for r in queries.table(spark, SF, "documents").select("doc_id").collect()} and len(ids) > 100
