"""Approximate nearest neighbours: inverted lists scanned dimension block by dimension block with early abandoning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vector_dedup import matrix, usable

#: Width of the hypothesis test in standard errors of a partial distance, and columns read at a time.
DOUBT, COLUMNS = 2.1, 16


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lift(x: np.ndarray, top: float, query: bool = False) -> np.ndarray:
    """Vectors scaled by the largest norm, with one dimension more so that nearest means largest inner product."""
    x = x / top
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
    return np.column_stack([x, last])


def centroids(x: np.ndarray, lists: int, steps: int = 8, seed: int = 5) -> np.ndarray:
    """k-means over a sample; a list that loses all its vectors keeps its centre."""
    c = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(steps):
        near = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
        for k in np.unique(near):
            c[k] = x[near == k].mean(axis=0)
    return c


def probes_for(x: np.ndarray, centre: np.ndarray, k: int, recall: float, asked: int = 256, seed: int = 3) -> int:
    """Lists that a query must probe so that its k largest inner products are in them as often as recall tells, measured on a
    sample's lifted vectors x. Lifting takes a query's last dimension away."""
    rng = np.random.default_rng(seed)
    pick = rng.choice(len(x), min(asked, len(x)), replace=False)
    q = x[pick].copy()
    q[:, -1] = 0
    score = q @ x.T
    score[np.arange(len(pick)), pick] = -np.inf
    near = np.argpartition(-score, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)] if len(x) > 1 else np.zeros((len(pick), 0), int)
    if not near.size:
        return len(centre)
    weight = (centre * centre).sum(axis=1)
    home = np.concatenate([(weight - 2 * (x[lo : lo + 4096] @ centre.T)).argmin(axis=1) for lo in range(0, len(x), 4096)])
    place = np.argsort(np.argsort(weight - 2 * (q @ centre.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, home[near], axis=1), axis=None)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def scan(x: np.ndarray, q: np.ndarray, limit: np.ndarray, doubt: float = DOUBT, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test abandons. After d of D rotated columns the distance is estimated as
    partial * D / d; the hypothesis that it is within limit (squared) is rejected beyond (1 + doubt / sqrt d)^2 of it."""
    dim = x.shape[1]
    a, b = x[:, :columns], q[:, :columns]
    part = (b * b).sum(axis=1)[:, None] + (a * a).sum(axis=1)[None, :] - 2 * (b @ a.T)
    d = min(columns, dim)
    bound = lambda d: limit * (1 if d == dim else (1 + doubt / np.sqrt(d)) ** 2 * d / dim) + 1e-12
    qi, xi = np.nonzero(part <= bound(d)[:, None])
    part = part[qi, xi]
    while d < dim:
        e = min(dim, d + columns)
        diff = x[xi, d:e] - q[qi, d:e]
        part = part + np.einsum("ij,ij->i", diff, diff)
        keep = part <= bound(e)[qi]
        qi, xi, part, d = qi[keep], xi[keep], part[keep], e
    return qi, xi


FOUND = "query_id long, vec_id long, score double"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def best_of(k: int, qi: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each query's k best candidates, ties to smaller ids, and their ranks from 0."""
    order = np.lexsort((ids, -score, qi))
    first = np.flatnonzero(np.diff(qi[order], prepend=-1))
    rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi))))
    return order[rank < k], rank[rank < k]


def probe(k: int, turn: np.ndarray, top: float, pairs: int = 2_000_000, opening: int = 64):
    """The k best candidates of one block of a list for each query that probes it.

    The candidates come in growing steps: what the first ones reach, or what a query reached before, is what the tests hold
    the next ones against."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return FOUND_ARROW.empty_table()
        raw, every = matrix(rows.column("embedding")), matrix(asked.column("embedding"))
        ids, names = rows.column("vec_id").to_numpy(), asked.column("query_id").to_numpy()
        x, turned = lift(raw, top) @ turn, lift(every, top, True) @ turn
        known = asked.column("worst").to_numpy(zero_copy_only=False).astype(np.float64)
        out, many = [], max(1, pairs // len(ids))
        for lo in range(0, len(names), many):
            want, q, worst = every[lo : lo + many], turned[lo : lo + many], np.nan_to_num(known[lo : lo + many], nan=-np.inf)
            norm = (want * want).sum(axis=1) / top**2
            qi, xi, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            at, step = 0, opening
            while at < len(ids):
                a, b = scan(x[at : at + step], q, norm + 1 - 2 * worst / top**2 + 1e-9)
                b = b + at
                keep = names[lo + a] != ids[b]
                a, b = a[keep], b[keep]
                s = np.empty(len(a))
                for c in range(0, len(a), 200_000):
                    s[c : c + 200_000] = np.einsum("ij,ij->i", want[a[c : c + 200_000]], raw[b[c : c + 200_000]])
                qi, xi, score = np.concatenate([qi, a]), np.concatenate([xi, b]), np.concatenate([score, s])
                best, rank = best_of(k, qi, ids[xi], score)
                qi, xi, score = qi[best], xi[best], score[best]
                last = rank == k - 1
                worst[qi[last]] = np.maximum(worst[qi[last]], score[last])
                at, step = at + step, step * 4
            out.append((names[lo + qi], ids[xi], score))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=FOUND_ARROW)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = 20_000, block_rows: int = 4096, query_rows: int = 2048, recall: float = 0.97) -> DataFrame:
    """For each query (query_id, embedding) its k candidates (vec_id, embedding) of largest inner product that the probed lists
    hold, itself left out: query_id, rank, vec_id, score. Ties go to the smaller vec_id.

    The lists are as many as the root of the rows, at most a tenth of the `sample` vectors (chosen by a hash) that their
    centres are fitted on; every vector is indexed. A query scans its nearest list first, which gives the distance to beat, then
    as many lists as the sample shows to hold the share `recall` of true neighbours. Long lists are dealt in blocks, and each
    goes out once for every query_rows of the queries that probe it. Vectors that are null, zero or hold null or non-finite
    components, rows without an id, and vectors of another length than the most common one (ties: the longest) take no part;
    rows that repeat a vec_id count once, with the least embedding. Rank is 1, 2, ...; fewer rows where there are fewer
    candidates; none without rows.
    """
    good = vectors.where(usable() & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    good = cut(good.select("vec_id", "embedding", F.size("embedding").alias("dim")))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    dims = good.groupBy("dim").agg(F.count("*").alias("rows"), F.max(length).alias("top")).orderBy(F.desc("rows"), F.desc("dim")).limit(1).collect()
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, rows, top = dims[0]["dim"], dims[0]["rows"], dims[0]["top"]
    good = good.where(F.col("dim") == dim).drop("dim")
    asked = queries.where(usable() & F.col("query_id").isNotNull() & (F.size("embedding") == dim)).groupBy("query_id").agg(F.min("embedding").alias("embedding"))
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    turn = rotation(dim + 1)
    fitted = lift(matrix(drawn.column("embedding")), top)
    centre = centroids(fitted, max(1, min(int(rows**0.5), sample // 10)))
    weight = (centre * centre).sum(axis=1)
    probes = probes_for(fitted, centre, k, recall)

    def nearest(many: int, query: bool):
        def run(batches):
            for b in batches:
                t = pa.Table.from_batches([b])
                far = weight - 2 * (lift(matrix(t.column("embedding")), top, query) @ centre.T)
                near = np.argsort(far, axis=1, kind="stable")[:, :many].astype(np.int32) if many > 1 else far.argmin(axis=1).astype(np.int32)[:, None]
                yield b.append_column("lists", pa.array(list(near), pa.list_(pa.int32())))

        return run

    kind = good.schema["embedding"].dataType.simpleString()
    listed = good.mapInArrow(nearest(1, False), f"vec_id long, embedding {kind}, lists array<int>")
    listed = cut(listed.select("vec_id", "embedding", F.col("lists")[0].alias("list")))
    blocks = listed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))  # a row a list
    listed = listed.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    asked = cut(asked.mapInArrow(nearest(probes, True), f"query_id long, embedding {queries.schema['embedding'].dataType.simpleString()}, lists array<int>"))

    def scanned(wanted: DataFrame) -> DataFrame:
        """The candidates of (query_id, embedding, worst, list)."""
        key = ["list", "block", "part"]
        parts = wanted.groupBy("list").agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("parts"))
        each = blocks.join(parts, "list")  # a row a list
        to = wanted.join(F.broadcast(each), "list").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        to = to.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sent = listed.join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        sent = sent.select(*key, "vec_id", "embedding").groupBy(*key)
        return sent.cogroup(to.select(*key, "query_id", "embedding", "worst").groupBy(*key)).applyInArrow(probe(k, turn, top), FOUND)

    first = cut(scanned(asked.select("query_id", "embedding", F.col("lists")[0].alias("list"), F.lit(None).cast("double").alias("worst"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    worst = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
    rest = asked.where(F.size("lists") > 1).join(worst, "query_id", "left")
    rest = rest.select("query_id", "embedding", "worst", F.explode(F.slice("lists", 2, probes)).alias("list"))
    every = first.union(scanned(rest))
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
