"""Nearest-neighbour search, reranking and merges of result lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot


def over_fetch(k: int, factor: float = 3.0, most: int = 50) -> int:
    return min(max(k, int(k * factor)), most)


def top_k(vectors: DataFrame, query: Column, k: int = 5, vector: str = "embedding", key: str = "vec_id", score: Column | None = None, descending: bool = True) -> DataFrame:
    """The k best rows with their score, ties by key: sort and limit become one top-k per task and one merge."""
    s = vectors.withColumn("score", dot(F.col(vector), query) if score is None else score)
    return s.orderBy(F.desc("score") if descending else F.asc("score"), key).limit(k)


def rerank(candidates: DataFrame, score: Column, k: int | None = None, order: str = "rank") -> DataFrame:
    out = candidates.withColumn("reranker_score", score).orderBy(F.desc("reranker_score"), F.asc(order))
    return out if k is None else out.limit(k)


def batch_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = 4096, most_queries: int = 20_000) -> DataFrame:
    """query_id, vec_id, score, rank: k best vectors for each query (query_id, embedding).

    The queries go to every task; each task multiplies blocks of its vectors with all of them and keeps k a query, so only k rows a
    query and task are shuffled. More than most_queries are dealt by a hash into parts of about half as many, one pass over the
    vectors for each part, so that what goes to a task stays bounded."""
    many = queries.count()
    parts = 1 if many <= most_queries else -(-2 * many // most_queries)
    dealt = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    found = [_top_of_part(queries.where(dealt == p) if parts > 1 else queries, vectors, k, block) for p in range(parts)]
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _top_of_part(queries: DataFrame, vectors: DataFrame, k: int, block: int) -> DataFrame:
    """(query_id, vec_id, score) of each task's k best for each of the queries, which fit in memory."""
    asked = queries.select("query_id", "embedding").toPandas()
    if asked.empty:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    ids, q = asked["query_id"].to_numpy(), np.array(asked["embedding"].tolist(), np.float64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_s, best_v = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for f in frames:
            for at in range(0, len(f), block):
                part = f.iloc[at : at + block]
                s = np.hstack([best_s, q @ np.array(part["embedding"].tolist(), np.float64).T])
                v = np.hstack([best_v, np.broadcast_to(part["vec_id"].to_numpy(), (len(ids), len(part)))])
                order = np.lexsort((v, -s), axis=1)[:, :k]
                best_s, best_v = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)
        out = pd.DataFrame({"query_id": np.repeat(ids, k), "vec_id": best_v.ravel(), "score": best_s.ravel()})
        yield out[np.isfinite(out["score"])]

    return vectors.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, score double")


def first_seen(df: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row of each key, the first in order."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rn = 1").drop("rn")
