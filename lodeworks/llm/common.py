"""Pieces that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker splits into words at a time.
SLICE_BYTES = 6 << 20
#: Eights of bytes of a word that are hashed for all words at once.
LANES = 8
#: Edges that one task joins in memory, about 100 bytes each.
FOREST_EDGES = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; in local mode one of our own where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodeworks-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder as Parquet. In loops of joins this is the way to cut: the optimiser then
    knows the real size, where a checkpoint's is the product of what was joined, which grows beyond all numbers."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """The optimiser's estimate of what df reads; where it has none, the bytes of column, counted."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else int(df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0)


def bucket_count(size: int, each: int, least: int = 24, knee: int = 4096) -> int:
    """Buckets for size bytes of input: one for each bytes up to knee buckets, then growing with the root of the size, so that a
    slice's share of a bucket doesn't shrink to nothing. There is no upper limit."""
    wanted = max(least, size // each)
    return int(wanted if wanted <= knee else (knee * wanted) ** 0.5)


def dealt(df: DataFrame, number: str, many: int, most: int = 1 << 15) -> DataFrame:
    """df with the rows of each number 0 .. many - 1 in a partition of its own, so that a task's share is one bucket at any size of
    the input; beyond `most` partitions a task goes through several buckets, one after the other."""
    return df.repartitionById(min(many, most), F.col(number))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Slices of batch with about limit bytes of text each; a longer text stands alone. Null texts become empty."""
    at = batch.schema.get_field_index(column)
    text = pc.fill_null(batch.column(at).cast(pa.string()), "")
    batch = batch.set_column(at, pa.field(column, pa.string()), text)
    if not len(batch):
        return
    sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(batch):
        done = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        stop = min(stop, start + 60_000)
        yield batch.slice(start, stop - start)
        start = stop


def split_words(text: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts in a row, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat = parts.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    keep = pc.not_equal(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return flat.filter(keep), kept[ends[1:]] - kept[ends[:-1]]


def word_codes(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """For each word its place in the list of distinct words, and that list."""
    if not len(words):
        return np.zeros(0, np.int64), []
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time for all words at once; words of over LANES times that go one by one."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64)
    data = np.concatenate([np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    size = np.diff(at)
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live = np.flatnonzero(size <= 8 * LANES)
    for lane in range(LANES):
        live = live[size[live] > 8 * lane] if lane else live
        if not len(live):
            break
        missing = np.maximum(0, 8 * (lane + 1) - size[live]).astype(np.uint64) << np.uint64(3)
        part = eight[at[live] + 8 * lane] << missing >> missing
        out[live] = mix(out[live] ^ (part * np.uint64(0xD6E8FEB86659FD93)))
    for k in np.flatnonzero(size > 8 * LANES).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[at[k] : at[k + 1]].tobytes())
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _forest(batches):
    """Joins the edges of one partition: each node but a root with its root, the smallest node it reaches there."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            up.setdefault(a, a)
            up.setdefault(b, b)
            up[max(a, b)] = min(a, b)
    pairs = [(root(x), x) for x in up if root(x) != x]
    if pairs:
        low, high = zip(*pairs, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (u, v): rows (node, comp), comp the smallest node.

    Each round first joins what it can inside each partition, then sends every node to the first node of its closed
    neighbourhood and contracts the graph. The order is the numbers' own in even rounds and a fresh hash in odd ones, so
    long chains shrink by a constant factor. A hub's edges are never gathered in one place; a partition
    holds about FOREST_EDGES edges, however many partitions they came in.
    """
    live = edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    labels = None
    for turn in range(rounds):
        dealt = written(live.distinct())
        left = dealt.count()
        if not left:
            break
        live = written(dealt.coalesce(-(-left // FOREST_EDGES)).mapInArrow(_forest, "u long, v long"))
        rank = (lambda c: F.struct(c.alias("k"), c.alias("x"))) if turn % 2 == 0 else (lambda c, s=turn: F.struct(F.xxhash64(c, F.lit(s)).alias("k"), c.alias("x")))
        both = live.union(live.select("v", "u"))
        up = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("best")).select(F.col("u").alias("node"), F.least(F.col("best"), rank(F.col("u")))["x"].alias("p"))
        up = written(up)
        if labels is None:
            labels = up.select("node", F.col("p").alias("comp"))
        else:
            labels = written(labels.join(up.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")))
        a, b = up.select(F.col("node").alias("u"), F.col("p").alias("pu")), up.select(F.col("node").alias("v"), F.col("p").alias("pv"))
        live = live.join(a, "u").join(b, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    low = written(labels.groupBy("comp").agg(F.min("node").alias("low")))  # written first, so that a join on a large component is split
    return labels.join(low, "comp").select("node", F.col("low").alias("comp"))
