"""Near-duplicate vectors by an exact metric range join over pivot cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut


def usable(column: str = "embedding") -> Column:
    """True for vectors without null or non-finite components and not all zero."""
    c = F.col(column)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of vectors of one length as doubles."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow, and no underflow to a zero norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: What shuffling a row costs, in products of two vectors; rows of a label that its pivots are tried on; fewest pivots.
SHIP, TRIED, FEWEST = 64, 512, 3
PIVOTS = "label long, dim int, vec_id long, v binary"
PIVOTS_ARROW = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("vec_id", pa.int64()), ("v", pa.binary())])


def rows_of(data: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), np.float64).reshape(-1, dim)


def reach_of(threshold: float) -> float:
    """The largest distance of two linked unit vectors."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) * (1 + 1e-9) + 1e-9


def cells_of(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its home, the nearest pivot, and in which cells it is needed.

    Let x have home i and a linked y home j: then y is no nearer to pivot i than to j, so by the triangle inequality x is at most
    reach further from j, measured along the line from i to j. Only there is x replicated."""
    cos = x @ pivots.T
    home = cos.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))
    near = cos[np.arange(len(x)), home][:, None] - cos <= reach * apart[home]
    near[np.arange(len(x)), home] = True
    return home, near


def spread(x: np.ndarray, apart: float, most: int) -> np.ndarray:
    """Places of vectors, in order, that are at least `apart` from all taken before, then of others up to FEWEST: pivots of one dense
    group would have all of it near the plane between them."""
    near, taken = np.full(len(x), -np.inf), []
    for k in range(len(x)):
        if len(taken) == most:
            break
        if 2 - 2 * near[k] >= apart * apart:
            taken.append(k)
            near = np.maximum(near, x @ x[k])
    rest = np.setdiff1d(np.arange(len(x)), taken)
    return np.concatenate([taken, rest[: max(0, FEWEST - len(taken))]]).astype(np.int64)


def choose(threshold: float):
    """Of a label's sample, in hash order, the number of pivots with the least estimated cost a row: finding its home, shipping its
    replicas, and comparing these with the rows of their cells. Replication is measured on the sample."""
    reach = reach_of(threshold)

    def run(sample: pa.Table) -> pa.Table:
        order = np.lexsort((sample.column("vec_id").to_numpy(), sample.column("u").to_numpy()))
        sample = sample.take(pa.array(order))
        x, rows = units(matrix(sample.column("embedding"))), sample.column("rows")[0].as_py()
        found = spread(x, 2 * reach, max(FEWEST, int(np.sqrt(rows))))
        tried = x[-TRIED:]
        best, count, p = np.inf, len(found), min(FEWEST, len(found))
        while p <= len(found):
            copies = cells_of(tried, x[found[:p]], reach)[1].sum(axis=1).mean()
            cost = p + copies * (SHIP + rows / p)
            if cost < best:
                best, count = cost, p
            p = len(found) if p < len(found) < p + max(1, p // 2) else p + max(1, p // 2)
        kept = sample.take(pa.array(found[:count]))
        data = pa.array([v.tobytes() for v in x[found[:count]]], pa.binary())
        return pa.table([kept.column("label"), kept.column("dim"), kept.column("vec_id"), data], schema=PIVOTS_ARROW)

    return run


CELLED = "label long, dim int, cell int, inner boolean, node long, copies long, v binary"
CELLED_ARROW = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("inner", pa.bool_()), ("node", pa.int64()), ("copies", pa.int64()), ("v", pa.binary())])


def assign(threshold: float, kind: type, products: int = 4_000_000):
    """Deals vectors of one label to the cells of its pivots; v holds their components as kind, without loss."""
    reach = reach_of(threshold)

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not len(rows):
            return CELLED_ARROW.empty_table()
        label, dim = rows.column("label")[0].as_py(), rows.column("dim")[0].as_py()
        p = rows_of(pivots.column("v"), dim)[np.argsort(pivots.column("vec_id").to_numpy(), kind="stable")]
        out, step = [], max(1, products // len(p))
        for at in range(0, len(rows), step):
            part = rows.slice(at, step)
            x = matrix(part.column("embedding"))
            home, near = cells_of(units(x), p, reach)
            row, cell = np.nonzero(near)
            data = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
            told = [pa.array(np.full(len(row), label, np.int64)), pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(cell == home[row])]
            taken = [c.take(pa.array(row)) for c in (part.column("vec_id"), part.column("copies"), data)]
            out.append(pa.table([*told, *taken], schema=CELLED_ARROW))
        return pa.concat_tables(out)

    return run


LINKED = "node long, n long, root long"
LINKED_ARROW = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def join_block(threshold: float, kind: type):
    """Links between a block of a cell's inner vectors and a block of all its vectors: how many rows each inner one links to, and
    a root for each linked vector."""

    def run(group: pa.Table) -> pa.Table:
        left = group.column("left").to_numpy(zero_copy_only=False).astype(bool)
        ids, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        v = units(np.frombuffer(b"".join(group.column("v").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64))
        a, b, ia, ib = v[left], v[~left], ids[left], ids[~left]
        if not len(a) or not len(b):
            return LINKED_ARROW.empty_table()
        linked = (a @ b.T >= threshold) & (ia[:, None] != ib[None, :])
        n = linked @ copies[~left]
        rows, cols = np.flatnonzero(n), np.flatnonzero(linked.any(axis=0))
        linked, ra, rb = linked[np.ix_(rows, cols)], ia[rows].copy(), ib[cols].copy()
        top = np.iinfo(np.int64).max
        while len(rows):  # smallest numbers spread along the links until nothing changes
            nb = np.minimum(rb, np.where(linked, ra[:, None], top).min(axis=0))
            na = np.minimum(ra, np.where(linked, nb[None, :], top).min(axis=1))
            if (na == ra).all() and (nb == rb).all():
                break
            ra, rb = na, nb
        zero = np.zeros(len(cols), np.int64)
        nodes, many = np.concatenate([ia[rows], ib[cols]]), np.concatenate([n[rows], zero]).astype(np.int64)
        return pa.table([pa.array(nodes), pa.array(many), pa.array(np.concatenate([ra, rb]))], schema=LINKED_ARROW)

    return run


def in_cells(distinct: DataFrame, threshold: float, kind: type, salt_rows: int) -> DataFrame:
    """The distinct vectors (vec_id, label, dim, embedding, copies) dealt to the cells of their label, replicas among them."""
    key = ["label", "dim"]
    sizes = distinct.groupBy(*key).agg(F.count("*").alias("rows"))
    sizes = sizes.select(*key, "rows", F.ceil(F.col("rows") / F.lit(salt_rows)).cast("int").alias("salts"), (1024 + 2 * F.sqrt("rows")).alias("wanted"))
    placed = distinct.join(sizes, key).withColumn("u", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 40)))
    sample = placed.where(F.col("u").cast("double") * F.col("rows") < F.col("wanted") * F.lit(float(1 << 40)))
    first = placed.groupBy(*key).agg(F.min_by("vec_id", F.struct("u", "vec_id")).alias("vec_id"))  # a sample is never empty
    sample = sample.unionByName(placed.join(first, [*key, "vec_id"], "left_semi")).dropDuplicates(["vec_id"])
    pivots = cut(sample.select(*key, "vec_id", "embedding", "rows", "u").groupBy(*key).applyInArrow(choose(threshold), PIVOTS))
    spread = pivots.join(sizes, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("salts")).cast("int"))
    rows = salted.select(*key, "salt", "vec_id", "copies", "embedding").groupBy(*key, "salt")
    return rows.cogroup(spread.select(*key, "salt", "vec_id", "v").groupBy(*key, "salt")).applyInArrow(assign(threshold, kind), CELLED)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, block_rows: int = 2048, salt_rows: int = 16_384) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of the same label (not null) and length link when their cosine is threshold or more. Equal vectors of a label are
    folded into one with a count first, so a group of copies is never compared with itself. Each label is cut into the cells of
    pivots drawn by a hash, at least FEWEST and as many more as pay by the replication seen on a sample, up to the root of
    its rows; cells are joined in blocks of block_rows inner and 2 * block_rows other vectors, so no task holds a hot label or
    cell. Vectors that are null, empty, zero or hold null or non-finite components, and rows without a vec_id, link with
    nothing; rows that repeat a vec_id count as one vector, the least (label, embedding) of them; no rows give no rows.
    """
    good = vectors.where(usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    good = good.groupBy("vec_id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "embedding")).alias("x"))
    name = [F.xxhash64("x.label", "x.embedding", F.lit(k)).alias(f"h{k}") for k in (1, 2)]  # 128 bits name a vector of a label
    good = cut(good.select("vec_id", *name, "x.label", "x.embedding", F.size("x.embedding").alias("dim")))
    distinct = good.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "label", "embedding", "dim")).alias("x"), F.count("*").alias("copies"))
    distinct = cut(distinct.select("h1", "h2", "x.*", "copies"))
    kind = np.float32 if isinstance(distinct.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    celled = cut(in_cells(distinct.drop("h1", "h2"), threshold, kind, salt_rows))
    place = ["label", "dim", "cell"]
    lefts = F.ceil(F.sum(F.col("inner").cast("int")) / F.lit(block_rows)).cast("int").alias("lefts")
    rights = F.ceil(F.count("*") / F.lit(2 * block_rows)).cast("int").alias("rights")
    blocks = celled.groupBy(*place).agg(lefts, rights)
    dealt = celled.join(blocks, place)
    home = lambda seed, parts: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = dealt.where("inner").select(*place, home(1, "lefts").alias("a"), every("rights").alias("b"), F.lit(True).alias("left"), "node", "copies", "v")
    right = dealt.where("lefts > 0").select(*place, every("lefts").alias("a"), home(2, "rights").alias("b"), F.lit(False).alias("left"), "node", "copies", "v")
    linked = cut(left.union(right).groupBy(*place, "a", "b").applyInArrow(join_block(threshold, kind), LINKED))
    counts = linked.groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    told = distinct.select("h1", "h2", F.col("vec_id").alias("node"), "copies").join(counts, "node", "left").join(comp, "node", "left")
    told = cut(told.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("comp", "node").alias("comp")))  # written first, as then a join on a hot copy is split
    known = good.select("vec_id", "h1", "h2").join(told, ["h1", "h2"]).select("vec_id", "n", "comp")
    out = vectors.select("vec_id").join(known, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", F.col("vec_id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
