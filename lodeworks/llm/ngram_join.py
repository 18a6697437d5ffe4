"""Near-duplicate documents by a Jaccard self-join of word shingles with adaptive multi-match prefixes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, components, cut, dealt, hashes_of, input_bytes, mix, split_words, text_slices

ODD = np.uint64(0x9E3779B97F4A7C15)
#: One salt for each place in a shingle.
SALTS = ODD * np.arange(1, 65, dtype=np.uint64)
#: Shingles are 48-bit hashes, so that one sorts together with a 16-bit document number.
SHINGLE_BITS, DOC_BITS = 48, 16
#: 64-bit words of a set's parity bitmap.
BITMAP_WORDS = 4
#: The longest extension of a prefix, and what verifying a candidate costs against reading a posting.
MOST_MATCHES, VERIFY_COST = 4, 16.0


def shingle_codes(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of texts that hold counts[k] of the word hashes in a row, in the order of the words, and the text of each.

    A text of fewer than n words gives its whole sequence as one shingle; one without words gives none.
    """
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    rest = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))  # words from here to the text's end
    first = np.zeros(len(hashes), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    code = np.zeros(len(hashes), np.uint64)
    for k in range(min(n, len(hashes))):
        here = rest > k
        code[: len(hashes) - k] += np.where(here[: len(hashes) - k], mix(hashes[k:] + SALTS[k]), np.uint64(0))
    size = np.minimum(rest, n).astype(np.uint64)
    keep = (rest >= n) | first
    return mix(code[keep] + ODD * size[keep]) >> np.uint64(64 - SHINGLE_BITS), doc[keep]


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Distinct (shingle << 16 | text) of shingle_codes, sorted."""
    code, doc = shingle_codes(hashes, counts, n)
    return np.unique((code << np.uint64(DOC_BITS)) | doc)


def packed(x: np.ndarray, width: int) -> bytes:
    """Sorted numbers as differences in byte planes, compressed; whole-range numbers just compressed."""
    planes = np.diff(x, prepend=x[:1] * 0).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpacked(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    planes = np.zeros((len(raw) // width, 8), np.uint8)
    planes[:, :width] = raw.reshape(width, -1).T
    return np.cumsum(planes.view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


POSTED = "bucket int, kind int, ids binary, sizes binary, codes binary, docs binary"
POSTED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("docs", pa.binary())])


def class_names(code: np.ndarray, doc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each document's set of shingles."""
    order = np.argsort(doc, kind="stable")
    total = np.zeros(len(size), np.uint64)
    if len(order):
        total[size > 0] = np.add.reduceat(mix(code[order] + ODD), (np.cumsum(size) - size)[size > 0])
    return mix(total ^ mix(size.astype(np.uint64))).view(np.int64)


def post(buckets: int, n: int):
    """Per slice of texts: postings by shingle range (kind 1), and what each document is (kind 0), dealt by a hash of its row.

    A class is a set of shingles, named by a 64-bit hash of it; exact copies are of one class. Of a slice each class posts
    its shingles once, and no bucket gathers a class's documents, however many they are."""

    bounds = np.array([(b << SHINGLE_BITS) // buckets for b in range(buckets + 1)], np.uint64)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                words, counts = split_words(part.column("text"))
                both = shingles(hashes_of(words), counts, n)
                doc = (both & np.uint64((1 << DOC_BITS) - 1)).astype(np.uint16)
                code = both >> np.uint64(DOC_BITS)
                size = np.bincount(doc, minlength=len(counts)).astype(np.int64)
                name = class_names(code, doc, size)
                lone = np.zeros(len(counts), bool)  # the first document of each class in this slice
                lone[np.unique(name, return_index=True)[1]] = True
                code, doc = code[lone[doc]], doc[lone[doc]]
                at = np.searchsorted(code, bounds)
                rows = []
                for b in np.flatnonzero(np.diff(at)).tolist():
                    own, local = np.unique(doc[at[b] : at[b + 1]], return_inverse=True)
                    sizes = size[own].astype("<i4").tobytes()
                    rows.append((b, 1, name[own].tobytes(), sizes, packed(code[at[b] : at[b + 1]], 6), local.astype("<u2").tobytes()))
                ids = part.column("doc_id").cast(pa.int64())
                known = np.array(ids.is_valid())
                id_values = np.array(pc.fill_null(ids, 0))
                marks = part.column("mark").to_numpy(zero_copy_only=False)
                home = (mix(id_values.view(np.uint64) + ODD * marks.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                for k in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
                    told = np.column_stack([name[k], marks[k]]).tobytes()
                    rows.append((int(home[k[0]]), 0, id_values[k].tobytes(), size[k].astype("<i4").tobytes(), told, known[k].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), POSTED_ARROW.types, strict=True)], schema=POSTED_ARROW)

    return run


GATHERED = "doc_id long, mark long, cls long, n int, codes binary, freqs binary"
GATHERED_ARROW = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("codes", pa.binary()), ("freqs", pa.binary())])


def gather(group: pa.Table) -> pa.Table:
    """One bucket: its documents (with null codes), and per class the shingles that other classes hold too, with how many do."""
    kinds = group.column("kind").to_pylist()
    cols = {c: group.column(c).to_pylist() for c in ("ids", "sizes", "codes", "docs")}
    out = []
    info = [k for k, kind in enumerate(kinds) if kind == 0]
    if info:
        ids = np.frombuffer(b"".join(cols["ids"][k] for k in info), np.int64)
        names, marks = np.frombuffer(b"".join(cols["codes"][k] for k in info), np.int64).reshape(-1, 2).T
        sizes = np.frombuffer(b"".join(cols["sizes"][k] for k in info), np.int32)
        known = np.frombuffer(b"".join(cols["docs"][k] for k in info), bool)
        null = pa.nulls(len(ids), pa.binary())
        out.append(pa.table([pa.array(ids, mask=~known), pa.array(marks), pa.array(names), pa.array(sizes), null, null], schema=GATHERED_ARROW))
    code, cls, names, sizes, base = [], [], [], [], 0
    for k, kind in enumerate(kinds):
        if kind:
            own = np.frombuffer(cols["ids"][k], np.int64)
            code.append(unpacked(cols["codes"][k], 6))
            cls.append(np.frombuffer(cols["docs"][k], "<u2").astype(np.int64) + base)
            names.append(own)
            sizes.append(np.frombuffer(cols["sizes"][k], np.int32))
            base += len(own)
    if code:
        code, cls, names, sizes = (np.concatenate(x) for x in (code, cls, names, sizes))
        names, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        cls = inverse[cls]
        order = np.lexsort((cls, code))
        code, cls = code[order], cls[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (cls[1:] != cls[:-1])
        code, cls = code[new], cls[new]
        _, inverse, freq = np.unique(code, return_inverse=True, return_counts=True)
        freq = freq[inverse]
        shared = freq > 1
        code, cls, freq = code[shared], cls[shared], freq[shared]
        order = np.argsort(cls, kind="stable")
        code, cls, freq = code[order], cls[order], freq[order]
        starts = np.flatnonzero(np.diff(cls, prepend=-1))
        ends = np.append(starts, len(cls))[1:]
        own = cls[starts]
        codes = pa.array([packed(code[a:b], 6) for a, b in zip(starts, ends, strict=True)], pa.binary())
        freqs = pa.array([freq[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
        none = pa.nulls(len(own), pa.int64())
        out.append(pa.table([none, none, pa.array(names[own]), pa.array(sizes[first][own]), codes, freqs], schema=GATHERED_ARROW))
    return pa.concat_tables(out) if out else GATHERED_ARROW.empty_table()


def prefix_length(n: int, unique: int, freq: np.ndarray, threshold: int) -> tuple[int, int]:
    """(matches, tokens): how many prefix tokens of a set of n shingles must be shared, and how many of its shared shingles,
    rare first with frequencies freq, its prefix then holds.

    A partner shares at least need = ceil(threshold * n / 100) shingles, so of the n - need + m first ones at least m. The
    `unique` first ones belong to no other class. Of the m up to MOST_MATCHES the one with the least estimated
    cost is taken: postings to read, plus candidates to verify, at most postings / m. One token more covers a collision
    of two of the set's hashes.
    """
    need = (threshold * n + 99) // 100
    best = (np.inf, 1, 0)
    for m in range(1, min(MOST_MATCHES, need) + 1):
        k = min(len(freq), n - need + m + 1 - unique)
        if n - need + 1 + 1 - unique <= 0 or k <= 0:
            return 1, 0
        read = float(freq[:k].sum())
        best = min(best, (read + VERIFY_COST * read / m, m, k))
    return best[1], best[2]


def parities(code: np.ndarray) -> list[int]:
    """A bitmap of BITMAP_WORDS words: each bit tells whether an odd number of the codes fall on it.

    Two sets' bitmaps differ in at most as many bits as there are codes that only one of the sets holds."""
    bits = np.bincount((mix(code + ODD) >> np.uint64(32)).astype(np.int64) % (64 * BITMAP_WORDS), minlength=64 * BITMAP_WORDS) % 2
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


SIGNED = "cls long, n int, m int, matches int, codes binary, prefix array<long>, bits array<long>, common double"
SIGNED_ARROW = pa.schema([
    ("cls", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("matches", pa.int32()), ("codes", pa.binary()),
    ("prefix", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("common", pa.float64()),
])


def sign(threshold: int):
    def run(group: pa.Table) -> pa.Table:
        """All shared shingles of one class: its prefix, unless it can't have a partner."""
        n = group.column("n")[0].as_py()
        code = np.concatenate([unpacked(c, 6) for c in group.column("codes").to_pylist()])
        freq = np.concatenate([np.frombuffer(f, "<u4") for f in group.column("freqs").to_pylist()])
        order = np.lexsort((code, freq))
        matches, k = prefix_length(n, n - len(code), freq[order], threshold)
        if not k:
            return SIGNED_ARROW.empty_table()
        head = code[order[:k]].astype(np.int64).tolist()
        told = {"cls": group.column("cls")[0].as_py(), "n": n, "m": len(code), "matches": matches, "codes": packed(np.sort(code), 6)}
        return pa.Table.from_pylist([told | {"prefix": head, "bits": parities(code), "common": float(freq.sum()) / n}], schema=SIGNED_ARROW)

    return run


def verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) of classes whose Jaccard similarity is at least threshold / 100, exactly."""

    def run(batches):
        for batch in batches:
            u, v, nu, nv = (batch.column(c).to_pylist() for c in ("u", "v", "nu", "nv"))
            good = []
            for k, (a, b) in enumerate(zip(batch.column("cu").to_pylist(), batch.column("cv").to_pylist(), strict=True)):
                both = len(np.intersect1d(unpacked(a, 6), unpacked(b, 6), assume_unique=True))
                if 100 * both >= threshold * (nu[k] + nv[k] - both):
                    good.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in good], pa.int64()), pa.array([v[k] for k in good], pa.int64())], names=["u", "v"])

    a, b = (sets.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("codes").alias(f"c{x}")) for x in "uv")
    met = pairs.join(a, "u").join(b, "v").where(f"100 * least(nu, nv) >= {threshold} * greatest(nu, nv)")
    return met.select("u", "v", "nu", "nv", "cu", "cv").mapInArrow(run, "u long, v long")


def link_classes(sets: DataFrame, threshold: int, rounds: int = 1, looks: int = 6) -> DataFrame:
    """Components (node, comp) of the classes under all links.

    In the first rounds each class is compared with a few others that share most of its prefix lists' places, so a large group of
    near copies falls together after a few comparisons for each member. Then every candidate pair of classes that are
    not joined yet is counted over the prefix lists and verified; pairs inside a component could add nothing. A pair is
    left out early only where sizes, places or parity bitmaps prove that it is no link.
    """
    listed = sets.select("cls", "common", F.explode("prefix").alias("code"))
    listed = cut(listed)
    comp = None
    by_common = Window.partitionBy("code").orderBy(F.desc("common"), "cls")
    for turn in range(rounds):
        # of each list the class whose shingles are the most common ones (what a group's members were copied from, as edits
        # are rare), the next such one, and those before in an order by hash; of all those that a class meets so, the ones
        # that it meets most often
        by_hash = Window.partitionBy("code").orderBy(F.xxhash64("cls", F.lit(turn)), "cls")
        some = [F.first("cls").over(by_common), F.lag("cls").over(by_common), *(F.lag("cls", k).over(by_hash) for k in (1, 2, 3))]
        near = listed.select("cls", *(c.alias(f"c{k}") for k, c in enumerate(some)))
        each = F.explode(F.array_distinct(F.array(*(f"c{k}" for k in range(len(some))))))
        near = near.select("cls", each.alias("x")).where("x <> cls")
        met = near.groupBy("cls", "x").agg(F.count("*").alias("met"))
        best = Window.partitionBy("cls").orderBy(F.desc("met"), "x")
        pairs = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= looks).select(F.least("cls", "x").alias("u"), F.greatest("cls", "x").alias("v")).distinct()
        if comp is not None:
            a, b = comp.select(F.col("node").alias("u"), F.col("comp").alias("cu")), comp.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
            pairs = pairs.join(a, "u", "left").join(b, "v", "left").where("coalesce(cu, u) <> coalesce(cv, v)").select("u", "v")
        found = cut(verify(pairs, sets, threshold))
        stars = [] if comp is None else [comp.select("node", "comp")]
        comp = cut(components(reduce(DataFrame.union, stars, found)))
    placed = cut(sets.join(comp, sets.cls == comp.node, "left").select("cls", "n", "m", "matches", "prefix", "bits", F.coalesce("comp", "cls").alias("comp")))
    bits = [F.col("bits")[k].alias(f"bits_{k}_") for k in range(BITMAP_WORDS)]
    now = placed.select("cls", "n", "m", "matches", F.size("prefix").alias("p"), "comp", *bits, F.posexplode("prefix").alias("k", "code"))
    # the component with most classes in a list meets only the others there
    by_comp = now.groupBy("code", "comp").agg(F.count("*").alias("many"))
    main = by_comp.groupBy("code").agg(F.max(F.struct("many", "comp"))["comp"].alias("main"), F.count("*").alias("comps")).where("comps > 1").select("code", "main")
    now = now.join(main, "code")
    side = lambda x: [F.col(c).alias(f"{c}{x}") for c in ("cls", "n", "m", "matches", "p", "k", "comp", *(f"bits_{k}_" for k in range(BITMAP_WORDS)))]
    few = now.where("comp <> main").select("code", *side("u"))
    every = now.select("code", *side("v"), (F.col("comp") == F.col("main")).alias("main"))
    # m shingles of a class are shared with any other; k of them come before this one in the common order
    able = f"(100 + {threshold}) * least(mu, mv) >= {threshold} * (nu + nv) and 100 * least(nu, nv) >= {threshold} * greatest(nu, nv)"
    reach = f"(100 + {threshold}) * (least(ku, kv) + 1 + least(mu - ku, mv - kv)) >= {threshold} * (nu + nv)"
    # shingles of only one of the two are at least those that no other class has and the bits in which the bitmaps differ
    apart = " + ".join(f"bit_count(bits_{k}_u ^ bits_{k}_v)" for k in range(BITMAP_WORDS))
    close = f"(100 + {threshold}) * (mu + mv - ({apart})) >= 2 * {threshold} * (nu + nv)"
    met = few.join(every, "code").where(f"compu <> compv and (main or clsu < clsv) and {able} and {reach} and {close}")
    # common shingles that the prefixes don't show lie behind the prefix that ends first
    bound = F.max(F.expr(f"{threshold} * (nu + nv) - (100 + {threshold}) * greatest(mu - pu, mv - pv)")).alias("bound")
    met = met.groupBy(F.least("clsu", "clsv").alias("u"), F.greatest("clsu", "clsv").alias("v")).agg(F.count("*").alias("met"), F.max(F.least("matchesu", "matchesv")).alias("m"), bound)
    met = met.where(f"met >= m and (100 + {threshold}) * met >= bound")
    found = verify(met.select("u", "v"), sets, threshold)
    return components(comp.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(found))


def classes(docs: DataFrame, words: int = 5, threshold: int = 80, bucket_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (doc_id, mark, n, cls), mark a hash of the text, and the components (node, comp) of their classes."""
    marked = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    buckets = bucket_count(input_bytes(docs), bucket_bytes)
    posted = marked.mapInArrow(post(buckets, words), POSTED)
    gathered = cut(dealt(posted, "bucket", buckets).groupBy("bucket").applyInArrow(gather, GATHERED))
    shared = gathered.where("codes is not null")
    # a prefix reaches shared shingles only if the class shares all but one of those that a partner needs
    may = shared.groupBy("cls").agg(F.sum(F.length("freqs") / 4).alias("m"), F.max("n").alias("n"))
    may = may.where(f"m + 1 >= floor(({threshold} * n + 99) / 100)").select("cls")
    sets = cut(shared.join(may, "cls", "left_semi").groupBy("cls").applyInArrow(sign(threshold), SIGNED))
    return gathered.where("codes is null").select("doc_id", "mark", "n", "cls"), cut(link_classes(sets, threshold))


def lowest(rows: DataFrame, comp: DataFrame, first: Column) -> DataFrame:
    """(cls, low) for each class of rows with shingles: the least value of first in its component. Copies are folded into
    their class by partial aggregation before anything is joined."""
    own = rows.where("n > 0").groupBy("cls").agg(F.min(first).alias("own"))
    placed = cut(own.join(comp, F.expr("cls = node"), "left").select("cls", "own", F.coalesce("comp", "cls").alias("comp")))
    low = cut(placed.groupBy("comp").agg(F.min("own").alias("low")))
    return cut(placed.join(low, "comp").select("cls", "low"))  # written first, as then a join on a hot class is split


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Documents link when the Jaccard similarity of their sets of word shingles is threshold / 100 or more. An inverted index is built by
    ranges of shingle hashes; only shingles of two classes or more come back to their class, which then picks its prefix.
    Null and empty texts have no shingles and link with nothing; exact copies are one class and link whatever their number;
    a null doc_id stands for itself alone; rows that repeat a doc_id share it; no rows give no rows. Other columns don't matter.
    """
    rows, comp = classes(docs, words, threshold, **options)
    low = lowest(rows, comp, F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("low"))
    linked = rows.where("n > 0").join(low, "cls").select("doc_id", "n", component.alias("component_id"))
    every = linked.union(rows.where("n = 0").select("doc_id", "n", "doc_id"))
    return every.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, threshold: int = 80, **options) -> DataFrame:
    """docs, with their columns, but of each component of linked texts only one row: that of the smallest doc_id (null last),
    of the least hash of its text among those. Rows are told apart by doc_id and text, so rows that repeat a doc_id with another
    text are documents of their own. Texts without words link with nothing and all stay."""
    rows, comp = classes(docs, words, threshold, **options)
    row = F.struct(F.col("doc_id").isNull().alias("lost"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))
    chosen = lowest(rows, comp, row).select("low.doc_id", "low.mark").distinct()
    own = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark"))
    spoken = F.coalesce(F.col("row.text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = whole.where(spoken).alias("d").join(chosen.alias("k"), F.expr("d.doc_id <=> k.doc_id and d.mark = k.mark"), "left_semi")
    same = Window.partitionBy("doc_id", "mark").orderBy("mark")  # rows alike in both are copies of each other
    kept = kept.withColumn("turn", F.row_number().over(same)).where("turn = 1")
    return kept.select("row").unionByName(whole.where(~spoken).select("row")).select("row.*")
