"""Near duplicates by SetSketch registers.

A document is the set of its word shingles. Register i of its sketch holds, for an own exponential hash h_i of each
shingle, the whole part of 1 - log_b(min h_i), cut to the range of 16 bits: truncated minima on an exponential scale.
Registers of a union are the larger ones of the parts, so sketches merge, and two registers are equal with a
probability near the similarity of the sets. With b close to 1 that holds for sets of any size.

1. Documents with equal sets are one class; what follows sees classes.
2. BANDS bands of ROWS registers each: classes that agree in a band are candidates. A pair at the limit of 0.75 agrees
   in none of 32 bands of 4 with a probability of 5e-6.
3. In each band's bucket every class is held against the smallest one; the similarity of a pair comes from the
   numbers of greater, equal and smaller registers by maximum likelihood. Classes that fall short are held against all
   of the bucket, in blocks of BLOCK x BLOCK, of which only a spanning forest of likely pairs leaves the task. Likely
   pairs (MARGIN below the limit) make coarse clusters: a true pair's ends are in the same one.
4. Within coarse clusters, full shingle sets are made again from the texts and pairs are counted exactly, in blocks of
   bounded weight; again a spanning forest of true pairs leaves the task. In a cluster of more than one block, all
   classes are held against PIVOTS of them first, and only those that this leaves outside the largest part against all.
5. Connected components of the true pairs, by rounds of star operations.
Buckets and clusters are cut to blocks, copies of a hot set are broadcast to; pairs don't leave a block, and none is left
out. What grows faster than its group is the number of blocks where many classes neither match the head, or any pivot, nor
have a match among themselves: classes outside times classes, the exact way that is left.

Cases: a null text, or one without words, has the empty set: linked with nothing, its own component. Repeated rows have
equal sets, so they are one group, and each row gets a result. A null id stays null; its component is the smallest id
that isn't null, or null if there is none. Other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import cut, in_slices, light, map_arrow, map_pandas, shingle_hashes, stored, text_of
from peakloom.llm.graph import components

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
MARGIN = 0.15
BLOCK = 512
#: The most shingles of a side of a block in the exact step.
WEIGHT = 400_000
#: Classes of a large cluster that all of it is held against first, and the most bytes of their sets that are broadcast.
PIVOTS, PIVOT_BYTES = 6, 16_000_000
#: The share of all documents from which a set's copies count as hot.
HOT_SHARE = 1e-4

_RNG = np.random.default_rng(51)
_MULTIPLY = _RNG.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_BAND_MIX = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """REGISTERS registers of a set of 64-bit hashes. Minima are taken of uniform 32-bit values first: logarithms keep
    their order, so one logarithm a register will do."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        h = x[k : k + 1024, None] * _MULTIPLY
        h += _ADD
        # the low bits of a product depend on few bits of its factor, the high ones on all
        np.minimum(low, h.min(axis=0), out=low)
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def bands(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    mixed = (registers.astype(np.uint64) + np.uint64(1)) * _BAND_MIX
    key = mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) ^ (np.arange(BANDS, dtype=np.uint64) << np.uint64(58))
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (key ^ (key >> np.uint64(27))).astype(np.int64)


def likely_similarity(greater: np.ndarray, equal: np.ndarray, smaller: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of greatest likelihood, from the numbers of registers of a that are greater than, equal
    to and smaller than b's, given the set sizes. With base near 1 a register is decided by the least shingle of the
    union: it lies in a only, in both or in b only, so the counts are multinomial with shares u - v J, J and v - u J,
    where u and v are the sizes' shares (u + v = 1 after scaling by 1 + J). The root is found by halving."""
    u = size_a / (size_a + size_b)
    v = 1 - u
    low = np.zeros_like(u)
    high = np.minimum(u / v, v / u)
    for _ in range(24):
        j = (low + high) / 2
        # log-likelihood: g log(u - v j) + e log(j) + s log(v - u j), constant of scaling: p = (u (1 + j) - j) etc.
        a, b = u * (1 + j) - j, v * (1 + j) - j
        slope = greater * (u - 1) / np.maximum(a, 1e-12) + equal / np.maximum(j, 1e-12) + smaller * (v - 1) / np.maximum(b, 1e-12)
        up = slope > 0
        low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_id (a 64-bit hash of the whole set, null if empty), registers (binary), bands."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_id long, registers binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            n, ids, regs, keys = [], [], [], []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingle_hashes(data, size)
                n.append(len(s))
                if len(s):
                    own = sketch(s)
                    ids.append(set_hash(s))
                    regs.append(own.tobytes())
                    keys.append(bands(own))
                else:
                    ids.append(None)
                    regs.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_id", "registers", "bands"],
            )

    return map_arrow(rows, run, schema)


def set_hash(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set of 64-bit hashes."""
    x = (shingles ^ (shingles >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return int(np.int64(np.uint64((int(x.sum(dtype=np.uint64)) * 0xD6E8FEB86659FD93 + len(shingles)) & (2**64 - 1))))


def against_open(rows: DataFrame, unique: str) -> DataFrame:
    """Copies rows so that each open row of a key meets all rows of the key. rows: open (boolean), chunks (blocks of the
    key's rows) and open_chunks (of its open ones). A key of one block is that block; else all rows are dealt to its
    chunks and open ones to open chunks, by a hash of unique, and each pair of chunks is a block. Adds lo and hi."""
    one = rows.where("chunks = 1").withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(0).cast("long")})
    many = rows.where("chunks > 1 and open_chunks > 0")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    every = many.withColumn("hi", F.pmod(F.xxhash64(unique), F.col("chunks"))).withColumn("lo", upto("open_chunks"))
    opened = many.where("open").withColumn("lo", F.pmod(F.xxhash64(unique, F.lit(1)), F.col("open_chunks"))).withColumn("hi", upto("chunks"))
    return one.unionByName(every).unionByName(opened)


def each_block(rows: DataFrame, key: str, work: Callable[[pd.DataFrame], list[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) that work gives for the rows of each block. Tasks take sorted blocks one after the other, which
    costs a small block far less than a call of its own."""
    columns = [key, "lo", "hi"]
    dealt = rows.repartition(*[F.col(c) for c in columns]).sortWithinPartitions(*columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            if rest is not None:
                frame = pd.concat((rest, frame), ignore_index=True)
            if not len(frame):
                continue
            marks = frame[columns].to_numpy()
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            bounds = [0, *edges.tolist()]
            out = [e for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1 for e in work(frame.iloc[a:b])]
            rest = frame.iloc[bounds[-1] :]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if rest is not None and len(rest) > 1:
            out = work(rest)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return map_pandas(dealt, run, "a long, b long")


def forest(pairs_a: np.ndarray, pairs_b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of pairs of numbers below n, those that join parts which earlier ones left apart."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
            if len(out) == n - 1:
                break
    return out


def _likely_pairs(block: pd.DataFrame, limit: float) -> list[tuple[int, int]]:
    """A spanning forest of the block's pairs whose likely similarity reaches limit."""
    block = block.drop_duplicates("set_id")
    ids, sizes = block["set_id"].to_numpy(), block["n"].to_numpy().astype(np.float64)
    regs = np.stack([np.frombuffer(x, np.uint16) for x in block["registers"]])
    found = []
    for i in range(len(ids) - 1):
        equal = (regs[i + 1 :] == regs[i]).sum(axis=1)
        near = np.flatnonzero(equal >= REGISTERS * (limit - 0.2))
        if len(near):
            found.append((np.full(len(near), i), near + i + 1, equal[near]))
    if not found:
        return []
    a, b, equal = (np.concatenate(x) for x in zip(*found, strict=True))
    # pairs that agree in a share of limit are likely as they are; of the others those count that would join parts
    sure = equal >= REGISTERS * limit
    edges = np.array(forest(a[sure], b[sure], len(ids)), np.int64).reshape(-1, 2)
    part = np.arange(len(ids))
    for x, y in edges:
        part[part == part[y]] = part[x]
    open_ = ~sure & (part[a] != part[b])
    a, b, equal = a[open_], b[open_], equal[open_]
    if len(a):
        greater = np.concatenate([(regs[a[k : k + 4096]] > regs[b[k : k + 4096]]).sum(axis=1) for k in range(0, len(a), 4096)])
        hit = likely_similarity(greater, equal, REGISTERS - equal - greater, sizes[a], sizes[b]) >= limit
        edges = np.array(forest(np.append(edges[:, 0], a[hit]), np.append(edges[:, 1], b[hit]), len(ids)), np.int64).reshape(-1, 2)
    return [(int(ids[x]), int(ids[y])) for x, y in edges]


def _true_pairs(block: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the block's pairs with 100 * intersection >= percent * union, by counting shared shingles:
    those that one set alone has are left out, the others are columns of a matrix of which products are counts."""
    block = block.drop_duplicates("set_id")
    ids = block["set_id"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in block["shingles"]]
    sizes = np.array([len(s) for s in sets])
    if len(ids) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(ids[0]), int(ids[1]))] if 100 * common >= percent * (sizes.sum() - common) else []
    if len(ids) < 2:
        return []
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[place] > 1
    owner, place = owner[shared], np.unique(place[shared], return_inverse=True)[1]
    counts = np.zeros((len(ids), len(ids)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = max(1, 8_000_000 // len(ids))
    top = int(place[-1]) + 1 if len(place) else 0
    for k in range(0, top, width):
        a, b = np.searchsorted(place, (k, k + width))
        m = np.zeros((len(ids), min(width, top - k)), np.float32)
        m[owner[a:b], place[a:b] - k] = 1
        counts += m @ m.T
    hits = np.triu(100 * counts >= percent * (sizes[:, None] + sizes[None, :] - counts), 1)
    return [(int(ids[a]), int(ids[b])) for a, b in forest(*np.nonzero(hits), len(ids))]


def _estimated(pairs: DataFrame, limit: float) -> DataFrame:
    """Adds likely (the estimate reaches limit) to rows (a, b, ra, rb, na, nb); keeps a and b."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack([np.frombuffer(r, np.uint16) for r in f["ra"]])
                y = np.stack([np.frombuffer(r, np.uint16) for r in f["rb"]])
                g, e = (x > y).sum(axis=1), (x == y).sum(axis=1)
                j = likely_similarity(g, e, REGISTERS - g - e, f["na"].to_numpy(np.float64), f["nb"].to_numpy(np.float64))
                yield pd.DataFrame({"a": f["a"], "b": f["b"], "likely": j >= limit})

    return map_pandas(pairs, run, "a long, b long, likely boolean")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    sets = stored(document_sets(docs, id_col, text_col, size))
    found = set_components(docs, sets, id_col, text_col, percent, size)
    classes = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("members"))
    linked = classes.join(found, classes["set_id"] == found["node"])
    firsts = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(firsts, "root").select(F.col("set_id").alias("__set"), F.col("least").alias("__least"))
    whole = classes.join(linked, classes["set_id"] == F.col("__set"), "left").select(F.col("set_id").alias("__id"), F.coalesce("__least", "first").alias("__component"), "members")
    return _with_components(sets.select("doc_id", "n_shingles", "set_id"), cut(whole))


def _with_components(sets: DataFrame, whole: DataFrame) -> DataFrame:
    """The result for the documents' sets (doc_id, n_shingles, set_id), given the component of each set (__id, __component,
    members). Sets with a HOT_SHARE of all documents or more, of which there are 1 / HOT_SHARE at most, are broadcast, so
    that no task gets all copies of one."""
    hot = F.col("members") >= F.lit(max(1, int(sets.count() * HOT_SHARE)))
    on = F.col("set_id") == F.col("__id")
    known = sets.where("set_id is not null").join(F.broadcast(whole.where(hot)), on, "left")
    rest = known.where("__id is null").select("doc_id", "n_shingles", "set_id").join(whole.where(~hot), on)
    empty = sets.where("set_id is null").withColumn("__component", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "__component"]
    out = known.where("__id is not null").select(columns).unionByName(rest.select(columns)).unionByName(empty.select(columns))
    return out.select("doc_id", "n_shingles", F.col("__component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("__component")).alias("kept"))


def set_components(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> DataFrame:
    """(node, root) over set ids, for sets that are linked with others."""
    limit = percent / 100 - MARGIN
    own = sets.where("set_id is not null").groupBy("set_id").agg(F.first("registers").alias("registers"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    own = stored(own)
    small = own.select("set_id", "registers", "n")
    # 2. buckets of at least two classes
    rows = own.select("set_id", F.explode("bands").alias("band"))
    heads = rows.groupBy("band").agg(F.count("*").alias("members"), F.min("set_id").alias("head")).where("members > 1")
    member = cut(rows.join(heads, "band"))
    # 3. each class against its bucket's smallest one
    stars = member.where("set_id <> head").select(F.col("set_id").alias("a"), F.col("head").alias("b")).distinct()
    left = small.toDF("a", "ra", "na")
    right = small.toDF("b", "rb", "nb")
    judged = cut(_estimated(stars.join(left, "a").join(right, "b"), limit))
    short = judged.where("not likely").select(F.col("a").alias("set_id"), F.col("b").alias("head"))
    opened = cut(member.where("members > 2").join(short, ["set_id", "head"], "left_semi").select("band", "set_id", F.lit(True).alias("open")))
    counts = opened.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("open_chunks"))
    rows = member.join(counts, "band").join(opened, ["band", "set_id"], "left").join(small, "set_id")
    rows = rows.select("band", "set_id", "n", "registers", F.coalesce("open", F.lit(False)).alias("open"), F.ceil(F.col("members") / BLOCK).alias("chunks"), "open_chunks")
    blocks = against_open(rows, "set_id").select("band", "lo", "hi", "set_id", "n", "registers")
    more = each_block(blocks, "band", lambda block: _likely_pairs(block, limit))
    coarse = components(judged.where("likely").select("a", "b").union(more))
    # 4. full sets of the classes in coarse clusters
    weights = coarse.join(small.select("set_id", "n"), coarse["node"] == F.col("set_id")).select("node", "root", "n")
    total = weights.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / WEIGHT)).alias("chunks"))
    one = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    wanted = weights.join(total, "root")
    wanted = cut(wanted.join(one, wanted["node"] == one["set_id"]).select("node", "root", "chunks", "first"))
    ready = wanted.where("chunks = 1").withColumns({"open": F.lit(True), "open_chunks": F.lit(1).cast("long")})
    full = lambda nodes: shingle_sets(docs, nodes.select("node", "first"), id_col, text_col, size)
    large = wanted.where("chunks > 1")
    edges = None
    if not large.isEmpty():
        sets_of = stored(full(large))
        edges = cut(_pivot_edges(large, sets_of, percent))
        outside = _outside(large, edges)
        blocks = against_open(outside.join(sets_of, outside["node"] == sets_of["set_id"]), "node").select("root", "lo", "hi", "set_id", "shingles")
        edges = edges.select("a", "b").union(each_block(blocks, "root", lambda block: _true_pairs(block, percent)))
    small_sets = full(ready)
    blocks = against_open(ready.join(small_sets, ready["node"] == small_sets["set_id"]), "node").select("root", "lo", "hi", "set_id", "shingles")
    found = each_block(blocks, "root", lambda block: _true_pairs(block, percent))
    return components(cut(found if edges is None else found.union(edges)))


def _pivot_edges(large: DataFrame, sets_of: DataFrame, percent: int) -> DataFrame:
    """Edges (root, a, b) between classes of large (node, root) and PIVOTS of their cluster, the ones of least hashes,
    counted exactly. The pivots' sets are broadcast if they take at most PIVOT_BYTES in all."""
    least = [F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(PIVOTS)]
    pivots = large.groupBy("root").agg(F.array_distinct(F.array(*least)).alias("p")).select(F.col("root").alias("__root"), F.explode("p").alias("pivot"))
    pivots = cut(pivots.join(sets_of.toDF("__id", "other"), F.col("pivot") == F.col("__id")).select("__root", "pivot", "other"))
    weight = pivots.agg(F.sum(F.length("other"))).first()[0] or 0
    members = large.select("node", "root").join(sets_of, F.col("node") == F.col("set_id")).select("node", "root", "shingles")
    pairs = members.join(F.broadcast(pivots) if weight <= PIVOT_BYTES else pivots, F.col("root") == F.col("__root")).where("node <> pivot").select("root", "node", "pivot", "shingles", "other")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for root, a, b, x, y in zip(f["root"], f["node"], f["pivot"], f["shingles"], f["other"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((root, a, b))
            yield pd.DataFrame(out, columns=["root", "a", "b"], dtype="int64")

    return map_pandas(pairs, run, "root long, a long, b long")


def _outside(large: DataFrame, edges: DataFrame) -> DataFrame:
    """The classes of large with open: whether they are neither the pivot with most edges of their cluster, nor joined to it,
    nor to a pivot that is; and open_chunks. Clusters without such classes are left out."""
    main = edges.groupBy("root", "b").count().groupBy("root").agg(F.max(F.struct("count", "b"))["b"].alias("main"))
    # a pivot's edges with pivots are there both ways
    near = edges.join(main, "root").where("b = main").select("root", F.col("a").alias("b")).union(main.select("root", F.col("main").alias("b")))
    joined = edges.join(near, ["root", "b"], "left_semi").select(F.col("a").alias("node")).union(main.select("main")).distinct().withColumn("joined", F.lit(True))
    marked = cut(large.join(joined, "node", "left").select("node", "root", "chunks", F.col("joined").isNull().alias("open")))
    counts = marked.where("open").groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("open_chunks"))
    return marked.join(counts, "root").select("node", "root", "chunks", "open", "open_chunks")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """set_id, shingles (binary) of the wanted classes (node, first: an id of a document that has the set). Ids may
    repeat, or be null, so a class can come more than once or be found by its set only."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    firsts = light(cut(wanted.select(F.col("first").alias("__first")).distinct()))
    found = rows.join(firsts, F.col("id").eqNullSafe(F.col("__first")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids, out = [], []
            for data in batch.column(0).cast(pa.binary()).to_pylist():
                s = shingle_hashes(data, size)
                if len(s):
                    ids.append(set_hash(s))
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["set_id", "shingles"])

    return map_arrow(found, run, "set_id long, shingles binary")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each group of copies and near copies (the one with the smallest id, nulls last, and one of
    those if the id repeats), and each row that has no words, with their columns as they were."""
    plain = [f"__c{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, plain, strict=True))
    rows = stored(docs.toDF(*plain).withColumn("__row", F.monotonically_increasing_id()))
    groups = near_duplicates(rows, "__row", names[text_col]).select(F.col("doc_id").alias("__member"), "component_id")
    ids = rows.select("__row", F.col(names[id_col]).alias("__id")).join(groups, F.col("__row") == F.col("__member"))
    first = F.min(F.struct(F.col("__id").isNull(), "__id", "__row")).alias("first")
    ids = cut(ids)
    kept = ids.groupBy("component_id").agg(first, F.count("*").alias("members")).where("members > 1")
    dropped = ids.join(light(cut(kept)), "component_id").where(F.col("__row") != F.col("first.__row")).select(F.col("__row").alias("__dropped"))
    return rows.join(light(cut(dropped)), F.col("__row") == F.col("__dropped"), "left_anti").select(*plain).toDF(*docs.columns)
