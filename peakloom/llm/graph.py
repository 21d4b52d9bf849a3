"""Connected components of an edge table, by rounds of star operations, and by one task once few edges are left."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import LIGHT_ROWS, cut, map_pandas


#: The most edges that one task joins; their nodes take some 50 MB.
LOCAL_ROWS = 200_000


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all edges of a task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for f in frames:
        for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for k in range(0, len(nodes), 10_000):
        some = nodes[k : k + 10_000]
        yield pd.DataFrame({"node": some, "root": [root(x) for x in some]}, dtype="int64")


def components(edges: DataFrame, most_rounds: int = 60, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(node, root) for each node of edges (a, b: long, any order, repeats allowed); root is the smallest node of the
    component. A round joins, at each node, its larger neighbours to its smallest one, then its smaller neighbours to
    its smallest one; the rounds end when the edges no longer change, which takes about the logarithm of the longest
    path. Once there are at most local_rows edges, one task joins what is left, instead of jobs of mostly empty tasks for
    each round, whose plans and task states the driver would hold. The smallest neighbours are kept apart from the edges,
    so that a join at the centre of a large star is a broadcast, or one whose skewed side Spark can split. Every round is
    kept in the shared folder. Self loops are dropped; a null end drops the edge."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, n = None, e.count()
    for _ in range(most_rounds):
        if n <= local_rows:
            return cut(map_pandas(e.coalesce(1), _joined, "node long, root long"))
        # a round's tables of smallest neighbours have two rows an edge at most, which says whether they are small
        small_side = F.broadcast if 2 * n <= LIGHT_ROWS else lambda df: df
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = small_side(cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        # now a > b in every row: to each node's smallest neighbour
        low = small_side(cut(large.groupBy("a").agg(F.min("b").alias("m"))))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = cut(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("the components didn't settle")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return cut(roots.union(e.select("b", "b")).distinct())
