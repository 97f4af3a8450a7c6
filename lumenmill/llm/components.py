"""Connected components of an edge table, by alternating stars.

Large-star and small-star rounds (Kiveris et al. 2014) rewrite the edges until
every node points at the smallest node it reaches. A round is two aggregations
with map-side minima and two joins, so a node with very many edges is never
gathered in one task. Edges go to a scratch table after each round: lineage
stays short and a lost executor costs a retry. Rounds go on until one changes
nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def spanning(link: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """A spanning forest (rows a, b) of the edges that a matrix of ``left`` by ``right`` tells, between n nodes."""
    tree, out = np.arange(n), []
    for i, row in zip(left.tolist(), link, strict=True):
        reached = right[row]
        trees, first = np.unique(tree[reached], return_index=True)
        other = trees != tree[i]
        if other.any():
            out += [(i, int(j)) for j in reached[first[other]]]
            tree[np.isin(tree, trees[other])] = tree[i]
    return np.array(out, np.int64).reshape(-1, 2)


def spanning_pairs(tree: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the edges a - b those that join two trees, in turn; ``tree`` names each node's tree and is brought up to date."""
    out = []
    while len(a):
        # an edge for each pair of trees, then those joined in turn
        apart = tree[a] != tree[b]
        a, b = a[apart], b[apart]
        _, first = np.unique(np.stack([tree[a], tree[b]], 1), axis=0, return_index=True)
        a, b = a[first], b[first]
        for x, y in zip(a[:64].tolist(), b[:64].tolist(), strict=True):
            if tree[x] != tree[y]:
                out.append((x, y))
                tree[tree == tree[y]] = tree[x]
        a, b = a[64:], b[64:]
    return np.array(out, np.int64).reshape(-1, 2)


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    return r[0], r[1]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) to (node, component): each node and the smallest that it reaches."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.keep(e, "edges-0")
    seen, k = _state(e), 0
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        k += 1
        e = scratch.keep(small, f"edges-{k}")
        now = _state(e)
        scratch.drop(f"edges-{k - 1}")
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
