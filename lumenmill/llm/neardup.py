"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots), no two of them close, are drawn from the vectors; each
vector is described by its nearest pivots. An inverted list per pivot holds the
vectors that name it. Two vectors are candidates if their descriptions share at
least ``SHARED`` pivots; a candidate pair is verified by cosine in double
precision. The number of pivots grows with the square root of the number of
vectors, up to a bound (their matrix is sent to all tasks).

Pivots are ranked by the lengths of their lists, rare ones first. Of k pivots a
vector enters the lists of its k - SHARED + 1 rarest only: two descriptions that
share SHARED pivots have the rarest of these in both. In a list the numbers of
shared pivots are counted first (bounded from above by bitmaps, then exactly, for
pairs whose rarest shared pivot is the list's own); only pairs with enough of
them are verified.

Equal vectors are one class with a weight, so copies cost nothing. A list too
long for one task is cut into blocks, and every pair of its blocks is one task.
Tasks send a weight per vector and a spanning forest of their links, never all
pairs.

Cases: null, empty or zero vectors and those with null or non-finite
components link with nothing and are kept; vectors of different lengths don't
link; repeated rows are copies; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, trim
from .components import components, spanning_pairs
from .vectors import component, packed, stacked, unit

THRESHOLD = 0.9
#: Pivots of a description, and how many a pair must share.
NEAREST, SHARED = 10, 4
#: Pivots per square root of the number of vectors; bounds of their number.
DENSITY, FEWEST, MOST = 3.0, 32, 16_384
#: Pivots are farther from each other than this cosine.
APART = 0.7
#: Vectors of a list in one block, and of one product.
BLOCK, TILE = 8192, 512


def choose_pivots(classes: DataFrame, total: int, width: int, kind: type = np.float64) -> np.ndarray:
    """Unit vectors drawn by their digest: the same ones in every run."""
    wanted = int(np.clip(DENSITY * total**0.5, FEWEST, MOST))
    u = F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) / float(1 << 30)
    found = classes.select("digest", "v", u.alias("u")).filter(F.col("u") < min(1.0, 1.5 * wanted / max(1, total))).orderBy("u", "digest").limit(wanted).toPandas()
    return apart(unit(stacked(list(found["v"]), width, kind)).astype(np.float32))


def apart(x: np.ndarray, most: float = APART) -> np.ndarray:
    """The rows, less those too near an earlier one: a dense group gets one pivot, so its members' descriptions agree."""
    kept = x[:1]
    for s in range(1, len(x), 512):
        block = x[s : s + 512]
        block = block[(block @ kept.T).max(axis=1) < most]
        near = block @ block.T >= most
        chosen: list[int] = []
        for i in range(len(block)):
            if not near[i, chosen].any():
                chosen.append(i)
        kept = np.vstack([kept, block[chosen]])
    return kept


def describe(classes: DataFrame, pivots: np.ndarray, width: int, kind: type = np.float64) -> DataFrame:
    """(rep, weight, v, near): the numbers of the nearest pivots, nearest first."""

    def run(batches):
        k = min(NEAREST, len(pivots))
        for b in batches:
            x = unit(stacked(b.column(2).to_pylist(), width, kind)).astype(np.float32)
            near = []
            for s in range(0, len(x), TILE):
                cosine = x[s : s + TILE] @ pivots.T
                part = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
                order = np.argsort(-np.take_along_axis(cosine, part, 1), axis=1, kind="stable")
                near += list(np.take_along_axis(part, order, 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(near, pa.list_(pa.int32()))], ["rep", "weight", "v", "near"])

    return classes.select("rep", "weight", "v").mapInArrow(run, "rep long, weight long, v binary, near array<int>")


def _listed(rank: np.ndarray, shared: int):
    """Adds the lists that a vector enters; pivots are renamed by rank, rare ones first."""

    def run(batches):
        for b in batches:
            near = [np.sort(rank[np.array(x)]) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(near, pa.list_(pa.int32())), pa.array([x[: len(x) - shared + 1] for x in near], pa.list_(pa.int32()))], ["rep", "weight", "v", "near", "lists"])

    return run


def _bitmaps(near: np.ndarray) -> np.ndarray:
    """256 bits of each description: no two share more pivots than bits."""
    held = np.zeros((len(near), 256), np.uint8)
    row, k = np.nonzero(near >= 0)
    held[row, near[row, k] & 255] = 1
    return np.packbits(held, axis=1).view(np.uint64)


def _linked(width: int, threshold: float, shared: int, kind: type = np.float64):
    """For one list or pair of blocks: links' weights by vector, and a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        pivot, first, second = (table.column(c)[0].as_py() for c in ("pivot", "p", "q"))
        rep, weight, block = (table.column(c).to_numpy() for c in ("rep", "weight", "block"))
        order = np.argsort(rep, kind="stable")
        rep, weight, block = rep[order], weight[order], block[order]
        raw = table.column("v").to_pylist()
        raw = [raw[k] for k in order]
        sizes = np.array([len(v) for v in raw])
        x = unit(stacked(raw, width, kind))
        near = np.full((len(rep), NEAREST), -1, np.int32)
        for i, k in enumerate(order.tolist()):
            own = table.column("near")[k].as_py()
            near[i, : len(own)] = own
        bits = _bitmaps(near)
        lost = (near >= 0).sum(axis=1) - np.bitwise_count(bits).sum(axis=1)
        total = np.zeros(len(rep), np.int64)
        tree, ones, others = np.arange(len(rep)), [], []
        for s in range(0, len(rep), TILE):
            for t in range(s, len(rep), TILE):
                most = np.zeros((len(bits[s : s + TILE]), len(bits[t : t + TILE])), np.uint8)
                for k in range(4):
                    most += np.bitwise_count(bits[s : s + TILE, None, k] & bits[None, t : t + TILE, k])
                most = most + np.minimum(lost[s : s + TILE, None], lost[None, t : t + TILE])
                i, j = np.nonzero(most >= shared)
                i, j = i + s, j + t
                some = (i < j) & (sizes[i] == sizes[j])
                if first != second:
                    some &= block[i] != block[j]
                i, j = i[some], j[some]
                for c in range(0, len(i), 1 << 17):
                    a, b = i[c : c + (1 << 17)], j[c : c + (1 << 17)]
                    same = (near[a][:, :, None] == near[b][:, None, :]).any(axis=2) & (near[a] >= 0)
                    least = np.where(same, near[a], np.iinfo(np.int32).max).min(axis=1)
                    able = (same.sum(axis=1) >= shared) & (least == pivot)
                    a, b = a[able], b[able]
                    true = np.einsum("nd,nd->n", x[a], x[b]) >= threshold
                    a, b = a[true], b[true]
                    np.add.at(total, a, weight[b])
                    np.add.at(total, b, weight[a])
                    joined = spanning_pairs(tree, a, b)
                    ones += joined[:, 0].tolist()
                    others += joined[:, 1].tolist()
        trim()
        some = np.flatnonzero(total)
        ids = np.concatenate([rep[some], rep[ones] if ones else rep[:0]])
        to = np.concatenate([rep[some], rep[others] if others else rep[:0]])
        links = np.concatenate([total[some], np.zeros(len(ones), np.int64)])
        return pa.table({"a": pa.array(ids, pa.int64()), "b": pa.array(to, pa.int64()), "links": pa.array(links, pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: direct links, component, and whether it is its component's first."""
    scratch = Scratch(vectors.sparkSession, "neardup")
    rows = scratch.keep(packed(vectors, id_col, vector_col), "vectors")
    usable = rows.filter("v is not null")
    sizes = usable.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = scratch.keep(usable.join(sizes, "digest").filter(F.col("vec_id").eqNullSafe(F.col("rep"))).dropDuplicates(["digest"]).select("digest", "rep", "weight", "v"), "classes")
    found = classes.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    kind = component(vectors, vector_col)
    total, width = found[0], max(1, (found[1] or 0) // np.dtype(kind).itemsize)
    # classes whose ids are all null have no name to link by
    named = classes.filter("rep is not null")
    if total > 1:
        pivots = choose_pivots(named, total, width, kind)
        shared = min(SHARED, len(pivots))
        described = scratch.keep(describe(named, pivots, width, kind), "described")
        # at most MOST counts come to the driver
        named_by = np.zeros(len(pivots), np.int64)
        for r in described.select(F.explode("near").alias("pivot")).groupBy("pivot").count().collect():
            named_by[r["pivot"]] = r["count"]
        rank = np.empty(len(pivots), np.int32)
        rank[np.argsort(named_by, kind="stable")] = np.arange(len(pivots))
        listed = described.mapInArrow(frugal(_listed(rank, shared)), "rep long, weight long, v binary, near array<int>, lists array<int>").withColumn("pivot", F.explode("lists")).drop("lists")
        length = listed.groupBy("pivot").count().filter(f"count > {BLOCK}").select("pivot", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        listed = listed.join(F.broadcast(length), "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # a row for each pivot at most
        listed = listed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        paired = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("pivot", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "rep", "weight", "v", "near")
        links = scratch.keep(paired.groupBy("pivot", "p", "q").applyInArrow(_linked(width, threshold, shared, kind), "a long, b long, links long"), "links")
    else:
        links = vectors.sparkSession.createDataFrame([], "a long, b long, links long")
    degree = links.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    member = components(links.filter("a <> b").select("a", "b"), scratch).withColumnRenamed("node", "rep")
    named = sizes.join(degree, "rep", "left").join(member, "rep", "left").select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "digest").join(named, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
