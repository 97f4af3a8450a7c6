"""Nearest neighbours by multi-index hashing.

Vectors become binary codes by learned rotations (iterative quantisation,
several rotations with their own starts). A code is cut into 8-bit substrings;
each has an inverted index from value to rows. Two codes within Hamming radius
r = 32 a + b agree in one of the first b + 1 substrings within a bits, or in a
later one within a - 1, so probing each substring's ball retrieves every code
within r. Candidates within r are reranked by cosine in double precision.

A query starts with a small radius; where that gives enough candidates, the next is
the one that holds nearly all vectors as near as the worst of its best: bits differ
in proportion to the angle, and the excess over this proportion that nearly all true neighbours of
a bounded sample keep within is measured. So a query with close neighbours probes
little, and the largest radius is that of nearly all the sample's neighbours,
unless candidates are too few. Rows and queries are cut into blocks of fixed size; a task
holds one block of each, and every row is indexed.

Cases: null, empty or zero vectors and those with null or non-finite components
take no part, nor do vectors of another length than the query; rows that repeat
an id are one candidate and one query, with the best of their scores; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, trim
from .vectors import component, packed, stacked, unit

#: Bits of a code (a whole number of rotations), bound of the learning sample and of its queries.
BITS, SAMPLE, PROBES = 256, 20_000, 400
#: Share of the sample's true neighbours that the radius holds.
HELD = 0.985
ROWS, QUERIES = 16_384, 4096
ROUNDS = 20
#: The first radius that is tried.
FIRST = 32


@functools.cache
def byte_distance() -> np.ndarray:
    v = np.arange(256, dtype=np.uint8)
    return np.bitwise_count(v[:, None] ^ v[None, :])


def learn(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the rotations, side by side (width x bits)."""
    rng, mean, width = np.random.default_rng(seed), x.mean(axis=0), x.shape[1]
    centred = x - mean
    turns = []
    for _ in range(-(-BITS // width)):
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(centred @ r >= 0, 1.0, -1.0).T @ centred)
            r = (u @ v).T
        turns.append(r)
    return mean, np.hstack(turns)[:, : max(BITS, 64)]


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    bits = (x - mean) @ turn >= 0
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1)


def distances(codes: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ one.view(np.uint64)).sum(axis=1)


def calibrate(x: np.ndarray, codes: np.ndarray, k: int) -> tuple[int, float]:
    """The Hamming radius that holds the share HELD of the sample's true neighbours, and the share's excess over the angle's bits."""
    found, excess = [], []
    for q in range(0, len(x), max(1, len(x) // PROBES)):
        cosine = x @ x[q]
        cosine[q] = -2
        best = np.argsort(-cosine, kind="stable")[: min(k, len(x) - 1)]
        far = distances(codes[best], codes[q : q + 1])
        found.append(far)
        excess.append(far - angle_bits(cosine[best], codes.shape[1] * 8))
    found = np.concatenate(found) if found else np.zeros(0)
    if not len(found):
        return 0, 0.0
    return int(np.quantile(found, HELD, method="higher")), float(np.quantile(np.concatenate(excess), HELD))


def angle_bits(cosine, bits: int):
    """Bits in which codes differ on average, in proportion to the angle."""
    return bits * np.arccos(np.clip(cosine, -1, 1)) / np.pi


class Index:
    """The inverted substring indexes of one block of codes, as bitmaps of rows."""

    def __init__(self, codes: np.ndarray):
        self.codes, n, m = codes, *codes.shape
        own = np.zeros((m, 256, -(-n // 8)), np.uint8)
        bit = (128 >> (np.arange(n) & 7)).astype(np.uint8)
        for j in range(m):
            np.bitwise_or.at(own[j], (codes[:, j], np.arange(n) >> 3), bit)
        self.own = own
        self.balls: dict[tuple[int, int, int], np.ndarray] = {}

    def ball(self, j: int, value: int, radius: int) -> np.ndarray:
        """Rows whose j-th substring is within the radius of a value; remembered while the index lives."""
        found = self.balls.get((j, value, radius))
        if found is None:
            found = np.bitwise_or.reduce(self.own[j][byte_distance()[value] <= radius], axis=0) if radius >= 0 else np.zeros(self.own.shape[2], np.uint8)
            self.balls[j, value, radius] = found
        return found

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes within the radius: pigeonhole probes, then exact distances."""
        n, m = self.codes.shape
        a, b = divmod(radius, m)
        hit = np.zeros(self.own.shape[2], np.uint8)
        for j in range(m):
            hit |= self.ball(j, int(code[j]), a if j <= b else a - 1)
        rows = np.flatnonzero(np.unpackbits(hit, count=n))
        return rows[distances(self.codes[rows], code[None]) <= radius]


def _searched(width: int, k: int, radius: int, excess: float, mean: np.ndarray, turn: np.ndarray, kind: type):
    names = ["query_id", "vec_id", "score"]

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("vec_id").to_numpy()
        raw = table.column("v").to_pylist()
        sizes = np.array([len(v) for v in raw])
        x = unit(stacked(raw, width, kind))
        codes = encode(x, mean, turn)
        row, query = np.flatnonzero(~asks), np.flatnonzero(asks)
        out: list[list] = [[], [], []]
        if len(row) and len(query):
            index = Index(np.ascontiguousarray(codes[row]))
            for q in query.tolist():
                able = np.unique(ids[row[(ids[row] != ids[q]) & (sizes[row] == sizes[q])]])
                r = min(radius, FIRST)
                while True:
                    found = row[index.within(codes[q], r)]
                    found = found[(ids[found] != ids[q]) & (sizes[found] == sizes[q])]
                    score = x[found] @ x[q]
                    met = len(np.unique(ids[found]))
                    if met >= min(k, len(able)):
                        if r >= radius or met == len(able):
                            break
                        worst = np.partition(score, len(score) - k)[-k]
                        if r >= (needed := angle_bits(worst, codes.shape[1] * 8) + excess):
                            break
                        r = min(radius, int(np.ceil(needed)))
                    else:
                        r = radius if r < radius else r + 16
                best = np.lexsort((ids[found], -score))
                _, once = np.unique(ids[found[best]], return_index=True)
                best = best[np.sort(once)[:k]]
                out[0] += [int(ids[q])] * len(best)
                out[1] += ids[found[best]].tolist()
                out[2] += score[best].tolist()
        trim()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names)

    return run


def search(vectors: DataFrame, asked, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of every row for which ``asked`` (a condition on vec_id) holds."""
    scratch = Scratch(vectors.sparkSession, "ann")
    rows = scratch.keep(packed(vectors, id_col, vector_col).filter("v is not null and vec_id is not null").drop("digest"), "vectors")
    found = rows.agg(F.count("*"), F.max(F.octet_length("v")), F.count(F.when(asked, 1))).first()
    kind = component(vectors, vector_col)
    total, width, queries = found[0], max(1, (found[1] or 0) // np.dtype(kind).itemsize), found[2]
    if not queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    u = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.select("v", u.alias("u"), "vec_id").filter(F.col("u") < min(1.0, SAMPLE / total)).orderBy("u", "vec_id").limit(SAMPLE).toPandas()
    if not len(sample):
        sample = rows.select("v", "vec_id").orderBy("vec_id").limit(1000).toPandas()
    x = unit(stacked(list(sample["v"]), width, kind))
    mean, turn = learn(x)
    radius, excess = calibrate(x, encode(x, mean, turn), k)
    row_blocks, query_blocks = -(-total // ROWS), -(-queries // QUERIES)
    at = lambda n, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select(at(row_blocks, 1).alias("rb"), every(query_blocks).alias("qb"), F.lit(False).alias("ask"), "vec_id", "v")
    asks = rows.filter(asked).select(every(row_blocks).alias("rb"), at(query_blocks, 2).alias("qb"), F.lit(True).alias("ask"), "vec_id", "v")
    best = held.unionByName(asks).groupBy("rb", "qb").applyInArrow(_searched(width, k, radius, excess, mean, turn, kind), "query_id long, vec_id long, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
