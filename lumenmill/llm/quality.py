"""Quality by positive-unlabelled learning.

Trusted positives are training documents labelled good; everything else the
learner sees is the unlabelled text of training documents. With the class prior
p the non-negative unbiased risk

    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]),   l(z) = 1 / (1 + e^z)

is minimised by gradient steps; where the second term falls below zero its
gradient is reversed. The prior is estimated from positives and unlabelled text
alone: a scorer that tells one from the other is fitted on half of both; on the
other halves, of the cuts above which half of the positives or more lie, the
one with the fewest unlabelled documents for each positive tells the largest
share of positives that the unlabelled can have. The scorer is a small network over whole-text statistics
(letter classes, repetition of words and lines, symbols at word ends).

Both samples the network is fitted on are bounded (``POSITIVES``,
``UNLABELLED``), drawn by a hash of id and text.

Cases: null and empty texts are scored like any other (all statistics 0);
without positives every score is 0; long texts count whole; repeated
rows, null ids and other columns don't matter.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import frugal, held_out, seeded_hash, sliced
from .textmath import COMMON, DIGIT, LINE, LOWER, SPACE, SYMBOL, UPPER, char_classes, chunks, points

#: Bounds of the fitting sample.
POSITIVES, UNLABELLED = 8000, 16000
HIDDEN, ROUNDS, BATCH, RATE, DECAY = 24, 60, 512, 0.005, 1e-4
FEATURES = 20


def statistics(texts: list[str]) -> np.ndarray:
    """texts x FEATURES."""
    out = np.zeros((len(texts), FEATURES), np.float64)
    for start, part in chunks(texts, rows=256, letters=2_000_000):
        at, row = points(part)
        kind = char_classes()[at]
        n = len(part)
        of = np.bincount(row * 8 + kind, minlength=n * 8).reshape(n, 8).astype(float)
        of[:, LINE] -= 2
        letters = np.maximum(of.sum(axis=1), 1)
        pair = lambda a, b: np.bincount(row[:-1][(kind[:-1] == a) & (kind[1:] >= b[0]) & (kind[1:] <= b[1])], minlength=n)
        ends, marks, caps = pair(SYMBOL, (SPACE, LINE)), pair(COMMON, (COMMON, COMMON)), pair(UPPER, (UPPER, UPPER))
        x = out[start : start + n]
        for j, k in enumerate((LOWER, UPPER, DIGIT, SPACE, LINE, COMMON, SYMBOL)):
            x[:, j] = of[:, k] / letters
        x[:, 7], x[:, 8], x[:, 9] = ends / letters, marks / letters, caps / letters
        for i, t in enumerate(part):
            words = t.split()
            m = len(words)
            if m:
                lines = t.split("\n")
                kinds = len(set(words))
                x[i, 10] = kinds / m
                x[i, 11] = np.log(kinds) / np.log(m) if m > 1 else 1
                x[i, 12] = sum(map(operator.eq, words, words[1:])) / m
                x[i, 13] = (len(t) - m) / m
                x[i, 14] = len(set(lines)) / len(lines)
                x[i, 15] = m / len(lines)
                x[i, 16] = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
                x[i, 17] = np.log1p(m)
                x[i, 18] = sum(map(str.isupper, words)) / m
                x[i, 19] = t.count(". ") / m
    out[:, [6, 7, 8, 9, 12, 18, 19]] = np.sqrt(np.maximum(out[:, [6, 7, 8, 9, 12, 18, 19]], 0))
    out[:, [13, 15]] = np.log1p(np.maximum(out[:, [13, 15]], 0))
    return out


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 0, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights of the network with the least non-negative unbiased risk found (Adam); without a prior, of one that tells the samples apart."""
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    weights = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(rounds):
        order = rng.permutation(len(unlabelled))
        for start in range(0, len(order), BATCH):
            u, p = unlabelled[order[start : start + BATCH]], positive[rng.integers(len(positive), size=BATCH)]
            x = np.vstack([p, u])
            h = np.tanh(x @ weights[0] + weights[1])
            g = np.clip(h @ weights[2] + weights[3], -30, 30)
            loss = 1 / (1 + np.exp(g))  # l(g); l(-g) is 1 - l(g), and their slopes are -s and s
            s = loss * (1 - loss)
            own, others = slice(0, len(p)), slice(len(p), None)
            slope = np.zeros(len(x))
            if prior is None:
                slope[own], slope[others] = -s[own] / len(p), s[others] / len(u)
            else:
                rest = (1 - loss[others]).mean() - prior * (1 - loss[own]).mean()
                if rest >= 0:
                    slope[own] = -prior * s[own] / len(p)
                sign = 1 if rest >= 0 else -1
                slope[others] += sign * s[others] / len(u)
                slope[own] -= sign * prior * s[own] / len(p)
            back = np.outer(slope, weights[2]) * (1 - h * h)
            grads = [x.T @ back, back.sum(axis=0), h.T @ slope, np.array([slope.sum()])]
            t += 1
            for k, grad in enumerate(grads):
                grad = grad + DECAY * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                weights[k] = weights[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-9)
    return weights


def margin(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    return np.tanh(x @ weights[0] + weights[1]) @ weights[2] + weights[3]


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> float:
    """Share of positives in the unlabelled rows, from the rows alone (mixture proportion estimation by a scorer's cuts)."""
    rng = np.random.default_rng(seed)
    positive, unlabelled = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
    p, q = len(positive) // 2, len(unlabelled) // 2
    if not p or not q:
        return 0.5
    weights = minimise(positive[:p], unlabelled[:q], None, seed, ROUNDS // 3)
    good, any_ = np.sort(margin(positive[p:], weights)), np.sort(margin(unlabelled[q:], weights))
    cuts = good[: len(good) - len(good) // 2]
    above = lambda x: 1 - np.searchsorted(x, cuts, side="left") / len(x)
    return float(np.clip((above(any_) / above(good)).min(), 0.02, 0.98))


def _measured(batches):
    for b in sliced(batches):
        x = statistics([t or "" for t in b.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["u", "x"])


def fit(docs: DataFrame, labels: DataFrame, train, id_col="doc_id", text_col="text", label_col="quality") -> dict:
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(train(F.col("doc_id")))
    good = known.filter("y = 1").count()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(train(F.col("doc_id")))
    total = rows.count()
    if not good or not total:
        return {"prior": 0.0, "weights": None}
    share = min(1.0, POSITIVES / good)
    u = (seeded_hash("quality", F.col("doc_id")) / float(2**60)).alias("u")
    chosen = rows.select("doc_id", "text", u).filter(F.col("u") < share).join(known.filter("y = 1").select("doc_id", u).filter(F.col("u") < share).select("doc_id").distinct(), "doc_id")
    # rows that repeat an id enter as often as the bound allows
    found = chosen.count()
    if found > 2 * POSITIVES:
        chosen = chosen.filter(seeded_hash("quality-rows", F.col("doc_id"), F.xxhash64("text")) / float(2**60) < POSITIVES / found)
    other = rows.select("text", (seeded_hash("unlabelled", F.col("doc_id"), F.xxhash64("text")) / float(2**60)).alias("u")).filter(F.col("u") < min(1.0, UNLABELLED / total))

    def drawn(df, most):
        found = df.select("text", "u").mapInArrow(frugal(_measured), "u double, x array<double>").toPandas()
        x = np.array(found["x"].tolist(), float).reshape(-1, FEATURES)
        return x[np.lexsort([*x.T, found["u"].to_numpy()])][: most + most // 8]

    p, q = drawn(chosen, POSITIVES), drawn(other, UNLABELLED)
    if not len(p) or not len(q):
        return {"prior": 0.0, "weights": None}
    middle, scale = q.mean(axis=0), q.std(axis=0) + 1e-6
    p, q = (np.clip((x - middle) / scale, -6, 6) for x in (p, q))
    prior = class_prior(p, q)
    weights = minimise(p, q, prior)
    return {"prior": prior, "weights": weights, "middle": middle, "scale": scale}


def score(docs: DataFrame, model: dict, fold, id_col="doc_id", text_col="text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores of all documents; ``keep`` carries further columns through (the text once, if it is one of them)."""
    carried = docs.select(*keep).schema if keep else None
    schema = StructType().add("doc_id", "long").add("held_out", "boolean").add("score", "double").add("predicted", "integer")
    inside = text_col in keep

    def run(batches):
        weights = model["weights"]
        for b in sliced(batches):
            texts = [t or "" for t in (pc.struct_field(b.column(2), text_col) if inside else b.column(2)).to_pylist()]
            if weights is None:
                s = np.full(len(texts), model["prior"])
            else:
                x = np.clip((statistics(texts) - model["middle"]) / model["scale"], -6, 6)
                s = 1 / (1 + np.exp(-np.clip(margin(x, weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), *([b.columns[-1]] if carried else [])], ["doc_id", "held_out", "score", "predicted", *(["kept"] if carried else [])])

    if carried:
        schema = schema.add("kept", carried)
    columns = [*([] if inside else [F.col(text_col).alias("text")]), *([F.struct(*keep).alias("kept")] if keep else [])]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fold.alias("held_out"), *columns).mapInArrow(frugal(run), schema)


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, id_col="doc_id", text_col="text", label_col="quality", keep: tuple[str, ...] = ()) -> DataFrame:
    """Learn outside the held-out fold, score every document."""
    model = fit(docs, labels, lambda c: ~held_out(c, modulus, rest), id_col, text_col, label_col)
    return score(docs, model, held_out(F.col(id_col), modulus, rest), id_col, text_col, keep)
