"""Language identification by the nearest centroid.

A text's vector: hashed letter n-grams (1 to 3, with word borders), square root
of the count times idf, scaled to length 1. Idf counts all training documents.
Each language has several centroids (spherical k-means over a bounded sample of
its training documents); the prediction is the language of the centroid with
the largest cosine. A text farther from its centroid than nearly all of that
centroid's own sample is marked ``rejected`` (its nearest language stays).

Training sees only text and non-null language of documents outside the held-out
fold; predictions see only text.

Cases: null texts and texts without a letter give ``und`` and score 0; without
training languages everything is ``und``; long texts count whole; repeated rows,
null ids and other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, held_out, seeded_hash, sliced
from .textmath import chunks, lower_letters, points

BITS = 12
WIDTH = 1 << BITS
#: Bounds of the sample that centroids are fitted on: vectors in all, and of one language.
SAMPLE, SAMPLE_EACH = 4096, 512
CENTROIDS = 4
REJECT = 0.005


def gram_counts(texts: list[str]) -> np.ndarray:
    """texts x WIDTH: square roots of hashed n-gram counts."""
    at, row = points(texts)
    c = lower_letters()[at]
    seen, base = [], row * WIDTH

    def add(grams, keep, of):
        hashed = ((grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
        seen.append((hashed + of)[keep])

    two = c[:-1] * np.uint32(40503) + c[1:]
    add(c + np.uint32(1 << 30), c > 0, base)
    add(two, (c[:-1] > 0) | (c[1:] > 0), base[:-1])
    add(two[:-1] * np.uint32(69069) + c[2:] + np.uint32(7), c[1:-1] > 0, base[1:-1])
    counts = np.bincount(np.concatenate(seen), minlength=len(texts) * WIDTH)
    return np.sqrt(counts.reshape(len(texts), WIDTH).astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; fewer centroids where there are fewer distinct rows."""
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < min(k, len(x)):
        far = np.clip(1 - (x @ centres.T).max(axis=1), 0, None)
        if far.sum() < 1e-6:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = np.vstack([_unit(x[own == j].sum(axis=0, keepdims=True)) if (own == j).any() else centres[[j]] for j in range(len(centres))])
    return centres


def fit(docs: DataFrame, train, id_col="doc_id", text_col="text", lang_col="lang", seed: int = 0) -> dict:
    """Idf, centroids, their languages and rejection cosines."""
    rows = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (seeded_hash("langid", F.col(id_col), F.xxhash64(text_col)) / float(2**60)).alias("u"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}

    def frequencies(batches):
        total = np.zeros(WIDTH, np.int64)
        for b in sliced(batches):
            texts = b.column(0).to_pylist()
            for _, part in chunks(texts):
                total += (gram_counts(part) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH, dtype=np.int32)), pa.array(total)], ["g", "n"])

    counts = rows.select("text").mapInArrow(frugal(frequencies), "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(WIDTH)
    for r in counts:
        df[r["g"]] = r["n"]
    idf = (np.log((1 + sum(sizes.values())) / (1 + df)) + 1).astype(np.float32)
    each = max(8, min(SAMPLE_EACH, SAMPLE // max(1, len(sizes))))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.3 * each / n)).otherwise(share)

    def vectors(batches):
        for b in sliced(batches):
            for start, part in chunks(b.column(0).to_pylist()):
                x = gram_counts(part).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(start, len(part)), b.column(2).slice(start, len(part)), pa.array([v.tobytes() for v in x])], ["lang", "u", "v"])

    sample = rows.filter(F.col("u") < share).mapInArrow(frugal(vectors), "lang string, u double, v binary").toPandas()
    rng, centres, langs, least = np.random.default_rng(seed), [], [], []
    for lang, group in sorted(sample.groupby("lang")):
        group = group.sort_values(["u", "v"], kind="stable").head(each)
        x = _unit(np.stack([np.frombuffer(v, np.float16) for v in group["v"]]).astype(np.float32) * idf)
        own = cluster(x, CENTROIDS, rng)
        cosine = x @ own.T
        for j in range(len(own)):
            mine = cosine[cosine.argmax(axis=1) == j, j]
            centres.append(own[j])
            langs.append(lang)
            least.append(float(np.quantile(mine, REJECT)) if len(mine) else 0.0)
    return {"idf": idf, "centres": np.array(centres, np.float32).reshape(-1, WIDTH), "langs": langs, "least": np.array(least)}


def predict(docs: DataFrame, model: dict, fold, id_col="doc_id", text_col="text") -> DataFrame:
    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"

    def run(batches):
        names, centres, idf, least = model["langs"], model["centres"], model["idf"], model["least"]
        for b in sliced(batches):
            texts = [t or "" for t in b.column(2).to_pylist()]
            lang, score, far = [], [], []
            for _, part in chunks(texts):
                x = gram_counts(part) * idf
                some = x.any(axis=1)
                cosine = _unit(x) @ centres.T if len(names) else np.zeros((len(part), 1))
                best = cosine.argmax(axis=1)
                top = np.clip(cosine[np.arange(len(part)), best].astype(float), 0, 1)
                known = some & bool(names)
                lang += [names[j] if k else "und" for j, k in zip(best, known, strict=True)]
                score += np.where(known, top, 0.0).tolist()
                far += [not k or bool(t < least[j]) for j, k, t in zip(best, known, top, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fold.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(frugal(run), schema)


def identify(docs: DataFrame, modulus: int = 3, rest: int = 1, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """Learn outside the held-out fold, predict every document."""
    fold = held_out(F.col(id_col), modulus, rest)
    return predict(docs, fit(docs, ~fold, id_col, text_col, lang_col), fold, id_col, text_col)
