"""Toxicity by noisy-channel deobfuscation.

Writers hide words by look-alike digits and signs, by spaces or dots between
letters, and by repeating letters. Every run of characters that may be such a
word is expanded into a lattice: at each character the letters it may stand
for, or nothing where it may be a separator or a repeat. A Viterbi search under
a letter 4-gram language model, counted over all documents, finds the likeliest
source text; the channel charges each change. Runs of any length are restored,
in linear time. As a restored run may hold several words, its features are taken
from every letter on. A classifier then scores the restored texts.

The language model has a fixed alphabet (26 letters and the word border), so
its table never exceeds 27^4 counts; the counts grow with the corpus. The
classifier is a logistic regression on the restored words and word beginnings,
fitted on a bounded, hash-drawn sample of labelled training documents.

Cases: null and empty texts get the score of a text without evidence; texts of
any length count whole; without a toxic label every score is 0, and without one
that says otherwise every score is 1; an id with several labels is toxic if one
of them says so; repeated rows, null ids and other columns don't matter.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, held_out, seeded_hash, sliced
from .textmath import chunks, latin_letters, points

ORDER, SYMBOLS = 4, 27
TABLE = SYMBOLS**ORDER
#: Bound of the classifier's sample of labelled documents.
SAMPLE = 20_000
#: Slots of hashed features; those kept have at least so many toxic documents and so much evidence.
SLOTS, LEAST, EVIDENCE, KEPT = 1 << 20, 3, 1.5, 20_000
MEMO = 300_000
#: What a digit or sign may stand for.
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
SEPARATOR = ".-_*~'"
#: Costs in natural logs of the channel.
CHANGE, DROP, REPEAT = 1.0, 0.7, 0.4
#: A word's feature hashes its letters from the last to the first, so those of all its ends cost one pass.
WORD = zlib.crc32(b"w:")

#: Single characters parted by spaces or separators, at least four of them.
SPACED = re.compile(r"(?<!\S)(?:[^\W_][\s._*\-~]{1,2}){3,}[^\W_](?!\S)", re.UNICODE)
LETTERS = re.compile(r"[^\W\d_]+")
REPEATED = re.compile(r"([^\W\d_])\1\1")
HIDDEN = re.compile(r"[^\W\d_][0-9@$!|+(<€£.\-_*~]+[^\W\d_]|^[0-9@$!|+(<€£]+[^\W\d_]{2}|[^\W\d_]{2}[0-9@$|+€£](?=[^\W\d_]|$)")


class LetterModel:
    """Log probabilities of a letter after the three before it, smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray):
        full = counts.reshape((SYMBOLS,) * ORDER).astype(float)
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for n in range(1, ORDER + 1):
            c = full.sum(axis=tuple(range(ORDER - n)))
            own = c.sum(axis=-1, keepdims=True)
            kinds = (c > 0).sum(axis=-1, keepdims=True) + 1
            p = (c + kinds * p) / (own + kinds)
        self.log = np.log(p).reshape(-1).astype(np.float32)

    def score(self, word: str) -> float:
        """Log probability of a word of a..z with its borders."""
        return self._run([ord(c) - 96 for c in word])

    def _run(self, codes: list[int]) -> float:
        a = b = c = 0
        total = 0.0
        for d in [*codes, 0]:
            total += self.log[((a * SYMBOLS + b) * SYMBOLS + c) * SYMBOLS + d]
            a, b, c = b, c, d
        return total


class _Fold(dict):
    """For str.translate: code points to a..z or nothing, filled as they occur."""

    def __missing__(self, point: int):
        k = int(latin_letters()[point])
        self[point] = chr(96 + k) if k else None
        return self[point]


_FOLD = _Fold()


def plain(word: str) -> str:
    """The word's letters as a..z."""
    return word.translate(_FOLD)


def restore(run: str, model: LetterModel) -> str:
    """The likeliest a..z word behind a run of characters: a Viterbi search over its lattice."""
    table = latin_letters()
    # last three letters -> (score, word as (word before, letter))
    states: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
    before = ""
    for c in run:
        own = int(table[ord(c)]) if ord(c) < len(table) else 0
        options = [(own, 0.0)] if own else [(ord(x) - 96, CHANGE) for x in LOOKALIKE.get(c, "")]
        drop = DROP if c in SEPARATOR or c.isspace() else REPEAT if own and c == before else None if options else DROP
        grown: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
        for (x, y, z), (s, word) in states.items():
            for letter, cost in options:
                t = s - cost + float(model.log[((x * SYMBOLS + y) * SYMBOLS + z) * SYMBOLS + letter])
                key = (y, z, letter)
                if key not in grown or t > grown[key][0]:
                    grown[key] = (t, (word, letter))
            if drop is not None and (s - drop > grown.get((x, y, z), (-math.inf,))[0]):
                grown[x, y, z] = (s - drop, word)
        states = grown
        before = c
    end = [(s + float(model.log[((x * SYMBOLS + y) * SYMBOLS + z) * SYMBOLS]), (x, y, z)) for (x, y, z), (s, _) in states.items()]
    word = states[max(end)[1]][1]
    letters = []
    while word:
        word, letter = word
        letters.append(chr(96 + letter))
    return "".join(reversed(letters))


def beginnings(word: str) -> set[int]:
    """Features of a word's first 4, 5 and 6 letters."""
    return {zlib.crc32(f"{n}:{word[:n]}".encode()) & (SLOTS - 1) for n in (4, 5, 6)}


class Restorer:
    """Texts to the ids of their restored words' features."""

    def __init__(self, model: LetterModel, kept: set[int] | None = None):
        self.model, self.kept, self.memo = model, kept, {}

    def restored(self, run: str) -> set[int]:
        """Features of a run's restored letters from every start on: where its words begin is not known."""
        found = {restore(run, self.model)}
        found |= {restore(w, self.model) for w in found if REPEATED.search(w)}
        ids: set[int] = set()
        for w in found:
            rest = WORD
            for k in range(len(w) - 1, -1, -1):
                rest = zlib.crc32(w[k].encode(), rest)
                if k < len(w) - 1:
                    ids.add(rest & (SLOTS - 1))
                    ids |= beginnings(w[k : k + 6])
        return ids

    def ids(self, chunk: str) -> tuple[int, ...]:
        """Features of the words that a chunk between spaces may be: as written, and restored."""
        found = self.memo.get(chunk)
        if found is None:
            ids: set[int] = set()
            for w in (plain(w) for w in LETTERS.findall(chunk)):
                if len(w) > 1:
                    ids.add(zlib.crc32(w[::-1].encode(), WORD) & (SLOTS - 1))
                    ids |= beginnings(w)
            if HIDDEN.search(chunk) or REPEATED.search(chunk):
                for run in {chunk, chunk.strip(".,;:!?*'\"()-_")}:
                    ids |= self.restored(run)
            found = tuple(sorted(ids if self.kept is None else ids & self.kept))
            if len(chunk) < 48:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[chunk] = found
        return found

    def features(self, text: str) -> set[int]:
        text = text.lower()
        out: set[int] = set()
        for chunk in set(text.split()):
            out.update(self.ids(chunk))
        for m in SPACED.finditer(text):
            run = m.group()
            for part in {run, *re.split(r"\s{2,}", run)}:
                ids = self.restored(part)
                out |= ids if self.kept is None else ids & self.kept
        return out


def letter_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """4-gram counts of all documents' letters (other characters are borders)."""

    def count(batches):
        total = np.zeros(TABLE, np.int64)
        for b in sliced(batches):
            for _, part in chunks([t or "" for t in b.column(0).to_pylist()], rows=4096):
                at, _ = points(part)
                c = latin_letters()[at].astype(np.int32)
                c = np.concatenate([[0, 0, 0], c])
                # a run of borders is one border, and starts the context anew
                border = np.flatnonzero(c == 0)
                keep = np.ones(len(c), bool)
                keep[border[1:][np.diff(border) == 1]] = False
                c = c[keep]
                p = np.concatenate([[0, 0], c])
                x, y, z, w = p[:-3], p[1:-2], p[2:-1], p[3:]
                y = np.where(z == 0, 0, y)
                x = np.where(y == 0, 0, x)
                total += np.bincount(((x * SYMBOLS + y) * SYMBOLS + z) * SYMBOLS + w, minlength=TABLE)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["g", "n"])

    found = docs.select(F.col(text_col)).mapInArrow(frugal(count), "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TABLE)
    out[found["g"].to_numpy(int)] = found["n"].to_numpy(float)
    return out


def logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int, start: np.ndarray, rounds: int = 1200, ridge: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised logistic regression over 0/1 features (accelerated gradient)."""
    w, bias, n = start.copy(), -2.0, len(y)
    ahead, ahead_b, t = w.copy(), bias, 1.0
    most = np.bincount(rows, minlength=n).max(initial=1) + 1
    step = 4.0 / most
    for _ in range(rounds):
        z = np.bincount(rows, weights=ahead[cols], minlength=n) + ahead_b
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        new = np.clip(ahead - step * (np.bincount(cols, weights=r[rows], minlength=width) + ridge * ahead / n), 0, 12)
        new_b = ahead_b - step * r.sum()
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_b = new + (t - 1) / u * (new - w), new_b + (t - 1) / u * (new_b - bias)
        w, bias, t = new, new_b, u
    z = np.bincount(rows, weights=w[cols], minlength=n) + bias
    return w, bias - threshold(z, y)


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The margin at which a cut makes the fewest errors (the middle of the best gap)."""
    order = np.argsort(z, kind="stable")
    values, ones = z[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(ones)]) + np.concatenate([np.cumsum((1 - ones)[::-1])[::-1], [0]])
    able = np.concatenate([[False], values[1:] > values[:-1], [False]])
    if not able.any():
        return 0.0
    best = np.flatnonzero(able & (wrong == wrong[able].min()))
    k = best[len(best) // 2]
    return float((values[k - 1] + values[k]) / 2)


def fit(docs: DataFrame, labels: DataFrame, train, id_col="doc_id", text_col="text", label_col="toxic") -> dict:
    model = LetterModel(letter_counts(docs, text_col))
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(train(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    total = known.count()
    u = (seeded_hash("toxicity", F.col("doc_id")) / float(2**60)).alias("u")
    share = min(1.0, SAMPLE / max(1, total))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", "text", u).filter(F.col("u") < share)
    chosen = texts.join(known.select("doc_id", "y", u.alias("v")).filter(F.col("v") < share), "doc_id")
    # rows that repeat an id enter as often as the bound allows
    rows = chosen.count()
    if rows > 2 * SAMPLE:
        chosen = chosen.filter(seeded_hash("toxicity-rows", F.col("doc_id"), F.xxhash64("text")) / float(2**60) < SAMPLE / rows)

    def features(batches):
        restorer = Restorer(model)
        for b in sliced(batches):
            ids = [np.array(sorted(restorer.features(t or "")), np.int32).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(ids, pa.binary())], ["y", "ids"])

    def counts(batches):
        yes, every = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        for b in sliced(batches):
            for y, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = np.frombuffer(ids, np.int32)
                every[at] += 1
                yes[at] += y
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(yes[some]), pa.array(every[some])], ["slot", "yes", "n"])

    # features stay on the executors until those that count are known
    table = Scratch(docs.sparkSession, "toxicity").keep(chosen.select("text", "y").mapInArrow(frugal(features), "y int, ids binary"), "features")
    n, ones = table.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not ones or ones == n:
        return {"model": model, "ids": [], "weights": [], "bias": math.inf if ones else -math.inf}
    slots = table.mapInArrow(counts, "slot long, yes long, n long").groupBy("slot").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n")).filter(F.col("yes") >= LEAST).toPandas().sort_values("slot")
    slot, yes, every = (slots[c].to_numpy(np.int64) for c in ("slot", "yes", "n"))
    a, b = float(ones), float(n - ones)
    evidence = np.log((yes + 0.1) / (a + 0.2)) - np.log((every - yes + 0.5) / (b + 1))
    able = np.flatnonzero(evidence >= EVIDENCE)
    able = np.sort(slot[able[np.lexsort((slot[able], -evidence[able] * yes[able]))][:KEPT]])

    def counted(batches):
        for b in sliced(batches):
            ids = [np.intersect1d(np.frombuffer(v, np.int32), able, assume_unique=True).astype(np.int32).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["y", "ids"])

    found = table.mapInArrow(counted, "y int, ids binary").toPandas().sort_values(["y", "ids"])
    y = found["y"].to_numpy(float)
    lists = [np.frombuffer(v, np.int32) for v in found["ids"]]
    rows, cols = np.repeat(np.arange(len(lists)), [len(v) for v in lists]), np.concatenate(lists)
    place = np.full(SLOTS, -1)
    place[able] = np.arange(len(able))
    w, bias = logistic(rows, place[cols], y, len(able), np.zeros(len(able)))
    return {"model": model, "ids": able.tolist(), "weights": w.tolist(), "bias": bias}


def score(docs: DataFrame, fitted: dict, fold, id_col="doc_id", text_col="text") -> DataFrame:
    def run(batches):
        weight = dict(zip(fitted["ids"], fitted["weights"], strict=True))
        restorer = Restorer(fitted["model"], set(weight))
        for b in sliced(batches):
            z = [fitted["bias"] + sum(weight[k] for k in sorted(restorer.features(t or ""))) for t in b.column(2).to_pylist()]
            z = np.array(z, float)
            s = np.where(np.isinf(z), z > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fold.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(frugal(run), "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0, id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """Learn outside the held-out fold, score every document."""
    fitted = fit(docs, labels, lambda c: ~held_out(c, modulus, rest), id_col, text_col, label_col)
    return score(docs, fitted, held_out(F.col(id_col), modulus, rest), id_col, text_col)
