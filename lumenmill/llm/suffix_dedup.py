"""Suffix-array deduplication by a run-length index.

Every byte of a string of ``LENGTH`` bytes that also starts somewhere else in
the corpus is marked. The work is split so that equal strings always meet:

1. Each string is represented by the smallest hash of its K-byte grams. Strings
   that share one with no other place are unique and leave here.
2. Neighbouring strings with the same smallest gram form a fragment. Equal
   fragments are one, with all their places; a fragment with two places is
   marked whole, as are texts that are copies of each other.
3. The distinct fragments of a gram are indexed together, where one of them has
   a single place. The index is the Burrows-Wheeler transform as runs, with the
   text positions of both ends of each run as samples and the length of the
   match between the ends of neighbouring runs of one byte. The fragments are
   then streamed from their last byte to their first: a backward step maps a row
   by its run; inside a run the neighbouring row steps along and the match grows
   by a byte, at a run's end the next run's sampled end takes its place. So every
   byte gets its matching statistic with the other places, and strings that reach
   ``LENGTH`` are marked. After it is built, the index needs memory for its runs
   alone, which in repetitive text are far fewer than its bytes.
4. Marks of fragments return to their places, and documents are rewritten.

Fragments are told apart by 128 bits: the hash of the gram and a digest.

A gram that would gather more distinct bytes than ``DENSE`` (a passage that a
large part of all documents hold in different surroundings) has no bounded
index. Its strings meet by 128 bits of hash instead, with the same marks: a task
marks what repeats among its own fragments and sends each string once, so a
string that all documents hold gathers in no task.

Cases: null texts are empty; texts shorter than LENGTH keep all bytes; matches
never cross documents; repeated rows are copies of each other; rows are told
apart by id and text, so null or repeated ids do no harm; other columns are
ignored or, for ``rewrite``, kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, sliced
from .shingles import BASE, mix

LENGTH, K = 200, 32
SPAN = LENGTH - K + 1
#: Bytes that are hashed at once, and distinct bytes of one index.
SLICE, INDEX = 1 << 19, 1 << 19
#: Distinct bytes of one gram's fragments above which its strings meet by hash.
DENSE = 1 << 20
#: Bytes of strings' hashes that meet in one bucket, about.
BUCKET = 16 << 20
#: Bytes between the starts of streams through a long fragment.
STRIDE = 512
OTHER = 0xC2B2AE3D27D4EB4F


def _rolling(b: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes of all ``width`` bytes in a row."""
    one = b.astype(np.uint64) + np.uint64(1)
    out, size, done = None, 0, one
    step = 1
    while True:
        if width & step:
            if out is None:
                out, size = done, step
            else:
                n = len(b) - size - step + 1
                out = out[:n] * np.uint64(pow(base, step, 1 << 64)) + done[size : size + n]
                size += step
        step <<= 1
        if step > width:
            return out
        half = step >> 1
        done = done[:-half] * np.uint64(pow(base, half, 1 << 64)) + done[half:]


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _pieces(data: list[bytes]):
    """Lists of (document, offset, bytes) of about SLICE bytes; pieces of one text overlap by LENGTH - 1."""
    held, total = [], 0
    for k, d in enumerate(data):
        for at in range(0, max(1, len(d) - LENGTH + 1), SLICE):
            part = d[at : at + SLICE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if held and total + len(part) > SLICE:
                yield held
                held, total = [], 0
            held.append((k, at, part))
            total += len(part)
    if held:
        yield held


class _Grams:
    """Smallest grams of all strings of some pieces."""

    def __init__(self, pieces):
        sizes = np.array([len(p) for _, _, p in pieces])
        self.bytes = np.frombuffer(b"".join([p for _, _, p in pieces]), np.uint8)
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.piece = np.repeat(np.arange(len(pieces)), sizes)
        self.hash = mix(_rolling(self.bytes, K, BASE)) | np.uint64(1)
        starts = len(self.bytes) - LENGTH + 1
        self.least = _sliding(self.hash, SPAN, np.minimum)
        self.able = self.piece[:starts] == self.piece[LENGTH - 1 :]

    def selected(self) -> tuple[np.ndarray, np.ndarray]:
        """(gram, piece) of each place whose gram is the smallest of a string over it."""
        m = np.where(self.able, self.least, np.uint64(0))
        m = np.concatenate([np.zeros(SPAN - 1, np.uint64), m, np.zeros(SPAN - 1, np.uint64)])
        at = np.flatnonzero(_sliding(m, SPAN, np.maximum) == self.hash)
        return self.hash[at], self.piece[at]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first string, last string, gram) of the maximal runs with one smallest gram."""
        m, ok = self.least, self.able
        new = np.concatenate([[True], (m[1:] != m[:-1]) | (self.piece[1 : len(m)] != self.piece[: len(m) - 1])]) & ok
        end = np.concatenate([new[1:] | ~ok[1:], [True]]) & ok
        start, stop = np.flatnonzero(new), np.flatnonzero(end)
        return start, stop, m[start]


def _utf8(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def _gram_places(batches):
    """(h, d, u, n): the grams of a text, and whether once (1) or more (2)."""
    for b in sliced(batches):
        d, u = b.column(1).to_numpy(), b.column(2).to_numpy()
        for p in _pieces(_utf8(b.column(0))):
            h, piece = _Grams(p).selected()
            row = np.array([k for k, _, _ in p])[piece]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, int)
            n = np.minimum(np.diff(np.append(first, len(h))), 2).astype(np.int32)
            h, row = h[first], row[first]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d[row]), pa.array(u[row]), pa.array(n)], ["h", "d", "u", "n"])


def _packed(batches):
    squeeze = zstandard.ZstdCompressor(level=3)
    for b in sliced(batches):
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([squeeze.compress(t) for t in _utf8(b.column(0))], pa.binary())], ["d", "u", "z"])


def _fragments(batches):
    """Every fragment of a wanted gram: where it is, and whether its gram comes again in it."""
    expand = zstandard.ZstdDecompressor()
    for b in sliced(batches):
        d, u = b.column(0).to_numpy(), b.column(1).to_numpy()
        data = [expand.decompress(z.as_py()) for z in b.column(2)]
        wanted = [np.array(h.as_py(), np.int64).view(np.uint64) for h in b.column(3)]
        for p in _pieces(data):
            g = _Grams(p)
            start, stop, gram = g.runs()
            whole, piece = g.bytes.tobytes(), g.piece[start]
            edges = np.searchsorted(piece, np.arange(len(p) + 1))
            rows, kind, at, size, again = [], [], [], [], []
            chosen = []
            for j, (k, offset, _) in enumerate(p):
                lo, hi = edges[j], edges[j + 1]
                mine = np.flatnonzero(np.isin(gram[lo:hi], wanted[k])) + lo
                chosen.append(mine)
                rows += [k] * len(mine)
                at += (offset + start[mine] - g.first[j]).tolist()
            chosen = np.concatenate(chosen)
            for x, y, h in zip(start[chosen].tolist(), stop[chosen].tolist(), gram[chosen].tolist(), strict=True):
                kind.append(int.from_bytes(hashlib.blake2b(whole[x : y + LENGTH], digest_size=8).digest(), "little", signed=True))
                size.append(y + LENGTH - x)
                again.append(int(np.count_nonzero(g.hash[x : y + SPAN] == np.uint64(h))) > 1)
            rows = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram[chosen].view(np.int64)), pa.array(kind, pa.int64()), pa.array(d[rows]), pa.array(u[rows]), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(again, pa.bool_())], ["h", "f", "d", "u", "at", "size", "again"])


def _cut(batches):
    """The bytes of one place of each fragment that an index needs."""
    expand = zstandard.ZstdDecompressor()
    for b in sliced(batches):
        out = [(r["h"], r["f"], data[r["at"] : r["at"] + r["size"]], r["n"], r["dense"]) for z, picks in zip(b.column(0), b.column(1).to_pylist(), strict=True) for data in [expand.decompress(z.as_py())] for r in picks]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()))], ["h", "f", "part", "n", "dense"])


def suffix_order(text: np.ndarray, fragment: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of fragments laid end to end, each closed by a separator.

    text: symbols, 0 for a separator and byte + 1 else; fragment: the number of
    each position's fragment; ends: distance to the fragment's separator.
    Separators differ (by fragment), so no order depends on what follows them.
    Prefix doubling, with only the still tied suffixes sorted again.
    """
    n, first = len(text), 7
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(first, text.dtype)]).astype(np.int64)
    for j in range(first):
        key = key << 9 | np.where(ends >= j, padded[j : j + n], 0)
    closed = ends < first
    order = np.lexsort((np.where(closed, fragment, 0), key))
    k, c = key[order], np.where(closed, fragment, -1)[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = first
    while True:
        single = new & np.concatenate([new[1:], [True]])
        place = np.flatnonzero(~single)
        if not len(place):
            return order
        who = order[place]
        after = rank[np.minimum(who + depth, n - 1)]
        group = rank[who]
        again = np.argsort(group * n + after, kind="stable")
        who, group, after = who[again], group[again], after[again]
        order[place] = who
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        new[place] = fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, place, 0))
        depth *= 2


class RunIndex:
    """The run-length Burrows-Wheeler transform of distinct fragments, with samples at run ends."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) + 1 for p in parts])
        raw = np.frombuffer(b"\0".join(parts) + b"\0" * 17, np.uint8)
        self.size = n = int(sizes.sum())
        self.fragment = np.repeat(np.arange(len(parts)), sizes)
        self.stop = np.cumsum(sizes) - 1
        self.base = np.concatenate([[0], self.stop[:-1] + 1])
        ends = self.stop[self.fragment] - np.arange(n)
        text = np.where(ends > 0, raw[:n].astype(np.int16) + 1, 0).astype(np.int16)
        order = suffix_order(text, self.fragment, ends)
        symbols = text[order - 1]
        # separators differ from all symbols, from each other too
        first = np.flatnonzero(np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (symbols[1:] == 0)]))
        last = np.append(first[1:], n) - 1
        self.first, self.last, self.symbol = first, last, symbols[first]
        self.sample_first, self.sample_last = order[first], order[last]
        # a backward step: rows of a run keep their distances
        of = np.argsort(self.symbol, kind="stable")
        size = last - first + 1
        self.step = np.empty(len(first), np.int64)
        self.step[of] = np.cumsum(size[of]) - size[of] - first[of]
        eight = np.ndarray((n + 9,), "<u8", raw.tobytes(), strides=(1,))
        match = lambda p, q: _match(eight, ends, p, q)
        # matches of a run's ends with the next runs of the same symbol
        same = self.symbol[of[1:]] == self.symbol[of[:-1]]
        above, below = of[:-1][same], of[1:][same]
        met = match(self.sample_last[above], self.sample_first[below]) + 1
        self.up, self.down = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        self.up[below], self.down[above] = met, met
        # where streams start: at the separators, and inside long fragments
        inner = np.arange(n)[(ends > 0) & (ends % STRIDE == 0)]
        self.starts = np.concatenate([self.stop, inner])
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        self.rows = row[self.starts]
        beside = lambda r: np.where((r >= 0) & (r < n), match(self.starts, order[np.clip(r, 0, n - 1)]), 0)
        self.matches = beside(self.rows - 1), beside(self.rows + 1)
        self.ways = np.minimum(self.starts - self.base[self.fragment[self.starts]], STRIDE - (-ends[self.starts] % STRIDE))

    @property
    def runs(self) -> int:
        return len(self.first)

    def statistics(self) -> np.ndarray:
        """For each byte the longest match of the text from it on with another place, within fragments."""
        out = np.zeros(self.size, np.int64)
        order = np.argsort(-self.ways, kind="stable")
        at, row, left = self.starts[order], self.rows[order], self.ways[order]
        up, down = self.matches[0][order], self.matches[1][order]
        out[at] = np.maximum(up, down)
        for k in range(int(left.max(initial=0))):
            live = int(np.searchsorted(-left, -k, side="left"))
            at, row, up, down = at[:live], row[:live], up[:live], down[:live]
            run = np.searchsorted(self.first, row, side="right") - 1
            up = np.where(row == self.first[run], self.up[run], up + 1)
            down = np.where(row == self.last[run], self.down[run], down + 1)
            row = row + self.step[run]
            at = at - 1
            out[at] = np.maximum(up, down)
        return out


def _match(eight: np.ndarray, ends: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Lengths of the matches of pairs of suffixes, up to their fragments' ends, eight bytes at a time."""
    most = np.minimum(ends[p], ends[q])
    out, live, at = most.copy(), np.flatnonzero(most > 0), 0
    while len(live):
        x = eight[p[live] + at] ^ eight[q[live] + at]
        some = x != 0
        # the lowest byte that differs: bits below the lowest set bit, in bytes
        low = x[some]
        same = np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> np.uint8(3)
        out[live[some]] = np.minimum(at + same.astype(np.int64), most[live[some]])
        at += 8
        live = live[~some]
        live = live[most[live] > at]
    return out


def index_marks(parts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each distinct fragment the byte ranges of strings that occur twice among all of them."""
    index = RunIndex(parts)
    at = np.flatnonzero(index.statistics() >= length)
    level = np.zeros(index.size + 1, np.int64)
    level[at] += 1
    level[at + length] -= 1
    return [[(x - f, y - f) for x, y in ranges] for f, ranges in zip(index.base.tolist(), _ranges(np.cumsum(level[:-1]) > 0, index.stop), strict=True)]


def _ranges(cover: np.ndarray, stops: np.ndarray) -> list[list[tuple[int, int]]]:
    """Covered ranges, by the fragment (up to its stop) that they lie in."""
    edge = np.flatnonzero(np.diff(cover, prepend=False, append=False))
    a, b = edge[::2], edge[1::2]
    out: list[list[tuple[int, int]]] = [[] for _ in stops]
    for x, y, f in zip(a.tolist(), b.tolist(), np.searchsorted(stops, a).tolist(), strict=True):
        out[f].append((x, y))
    return out


MARKS = "h long, f long, marks array<struct<`from`: long, `to`: long>>"
_MARKS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _marked(rows: list[tuple[int, int, list[tuple[int, int]]]]) -> pa.RecordBatch:
    marks = [[{"from": a, "to": b} for a, b in r[2]] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(marks, _MARKS)], ["h", "f", "marks"])


def _indexed(batches):
    """Rows (h, f, part, n), sorted by h, to (h, f, marks) of fragments that have one place.

    Whole grams are indexed together, up to INDEX bytes or one gram.
    """

    def index(block):
        found = [(h, f, marks) for (h, f, _, n), marks in zip(block, index_marks([r[2] for r in block]), strict=True) if n == 1 and marks]
        block.clear()
        return _marked(found)

    block, group, size, own = [], [], 0, 0
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if group and r[0] != group[0][0]:
                if block and size + own > INDEX:
                    yield index(block)
                    size = 0
                block += group
                size += own
                group, own = [], 0
            group.append(r)
            own += len(r[2])
    for last in ([block, group] if size + own > INDEX else [block + group]):
        if last:
            yield index(last)


def _blobs(kind: int, key: np.ndarray, rows: np.ndarray):
    """Rows of numbers, packed by key: (kind, key, blob)."""
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    packed = [rows[x:y].tobytes() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), kind, np.int32)), pa.array(key[edge[:-1]].astype(np.int64)), pa.array(packed, pa.binary())], ["kind", "key", "blob"])


def _repeated(every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (two hashes, h, f, at, n; n over 1: marked or needing no mark) by string; whether it comes again; the first of each."""
    every = every[np.lexsort((every[:, 1], every[:, 0]))]
    new = np.concatenate([[True], (every[1:, :2] != every[:-1, :2]).any(axis=1)]) if len(every) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(every)))
    return every, np.repeat(size > 1, size), first


def _strings(buckets: int):
    """Dense fragments to strings' hashes (kind 1, by bucket), and to the marks that their task sees (kind 0, by gram).

    Of the strings that repeat here one is sent on, as one that has its mark.
    """

    def run(batches):
        for b in sliced(batches, 1024, 1 << 20):
            rows = []
            for h, f, part, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for at in range(0, len(part) - LENGTH + 1, SLICE):
                    x = np.frombuffer(part[at : at + SLICE + LENGTH - 1], np.uint8)
                    v, w = (mix(_rolling(x, LENGTH, base)).view(np.int64) for base in (BASE, OTHER))
                    rows.append(np.stack([v, w, np.full(len(v), h), np.full(len(v), f), np.arange(at, at + len(v)), np.full(len(v), n)], axis=1))
            if rows:
                every, twice, first = _repeated(np.concatenate(rows))
                found = every[twice & (every[:, 5] == 1)]
                yield from _blobs(0, found[:, 2] % buckets, found[:, 2:5])
                sent = every[first]
                sent[:, 5] = np.where(twice[first], 2, sent[:, 5])
                yield from _blobs(1, (sent[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64), sent)

    return run


def _by_key(batches):
    """The blobs of one key after another, joined; batches are sorted by key."""
    last, blobs = None, []
    for b in batches:
        for key, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if blobs and key != last:
                yield b"".join(blobs)
                blobs = []
            last = key
            blobs.append(blob.as_buffer().to_pybytes())
    if blobs:
        yield b"".join(blobs)


def _met(buckets: int):
    """Buckets of strings to marks by gram."""

    def run(batches):
        for blob in _by_key(batches):
            every, twice, _ = _repeated(np.frombuffer(blob, np.int64).reshape(-1, 6))
            found = every[twice & (every[:, 5] == 1)]
            yield from _blobs(0, found[:, 2] % buckets, found[:, 2:5])

    return run


def _gathered(batches):
    """Strings' marks by gram to ranges of fragments."""
    for blob in _by_key(batches):
        rows = np.unique(np.frombuffer(blob, np.int64).reshape(-1, 3), axis=0)
        edge = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1), [True]]))
        out = []
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            at = rows[x:y, 2]
            cut = np.flatnonzero(np.diff(at) > LENGTH) + 1
            out.append((int(rows[x, 0]), int(rows[x, 1]), [(int(p[0]), int(p[-1]) + LENGTH) for p in np.split(at, cut)]))
        yield _marked(out)


def _rewritten(batches):
    expand = zstandard.ZstdDecompressor()
    for b in sliced(batches):
        out = []
        for z, spans in zip(b.column(2), b.column(3).to_pylist(), strict=True):
            data = expand.decompress(z.as_py())
            merged: list[list[int]] = []
            for s in sorted((p["at"] + s["from"], p["at"] + s["to"]) for p in spans for s in p["marks"]):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            kept, last = [], 0
            for a, c in merged:
                kept.append(data[last:a])
                last = c
            kept.append(data[last:])
            left = b"".join(kept)
            out.append((sum(c - a for a, c in merged), len(merged), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))], ["d", "u", "n_removed", "n_spans", "kept_sha256", "kept"])


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, u, n_removed, n_spans, kept_sha256, kept) of the documents that lose bytes."""
    scratch = Scratch(docs.sparkSession, "suffix")
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("d"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("u")]
    texts = docs.filter(F.octet_length(text_col) >= LENGTH).select(F.col(text_col).alias("t"), *key)
    # copies lose all bytes; one of them stays in the work, for others to match
    digest = F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest")
    place = F.struct("d", "u")
    alike = texts.groupBy(digest).agg(F.count("*").alias("n"), F.min(place).alias("stays")).filter("n > 1").select("digest", "stays")
    copies = scratch.keep(texts.select(digest, "d", "u", F.octet_length("t").cast("long").alias("n")).join(alike, "digest").select("d", "u", "n", (place != F.col("stays")).alias("spare")), "copies")
    grams = scratch.keep(texts.mapInArrow(frugal(_gram_places), "h long, d long, u long, n int"), "grams")
    shared = grams.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    wanted = grams.join(shared, "h").groupBy("d", "u").agg(F.collect_set("h").alias("hs"))
    wanted = wanted.join(copies.filter("spare").select("d", "u").distinct(), ["d", "u"], "left_anti")
    held = scratch.keep(texts.mapInArrow(frugal(_packed), "d long, u long, z binary").join(wanted, ["d", "u"]).dropDuplicates(["d", "u"]), "held")
    scratch.drop("grams")
    places = scratch.keep(held.mapInArrow(frugal(_fragments), "h long, f long, d long, u long, at long, size long, again boolean"), "places")
    kinds = places.groupBy("h", "f").agg(F.count("*").alias("n"), F.min("size").alias("size"), F.max("again").alias("again"), F.min(F.struct("d", "u", "at")).alias("first"))
    kinds = scratch.keep(kinds, "kinds")
    # a gram whose fragments all have two places needs no index, nor does one with a single fragment that is not in itself again
    wants = kinds.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.max(F.col("again") & (F.col("n") == 1)).alias("own"), F.sum("size").alias("bytes"))
    wants = scratch.keep(wants.filter("(m > 1 and least = 1) or own").select("h", "bytes", (F.col("bytes") > DENSE).alias("dense")), "wants")
    crowd = wants.filter("dense").agg(F.sum("bytes")).first()[0] or 0
    pick = F.collect_list(F.struct("h", "f", F.col("first.at").alias("at"), "size", "n", "dense")).alias("picks")
    picks = kinds.join(wants.drop("bytes"), "h").groupBy(F.col("first.d").alias("d"), F.col("first.u").alias("u")).agg(pick)
    parts = held.select("d", "u", "z").join(picks, ["d", "u"]).select("z", "picks").mapInArrow(frugal(_cut), "h long, f long, part binary, n long, dense boolean")
    if crowd:
        parts = scratch.keep(parts, "parts")
    fields = ["h", "f", "part", "n"]
    marks = (parts.filter("not dense") if crowd else parts).select(*fields).repartition("h").sortWithinPartitions("h", "f").mapInArrow(frugal(_indexed), MARKS)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("size").alias("to"))).alias("marks")
    marks = marks.unionByName(kinds.filter("n > 1").select("h", "f", whole))
    if crowd:
        buckets = -(-crowd * 48 // BUCKET)
        blobs = "kind int, key long, blob binary"
        strings = scratch.keep(parts.filter("dense").select(*fields).mapInArrow(frugal(_strings(buckets)), blobs), "strings")
        dealt = lambda df: df.select("key", "blob").repartition("key").sortWithinPartitions("key")
        told = strings.filter("kind = 0").unionByName(dealt(strings.filter("kind = 1")).mapInArrow(frugal(_met(buckets)), blobs))
        marks = marks.unionByName(dealt(told).mapInArrow(frugal(_gathered), MARKS))
    marks = scratch.keep(marks, "marks")
    spans = places.select("h", "f", "d", "u", "at").join(marks, ["h", "f"]).groupBy("d", "u").agg(F.collect_list(F.struct("at", "marks")).alias("spans"))
    spans = spans.join(copies.select("d", "u").distinct(), ["d", "u"], "left_anti")
    out = held.select("d", "u", "z").join(spans, ["d", "u"]).mapInArrow(frugal(_rewritten), "d long, u long, n_removed long, n_spans long, kept_sha256 string, kept string")
    none = F.sha2(F.lit("").cast("binary"), 256)
    gone = copies.select("d", "u", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), none.alias("kept_sha256"), F.lit("").alias("kept")).distinct()
    return out.unionByName(gone)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: bytes, removed bytes and spans, digest of what is left."""
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("d"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("u")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *key, F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("_whole"))
    lost = marked(docs, id_col, text_col).drop("kept")
    none = F.lit(0).cast("long")
    return rows.join(lost, ["d", "u"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "_whole").alias("kept_sha256"))


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the marked bytes taken out of their texts; bytes that no longer form UTF-8 at a cut are dropped."""
    names = docs.columns
    keyed = docs.withColumns({"_d": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "_u": F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))})
    lost = marked(docs, id_col, text_col).select(F.col("d").alias("_d"), F.col("u").alias("_u"), F.col("kept").alias("_kept"))
    return keyed.join(lost, ["_d", "_u"], "left").withColumn(text_col, F.coalesce("_kept", F.col(text_col))).select(*names)
