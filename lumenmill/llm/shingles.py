"""Sets of hashed 5-word shingles, by numpy over whole batches."""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers of the polynomial and mixing hashes.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
WIDTH = 5
#: Highest level of a common word.
TOP = 12
#: By byte: whether it belongs to a word. By length: the bytes of a block that count.
_IN_WORD = np.array([k != 32 and not 9 <= k <= 13 for k in range(256)])
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ASCII-lower-cased bytes, and where they start.

    A word is read in blocks of eight bytes; each is mixed with a key of its
    place before the blocks are added up, so that no arrangement of the same
    letters cancels out, as it may in a polynomial modulo 2^64.
    """
    data = data.lower() + bytes(8)
    b = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_IN_WORD[b[:-8]], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    size = end - start
    eight = np.ndarray((len(b) - 7,), "<u8", data, strides=(1,))
    out = mix((eight[start] & _HEADS[np.minimum(size, 8)]) + _place(np.zeros(1, np.int64)))
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        of = np.repeat(np.arange(len(long)), more)
        first = np.cumsum(more) - more
        k = np.arange(len(of)) - first[of] + 1
        at, left = start[long][of] + 8 * k, size[long][of] - 8 * k
        blocks = mix((eight[at] & _HEADS[np.minimum(left, 8)]) + _place(k))
        out[long] += np.add.reduceat(blocks, first)
    return mix(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def _place(k: np.ndarray) -> np.ndarray:
    """The key of a word's k-th block."""
    return mix((k.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))


def _combined(words: np.ndarray, n: int, width: int) -> np.ndarray:
    """Hashes of all ``width`` words in a row (n results)."""
    x = np.full(n, width * 0x2545F4914F6CDD1D & MASK, np.uint64)
    for k in range(width):
        x = mix(x + words[k : k + n]) * np.uint64(BASE)
    return x


class Rarity:
    """How common words are, so that a shingle's hash can sort by how common its words are.

    ``words``: sorted hashes of the most common words; ``level``: 0 for words
    that are not listed, rising with the logarithm of the count.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words = words[order]
        least = counts.min() if len(counts) else 1
        self.level = np.minimum(1 + np.log2(counts[order] / least), TOP).astype(np.int64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.level[at], 0)


def _ordered(runs: np.ndarray, levels: np.ndarray, width: int) -> np.ndarray:
    """Hashes whose top bits are the sum of the words' levels: rare wording sorts first."""
    total = np.concatenate([[0], np.cumsum(levels)])
    group = (total[width:] - total[:-width])[: len(runs)] * 63 // (TOP * width)
    return runs >> np.uint64(6) | group.astype(np.uint64) << np.uint64(58)


def text_words(texts: list[str], letters: int = 500_000):
    """Word hashes of the texts, some texts at a time."""
    for part in _portions(texts, letters):
        yield word_hashes(b"\n".join([t.encode("utf-8", "surrogatepass") for t in part]))[0]


def _portions(texts: list[str], letters: int):
    start = 0
    while start < len(texts):
        stop, total = start, 0
        while stop < len(texts) and (stop == start or total + len(texts[stop]) < letters):
            total += len(texts[stop])
            stop += 1
        yield texts[start:stop]
        start = stop


def shingle_sets(texts: list[str], rarity: Rarity | None = None, width: int = WIDTH, letters: int = 500_000):
    """For each text its sorted distinct shingle hashes; a shorter text is one shingle."""
    for part in _portions(texts, letters):
        encoded = [t.encode("utf-8", "surrogatepass") for t in part]
        ends = np.cumsum([len(e) + 1 for e in encoded])
        words, at = word_hashes(b"\n".join(encoded) + b"\n")
        last = np.searchsorted(at, ends)
        runs = _combined(words, max(0, len(words) - width + 1), width)
        if rarity is not None and len(runs):
            runs = _ordered(runs, rarity.of(words), width)
        first = 0
        for stop_word in last.tolist():
            n = stop_word - first
            if n >= width:
                yield np.unique(runs[first : stop_word - width + 1])
            elif n:
                yield _combined(words[first:stop_word], 1, n)
            else:
                yield np.zeros(0, np.uint64)
            first = stop_word
