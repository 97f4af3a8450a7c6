"""Batches of texts as code-point arrays, for numpy."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

POINTS = 0x110000


@functools.cache
def lower_letters() -> np.ndarray:
    """Code point to that of the lower-case letter, 0 where it is no letter."""
    out = np.zeros(POINTS, np.uint32)
    for p in range(POINTS):
        c = chr(p)
        if c.isalpha():
            low = c.lower()
            out[p] = ord(low) if len(low) == 1 else p
    return out


@functools.cache
def latin_letters() -> np.ndarray:
    """Code point to 1..26 for a letter based on a..z, else 0."""
    out = np.zeros(POINTS, np.uint8)
    for p in range(0x2000):
        base = unicodedata.normalize("NFKD", chr(p)).lower()[:1]
        base = {"ß": "s", "æ": "a", "ø": "o", "œ": "o", "ł": "l", "đ": "d"}.get(chr(p).lower(), base)
        if "a" <= base <= "z":
            out[p] = ord(base) - 96
    return out


#: Classes of ``char_classes``.
LOWER, UPPER, DIGIT, SPACE, LINE, COMMON, SYMBOL = range(7)


@functools.cache
def char_classes() -> np.ndarray:
    """Code point to one of the seven classes."""
    out = np.full(POINTS, SYMBOL, np.uint8)
    for p in range(POINTS):
        c = chr(p)
        if c.isalpha():
            out[p] = UPPER if c.isupper() else LOWER
        elif c.isdigit():
            out[p] = DIGIT
        elif c.isspace():
            out[p] = LINE if c == "\n" else SPACE
    out[[ord(c) for c in ".,;:!?'\"()-"]] = COMMON
    return out


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points, each text with a line end before and after; the row of each point."""
    joined = "".join([f"\n{t}\n" for t in texts])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])


def chunks(texts: list[str], rows: int = 64, letters: int = 1_000_000):
    """Slices of the list with so many texts or letters at most (one text at least)."""
    start = total = 0
    for k, t in enumerate(texts):
        if k > start and (k - start >= rows or total + len(t) > letters):
            yield start, texts[start:k]
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield start, texts[start:]
