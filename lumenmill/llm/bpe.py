"""Exact BPE by a dynamic program over prefixes, and decoding.

For every prefix of a word the BPE encoding ends in one token only. The tokens
that end at a position come from a suffix automaton of the vocabulary: the word
is streamed through it and the suffix links of the state reached name every
vocabulary entry that is a suffix of the prefix. Of these, the one that is
compatible with the last token of the prefix before it is kept; following these
back-pointers from the end gives the ids. No merge is ever simulated.

Two tokens are compatible if no merge across their border would have come
before the merges that built them (see ``Vocabulary.compatible``).

The vocabulary is BPE with word ends: lower-cased NFC text, white space
dropped, letters, single digits and runs of other marks as words. Strings of
the special tokens in a text become their ids, as the file's library does.
Without a decoder in the file, decoding joins the tokens' strings by spaces.

Cases: null and empty texts give no ids; texts of any length are encoded
whole in linear time; repeated rows, null ids and other columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, frugal, sliced, trim

#: Entries in each of the two generations of a worker's memo of words and chunks, and the longest that it holds.
MEMO, MEMO_LENGTH = 130_000, 48
#: Unicode white space (White_Space=yes).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Capitals that the library makes small though Python doesn't know them yet (first, last, distance).
NEWER = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
CAPITALS = {k: chr(k + by) for first, last, by in NEWER for k in range(first, last + 1)}
CAPITAL = re.compile("[" + "".join(map(chr, CAPITALS)) + "]")
#: Code points beyond which there are no letters or numbers.
LETTERS_END = 0x32400


#: Letters and numbers of Unicode 16, which the library knows and Python's tables (15.1) don't.
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CC, 0xA7CD), (0xA7DA, 0xA7DB), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


def _class(kind: str, newer: list[tuple[int, int]]) -> str:
    """Ranges of the code points of a general category, for a pattern's brackets."""
    edges, last = [], False
    for k in range(LETTERS_END + 1):
        held = k < LETTERS_END and unicodedata.category(chr(k))[0] == kind
        if held != last:
            edges.append(k)
            last = held
    ranges = [(a, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)] + newer
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


@functools.cache
def word_pattern() -> re.Pattern:
    letters, numbers = _class("L", NEWER_LETTERS), _class("N", NEWER_NUMBERS)
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


#: What str.split() takes for white space though Unicode doesn't.
ODD = re.compile(r"[\x1c-\x1f]")
END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tokens by merge rank, their suffix automaton, and pair compatibility."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids, self.special = model["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        names = [*letters, *(c + END for c in letters)]
        self.names, self.parts, symbols = names, [None] * len(names), [(k,) for k in range(len(names))]
        number = {n: k for k, n in enumerate(names)}
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = number[left], number[right]
            number[left + right] = self.merged[a, b] = len(names)
            names.append(left + right)
            self.parts.append((a, b))
            symbols.append(symbols[a] + symbols[b])
        self.text_id = [str(self.ids[n]) for n in names]
        self.pairs: dict[int, bool] = {}
        self._automaton(symbols)

    def _automaton(self, tokens: list[tuple[int, ...]]) -> None:
        """The suffix automaton of all tokens, grown over their trie breadth first."""
        trie, leaf = [{}], [None]
        for t, word in enumerate(tokens):
            at = 0
            for c in word:
                if c not in trie[at]:
                    trie[at][c] = len(trie)
                    trie.append({})
                    leaf.append(None)
                at = trie[at][c]
            leaf[at] = t
        step, link, size = [{}], [-1], [0]
        place, queue = [0] * len(trie), [0]
        for node in queue:
            for c, child in trie[node].items():
                place[child] = self._extend(step, link, size, place[node], c)
                queue.append(child)
        ends: list[list[tuple[int, int]]] = [[] for _ in step]
        for node, t in enumerate(leaf):
            if t is not None:
                ends[place[node]].append((len(tokens[t]), t))
        #: chain[v]: (length, token) of all tokens that are suffixes of v's strings, longest first
        chain: list[tuple] = [()] * len(step)
        for v in sorted(range(len(step)), key=size.__getitem__):
            own = tuple(sorted(ends[v], reverse=True))
            chain[v] = own + chain[link[v]] if v and own else chain[link[v]] if v else ()
        self.step, self.link, self.size, self.chain = step, link, size, chain

    @staticmethod
    def _extend(step, link, size, last, c) -> int:
        if c in step[last]:
            q = step[last][c]
            if size[q] == size[last] + 1:
                return q
            new = None
        else:
            new = len(step)
            step.append({})
            link.append(0)
            size.append(size[last] + 1)
        p = last
        while new is not None and p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p == -1:
            return new
        q = step[p][c]
        if size[q] == size[p] + 1:
            target = q
        else:
            target = len(step)
            step.append(dict(step[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            link[q] = target
            while p != -1 and step[p].get(c) == q:
                step[p][c] = target
                p = link[p]
        if new is None:
            return target
        link[new] = target
        return new

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of a token while it is built: (token, merge that takes it)."""
        out, taken = [(token, math.inf)], token
        while parts := self.parts[taken]:
            out.append((parts[side], taken))
            taken = parts[side]
        return out

    def compatible(self, a: int, b: int) -> bool:
        """True if BPE leaves a and b apart when they stand side by side.

        Numbers rise with merge rank. A merge over the border happens where its
        number is below that of the merge that takes its left part inside a,
        and not above that of the merge that takes its right part inside b (for
        equal merges the left one goes first).
        """
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            right = self._spine(b, 0)
            known = self.pairs[key] = not any((m := self.merged.get((x, y))) is not None and m < gone and m <= taken for x, gone in self._spine(a, 1) for y, taken in right)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Token numbers (merge ranks, not ids) of one pre-tokenised word."""
        data = word.encode()
        step, link, size, chain, compatible, pairs = self.step, self.link, self.size, self.chain, self.compatible, self.pairs
        last = [-1] * (len(data) + 1)
        back = [0] * (len(data) + 1)
        state = length = 0
        final = len(data) - 1
        for i, c in enumerate(data):
            if i == final:
                c += 256
            while c not in step[state]:
                state = link[state]
                length = size[state]
            state, length = step[state][c], length + 1
            for n, t in chain[state]:
                j = i + 1 - n
                if n <= length:
                    if j:
                        fits = pairs.get(last[j] << 20 | t)
                        if not (compatible(last[j], t) if fits is None else fits):
                            continue
                    last[i + 1], back[i + 1] = t, j
                    break
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i = back[i]
        return out[::-1]


class Encoder:
    """Texts to ids joined by spaces, and back; remembers the ids of words and of chunks between spaces."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.split = re.compile("(" + "|".join(map(re.escape, self.v.special)) + ")") if self.v.special else None
        self.pattern = word_pattern()
        self.name = {i: n for i, n in zip(self.v.text_id, self.v.names, strict=True)} | {str(i): n for n, i in self.v.special.items()}
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _found(self, chunk: str, split: bool) -> str:
        """A chunk between spaces, or a word of one (a chunk that is one word is the same to the memo)."""
        found = self.memo.get(chunk) or self.older.get(chunk)
        if found is None:
            words = self.pattern.findall(chunk) if split else [chunk]
            if len(words) == 1:
                text_id = self.v.text_id
                found = " ".join([text_id[t] for t in self.v.encode_word(words[0])])
            else:
                found = " ".join([self.memo.get(w) or self._found(w, False) for w in words])
        if len(chunk) < MEMO_LENGTH:
            if len(self.memo) >= MEMO:  # what is met again moves to the newer generation, the rest is forgotten
                self.older, self.memo = self.memo, {}
            self.memo[chunk] = found
        return found

    def encode(self, text: str) -> str:
        parts = self.split.split(text) if self.split and "<|" in text else [text]
        found = []
        for k, part in enumerate(parts):
            if k % 2:
                found.append(str(self.v.special[part]))
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower case letter by letter
                    if CAPITAL.search(part):
                        part = part.translate(CAPITALS)
                part = part.lower()
                chunks = [part] if ODD.search(part) else part.split()
                found += [self.memo.get(c) or self._found(c, True) for c in chunks]
        return " ".join(filter(None, found))

    def decode(self, ids: str) -> str:
        """The tokens' strings, joined by spaces."""
        name = self.name
        return " ".join([name[i] for i in ids.split(" ")]) if ids else ""


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    own = Encoder(path)
    KEPT["encoder"] = encoder.cache_clear
    trim()  # what building it took
    return own


def tokenize(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: token count and digests; with ``with_ids`` the ids and the decoded text too."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_ids else []
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches):
        own = encoder(vocabulary)
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1):
                ids = own.encode(text.as_py() or "")
                decoded = own.decode(ids)
                row = [ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append(row + ([[*map(int, ids.split())], decoded] if with_ids else []))
            columns = [batch.column(0), *([pa.array(list(c), f[1]) for c, f in zip(zip(*rows, strict=True), fields[1:], strict=True)] if rows else [pa.array([], f[1]) for f in fields[1:]])]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run, "encoder"), schema)
