"""JPEG in pure Python and numpy: baseline, extended and progressive Huffman files of 8 bits.

Coefficients are read bit by bit into one array a component; the inverse
transform, upsampling and colours run on whole planes.
"""

from __future__ import annotations

import struct
from array import array
from dataclasses import dataclass, field

import numpy as np

from .formats import UnsupportedFormat


def _diagonal(i: int) -> tuple[int, int]:
    y, x = divmod(i, 8)
    return y + x, y if (y + x) % 2 else x


ZIGZAG = sorted(range(64), key=_diagonal)
WAVES = np.sqrt(np.where(np.arange(8) == 0, 1, 2) / 8)[:, None] * np.cos((2 * np.arange(8)[None] + 1) * np.arange(8)[:, None] * np.pi / 16)


@dataclass
class Component:
    name: int
    across: int
    down: int
    table: int
    wide: int = 0  # blocks a row, whole units
    width: int = 0  # pixels that count
    height: int = 0
    values: array = field(default_factory=lambda: array("i"))


class Bits:
    """A stretch of coded bits, read from the front; zeros follow its end."""

    def __init__(self, data: bytes):
        plain = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + bytes(4), np.uint8).astype(np.int64)
        self.words = (plain[:-3] << 24 | plain[1:-2] << 16 | plain[2:-1] << 8 | plain[3:]).tolist()
        self.at, self.most = 0, 8 * len(self.words) + 512

    def take(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return self._word(at) >> 32 - (at & 7) - n & (1 << n) - 1

    def _word(self, at: int) -> int:
        k = at >> 3
        if k < len(self.words):
            return self.words[k]
        if at > self.most:
            raise ValueError("the JPEG file is cut short")
        return 0

    def symbol(self, codes: list[int]) -> int:
        """Codes by their next 16 bits: length and symbol in one number."""
        at = self.at
        found = codes[self._word(at) >> 16 - (at & 7) & 0xFFFF]
        if not found:
            raise ValueError("the JPEG file has an unknown code")
        self.at = at + (found >> 8)
        return found & 255

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.take(n)
        return v if v >> n - 1 else v - (1 << n) + 1


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    out, k = [], 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out += [length << 8 | symbols[k]] * (1 << 16 - length)
            k += 1
    return (out + [0] * (65536 - len(out)))[:65536]


@dataclass
class Scan:
    """One scan's share of the coefficients: places first..last, bits above ``low``."""

    first: int
    last: int
    high: int
    low: int
    run: int = 0

    def whole(self, bits: Bits, values: array, base: int, dc, ac, before: int) -> int:
        before += bits.signed(bits.symbol(dc))
        values[base] = before
        k = 1
        while k < 64:
            run, size = divmod(bits.symbol(ac), 16)
            if not size and run < 15:
                break
            k += run
            if size:
                if k > 63:
                    raise ValueError("the JPEG file has a block that is too long")
                values[base + ZIGZAG[k]] = bits.signed(size)
            k += 1
        return before

    def mean(self, bits: Bits, values: array, base: int, dc, before: int) -> int:
        if self.high:
            values[base] |= bits.take(1) << self.low
            return before
        before += bits.signed(bits.symbol(dc))
        values[base] = before * (1 << self.low)
        return before

    def fresh(self, bits: Bits, values: array, base: int, ac) -> None:
        if self.run:
            self.run -= 1
            return
        k = self.first
        while k <= self.last:
            run, size = divmod(bits.symbol(ac), 16)
            if not size and run < 15:
                self.run = (1 << run) - 1 + bits.take(run)
                return
            k += run
            if size:
                if k > 63:
                    raise ValueError("the JPEG file has a block that is too long")
                values[base + ZIGZAG[k]] = bits.signed(size) * (1 << self.low)
            k += 1

    def finer(self, bits: Bits, values: array, base: int, ac) -> None:
        """One more bit of what is there, and values that now first show."""
        k, step = self.first, 1 << self.low
        while k <= self.last:
            new, gap = 0, 64
            if not self.run:
                gap, size = divmod(bits.symbol(ac), 16)
                if size:
                    new = step if bits.take(1) else -step
                elif gap < 15:
                    self.run, gap = (1 << gap) + bits.take(gap), 64
            while k <= self.last:
                at = base + ZIGZAG[k]
                if values[at]:
                    if bits.take(1):
                        values[at] += step if values[at] > 0 else -step
                elif gap == 0:
                    values[at] = new
                    k += 1
                    break
                else:
                    gap -= 1
                k += 1
        if self.run:
            self.run -= 1


def _units(parts: list[Component], across: int, down: int):
    """Blocks of each unit in coded order: (which component, where its values start)."""
    if len(parts) == 1:
        c = parts[0]
        for y in range(-(-c.height // 8)):
            for x in range(-(-c.width // 8)):
                yield [(0, (y * c.wide + x) * 64)]
        return
    for y in range(down):
        for x in range(across):
            yield [(k, ((y * c.down + v) * c.wide + x * c.across + h) * 64) for k, c in enumerate(parts) for v in range(c.down) for h in range(c.across)]


def _split(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Coded stretches between restart marks, and where the next other mark is."""
    found, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*found, data[start:]], len(data)
        kind = data[at + 1]
        if 0xD0 <= kind <= 0xD7:
            found.append(data[start:at])
            start = at + 2
        elif kind not in (0, 0xFF):
            return [*found, data[start:at]], at
        at += 1 if kind == 0xFF else 2


def _double(x: np.ndarray, axis: int) -> np.ndarray:
    """Twice as many samples, each three parts of the nearer and one of the farther."""
    x = np.moveaxis(x, axis, 0)
    before, after = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-1:]])
    return np.moveaxis(np.stack([(before + 3 * x) / 4, (after + 3 * x) / 4], 1).reshape(-1, *x.shape[1:]), 0, axis)


def _plane(c: Component, table: np.ndarray, across: int, down: int, h: int, w: int) -> np.ndarray:
    blocks = np.frombuffer(c.values, np.int32).reshape(-1, 8, 8) * table
    pixels = np.clip(np.rint(WAVES.T @ blocks @ WAVES + 128), 0, 255)
    x = pixels.reshape(-1, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(-1, c.wide * 8)[: c.height, : c.width]
    # planes of two columns or fewer are repeated, as common decoders do
    for axis, times, n in ((0, down / c.down, h), (1, across / c.across, w)):
        x = _double(x, axis) if times == 2 and c.width > 2 else x.take((np.arange(n) / times).astype(int).clip(0, x.shape[axis] - 1), axis)
    return x[:h, :w]


def _colours(planes: list[np.ndarray], names: list[int], transform: int | None) -> np.ndarray:
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, 2)
    x = np.stack(planes, 2)
    if transform in (1, 2) or transform is None and len(planes) == 3 and bytes(names) != b"RGB":
        y, b, r = x[..., 0], x[..., 1] - 128, x[..., 2] - 128
        x[..., :3] = np.clip(np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], 2), 0, 255)
    if len(planes) == 4:  # the four inks are stored upside down where a transform is named
        light = x if transform is not None else 255 - x
        x = light[..., :3] * light[..., 3:] / 255
    return x[..., :3]


def decode_jpeg(data: bytes) -> np.ndarray:
    """A JPEG file to (height, width, 4) RGBA, opaque."""
    at, quantities, codes, parts, interval, transform, progressive = 2, {}, {}, None, 0, None, False
    h = w = most_across = most_down = units_across = units_down = 0
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] in (0, 0xFF):
            at += 1
            continue
        kind = data[at + 1]
        if kind == 0xD9:
            break
        if kind == 1 or 0xD0 <= kind <= 0xD8:
            at += 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quantities[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(int)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body.startswith(b"Adobe"):
            transform = body[11]
        elif kind in (0xC0, 0xC1, 0xC2):
            bits, h, w, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not h or not w or n not in (1, 3, 4):
                raise UnsupportedFormat("only JPEG files of 8 bits and 1, 3 or 4 planes are read")
            progressive = kind == 0xC2
            parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            most_across, most_down = max(c.across for c in parts), max(c.down for c in parts)
            units_across, units_down = -(-w // (8 * most_across)), -(-h // (8 * most_down))
            for c in parts:
                c.wide = units_across * c.across
                c.width, c.height = -(-w * c.across // most_across), -(-h * c.down // most_down)
                c.values = array("i", bytes(4 * 64 * c.wide * units_down * c.down))
        elif 0xC3 <= kind <= 0xCF and kind != 0xC8:
            raise UnsupportedFormat("lossless and arithmetic JPEG files are not read")
        elif kind == 0xDA:
            if parts is None:
                raise ValueError("the JPEG file has a scan before its frame")
            n = body[0]
            chosen = [(next(c for c in parts if c.name == body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
            scan = Scan(body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15)
            stretches, at = _split(data, at)
            _read(scan, chosen, codes, stretches, interval, units_across, units_down, progressive)
    if parts is None:
        raise ValueError("the JPEG file has no frame")
    planes = []
    for c in parts:
        table = np.zeros(64, int)
        table[ZIGZAG] = quantities[c.table]
        planes.append(_plane(c, table.reshape(8, 8), most_across, most_down, h, w))
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = np.rint(_colours(planes, [c.name for c in parts], transform))
    return out


def _read(scan: Scan, chosen, codes, stretches: list[bytes], interval: int, across: int, down: int, progressive: bool) -> None:
    before, left, rest = [0] * len(chosen), interval, iter(stretches)
    bits = Bits(next(rest))
    for unit in _units([c for c, _, _ in chosen], across, down):
        if interval and not left:
            if (more := next(rest, None)) is None:
                raise ValueError("the JPEG file is cut short")
            bits, before, scan.run, left = Bits(more), [0] * len(chosen), 0, interval
        left -= 1
        for k, base in unit:
            c, dc, ac = chosen[k]
            if not progressive:
                before[k] = scan.whole(bits, c.values, base, codes[dc], codes[16 + ac], before[k])
            elif scan.first == 0:
                before[k] = scan.mean(bits, c.values, base, codes.get(dc), before[k])
            elif scan.high:
                scan.finer(bits, c.values, base, codes[16 + ac])
            else:
                scan.fresh(bits, c.values, base, codes[16 + ac])
