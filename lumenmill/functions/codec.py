"""Images in pure Python: PNG of every depth and colour type, and what other decoders there are."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .bmp import decode_bmp
from .formats import UnsupportedFormat
from .jpeg import decode_jpeg

SIGNATURE = b"\x89PNG\r\n\x1a\n"


CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
# First row and column, and the steps between them, of the interlaced passes.
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray, level: int = 1) -> bytes:
    """RGB or RGBA bytes to a PNG file."""
    if pixels.dtype != np.uint8 or pixels.ndim != 3 or pixels.shape[2] not in (3, 4):
        raise ValueError(f"a PNG needs uint8 pixels of 3 or 4 channels, got {pixels.dtype} {pixels.shape}")
    h, w, c = pixels.shape
    rows = np.zeros((h, w * c + 1), np.uint8)
    rows[:, 1:] = pixels.reshape(h, w * c)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 6, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _guessed(line: list[int], above: list[int], step: int, mean: bool) -> list[int]:
    """A row under the average or Paeth filter, byte by byte (each needs the one before it)."""
    for k in range(step):
        left = corner = 0
        for x in range(k, len(line), step):
            up = above[x]
            if mean:
                guess = (left + up) >> 1
            else:
                a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                guess = left if a <= b and a <= c else up if b <= c else corner
            left = line[x] = (line[x] + guess) & 255
            corner = up
    return line


def _unfilter(raw: np.ndarray, h: int, stride: int, step: int) -> np.ndarray:
    out, above = np.zeros((h, stride), np.uint8), np.zeros(stride, np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 1:
            line = line.reshape(-1, step).cumsum(axis=0).ravel() & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            line = np.array(_guessed(raw[y, 1:].tolist(), above.tolist(), step, kind == 3), np.int64)
        elif kind:
            raise ValueError(f"unknown PNG filter {kind}")
        out[y] = above = line
    return out


def _samples(raw: np.ndarray, h: int, w: int, c: int, depth: int) -> tuple[np.ndarray, int]:
    """One image or pass: its samples (h, w, c), and the bytes it took."""
    stride = (w * c * depth + 7) // 8
    taken = h * (stride + 1)
    rows = _unfilter(raw[:taken].reshape(h, stride + 1), h, stride, max(1, c * depth // 8))
    if depth == 16:
        rows = np.ascontiguousarray(rows).view(">u2")
    elif depth < 8:
        rows = np.unpackbits(rows, axis=1).reshape(h, -1, depth) @ (1 << np.arange(depth)[::-1])
    return rows[:, : w * c].reshape(h, w, c).astype(np.uint16), taken


def decode_png(data: bytes) -> np.ndarray:
    """A PNG file to (height, width, 4) RGBA; opaque where it has no alpha. 16 bits keep their upper 8."""
    if not data.startswith(SIGNATURE):
        raise UnsupportedFormat("not a PNG file")
    at, body, palette, alpha, head = 8, [], None, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        at += n + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = part
        elif kind == b"IDAT":
            body.append(part)
    if head is None or head[2] not in DEPTHS.get(head[3], ()) or head[6] > 1:
        raise UnsupportedFormat("the PNG file's head names no known kind")
    w, h, depth, kind = head[:4]
    c, raw = CHANNELS[kind], np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if head[6]:
        x = np.zeros((h, w, c), np.uint16)
        for y0, x0, down, across in PASSES:
            part = x[y0::down, x0::across]
            if part.size:
                part[...], taken = _samples(raw, *part.shape[:2], c, depth)
                raw = raw[taken:]
    else:
        x, _ = _samples(raw, h, w, c, depth)
    out = np.full((h, w, 4), 255, np.uint8)
    if kind == 3:
        out[..., :3] = palette[x[..., 0]]
        table = np.full(256, 255, np.uint8)
        table[: len(alpha)] = np.frombuffer(alpha, np.uint8)
        out[..., 3] = table[x[..., 0]]
        return out
    if alpha and kind in (0, 2):
        out[..., 3] = np.where((x == np.frombuffer(alpha, ">u2")).all(axis=2), 0, 255)
    x = x >> 8 if depth == 16 else x * (255 // ((1 << depth) - 1))
    out[..., :3] = x[..., :1] if c < 3 else x[..., :3]
    if c in (2, 4):
        out[..., 3] = x[..., -1]
    return out


def decode_image(data: bytes) -> np.ndarray:
    """A PNG, JPEG or BMP file, told by its first bytes, to (height, width, 4) RGBA."""
    if data.startswith(SIGNATURE):
        return decode_png(data)
    if data.startswith(b"\xff\xd8\xff"):
        return decode_jpeg(data)
    if data.startswith(b"BM"):
        return decode_bmp(data)
    raise UnsupportedFormat("not a PNG, JPEG or BMP file")
