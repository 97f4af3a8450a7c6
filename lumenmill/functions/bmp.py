"""BMP: uncompressed files of 1, 4, 8, 24 and 32 bits a pixel."""

from __future__ import annotations

import struct

import numpy as np

from .formats import UnsupportedFormat


def decode_bmp(data: bytes) -> np.ndarray:
    """A BMP file to (height, width, 4) RGBA, opaque."""
    start, head = struct.unpack("<I", data[10:14])[0], struct.unpack("<I", data[14:18])[0]
    if head < 40:
        raise UnsupportedFormat("BMP files with the oldest head are not read")
    w, h, _, depth, packing = struct.unpack("<iiHHI", data[18:34])
    # packing 3 names the places of the planes; only the usual ones are read
    usual = packing == 0 or packing == 3 and depth == 32 and struct.unpack("<3I", data[54:66]) == (0xFF0000, 0xFF00, 0xFF)
    if depth not in (1, 4, 8, 24, 32) or not usual or w <= 0 or not h:
        raise UnsupportedFormat(f"BMP files of {depth} bits and packing {packing} are not read")
    stride = (w * depth + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, start).reshape(abs(h), stride)
    if h > 0:
        rows = rows[::-1]
    out = np.full((abs(h), w, 4), 255, np.uint8)
    if depth >= 24:
        out[..., :3] = rows[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[..., 2::-1]
    else:
        n = struct.unpack("<I", data[46:50])[0] or 1 << depth
        palette = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)
        places = np.unpackbits(rows, axis=1).reshape(abs(h), -1, depth)[:, :w] @ (1 << np.arange(depth)[::-1])
        out[..., :3] = palette[places][..., 2::-1]
    return out
