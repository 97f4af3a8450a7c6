"""Pixel kernels of the catalogue: (pixels, generator, parameters) -> pixels.

Pixels are uint8 (height, width, planes). Kernels draw only from the generator
they are given. The arithmetic follows the parameters' meaning and published
descriptions of the effects; it is not meant to equal any library bit by bit.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

KERNELS = {}
PAD = {"constant": "constant", "replicate": "edge", "reflect": "symmetric", "wrap": "wrap", "reflect_101": "reflect"}


def kernel(f):
    KERNELS[f.__name__.rstrip("_")] = f
    return f


# --- helpers -----------------------------------------------------------------


def pair(value, symmetric: bool = False) -> tuple[float, float]:
    """A pair as it is; a number as a fixed magnitude, or around 0 for limits."""
    if isinstance(value, (list, tuple)):
        return value[0], value[1]
    return (-abs(value), abs(value)) if symmetric else (value, value)


def draw(r, value, symmetric: bool = False) -> float:
    low, high = pair(value, symmetric)
    return float(r.uniform(low, high))


def draw_int(r, value, symmetric: bool = False) -> int:
    low, high = pair(value, symmetric)
    return int(r.integers(int(low), int(high) + 1))


def draw_odd(r, value) -> int:
    low, high = pair(value)
    return int(r.integers(int(low) // 2, (int(high) - 1) // 2 + 1)) * 2 + 1


def clip(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def lut(x: np.ndarray, f) -> np.ndarray:
    return clip(f(np.arange(256, dtype=float)))[x]


def grid(shape) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[: shape[0], : shape[1]]
    return y.astype(float), x.astype(float)


def _index(i: np.ndarray, n: int, border: str) -> tuple[np.ndarray, np.ndarray | None]:
    if border == "constant":
        return np.clip(i, 0, n - 1), (i >= 0) & (i < n)
    if border == "wrap":
        return i % n, None
    if border == "replicate" or n == 1:
        return np.clip(i, 0, n - 1), None
    if border == "reflect":
        i = i % (2 * n)
        return np.where(i < n, i, 2 * n - 1 - i), None
    i = np.abs(i) % (2 * n - 2)
    return np.where(i < n, i, 2 * n - 2 - i), None


def _weights(t: np.ndarray, taps: int) -> np.ndarray:
    """Weights at offsets 1 - taps/2 .. taps/2 for a fraction t: linear, cubic (a = -0.75) or Lanczos."""
    d = np.abs(t[..., None] - np.arange(1 - taps // 2, taps // 2 + 1))
    if taps == 2:
        w = np.maximum(0, 1 - d)
    elif taps == 4:
        a = -0.75
        w = np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, np.where(d < 2, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a, 0))
    else:
        w = np.where(d < taps / 2, np.sinc(d) * np.sinc(d / (taps / 2)), 0)
    return w / w.sum(axis=-1, keepdims=True)


def sample(x: np.ndarray, sy: np.ndarray, sx: np.ndarray, how: str = "bilinear", border: str = "constant", fill: float = 0) -> np.ndarray:
    """Pixels at real coordinates."""
    taps = {"nearest": 1, "bilinear": 2, "area": 2, "bicubic": 4, "lanczos": 8}[how]
    h, w = x.shape[:2]
    if taps == 1:
        iy, oky = _index(np.rint(sy).astype(int), h, border)
        ix, okx = _index(np.rint(sx).astype(int), w, border)
        out = x[iy, ix]
        return out if oky is None else np.where((oky & okx)[..., None], out, np.array(fill, x.dtype))
    fy, fx = np.floor(sy).astype(int), np.floor(sx).astype(int)
    wy, wx = _weights(sy - fy, taps), _weights(sx - fx, taps)
    out = np.zeros((*sy.shape, x.shape[2]))
    for a in range(taps):
        iy, oky = _index(fy + a + 1 - taps // 2, h, border)
        for b in range(taps):
            ix, okx = _index(fx + b + 1 - taps // 2, w, border)
            value = x[iy, ix].astype(float)
            if oky is not None:
                value = np.where((oky & okx)[..., None], value, fill)
            out += value * (wy[..., a] * wx[..., b])[..., None]
    return clip(out)


def resize(x: np.ndarray, h: int, w: int, how: str = "bilinear") -> np.ndarray:
    y = (np.arange(h) + 0.5) * x.shape[0] / h - 0.5
    z = (np.arange(w) + 0.5) * x.shape[1] / w - 0.5
    if how == "nearest":
        y, z = np.floor(y + 0.5), np.floor(z + 0.5)
    if how == "area" and h <= x.shape[0] and w <= x.shape[1]:
        edge_y, edge_x = np.linspace(0, x.shape[0], h + 1).astype(int), np.linspace(0, x.shape[1], w + 1).astype(int)
        total = np.pad(x.astype(float).cumsum(0).cumsum(1), ((1, 0), (1, 0), (0, 0)))
        y1, x1 = np.maximum(edge_y[1:], edge_y[:-1] + 1), np.maximum(edge_x[1:], edge_x[:-1] + 1)
        area = ((y1 - edge_y[:-1])[:, None] * (x1 - edge_x[:-1]))[..., None]
        return clip((total[y1][:, x1] - total[edge_y[:-1]][:, x1] - total[y1][:, edge_x[:-1]] + total[edge_y[:-1]][:, edge_x[:-1]]) / area)
    return sample(x, *np.meshgrid(y, z, indexing="ij"), how, "replicate")


def warp(x, p, dy, dx):
    """Gather at each pixel's place plus a displacement."""
    y, z = grid(x.shape)
    return sample(x, y + dy, z + dx, p["interpolation"], p.get("border_mode", "constant"), p.get("fill", 0))


def affine_(x, p, matrix: np.ndarray) -> np.ndarray:
    """Gather by the inverse of a 2x3 forward map about the centre, in (x, y)."""
    h, w = x.shape[:2]
    y, z = grid(x.shape)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    full = np.linalg.inv(np.vstack([matrix, [0, 0, 1]]))
    u, v = z - cx, y - cy
    return sample(x, full[1, 0] * u + full[1, 1] * v + full[1, 2] + cy, full[0, 0] * u + full[0, 1] * v + full[0, 2] + cx, p["interpolation"], p["border_mode"], p["fill"])


def turn(degrees: float, scale: float = 1.0, dx: float = 0.0, dy: float = 0.0) -> np.ndarray:
    a = np.deg2rad(degrees)
    return np.array([[scale * np.cos(a), scale * np.sin(a), dx], [-scale * np.sin(a), scale * np.cos(a), dy]])


def convolve(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Correlation with mirrored edges, as floats."""
    a, b = k.shape
    padded = np.pad(x.astype(float), ((a // 2, (a - 1) // 2), (b // 2, (b - 1) // 2), (0, 0)), mode="reflect" if min(x.shape[:2]) > max(a, b) // 2 else "symmetric")
    out = np.zeros(x.shape)
    for i, j in zip(*np.nonzero(k), strict=True):
        out += k[i, j] * padded[i : i + x.shape[0], j : j + x.shape[1]]
    return out


def along(x: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with one line of weights along an axis, mirrored edges, as floats.

    Blocks of lines times a band matrix: the work of the taps at the speed of a matrix product.
    """
    n = len(taps)
    lines = np.moveaxis(x.astype(float), axis, 0)
    shape = lines.shape
    lines = np.pad(lines.reshape(shape[0], -1), ((n // 2, (n - 1) // 2), (0, 0)), mode="reflect" if min(x.shape[:2]) > n // 2 else "symmetric")
    block = max(16, n)
    band = sliding_window_view(np.pad(taps, block - 1), block + n - 1)[::-1]
    out = np.empty((shape[0], lines.shape[1]))
    for start in range(0, shape[0], block):
        size = min(block, shape[0] - start)
        np.matmul(band[:size, : size + n - 1], lines[start : start + size + n - 1], out=out[start : start + size])
    return np.moveaxis(out.reshape(shape), 0, axis)


def gaussian(x: np.ndarray, sigma: float, size: int | None = None) -> np.ndarray:
    """Separable Gaussian blur, as floats."""
    if sigma <= 0:
        if not size or size < 3:
            return x.astype(float)
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    size = size or int(3.5 * sigma) * 2 + 1
    t = np.exp(-0.5 * ((np.arange(size) - size // 2) / sigma) ** 2)
    t /= t.sum()
    return along(along(x, t, 0), t, 1)


def field(r, h: int, w: int, size: int, roughness: float) -> np.ndarray:
    """A plasma field in 0..1: octaves of noise whose weight falls with frequency."""
    out, weight, n = np.zeros((h, w)), 1.0, 2
    while n <= max(2, min(size, 2 * max(h, w))):
        out += weight * resize((r.random((n, n, 1)) * 255).astype(np.uint8), h, w)[..., 0]
        weight *= 2 ** -min(roughness, 8) * 2
        n *= 2
    low, high = out.min(), out.max()
    return (out - low) / (high - low) if high > low else np.zeros((h, w))


def to_hsv(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees, saturation and value in 0..1."""
    a = x[..., :3] / 255.0
    v, low = a.max(axis=2), a.min(axis=2)
    d = np.where(v > low, v - low, 1)
    red, green, blue = a[..., 0], a[..., 1], a[..., 2]
    h = np.where(v == red, (green - blue) / d % 6, np.where(v == green, (blue - red) / d + 2, (red - green) / d + 4))
    return np.where(v > low, h * 60, 0), np.where(v > 0, (v - low) / np.where(v > 0, v, 1), 0), v


def from_hsv(h, s, v) -> np.ndarray:
    k = (np.array([5, 3, 1]) + h[..., None] / 60) % 6
    return clip(255 * v[..., None] * (1 - s[..., None] * np.clip(np.minimum(k, 4 - k), 0, 1)))


def gray(x: np.ndarray) -> np.ndarray:
    return x[..., :3] @ np.array([0.299, 0.587, 0.114])


def box(x: np.ndarray, holes, fill) -> np.ndarray:
    out = x.copy()
    for top, left, h, w in holes:
        out[top : top + h, left : left + w] = fill
    return out


def side(r, value, n: int) -> int:
    """A drawn length: pixels, or a share of n where it is 1 at most."""
    v = draw(r, value)
    return int(np.clip(v * n if v <= 1 else v, 1, n))


def polygon(shape, points: np.ndarray) -> np.ndarray:
    """Even-odd inside test."""
    y, x = grid(shape)
    inside = np.zeros(shape[:2], bool)
    for (x0, y0), (x1, y1) in zip(points, np.roll(points, -1, axis=0), strict=True):
        if y0 != y1:
            inside ^= ((y < y0) != (y < y1)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    return inside


def spots(shape, circles):
    """Soft discs (y, x, radius, opacity): the window each lies in, and its opacity in 0..1 there."""
    for cy, cx, radius, alpha in circles:
        window = tuple(slice(max(0, int(c - radius - 1)), max(0, int(c + radius + 3))) for c in (cy, cx))
        y, x = (np.arange(n, dtype=float)[w] for n, w in zip(shape, window, strict=False))
        yield window, alpha * np.clip(radius - np.hypot(y[:, None] - cy, x - cx) + 0.5, 0, 1)


def discs(shape, circles) -> np.ndarray:
    """Opacity in 0..1 of soft discs, the strongest where they overlap."""
    out = np.zeros(shape[:2])
    for window, opacity in spots(shape, circles):
        out[window] = np.maximum(out[window], opacity)
    return out


def blend(x, alpha, colour) -> np.ndarray:
    return clip(x * (1 - alpha[..., None]) + np.asarray(colour, float) * alpha[..., None])


# --- dihedral and geometric ----------------------------------------------------


@kernel
def vertical_flip(x, r, p):
    return x[::-1]


@kernel
def d4(x, r, p):
    square = x.shape[0] == x.shape[1]
    k = int(r.integers(8 if square else 4))
    if k < 4:  # the four members that keep any shape
        return [x, x[::-1], x[:, ::-1], x[::-1, ::-1]][k]
    return [np.rot90(x), np.rot90(x, 3), x.transpose(1, 0, 2), np.rot90(x, 2).transpose(1, 0, 2)][k - 4]


KERNELS["square_symmetry"] = d4


@kernel
def rotate(x, r, p):
    return affine_(x, p, turn(draw(r, p["limit"], True)))


@kernel
def shift_scale_rotate(x, r, p):
    across = p["shift_limit"] if p["shift_limit_x"] is None else p["shift_limit_x"]
    down = p["shift_limit"] if p["shift_limit_y"] is None else p["shift_limit_y"]
    dx, dy = draw(r, across, True) * x.shape[1], draw(r, down, True) * x.shape[0]
    scale = max(1e-3, 1 + draw(r, p["scale_limit"], True))
    return affine_(x, p, turn(draw(r, p["rotate_limit"], True), scale, dx, dy))


@kernel
def safe_rotate(x, r, p):
    degrees = draw(r, p["limit"], True)
    h, w = x.shape[:2]
    c, s = abs(np.cos(np.deg2rad(degrees))), abs(np.sin(np.deg2rad(degrees)))
    return affine_(x, p, turn(degrees, min(w / (w * c + h * s), h / (w * s + h * c))))


@kernel
def affine(x, r, p):
    scale, degrees = max(1e-3, draw(r, p["scale"])), draw(r, p["rotate"], True)
    shear_x, shear_y = np.tan(np.deg2rad(draw(r, p["shear"], True))), np.tan(np.deg2rad(draw(r, p["shear"], True)))
    dx = dy = 0.0
    if p["translate_px"] is not None:
        dx, dy = draw_int(r, p["translate_px"], True), draw_int(r, p["translate_px"], True)
    elif p["translate_percent"] is not None:
        dx, dy = draw(r, p["translate_percent"], True) * x.shape[1], draw(r, p["translate_percent"], True) * x.shape[0]
    m = turn(degrees, scale, dx, dy)
    m[:, :2] = m[:, :2] @ np.array([[1, shear_x], [shear_y, 1 + shear_x * shear_y]])
    return affine_(x, p, m)


@kernel
def perspective(x, r, p):
    h, w = x.shape[:2]
    corners = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    inward = np.array([[1, 1], [-1, 1], [-1, -1], [1, -1]])
    scale = min(draw(r, p["scale"]), 0.49)
    to = corners + inward * np.abs(r.normal(0, scale, (4, 2))).clip(0, 0.49) * [w, h]
    rows = []
    for (u, v), (a, b) in zip(corners, to, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * a, -v * a], [0, 0, 0, u, v, 1, -u * b, -v * b]]
    m = np.append(np.linalg.solve(np.array(rows), to.ravel()), 1).reshape(3, 3)
    y, z = grid(x.shape)
    d = m[2, 0] * z + m[2, 1] * y + 1
    return sample(x, (m[1, 0] * z + m[1, 1] * y + m[1, 2]) / d, (m[0, 0] * z + m[0, 1] * y + m[0, 2]) / d, p["interpolation"], p["border_mode"], p["fill"])


def _smooth(r, shape, rows: int, cols: int, amount: float) -> np.ndarray:
    """A smooth random displacement from a coarse grid, in pixels."""
    coarse = r.uniform(-1, 1, (rows, cols, 2))
    y, x = np.linspace(0, rows - 1, shape[0]), np.linspace(0, cols - 1, shape[1])
    fy, fx = np.minimum(y.astype(int), max(rows - 2, 0)), np.minimum(x.astype(int), max(cols - 2, 0))
    ty, tx = (y - fy)[:, None, None], (x - fx)[None, :, None]
    gy, gx = np.minimum(fy + 1, rows - 1), np.minimum(fx + 1, cols - 1)
    return amount * ((coarse[fy][:, fx] * (1 - tx) + coarse[fy][:, gx] * tx) * (1 - ty) + (coarse[gy][:, fx] * (1 - tx) + coarse[gy][:, gx] * tx) * ty)


@kernel
def elastic_transform(x, r, p):
    noise = r.uniform(-1, 1, (*x.shape[:2], 2))
    d = gaussian(noise, float(p["sigma"])) * float(p["alpha"])
    return warp(x, p, d[..., 0], d[..., 1])


@kernel
def grid_distortion(x, r, p):
    def line(n):
        steps = max(1, int(p["num_steps"]))
        sizes = 1 + r.uniform(*pair(p["distort_limit"], True), steps)
        knots = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0.05))])
        return np.interp(np.arange(n), np.linspace(0, n - 1, steps + 1), knots / knots[-1] * (n - 1))

    y, z = np.meshgrid(line(x.shape[0]), line(x.shape[1]), indexing="ij")
    return sample(x, y, z, p["interpolation"], p["border_mode"], p["fill"])


def radial(x, k: float, how, border="constant", fill=0, k2: float = 0.0) -> np.ndarray:
    y, z = grid(x.shape)
    cy, cx = (x.shape[0] - 1) / 2, (x.shape[1] - 1) / 2
    u, v = (z - cx) / max(cx, 1), (y - cy) / max(cy, 1)
    s = 1 + k * (u * u + v * v) + k2 * (u * u + v * v) ** 2
    return sample(x, v * s * max(cy, 1) + cy, u * s * max(cx, 1) + cx, how, border, fill)


@kernel
def optical_distortion(x, r, p):
    return radial(x, draw(r, p["distort_limit"], True), p["interpolation"], p["border_mode"], p["fill"])


@kernel
def piecewise_affine(x, r, p):
    d = _smooth(r, x.shape, max(2, draw_int(r, p["nb_rows"])), max(2, draw_int(r, p["nb_cols"])), draw(r, p["scale"]))
    return warp(x, p, d[..., 0] * x.shape[0], d[..., 1] * x.shape[1])


@kernel
def thin_plate_spline(x, r, p):
    n = max(2, int(round(float(p["num_control_points"]) ** 0.5)))
    at = np.stack(np.meshgrid(np.linspace(0, 1, n), np.linspace(0, 1, n), indexing="ij"), -1).reshape(-1, 2)
    move = r.normal(0, draw(r, p["scale_range"]) / 10, at.shape)
    bend = lambda d: np.where(d > 0, d * d * np.log(np.maximum(d, 1e-12)), 0)
    m = len(at)
    full = np.zeros((m + 3, m + 3))
    full[:m, :m] = bend(np.linalg.norm(at[:, None] - at[None], axis=2)) + 1e-9 * np.eye(m)
    full[:m, m], full[:m, m + 1 :], full[m, :m], full[m + 1 :, :m] = 1, at, 1, at.T
    weights = np.linalg.solve(full, np.vstack([move, np.zeros((3, 2))]))
    y, z = grid(x.shape)
    q = np.stack([y / max(1, x.shape[0] - 1), z / max(1, x.shape[1] - 1)], -1).reshape(-1, 2)
    d = bend(np.linalg.norm(q[:, None] - at[None], axis=2)) @ weights[:m] + weights[m] + q @ weights[m + 1 :]
    d = d.reshape(*x.shape[:2], 2)
    return warp(x, p, d[..., 0] * x.shape[0], d[..., 1] * x.shape[1])


@kernel
def grid_elastic_deform(x, r, p):
    n = pair(p["num_grid_xy"])
    d = _smooth(r, x.shape, int(n[1]) + 1, int(n[0]) + 1, float(p["magnitude"]))
    return warp(x, p | {"border_mode": "reflect_101"}, d[..., 0], d[..., 1])


def padded(x, h: int, w: int, p, position: str = "center", r=None):
    """The image within a frame of h x w at least."""
    dh, dw = max(0, h - x.shape[0]), max(0, w - x.shape[1])
    if position == "random":
        top, left = int(r.integers(dh + 1)), int(r.integers(dw + 1))
    else:
        top = 0 if "top" in position else dh if "bottom" in position else dh // 2
        left = 0 if "left" in position else dw if "right" in position else dw // 2
    mode = PAD[p["border_mode"]]
    if mode == "reflect" and min(x.shape[:2]) == 1:
        mode = "edge"
    extra = {"constant_values": p["fill"]} if mode == "constant" else {}
    return np.pad(x, ((top, dh - top), (left, dw - left), (0, 0)), mode=mode, **extra)


@kernel
def random_crop(x, r, p):
    x = padded(x, int(p["height"]), int(p["width"]), p)
    h, w = int(p["height"]), int(p["width"])
    top, left = int(r.integers(x.shape[0] - h + 1)), int(r.integers(x.shape[1] - w + 1))
    return x[top : top + h, left : left + w]


@kernel
def center_crop(x, r, p):
    h, w = int(p["height"]), int(p["width"])
    if p["pad_if_needed"]:
        x = padded(x, h, w, p)
    if h > x.shape[0] or w > x.shape[1]:
        raise ValueError(f"center_crop: {h}x{w} does not fit into {x.shape[0]}x{x.shape[1]}")
    top, left = (x.shape[0] - h) // 2, (x.shape[1] - w) // 2
    return x[top : top + h, left : left + w]


@kernel
def crop(x, r, p):
    if p["pad_if_needed"]:
        x = padded(x, int(p["y_max"]), int(p["x_max"]), p, "top_left")
    part = x[int(p["y_min"]) : int(p["y_max"]), int(p["x_min"]) : int(p["x_max"])]
    if not part.size:
        raise ValueError("crop: the window is empty")
    return part


@kernel
def random_crop_from_borders(x, r, p):
    cut = lambda share, n: int(r.uniform(0, float(share)) * n)
    top, left = cut(p["crop_top"], x.shape[0]), cut(p["crop_left"], x.shape[1])
    bottom, right = cut(p["crop_bottom"], x.shape[0]), cut(p["crop_right"], x.shape[1])
    top, left = min(top, x.shape[0] - 1), min(left, x.shape[1] - 1)
    return x[top : max(top + 1, x.shape[0] - bottom), left : max(left + 1, x.shape[1] - right)]


@kernel
def random_scale(x, r, p):
    s = max(1e-3, 1 + draw(r, p["scale_limit"], True))
    how = "area" if s < 1 and p["area_for_downscale"] != "none" else p["interpolation"]
    return resize(x, max(1, round(x.shape[0] * s)), max(1, round(x.shape[1] * s)), how)


def _fitted(x, part, size, p):
    how = "area" if part.shape[0] > size and p["area_for_downscale"] != "none" else p["interpolation"]
    return resize(part, size, size, how)


@kernel
def random_resized_crop(x, r, p):
    h, w = x.shape[:2]
    area, ratio = draw(r, p["scale"]) * h * w, np.exp(r.uniform(*np.log(np.maximum(pair(p["ratio"]), 1e-6))))
    a, b = int(np.clip(round((area / ratio) ** 0.5), 1, h)), int(np.clip(round((area * ratio) ** 0.5), 1, w))
    top, left = int(r.integers(h - a + 1)), int(r.integers(w - b + 1))
    return _fitted(x, x[top : top + a, left : left + b], int(p["size"]), p)


@kernel
def random_sized_crop(x, r, p):
    h, w = x.shape[:2]
    a = int(np.clip(draw_int(r, p["min_max_height"]), 1, h))
    b = int(np.clip(a * float(p["w2h_ratio"]), 1, w))
    top, left = int(r.integers(h - a + 1)), int(r.integers(w - b + 1))
    return _fitted(x, x[top : top + a, left : left + b], int(p["size"]), p)


@kernel
def resize_(x, r, p):
    return resize(x, int(p["height"]), int(p["width"]), p["interpolation"])


@kernel
def pad(x, r, p):
    n = int(p["padding"])
    return padded(x, x.shape[0] + 2 * n, x.shape[1] + 2 * n, p)


@kernel
def pad_if_needed(x, r, p):
    up = lambda n, least, divisor: -(-n // int(divisor)) * int(divisor) if divisor else max(n, int(least))
    return padded(x, up(x.shape[0], p["min_height"], p["pad_height_divisor"]), up(x.shape[1], p["min_width"], p["pad_width_divisor"]), p, p["position"], r)


# --- blur ------------------------------------------------------------------------


@kernel
def blur(x, r, p):
    n = draw_odd(r, p["blur_limit"])
    return clip(along(along(x, np.full(n, 1 / n), 0), np.full(n, 1 / n), 1))


@kernel
def median_blur(x, r, p):
    n = draw_odd(r, p["blur_limit"])
    around = np.pad(x, ((n // 2,) * 2, (n // 2,) * 2, (0, 0)), mode="edge")
    return np.median(sliding_window_view(around, (n, n), axis=(0, 1)), axis=(-2, -1)).astype(np.uint8)


@kernel
def gaussian_blur(x, r, p):
    return clip(gaussian(x, draw(r, p["sigma_limit"])))


@kernel
def motion_blur(x, r, p):
    n = draw_odd(r, p["blur_limit"])
    angle, lean = np.deg2rad(draw(r, p["angle_range"])), draw(r, p["direction_range"])
    middle = (r.integers(-(n // 4), n // 4 + 1, 2) if p["allow_shifted"] else np.zeros(2)) + n // 2
    k = np.zeros((n, n))
    for t in np.linspace(-1, 1, 4 * n):
        y, z = middle + t * (n // 2) * np.array([np.sin(angle), np.cos(angle)])
        if 0 <= round(y) < n and 0 <= round(z) < n:
            k[round(y), round(z)] = max(k[round(y), round(z)], 1 + lean * t)
    return clip(convolve(x, k / k.sum())) if k.sum() > 0 else x


@kernel
def advanced_blur(x, r, p):
    n = draw_odd(r, p["blur_limit"])
    sx, sy, a = max(0.05, draw(r, p["sigma_x_limit"])), max(0.05, draw(r, p["sigma_y_limit"])), np.deg2rad(draw(r, p["rotate_limit"], True))
    v, u = np.mgrid[:n, :n] - n // 2
    k = np.exp(-0.5 * (((u * np.cos(a) + v * np.sin(a)) / sx) ** 2 + ((v * np.cos(a) - u * np.sin(a)) / sy) ** 2))
    k *= r.uniform(0.9, 1.1, k.shape)
    return clip(convolve(x, k / k.sum()))


def _disc(radius: int) -> np.ndarray:
    v, u = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    k = (u * u + v * v <= radius * radius).astype(float)
    return k / k.sum()


@kernel
def defocus(x, r, p):
    k = _disc(max(1, draw_int(r, p["radius"])))
    return clip(gaussian(convolve(x, k), draw(r, p["alias_blur"]), 3))


@kernel
def zoom_blur(x, r, p):
    most, step = draw(r, p["max_factor"]), max(1e-3, draw(r, p["step_factor"]))
    y, z = grid(x.shape)
    cy, cx = (x.shape[0] - 1) / 2, (x.shape[1] - 1) / 2
    factors = np.arange(1, most + step / 2, step)
    return clip(sum(sample(x, (y - cy) / f + cy, (z - cx) / f + cx, "bilinear", "replicate").astype(float) for f in factors) / len(factors))


@kernel
def sharpen(x, r, p):
    a, light = draw(r, p["alpha"]), draw(r, p["lightness"])
    k = np.full((3, 3), -1.0)
    k[1, 1] = 8 + light
    return clip((1 - a) * x + a * convolve(x, k))


@kernel
def unsharp_mask(x, r, p):
    n, a = draw_odd(r, p["blur_limit"]), draw(r, p["alpha"])
    d = x - gaussian(x, float(p["sigma_limit"]), n)
    return clip(x + a * d * (np.abs(d) > float(p["threshold"])))


@kernel
def ringing_overshoot(x, r, p):
    n, cut = draw_odd(r, p["blur_limit"]), draw(r, p["cutoff"])
    v, u = np.mgrid[:n, :n] - n // 2
    d = np.hypot(u, v)
    t = np.linspace(0, np.pi, 129)
    j1 = np.cos(t[None, None] - cut * d[..., None] * np.sin(t)[None, None]).mean(axis=2)
    k = np.where(d > 0, cut * j1 / (2 * np.pi * np.where(d > 0, d, 1)), cut * cut / (4 * np.pi))
    return clip(convolve(x, k / k.sum()))


# --- noise -------------------------------------------------------------------------


@kernel
def gauss_noise(x, r, p):
    std, mean, f = draw(r, p["std_range"]) * 255, draw(r, p["mean_range"]) * 255, float(p["noise_scale_factor"]) or 1.0
    h, w = max(1, round(x.shape[0] * f)), max(1, round(x.shape[1] * f))
    noise = r.normal(mean, std, (h, w, x.shape[2] if p["per_channel"] else 1))
    if f < 1:
        noise = noise[np.arange(x.shape[0]) * h // x.shape[0]][:, np.arange(x.shape[1]) * w // x.shape[1]]
    return clip(x + noise)


@kernel
def salt_and_pepper(x, r, p):
    amount, salt = draw(r, p["amount"]), draw(r, p["salt_vs_pepper"])
    u = r.random(x.shape[:2])[..., None]
    return np.where(u < amount * salt, np.uint8(255), np.where(u < amount, np.uint8(0), x))


@kernel
def additive_noise(x, r, p):
    f = max(float(p["approximation"]), 0.01)
    h, w = max(1, round(x.shape[0] * f)), max(1, round(x.shape[1] * f))
    noise = r.uniform(-0.1, 0.1, (h, w, x.shape[2])) if p["noise_type"] == "uniform" else r.normal(0, 0.05, (h, w, x.shape[2]))
    return clip(x + 255 * noise[np.arange(x.shape[0]) * h // x.shape[0]][:, np.arange(x.shape[1]) * w // x.shape[1]])


@kernel
def multiplicative_noise(x, r, p):
    planes = x.shape[2] if p["per_channel"] else 1
    return clip(x * r.uniform(*pair(p["multiplier"]), (*x.shape[:2], planes) if p["elementwise"] else (1, 1, planes)))


@kernel
def shot_noise(x, r, p):
    scale = max(1e-4, draw(r, p["scale_range"]))
    linear = (x / 255.0) ** 2.2
    return clip(255 * np.clip(r.poisson(linear / scale * 10) * scale / 10, 0, 1) ** (1 / 2.2))


@kernel
def isonoise(x, r, p):
    shift, strength = draw(r, p["color_shift"]), draw(r, p["intensity"])
    h, s, v = to_hsv(x)
    light = r.poisson(v.std() * strength * 255, v.shape) / 255 * (1 - v)
    return from_hsv((h + r.normal(0, shift * 360 * strength, h.shape)) % 360, s, np.clip(v + light, 0, 1))


# --- colour --------------------------------------------------------------------------


@kernel
def color_jitter(x, r, p):
    steps = [draw(r, p[k]) if isinstance(p[k], list) else float(r.uniform(max(0, 1 - p[k]), 1 + p[k])) for k in ("brightness", "contrast", "saturation")]
    hue = draw(r, p["hue"], True)
    for k in r.permutation(4):
        if k == 0:
            x = clip(x * steps[0])
        elif k == 1:
            x = clip(gray(x).mean() + steps[1] * (x - gray(x).mean()))
        elif k == 2:
            x = clip(gray(x)[..., None] + steps[2] * (x - gray(x)[..., None]))
        else:
            h, s, v = to_hsv(x)
            x = from_hsv((h + 360 * hue) % 360, s, v)
    return x


@kernel
def hue_saturation_value(x, r, p):
    dh, ds, dv = (draw_int(r, p[k], True) for k in ("hue_shift_limit", "sat_shift_limit", "val_shift_limit"))
    h, s, v = to_hsv(x)
    return from_hsv((h + 2 * dh) % 360, np.clip(s + ds / 255, 0, 1), np.clip(v + dv / 255, 0, 1))


@kernel
def random_gamma(x, r, p):
    g = draw(r, p["gamma_limit"]) / 100
    return lut(x, lambda v: 255 * (v / 255) ** g)


@kernel
def solarize(x, r, p):
    t = draw(r, p["threshold_range"]) * 255
    return lut(x, lambda v: np.where(v < t, v, 255 - v))


def _equal(plane: np.ndarray, mode: str) -> np.ndarray:
    count = np.bincount(plane.ravel(), minlength=256)
    total, first = count.cumsum(), np.flatnonzero(count)[0]
    if total[-1] == count[first]:
        return plane
    if mode == "pil":
        step = (total[-1] - count[np.flatnonzero(count)[-1]]) // 255
        return np.clip((total - count + step // 2) // step, 0, 255).astype(np.uint8)[plane] if step else plane
    return clip((total - count[first]) * 255 / (total[-1] - count[first]))[plane]


@kernel
def equalize(x, r, p):
    if p["by_channels"]:
        return np.stack([_equal(x[..., c], p["mode"]) for c in range(x.shape[2])], 2)
    luma = clip(gray(x))
    return clip(x + (_equal(luma, p["mode"]).astype(float) - luma)[..., None])


@kernel
def random_brightness_contrast(x, r, p):
    b, a = draw(r, p["brightness_limit"], True), 1 + draw(r, p["contrast_limit"], True)
    if p["ensure_safe_range"]:
        low, high = x.min() / 255, x.max() / 255
        a = np.clip(a, 0, 1 / (high - low)) if high > low else a
        b = np.clip(b, -a * low, 1 - a * high) if -a * low <= 1 - a * high else 0.0
    return lut(x, lambda v: a * v + b * 255)


@kernel
def auto_contrast(x, r, p):
    out = np.empty_like(x)
    for c in range(x.shape[2]):
        plane, cut = x[..., c], float(p["cutoff"])
        if p["method"] == "pixel":
            keep = np.sort(plane.ravel())
            n = int(len(keep) * cut / 100 / 2) if cut < 100 else 0
            low, high = keep[n], keep[-1 - n]
        else:
            low, high = np.percentile(plane, [min(cut, 50), max(100 - cut, 50)])
        out[..., c] = lut(plane, lambda v, low=low, high=high: (v - low) * 255 / (high - low)) if high > low else plane
    return out


@kernel
def clahe(x, r, p):
    limit = float(p["clip_limit"]) if not isinstance(p["clip_limit"], list) else draw(r, p["clip_limit"])
    rows, cols = (max(1, min(int(n), s)) for n, s in zip(pair(p["tile_grid_size"]), x.shape[:2], strict=True))
    luma = clip(gray(x))
    ey, ex = np.linspace(0, x.shape[0], rows + 1).astype(int), np.linspace(0, x.shape[1], cols + 1).astype(int)
    tables = np.zeros((rows, cols, 256))
    for i in range(rows):
        for j in range(cols):
            tile = luma[ey[i] : ey[i + 1], ex[j] : ex[j + 1]].ravel()
            count = np.bincount(tile, minlength=256).astype(float)
            most = max(1.0, limit * len(tile) / 256)
            over = np.maximum(count - most, 0).sum()
            tables[i, j] = (np.minimum(count, most) + over / 256).cumsum() * 255 / max(1, len(tile))
    y, z = np.clip((np.arange(x.shape[0]) + 0.5) * rows / x.shape[0] - 0.5, 0, rows - 1), np.clip((np.arange(x.shape[1]) + 0.5) * cols / x.shape[1] - 0.5, 0, cols - 1)
    fy, fx = y.astype(int)[:, None], z.astype(int)[None]
    gy, gx, ty, tx = np.minimum(fy + 1, rows - 1), np.minimum(fx + 1, cols - 1), y[:, None] - fy, z[None] - fx
    new = (tables[fy, fx, luma] * (1 - tx) + tables[fy, gx, luma] * tx) * (1 - ty) + (tables[gy, fx, luma] * (1 - tx) + tables[gy, gx, luma] * tx) * ty
    return clip(x + (new - luma)[..., None])


@kernel
def fancy_pca(x, r, p):
    flat = x.reshape(-1, x.shape[2]) / 255.0
    values, vectors = np.linalg.eigh(np.atleast_2d(np.cov(flat.T)) if len(flat) > 1 else np.zeros((x.shape[2],) * 2))
    return clip(x + 255 * vectors @ (r.normal(0, float(p["alpha"]), len(values)) * values))


@kernel
def invert_img(x, r, p):
    return 255 - x


@kernel
def posterize(x, r, p):
    return x & np.uint8(256 - (1 << (8 - int(p["num_bits"]))) & 255)


@kernel
def rgb_shift(x, r, p):
    return clip(x + np.array([draw_int(r, p[f"{c}_shift_limit"], True) for c in "rgb"]))


@kernel
def random_tone_curve(x, r, p):
    def curve():
        a, b = np.clip([0.25, 0.75] + r.normal(0, float(p["scale"]), 2), 0, 1)
        return lambda v: 255 * (3 * (1 - v / 255) ** 2 * (v / 255) * a + 3 * (1 - v / 255) * (v / 255) ** 2 * b + (v / 255) ** 3)

    return np.stack([lut(x[..., c], curve()) for c in range(x.shape[2])], 2) if p["per_channel"] else lut(x, curve())


@kernel
def planckian_jitter(x, r, p):
    usual = (3000, 15000) if p["mode"] == "blackbody" else (4000, 15000)
    low, high = pair(p["temperature_limit"]) if p["temperature_limit"] is not None else usual
    t = r.uniform(low, high) if p["sampling_method"] == "uniform" else np.clip(r.normal((low + high) / 2, (high - low) / 6), low, high)
    wave = np.array([610e-9, 550e-9, 465e-9])
    light = lambda k: 1 / (wave**5 * np.expm1(1.4388e-2 / (wave * k)))
    gain = light(t) / light(6500.0)
    return clip(x * (gain / gain[1]))


@kernel
def illumination(x, r, p):
    y, z = grid(x.shape)
    u, v = z / max(1, x.shape[1] - 1) - 0.5, y / max(1, x.shape[0] - 1) - 0.5
    strength = draw(r, p["intensity_range"])
    sign = {"brighten": 1, "darken": -1}.get(p["effect_type"]) or int(r.choice([-1, 1]))
    if p["mode"] == "linear":
        a = np.deg2rad(draw(r, p["angle_range"]))
        light = u * np.cos(a) + v * np.sin(a) + 0.5
    elif p["mode"] == "corner":
        cy, cx = r.choice([-0.5, 0.5], 2)
        light = 1 - np.hypot(u - cx, v - cy) / 2**0.5
    else:
        cy, cx = r.uniform(-0.5, 0.5, 2)
        light = np.exp(-(((u - cx) ** 2 + (v - cy) ** 2) / (2 * max(1e-3, draw(r, p["sigma_range"])) ** 2)))
    return clip(x * (1 + sign * strength * light)[..., None])


@kernel
def plasma_brightness_contrast(x, r, p):
    b, c = draw(r, p["brightness_range"], True), draw(r, p["contrast_range"], True)
    f = field(r, *x.shape[:2], int(p["plasma_size"]), float(p["roughness"]))[..., None]
    return clip((x - x.mean()) * (1 + c * f) + x.mean() + 255 * b * f)


@kernel
def plasma_shadow(x, r, p):
    f = field(r, *x.shape[:2], int(p["plasma_size"]), float(p["roughness"]))[..., None]
    return clip(x * (1 - draw(r, p["shadow_intensity_range"]) * f))


@kernel
def morphological(x, r, p):
    n = draw_int(r, p["scale"])
    around = np.pad(x, ((n // 2, (n - 1) // 2), (n // 2, (n - 1) // 2), (0, 0)), mode="edge")
    window = sliding_window_view(around, (n, n), axis=(0, 1))
    return window.max(axis=(-2, -1)) if p["operation"] == "dilation" else window.min(axis=(-2, -1))


@kernel
def channel_shuffle(x, r, p):
    return x[..., r.permutation(x.shape[2])]


@kernel
def channel_dropout(x, r, p):
    out = x.copy()
    out[..., r.permutation(x.shape[2])[: min(draw_int(r, p["channel_drop_range"]), x.shape[2])]] = p["fill"]
    return out


@kernel
def chromatic_aberration(x, r, p):
    a, b = draw(r, p["primary_distortion_limit"], True), draw(r, p["secondary_distortion_limit"], True)
    mode = p["mode"] if p["mode"] != "random" else str(r.choice(["green_purple", "red_blue"]))
    red, blue = ((abs(a), abs(b)), (abs(a), abs(b))) if mode == "green_purple" else ((-abs(a), -abs(b)), (abs(a), abs(b)))
    out = x.copy()
    for plane, (k, k2) in ((0, red), (2, blue)):
        out[..., plane : plane + 1] = radial(x[..., plane : plane + 1], k, p["interpolation"], "replicate", 0, k2)
    return out


# --- dropout ---------------------------------------------------------------------------


@kernel
def coarse_dropout(x, r, p):
    holes = []
    for _ in range(draw_int(r, p["num_holes_range"])):
        h, w = side(r, p["hole_height_range"], x.shape[0]), side(r, p["hole_width_range"], x.shape[1])
        holes.append((int(r.integers(x.shape[0] - h + 1)), int(r.integers(x.shape[1] - w + 1)), h, w))
    return box(x, holes, p["fill"])


@kernel
def erasing(x, r, p):
    area, ratio = draw(r, p["scale"]) * x.shape[0] * x.shape[1], np.exp(r.uniform(*np.log(np.maximum(pair(p["ratio"]), 1e-6))))
    h, w = int(np.clip((area * ratio) ** 0.5, 1, x.shape[0])), int(np.clip((area / ratio) ** 0.5, 1, x.shape[1]))
    return box(x, [(int(r.integers(x.shape[0] - h + 1)), int(r.integers(x.shape[1] - w + 1)), h, w)], p["fill"])


@kernel
def grid_dropout(x, r, p):
    if p["holes_number_xy"] is not None:
        n = pair(p["holes_number_xy"])
        uy, ux = max(2, x.shape[0] // int(n[1])), max(2, x.shape[1] // int(n[0]))
    else:
        unit = draw_int(r, p["unit_size_range"]) if p["unit_size_range"] is not None else max(2, min(x.shape[:2]) // 10)
        uy = ux = max(2, unit)
    hy, hx = (max(1, min(u - 1, int(u * float(p["ratio"])))) for u in (uy, ux))
    oy, ox = (int(r.integers(u - h + 1)) for u, h in ((uy, hy), (ux, hx))) if p["random_offset"] else (0, 0)
    y, z = (np.arange(n) for n in x.shape[:2])
    hole = (((y - oy) % uy < hy)[:, None] & ((z - ox) % ux < hx)[None])[..., None]
    return np.where(hole, np.uint8(p["fill"]), x)


@kernel
def pixel_dropout(x, r, p):
    gone = r.random((*x.shape[:2], x.shape[2] if p["per_channel"] else 1)) < float(p["dropout_prob"])
    return np.where(gone, np.uint8(int(p["drop_value"])), x)


@kernel
def xy_masking(x, r, p):
    holes = []
    for axis, n, length in ((1, p["num_masks_x"], p["mask_x_length"]), (0, p["num_masks_y"], p["mask_y_length"])):
        for _ in range(int(n)):
            size = min(int(length), x.shape[axis])
            at = int(r.integers(x.shape[axis] - size + 1))
            holes.append((0, at, x.shape[0], size) if axis else (at, 0, size, x.shape[1]))
    return box(x, holes, p["fill"])


@kernel
def frequency_masking(x, r, p):
    size = min(int(r.integers(int(p["freq_mask_param"]) + 1)), x.shape[0])
    return box(x, [(int(r.integers(x.shape[0] - size + 1)), 0, size, x.shape[1])], 0)


@kernel
def random_grid_shuffle(x, r, p):
    rows, cols = (max(1, min(int(n), s)) for n, s in zip(pair(p["grid"]), x.shape[:2], strict=True))
    h, w = x.shape[0] // rows, x.shape[1] // cols
    out, order = x.copy(), r.permutation(rows * cols)
    for k, q in enumerate(order.tolist()):
        out[k // cols * h : k // cols * h + h, k % cols * w : k % cols * w + w] = x[q // cols * h : q // cols * h + h, q % cols * w : q % cols * w + w]
    return out


# --- compression and weather -----------------------------------------------------------------

# The luminance and chrominance tables of ITU-T T.81, annex K.
LUMA = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"""
CHROMA = """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"""


@kernel
def image_compression(x, r, p):
    if p["compression_type"] != "jpeg":
        raise ValueError("image_compression: there is no webp codec here; use jpeg")
    q = draw_int(r, p["quality_range"])
    scale = 5000 / q if q < 50 else 200 - 2 * q
    k = np.arange(8)
    dct = np.sqrt(np.where(k == 0, 1, 2) / 8)[:, None] * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
    full = np.pad(x.astype(float), ((0, -x.shape[0] % 8), (0, -x.shape[1] % 8), (0, 0)), mode="edge")
    to = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
    planes = full @ to.T - np.array([128, 0, 0])
    out = np.empty_like(planes)
    for c in range(3):
        table = np.clip((np.array((LUMA if c == 0 else CHROMA).split(), float) * scale + 50) // 100, 1, 255).reshape(8, 8)
        tiles = planes[..., c].reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        tiles = dct.T @ (np.rint(dct @ tiles @ dct.T / table) * table) @ dct
        out[..., c] = tiles.transpose(0, 2, 1, 3).reshape(full.shape[:2])
    return clip((out + np.array([128, 0, 0])) @ np.linalg.inv(to).T)[: x.shape[0], : x.shape[1]]


@kernel
def downscale(x, r, p):
    s = draw(r, p["scale_range"])
    h, w = max(1, int(x.shape[0] * s)), max(1, int(x.shape[1] * s))
    small = x[np.arange(h) * x.shape[0] // h][:, np.arange(w) * x.shape[1] // w]
    return small[np.arange(x.shape[0]) * h // x.shape[0]][:, np.arange(x.shape[1]) * w // x.shape[1]]


@kernel
def random_fog(x, r, p):
    thick = draw(r, p["fog_coef_range"])
    n = max(1, int(min(x.shape[:2]) * 0.3))
    circles = [(r.uniform(0, x.shape[0]), r.uniform(0, x.shape[1]), n, float(p["alpha_coef"]) * thick) for _ in range(max(1, int(40 * thick)))]
    clear = np.ones(x.shape[:2])
    for window, opacity in spots(x.shape, circles):
        clear[window] *= 1 - opacity
    return clip(gaussian(blend(x, 1 - clear, 255), 1 + 2 * thick, 5))


@kernel
def random_rain(x, r, p):
    # Share of streaks and length by kind of rain.
    density, length = {"default": (1.0, 20), "drizzle": (1.5, 10), "heavy": (2.0, 30), "torrential": (3.0, 60)}[p["rain_type"]]
    length = int(p["drop_length"]) if p["drop_length"] is not None else min(length, x.shape[0])
    slant = draw_int(r, p["slant_range"], True)
    mask = np.zeros(x.shape[:2])
    for _ in range(int(density * x.shape[0] * x.shape[1] / 600) + 1):
        top, left = int(r.integers(x.shape[0])), int(r.integers(x.shape[1]))
        for t in range(length):
            y, z = top + t, left + round(slant * t / max(length, 1))
            if y < x.shape[0]:
                mask[y, max(0, z) : max(0, z + int(p["drop_width"]))] = 1
    wet = blend(x, mask * 0.75, 200)
    n = int(p["blur_value"])
    return clip((along(along(wet, np.full(n, 1 / n), 0), np.full(n, 1 / n), 1) if n > 1 else wet) * float(p["brightness_coefficient"]))


@kernel
def random_shadow(x, r, p):
    for _ in range(draw_int(r, p["num_shadows_limit"])):
        points = r.uniform(0, 1, (max(3, int(p["shadow_dimension"])), 2)) * [x.shape[1], x.shape[0]]
        x = clip(x * np.where(polygon(x.shape, points), 1 - draw(r, p["shadow_intensity_range"]), 1)[..., None])
    return x


@kernel
def random_snow(x, r, p):
    point, strength = draw(r, p["snow_point_range"]), float(p["brightness_coeff"])
    h, s, v = to_hsv(x)
    if p["method"] == "bleach":
        return from_hsv(h, s, np.clip(np.where(v < (point + 1) / 3, v * strength, v), 0, 1))
    flakes = gaussian(r.normal(0.5, 0.3, (*x.shape[:2], 1)), 1.0)[..., 0].clip(0, 1) * point
    return from_hsv(h, s * (1 - flakes), np.clip(v + flakes * strength / 2.5, 0, 1))


@kernel
def random_sun_flare(x, r, p):
    h, w = x.shape[:2]
    cy, cx = r.uniform(0, 0.5) * h, r.uniform(0, 1) * w
    angle = 2 * np.pi * draw(r, p["angle_range"])
    radius = float(p["src_radius"])
    y, z = grid(x.shape)
    light = np.clip(1 - np.hypot(y - cy, z - cx) / radius, 0, 1) ** (2 if p["method"] == "overlay" else 3)
    for _ in range(draw_int(r, p["num_flare_circles_range"])):
        t = r.uniform(-1, 1) * max(h, w)
        light = np.maximum(light, discs(x.shape, [(cy + t * np.sin(angle), cx + t * np.cos(angle), r.uniform(1, max(2, radius / 10)), r.uniform(0.05, 0.2))]))
    return blend(x, light, 255) if p["method"] == "overlay" else clip(255 - (255 - x) * (1 - light[..., None] * [1, 0.97, 0.9]))


@kernel
def spatter(x, r, p):
    noise = r.normal(draw(r, p["mean"]), draw(r, p["std"]), (*x.shape[:2], 1))
    soft = gaussian(noise, draw(r, p["gauss_sigma"]))[..., 0]
    drops = np.where(soft > draw(r, p["cutout_threshold"]), soft, 0)
    amount = np.clip(drops, 0, 1) * draw(r, p["intensity"])
    return blend(x, amount, (175, 238, 238) if p["mode"] == "rain" else (63, 42, 20))
