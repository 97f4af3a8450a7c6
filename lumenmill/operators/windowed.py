"""A tool model around a network: it sees a window about the hole and may change only the hole."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from pathlib import Path
from typing import Any

import numpy as np

MULTIPLE = 8


class WindowedNet:
    """Fills holes with ``net(pixels, holes)``: float32 (B, planes, H, W) in 0..1 and (B, 1, H, W) in {0, 1}.

    The network gets the smallest window that holds every hole of the batch, with
    ``margin`` pixels of context, its sides mirrored up to multiples of 8. Pixels
    outside the holes and planes past ``channels`` come back as they were; without
    a hole the network is not asked. ``net`` is a callable or ``module:name``.
    """

    def __init__(self, net: Callable | str, margin: int = 256, channels: int = 3, name: str | None = None):
        if isinstance(net, str):
            module, _, attribute = net.partition(":")
            net = getattr(importlib.import_module(module), attribute)
        self.net, self.margin, self.channels = net, margin, channels
        self.name = name or getattr(net, "__name__", type(net).__name__)

    def inpaint(self, xs: np.ndarray, masks: np.ndarray) -> np.ndarray:
        if xs.ndim != 4 or xs.shape[3] < self.channels:
            raise ValueError(f"{self.name}: images (B, H, W, {self.channels} or more) are needed, got {xs.shape}")
        out, union = xs.copy(), masks.any(axis=0)
        if not union.any():
            return out
        window = tuple(self._extent(union.any(axis=1 - axis), union.shape[axis]) for axis in (0, 1))
        part, holes = xs[:, *window, : self.channels], masks[:, *window]
        h, w = holes.shape[1:]
        grow = ((0, 0), (0, -h % MULTIPLE), (0, -w % MULTIPLE))
        pixels = np.pad(part, (*grow, (0, 0)), mode="symmetric").astype(np.float32) / np.float32(255)
        seen = np.pad(holes, grow, mode="symmetric").astype(np.float32)
        made = np.asarray(self.net(np.ascontiguousarray(np.moveaxis(pixels, 3, 1)), seen[:, None]))
        if made.shape != (len(xs), self.channels, *seen.shape[1:]):
            raise ValueError(f"{self.name}: the network returned shape {made.shape}")
        # bytes are cut, not rounded
        made = np.clip(np.moveaxis(made[:, :, :h, :w], 1, 3) * 255.0, 0, 255).astype(xs.dtype)
        out[:, *window, : self.channels] = np.where(holes[..., None], made, part)
        return out

    def _extent(self, touched: np.ndarray, n: int) -> slice:
        places = np.flatnonzero(touched)
        return slice(max(0, places[0] - self.margin), min(n, places[-1] + 1 + self.margin))


def torch_script(weights: str, margin: int = 256, **more: Any) -> WindowedNet:
    """A TorchScript checkpoint on the worker's disk; needs torch. Named after its file."""
    try:
        import torch
    except ImportError as e:
        raise ValueError("a model from weights needs torch, which is not installed") from e
    script = torch.jit.load(weights, map_location="cpu").eval()

    def net(pixels: np.ndarray, holes: np.ndarray) -> np.ndarray:
        with torch.inference_mode():
            return script(torch.from_numpy(pixels), torch.from_numpy(holes)).numpy()

    return WindowedNet(net, margin, **{"name": Path(weights).stem} | more)
