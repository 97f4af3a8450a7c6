"""Parameter sweeps: a range of values in place of one."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np

KEYS = {"range", "samples", "step", "mode", "round"}


@dataclass(frozen=True)
class Sweep:
    """Values over [low, high]: ``samples`` of them, or one every ``step``."""

    low: float
    high: float
    samples: int | None = None
    step: float | None = None
    mode: str = "even"
    round: int = 2

    @classmethod
    def parse(cls, given: dict) -> Sweep:
        if unknown := set(given) - KEYS:
            raise ValueError(f"unknown sweep keys: {sorted(unknown)}")
        pair = given.get("range")
        if not isinstance(pair, (list, tuple)) or len(pair) != 2:
            raise ValueError("a sweep needs range: [min, max]")
        if (given.get("samples") is None) == (given.get("step") is None):
            raise ValueError("a sweep takes exactly one of samples and step")
        low, high = float(pair[0]), float(pair[1])
        if low > high:
            raise ValueError(f"a sweep's range must be ordered, got {list(pair)}")
        mode = given.get("mode", "even")
        if mode not in ("even", "random"):
            raise ValueError(f"a sweep's mode is even or random, got {mode!r}")
        samples, step = given.get("samples"), given.get("step")
        if samples is not None and (isinstance(samples, bool) or int(samples) != samples or samples < 1):
            raise ValueError("samples must be a whole number, 1 at least")
        if step is not None and step <= 0:
            raise ValueError("step must be above 0")
        return cls(low, high, samples and int(samples), step, mode, int(given.get("round", 2)))

    def values(self, seed: int | None) -> list[float]:
        """The rounded values. A partial last step is dropped; all random sweeps of a seed draw alike."""
        if self.step is not None:
            found = [self.low + k * self.step for k in range(int((self.high - self.low) / self.step) + 1)]
        elif self.mode == "even":
            found = np.linspace(self.low, self.high, self.samples).tolist()
        else:
            found = np.random.default_rng(seed).uniform(self.low, self.high, self.samples).tolist()
        return [round(float(v), self.round) for v in found]


def is_sweep(value) -> bool:
    return isinstance(value, dict) and "range" in value


def expand(entry: dict, whole: set[str], seed: int | None) -> list[dict]:
    """One entry per combination of its sweeps' values, in the order of its fields.

    ``whole`` names the fields that take whole numbers: their values lose the
    fraction (also where a field takes both kinds, as ids depend on it).
    """
    swept = {k: Sweep.parse(v).values(seed) for k, v in entry.items() if is_sweep(v)}
    if not swept:
        return [entry]
    out = []
    for combination in itertools.product(*swept.values()):
        chosen = {k: int(v) if k in whole else v for k, v in zip(swept, combination, strict=True)}
        out.append(entry | chosen | {"name": f"{entry.get('name')}__" + "_".join(str(v) for v in chosen.values())})
    return out
