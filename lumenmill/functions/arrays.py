"""Pointwise and gather transformations as array expressions, run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def flip(a: Column) -> Column:
    return F.reverse(a)


def crop_resize(a: Column, fraction: float, left: int = 0) -> Column:
    """A window of the array, stretched back to its length by nearest index."""
    n = F.size(a)
    w = F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction))).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(a, (F.floor(i * w / n) + left + 1).cast("int")))


def mask_region(a: Column, left: int, width: int, value: float = 0.0) -> Column:
    return F.transform(a, lambda x, i: F.when((i >= left) & (i < left + width), F.lit(value)).otherwise(x))


def clip(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))


def signed_step(a: Column, gradient: Column, epsilon: float, low: float = -1.0, high: float = 1.0) -> Column:
    """a + epsilon * sign(gradient), clipped."""
    return clip(F.zip_with(a, gradient, lambda x, g: x + epsilon * F.signum(g)), low, high)


def invert(a: Column, top: float = 1.0) -> Column:
    return F.transform(a, lambda x: F.lit(top) - x)


def solarize(a: Column, threshold: float, top: float = 1.0) -> Column:
    return F.transform(a, lambda x: F.when(x < threshold, x).otherwise(F.lit(top) - x))


def posterize(a: Column, bits: int) -> Column:
    mask = 256 - (1 << (8 - bits))
    return F.transform(a, lambda x: x.bitwiseAND(F.lit(mask)))


def gamma(a: Column, power: float) -> Column:
    return F.transform(a, lambda x: F.pow(x, F.lit(float(power))))


def brightness_contrast(a: Column, alpha: float, beta: float) -> Column:
    return F.transform(a, lambda x: x * alpha + beta)


def to_bytes(a: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Values of a range as 0..255."""
    return F.transform(a, lambda x: F.floor((x - low) / (high - low) * 255 + 0.5).cast("int"))
