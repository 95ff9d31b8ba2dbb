"""Column functions: keyed uniforms, vector arithmetic, weights, votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, purpose: str, *key: Column) -> Column:
    """A number strictly between 0 and 1 that depends on seed, purpose and key alone, whatever the partitioning."""
    text = F.concat_ws(":", F.lit(f"{seed}:{purpose}"), *(k.cast("string") for k in key))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_distance(a, b))


def interpolated(a: Column | str, b: Column | str, alpha: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + alpha * (y - x))


def min_max(value: Column, low: Column, high: Column, n: Column | None = None) -> Column:
    """(value - low) / (high - low); where both are equal 1 / n, or 0 without n."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(1.0) / n if n is not None else F.lit(0.0))


def gaussian(value: Column, mu: Column | float, sigma: Column | float, floor: float = 1e-10) -> Column:
    """Density of the normal distribution, at least ``floor``."""
    if not isinstance(sigma, Column) and sigma <= 0:
        raise ValueError("sigma must be positive")
    mu = mu if isinstance(mu, Column) else F.lit(float(mu))
    return F.greatest(F.exp(-0.5 * F.pow((value - mu) / sigma, F.lit(2.0))) / (sigma * F.sqrt(2 * F.pi())), F.lit(floor))


def argmax(scores: Column | str) -> Column:
    """Index from 0 of the largest entry, the first among equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
