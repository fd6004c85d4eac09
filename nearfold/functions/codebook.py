"""Scalar codebooks of a centred normal distribution."""

from __future__ import annotations

import math


def erfinv(x: float) -> float:
    """Inverse of math.erf: a closed-form start (Winitzki's approximation), then Newton's method."""
    if not -1 < x < 1:
        raise ValueError("erfinv is defined between -1 and 1")
    if not x:
        return 0.0
    a = 0.147
    log = math.log(1 - x * x)
    half = 2 / (math.pi * a) + log / 2
    y = math.copysign(math.sqrt(math.sqrt(half * half - log / a) - half), x)
    for _ in range(4):
        y -= (math.erf(y) - x) / (2 / math.sqrt(math.pi) * math.exp(-y * y))
    return y


def normal_levels(sigma: float, k: int) -> list[float]:
    """The k quantiles of N(0, sigma) at the middles of k equal shares, ascending."""
    return [sigma * math.sqrt(2) * erfinv(2 * (i + 0.5) / k - 1) for i in range(k)]


def half_mean(sigma: float) -> float:
    """Mean of the positive half of N(0, sigma)."""
    return sigma * math.sqrt(2 / math.pi)
