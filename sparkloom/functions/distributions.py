"""Tail probabilities of test statistics, as numpy."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, from its even and odd terms, by the modified Lentz rule."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, freedom: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    if math.isnan(t) or math.isnan(freedom) or freedom <= 0:
        return math.nan
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def kolmogorov(distance: float, n: float) -> float:
    """P(a largest distance of n values' steps from a continuous distribution is at least `distance`): the limit's series at Stephens' argument."""
    if math.isnan(distance) or n <= 0:
        return math.nan
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * distance
    if x < 0.2:
        return 1.0
    k = np.arange(1, 101)
    return float(min(1.0, max(0.0, 2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x)).sum())))
