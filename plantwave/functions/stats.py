"""Scalar distribution quantiles for control limits (driver-side, a few numbers)."""

from __future__ import annotations

import math
from statistics import NormalDist


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_quantile(p: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution by bisection on its beta form."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if beta_cdf(d1 / 2.0, d2 / 2.0, mid) < p else (lo, mid)
    y = (lo + hi) / 2.0
    return d2 * y / (d1 * (1.0 - y))


def hotelling_limit(k: int, n: int, alpha: float) -> float:
    return k * (n - 1) * (n + 1) / (n * (n - k)) * f_quantile(alpha, k, n - k)


def residual_limit(eigenvalues, alpha: float) -> float:
    """Limit of the squared residual from the discarded eigenvalues.

    The normal quantile is the two-sided one, as existing alert counts rely on it.
    """
    t1, t2, t3 = (sum(float(e) ** i for e in eigenvalues) for i in (1, 2, 3))
    if t1 < 1e-12 or t2 < 1e-12:
        return math.inf
    h0 = 1.0 - 2.0 * t1 * t3 / (3.0 * t2 * t2)
    c = NormalDist().inv_cdf((1.0 + alpha) / 2.0)
    term = c * math.sqrt(2.0 * t2 * h0 * h0) / t1 + 1.0 + t2 * h0 * (h0 - 1.0) / (t1 * t1)
    return t1 * term ** (1.0 / h0)
