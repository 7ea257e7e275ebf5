"""Beta quantile for the few plotted ranks of a probability plot (at most 1,500 per column)."""

from __future__ import annotations

import math

import numpy as np


def _ln_beta(a, b):
    g = np.vectorize(math.lgamma)
    return g(a) + g(b) - g(a + b)


def _fraction(a, b, x, steps=500):
    """Continued fraction DLMF 8.17.22 evaluated backwards."""
    f = np.ones_like(x)
    for m in range(steps, 0, -1):
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        f = 1 + even / (1 + odd / f)
    return 1 / (1 - (a + b) * x / (a + 1) / f)


def beta_cdf(a, b, x):
    front = np.exp(a * np.log(x) + b * np.log1p(-x) - _ln_beta(a, b))
    left = x < (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(left, a, b), np.where(left, b, a), np.where(left, x, 1 - x)
    part = front * _fraction(aa, bb, xx) / aa
    return np.where(left, part, 1 - part)


def beta_quantile(p, a, b):
    lo, hi = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = beta_cdf(a, b, mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2
