"""Shapiro-Wilk W and p-value by Royston's approximation (AS R94, 1995), per small group."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Royston's polynomials, lowest power first.
LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
SMALL_GAMMA = (-2.273, 0.459)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(coefs, x):
    return sum(c * x ** i for i, c in enumerate(coefs))


def _weights(n: int) -> np.ndarray:
    """Weights of the upper half of the sample, largest first."""
    if n == 3:
        return np.array([math.sqrt(0.5)])
    normal = NormalDist()
    m = np.array([normal.inv_cdf((n - i - 0.375) / (n + 0.25)) for i in range(n // 2)])
    total, u = 2 * float(m @ m), 1 / math.sqrt(n)
    fixed = [m[0] / math.sqrt(total) + _poly(LAST, u)]
    if n > 5:
        fixed.append(m[1] / math.sqrt(total) + _poly(SECOND, u))
    k = len(fixed)
    scale = (total - 2 * sum(m[:k] ** 2)) / (1 - 2 * sum(w * w for w in fixed))
    return np.concatenate([fixed, m[k:] / math.sqrt(scale)])


def shapiro(values) -> tuple[float, float]:
    x = np.sort(np.asarray(values, float))
    n = len(x)
    spread = float(((x - x.mean()) ** 2).sum())
    if spread == 0:
        return 1.0, 1.0
    w = _weights(n)
    stat = min(float(w @ (x[::-1][:len(w)] - x[:len(w)])) ** 2 / spread, 1.0)
    if n == 3:
        return stat, max(0.0, 6 / math.pi * (math.asin(math.sqrt(stat)) - math.asin(math.sqrt(0.75))))
    if stat == 1.0:
        return stat, 1.0
    y, ln = math.log(1 - stat), math.log(n)
    if n <= 11:
        gamma = _poly(SMALL_GAMMA, n)
        if y >= gamma:
            return stat, 0.0
        y, mean, sd = -math.log(gamma - y), _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_SD, n))
    else:
        mean, sd = _poly(LARGE_MEAN, ln), math.exp(_poly(LARGE_SD, ln))
    return stat, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))


def shapiro_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` holds (keys, x), up to 5,000 per group; fewer than 3 give no statistic."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 3:
            return pdf[keys].head(1).assign(n=len(pdf), statistic=np.nan, pvalue=np.nan, normal=False)
        stat, p = shapiro(pdf["x"])
        return pdf[keys].head(1).assign(n=len(pdf), statistic=stat, pvalue=p, normal=p > 0.05)

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(run, f"{types}, n bigint, statistic double, pvalue double, normal boolean")
