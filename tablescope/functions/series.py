"""Numpy helpers for one bounded block (or one small coefficient table) of a series."""

from __future__ import annotations

import math

import numpy as np

# MacKinnon (1994) response surface, one series, constant only; powers from 0 up.
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
# Kwiatkowski et al. (1992), level stationarity.
KPSS_STAT, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)
# CUSUM drift and threshold (in standard deviations).
DRIFT, THRESHOLD, STEP = 0.5, 5.0, 1024
# STL spans and iterations.
SEASONAL_SPAN, INNER = 7, 5


def adf_pvalue(tau: float) -> float:
    if tau >= TAU_MAX:
        return 1.0
    if tau <= TAU_MIN:
        return 0.0
    coefs = TAU_SMALL if tau <= TAU_STAR else TAU_LARGE
    return 0.5 * math.erfc(-sum(c * tau ** i for i, c in enumerate(coefs)) / math.sqrt(2))


def adf_design(x: np.ndarray, lags: int) -> np.ndarray:
    """Columns: response dy(t), y(t-1), 1, dy(t-1) ... dy(t-lags); one row per usable t."""
    d = np.diff(x)
    rows = len(d) - lags
    if rows <= 0:
        return np.zeros((0, lags + 3))
    cols = [d[lags:], x[lags:-1], np.ones(rows)] + [d[lags - j:len(d) - j] for j in range(1, lags + 1)]
    return np.column_stack(cols)


def adf_from_gram(gram: np.ndarray, n_obs: int, head: np.ndarray, max_lag: int) -> tuple[float, int]:
    """(tau, chosen lag): AIC over all lag counts on the common sample, then the refit on all usable rows.

    ``gram`` is the cross-product matrix of the common sample, ``head`` the first values of the series,
    which supply the rows that a shorter lag can use in addition.
    """
    best = None
    for lag in range(max_lag + 1):
        k = lag + 2
        a, b = gram[1:k + 1, 1:k + 1], gram[1:k + 1, 0]
        ssr = gram[0, 0] - b @ np.linalg.lstsq(a, b, rcond=None)[0]
        aic = n_obs * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / n_obs) + 1) + 2 * k
        if best is None or aic < best[0]:
            best = (aic, lag)
    lag = best[1]
    k = lag + 2
    extra = adf_design(head[:max_lag + 1], lag) if lag < max_lag else np.zeros((0, lag + 3))
    full = gram[:k + 1, :k + 1] + extra.T @ extra
    n = n_obs + len(extra)
    inverse = np.linalg.pinv(full[1:, 1:])
    beta = inverse @ full[1:, 0]
    ssr = full[0, 0] - full[1:, 0] @ beta
    return float(beta[0] / math.sqrt(ssr / (n - k) * inverse[0, 0])), lag


def lagged_products(x: np.ndarray, own: np.ndarray, lags: int) -> np.ndarray:
    """Sums of x(t) * x(t - k) over the own rows t, for k = 1 .. lags, by one transform for all lags."""
    size = 1 << int(len(x) + lags).bit_length()
    spectrum = np.fft.rfft(np.where(own, x, 0.0), size) * np.conj(np.fft.rfft(x, size))
    return np.fft.irfft(spectrum, size)[1:lags + 1]


def levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations r[0..m] (Durbin's recursion)."""
    out, phi, noise = [1.0], np.zeros(0), 1.0
    for k in range(1, len(r)):
        value = (r[k] - phi @ r[k - 1:0:-1]) / noise if noise > 1e-12 else 0.0
        phi = np.append(phi - value * phi[::-1], value)
        noise *= 1 - value * value
        out.append(float(value))
    return np.array(out)


def cusum(x, tail_mean, tail_sd, first, state):
    """Alarms of one block and the state behind its last row.

    ``state`` = (start, mean, sd, hi, lo); ``tail_mean`` / ``tail_sd`` describe the series from each row on.
    Between two alarms the two sums are max-plus prefix scans, so they are computed STEP rows at a time.
    """
    start, mean, sd, hi, lo = state
    alarms, i = [], 0
    while i < len(x) and sd > 0:
        z = (x[i:i + STEP] - mean) / sd
        up = hi + np.cumsum(z - DRIFT)
        up -= np.minimum(np.minimum.accumulate(up), 0)
        down = lo + np.cumsum(-z - DRIFT)
        down -= np.minimum(np.minimum.accumulate(down), 0)
        over = np.flatnonzero((up > THRESHOLD) | (down > THRESHOLD))
        if len(over):
            i += int(over[0])
            alarms.append(first + i)
            start, mean, sd, hi, lo = first + i, tail_mean[i], tail_sd[i], 0.0, 0.0
            i += 1
        else:
            hi, lo = float(up[-1]), float(down[-1])
            i += len(z)
    return alarms, (start, mean, sd, hi, lo)


def cusum_map(x, mean, sd):
    """What a block without alarms does to the two sums: for each side (total, end from 0, highest running total, peak from 0).

    A sum that enters at h leaves at max(end, h + total) and peaks at max(peak, h + highest): maps that can be composed.
    """
    if not sd > 0:
        return (0.0, 0.0, -np.inf, -np.inf) * 2
    out = []
    for side in (1.0, -1.0):
        total = np.cumsum(side * (x - mean) / sd - DRIFT)
        own = total - np.minimum(np.minimum.accumulate(total), 0)
        out += [float(total[-1]), float(own[-1]), float(total.max()), float(own.max())]
    return tuple(out)


def _local_line(y, at, left, span, reach, scale):
    """Tricube local line at positions ``at`` using ``span`` points from ``left``; ``scale`` is the series range."""
    n = len(y)
    idx = left[:, None] + np.arange(span)[None, :]
    dist = np.abs(idx - at[:, None])
    h = np.maximum(at - left, left + span - 1 - at).astype(float) + reach
    w = np.where(dist <= 0.999 * h[:, None], np.where(dist <= 0.001 * h[:, None], 1.0, (1 - (dist / h[:, None]) ** 3) ** 3), 0.0)
    w /= w.sum(axis=1, keepdims=True)
    centre = (w * idx).sum(axis=1)
    spread = (w * (idx - centre[:, None]) ** 2).sum(axis=1)
    tilt = np.sqrt(spread) > 0.001 * scale
    slope = np.where(tilt, (at - centre) / np.where(spread > 0, spread, 1.0), 0.0)
    w = w * (1 + slope[:, None] * (idx - centre[:, None]))
    return (w * y[np.clip(idx, 0, n - 1)]).sum(axis=1)


def loess(y, span, scale, at=None):
    """Local linear smoothing with the ``span`` nearest points."""
    n = len(y)
    at = np.arange(n) if at is None else at
    q = min(span, n)
    reach = (span - n) // 2 if span > n else 0
    left = np.clip(at - (q - 1) // 2 if q % 2 else at - q // 2, 0, n - q)
    return _local_line(y, at.astype(float), left, q, reach, scale)


def _moving(y, k):
    c = np.cumsum(np.insert(y, 0, 0.0))
    return (c[k:] - c[:-k]) / k


def stl(y, period, total):
    """Seasonal-trend decomposition by LOESS (Cleveland et al. 1990), not robust; ``total`` is the whole length."""
    n = len(y)
    trend_span = math.ceil(1.5 * period / (1 - 1.5 / SEASONAL_SPAN))
    trend_span += 1 - trend_span % 2
    low_span = period + 1 + (period + 1) % 2 - 0
    low_span += 1 - low_span % 2
    trend, season = np.zeros(n), np.zeros(n)
    for _ in range(INNER):
        detrended = y - trend
        cycle = np.zeros(n + 2 * period)
        for phase in range(period):
            sub = detrended[phase::period]
            places = np.arange(-1, len(sub) + 1)
            cycle[phase::period][:len(places)] = loess(sub, SEASONAL_SPAN, (total - 1) // period, places)
        low = loess(_moving(_moving(_moving(cycle, period), period), 3), low_span, total - 1)
        season = cycle[period:period + n] - low
        trend = loess(y - season, trend_span, total - 1)
    return trend, season
