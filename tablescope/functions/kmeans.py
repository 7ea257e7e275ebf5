"""Numpy helpers of the k-means fits: starts from a weighted sample, sums of one Arrow batch for all fits at once."""

from __future__ import annotations

import numpy as np

#: Fits that compete for a start, and points of the sample they see.
STARTS, FIRST = 4, 20_000


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, half squared distance less half the squared norm) of every column of ``x``; the first of equal centres."""
    score = (centres * centres).sum(axis=1)[:, None] / 2 - centres @ x
    label, best = np.zeros(x.shape[1], np.int64), score[0].copy()
    for j in range(1, len(score)):
        closer = score[j] < best
        label[closer] = j
        np.minimum(best, score[j], out=best)
    return label, best


def sums(x: np.ndarray, label: np.ndarray, k: int, w: np.ndarray | None = None) -> np.ndarray:
    """(k, 1 + columns): weight and sum of the members of every cluster."""
    rows = [np.bincount(label, w, k)] + [np.bincount(label, v if w is None else v * w, k) for v in x]
    return np.stack(rows, axis=1).astype(float)


def moved(centres: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Means of the members; a centre without members stays."""
    n = total[:, :1]
    return np.where(n > 0, total[:, 1:] / np.maximum(n, 1e-300), centres)


def _seeds(x: np.ndarray, w: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means++: every further centre by its weighted squared distance; fewer, if there are fewer different points."""
    at = [int(rng.choice(x.shape[1], p=w / w.sum()))]
    d = ((x - x[:, at]) ** 2).sum(axis=0)
    while len(at) < k and (w * d).sum() > 0:
        at.append(int(rng.choice(x.shape[1], p=w * d / (w * d).sum())))
        d = np.minimum(d, ((x - x[:, at[-1:]]) ** 2).sum(axis=0))
    return x[:, at].T.copy()


def _settle(x: np.ndarray, w: np.ndarray, centres: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    for _ in range(rounds):
        new = moved(centres, sums(x, nearest(x, centres)[0], len(centres), w))
        gap = np.sqrt(((new - centres) ** 2).sum(axis=1).max())
        centres = new
        if gap <= tolerance:
            break
    return centres


def start(x: np.ndarray, w: np.ndarray, k: int, seed: int, rounds: int, tolerance: float) -> np.ndarray:
    """Where a fit over all rows starts: the best of a few fits over the first points of the sample, settled on all of it
    ten times as closely, so that the rounds over all rows need not creep there."""
    few, part = x[:, :FIRST], w[:FIRST]
    fits = [_settle(few, part, _seeds(few, part, k, np.random.default_rng([seed, k, i])), rounds, tolerance) for i in range(STARTS)]
    best = min(fits, key=lambda c: float((part * nearest(few, c)[1]).sum()))
    return _settle(x, w, best, rounds, tolerance / 10)


def silhouettes(x: np.ndarray, label: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Silhouette by mean squared distances, from weight, sums and squared norms of the clusters; 0 where a cluster has one row."""
    n = total[:, 0]
    there = n > 0
    norm = (x * x).sum(axis=0)
    # mean squared distance to the members of every cluster
    mean = norm + ((squares[there, None] - 2 * total[there, 1:] @ x) / n[there, None])
    own = (np.cumsum(there) - 1)[label]
    at = np.arange(x.shape[1])
    size = n[label]
    a = mean[own, at] * size / np.maximum(size - 1, 1)
    mean[own, at] = np.inf
    b = mean.min(axis=0)
    most = np.maximum(a, b)
    return np.where((size > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1), 0.0)
