import math
import random

import numpy as np
import pytest

from tablescope.llm import tiles
from tablescope.llm.hard_negatives import mine, slots, windows
from tablescope.llm.topk_search import search

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def table(rng, n, dim=6, ids=None):
    """Few distinct values, so that many scores tie; one vector in three is the same, one label holds a third of the rows."""
    rows = []
    for k in range(n):
        v = [0.5] * dim if k % 3 == 0 else [rng.choice([-0.5, -0.01, 0.0, 0.25, 0.3]) for _ in range(dim)]
        rows.append((ids[k] if ids else k, v, 1 if k % 3 == 1 else rng.randrange(4), "x", 7))
    return rows


ODD = [(150, None, 1, "x", 1), (200, [0.1, None, 0.2, 0.1, 0.1, 0.1], 1, "x", 1), (250, [math.nan] * 6, 1, "x", 1), (300, [math.inf] + [0.0] * 5, 1, "x", 1),
       (None, [9.0] * 6, 1, "x", 1), (350, [], 2, "x", 1), (351, [], 2, "x", 1), (400, [0.2, 0.4], 2, "x", 1), (403, [0.2, 0.1], 3, "x", 1),
       (450, [3e38] * 6, 2, "x", 1), (451, [1e30] * 6, 2, "x", 1), (452, [1e9, 1e9, 1.0, 1.0, 1.0, 1.0], None, "x", 1)]


def whole(rows, label):
    out = []
    for i, v, g, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (g is not None or not label):
            out.append((i, [math.floor(256 * float(np.float32(x))) for x in v], g))
    return out


def scored(rows, q, k):
    """(score, id, label) of all rows but number ``k``, best first."""
    out = []
    for n, (i, v, g) in enumerate(rows):
        if n != k and len(v) == len(q):
            s = sum(a * b for a, b in zip(q, v, strict=True))
            out.append((min(max(s, -(1 << 63) + 1), (1 << 63) - 1), i, g))
    return sorted(out, key=lambda t: (-t[0], t[1]))


def brute_search(rows, modulus, k):
    rows, out = whole(rows, False), []
    for n, (i, v, _) in enumerate(rows):
        if i % modulus == 0:
            out += [(i, r + 1, j, s) for r, (s, j, _) in enumerate(scored(rows, v, n)[:k])]
    return sorted(out)


def brute_mine(rows, modulus, positives, negatives):
    rows, out = whole(rows, True), []
    for n, (i, v, g) in enumerate(rows):
        if i % modulus == 0:
            ranked = scored(rows, v, n)
            for ps, pid, _ in [t for t in ranked if t[2] == g][:positives]:
                found = [(s, j) for s, j, h in ranked if h != g and 50 * ps <= 100 * s <= 95 * ps][:negatives]
                out += [(i, pid, r + 1, j, ps, s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("bytes_", [1 << 20, 400])
def test_search_and_negatives_equal_brute_force(spark, monkeypatch, bytes_):
    """With the small size there are many query tiles and shards, merged in several rounds."""
    monkeypatch.setattr(tiles, "TILE_BYTES", bytes_)
    monkeypatch.setattr(tiles, "SHARD_BYTES", bytes_)
    rng = random.Random(5)
    rows = table(rng, 180) + ODD + table(rng, 30, ids=[50] * 2 + list(range(500, 528)))  # id 50 occurs three times
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert tuples(search(df, 10, 5)) == brute_search(rows, 10, 5)
    got, want = tuples(mine(df, 10)), brute_mine(rows, 10, 5, 3)
    assert got == want and len(want) > 50


def test_overlapping_windows(spark):
    """Random scores: the windows of one anchor overlap and end at five different limits."""
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in np.abs(rng.normal(size=8))], int(i % 3), "", 0) for i in range(400)]
    got, want = tuples(mine(spark.createDataFrame(rows, SCHEMA).repartition(3), 20)), brute_mine(rows, 20, 5, 3)
    assert got == want and len({g[4] for g in got}) > 40


def test_slots_are_disjoint_and_cover_the_windows():
    rng = np.random.default_rng(0)
    p = -np.sort(-rng.integers(-5, 60, (500, 5)), axis=1)
    low, high = windows(p)
    begin, end, slot = slots(p)
    for r in range(len(p)):
        parts = [set(range(begin[r, s], end[r, s] + 1)) if begin[r, s] <= end[r, s] else set() for s in range(5)]
        assert sum(map(len, parts)) == len(set().union(*parts))
        for k in range(5):
            window = {x for x in range(-10, 80) if 50 * p[r, k] <= 100 * x <= 95 * p[r, k]}
            assert window == (set(range(low[r, k], high[r, k] + 1)) if low[r, k] <= high[r, k] else set())
            assert window <= set().union(*parts[slot[r, k]:])


def test_few_rows_and_empty(spark):
    few = spark.createDataFrame([(50, [1.0], 1, "", 0), (51, [1.0], 1, "", 0)], SCHEMA)
    assert tuples(search(few)) == [(50, 1, 51, 65536)]
    assert tuples(mine(few)) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert search(empty).count() == 0 and mine(empty).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (100, 1 << 20, 1 << 30):
        a, b = rng.integers(-top, top, (5, 7)), rng.integers(-top, top, (6, 7))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert tiles.products(a, b).astype(np.int64).tolist() == want
