"""The outlier factor in regions that find neighbours again instead of writing them."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators import ml as ML
from tablescope.plans import blocks as B
from tablescope.session import shared_folder


def vectors_of(spark, x, w):
    rows = [(*map(float, v), int(c), i) for i, (v, c) in enumerate(zip(x, w, strict=True))]
    return spark.createDataFrame(rows, ", ".join(f"z{j} double" for j in range(x.shape[1])) + ", w long, id long").repartition(5)


def brute(x, w, k):
    """LOF of weighted vectors, by rows: every vector stands for w rows."""
    at = np.repeat(np.arange(len(x)), w)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    rows = d[at][:, at]
    np.fill_diagonal(rows, np.inf)
    near = np.argsort(rows, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(rows, near, axis=1)
    lrd = 1 / (np.maximum(dist, dist[near][:, :, -1]).mean(axis=1) + 1e-10)
    lof = lrd[near].mean(axis=1) / lrd
    return lof[np.searchsorted(at, np.arange(len(x)))]


def written(folder):
    return sum(os.path.getsize(os.path.join(p, f)) for p, _, names in os.walk(folder) for f in names)


@pytest.mark.parametrize("size", [30, 200, None])
def test_regions_find_the_neighbours_of_far_and_repeated_points(spark, size):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(700, 3)), rng.normal(scale=1e-3, size=(300, 3)) + 4, rng.normal(scale=60, size=(25, 3)), [[500.0, 0, 0]]])
    w = np.where(np.arange(len(x)) % 40 == 0, 3, 1)
    w[5], w[-1] = 25, 2  # more copies than neighbours are wanted; a far pair
    got = ML.lof_scores(vectors_of(spark, x, w), ["z0", "z1", "z2"], 12, size).toPandas()
    assert len(got) == len(x) and got["id"].is_unique and got["w"].sum() == w.sum()
    want = {tuple(v): (int(c), f) for v, c, f in zip(x, w, brute(x, w, 12), strict=True)}
    for z0, z1, z2, c, f in got[["z0", "z1", "z2", "w", "lof"]].itertuples(index=False):
        assert want[z0, z1, z2] == (c, pytest.approx(f, rel=1e-6))


def test_points_on_a_grid_are_cut_and_weighed(spark):
    x = np.array([(a, b) for a in range(40) for b in range(5)], float)
    got = ML.lof_scores(vectors_of(spark, x, np.full(200, 30)), ["z0", "z1"], 20, 16).toPandas()
    assert len(got) == 200 and np.allclose(got["lof"], 1)


def test_outlier_factor_writes_no_neighbour_lists(spark):
    x = np.random.default_rng(7).normal(size=(20_000, 2))
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double").repartition(4).cache()
    df.count()
    folder = shared_folder(spark)
    folder = (spark.sparkContext.getCheckpointDir() or folder).removeprefix("file:")
    before = written(folder)
    assert ML.local_outlier_factor(df, ["a", "b"]).where("anomaly").count() == 1000
    assert written(folder) - before < 400 * len(x)  # lists of 20 neighbours a vector took over 1,000 bytes a vector


def test_weighted_cut_is_the_quantile_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "KEEP", 20)
    monkeypatch.setattr(B, "CUT_RANGES", 8)
    rng = np.random.default_rng(3)
    x, w = np.round(np.exp(rng.normal(size=900) * 3), 3), rng.integers(1, 6, 900)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, w, strict=True)], "v double, w long").repartition(3)
    for p in (0.0, 0.05, 0.5, 0.95, 0.9993, 1.0):
        assert B.weighted_cut(df, "v", "w", p) == pytest.approx(float(np.quantile(np.repeat(x, w), p)), rel=1e-12)
    assert B.weighted_cut(df.where("false"), "v", "w", 0.5) is None
    assert B.weighted_cut(df.select(F.lit(2.5).alias("v"), "w"), "v", "w", 0.3) == 2.5
