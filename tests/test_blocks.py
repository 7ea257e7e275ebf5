import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.functions import stats as ST
from tablescope.plans import blocks as B


def test_quantiles_fold_and_still_find_exact_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(B, "EXACT_BELOW", 10)
    monkeypatch.setattr(B, "ACCURACY", 200)
    rng = np.random.default_rng(1)
    x = np.round(rng.gamma(2.0, 10.0, 20_000), 2)
    x[:7_000] = 5.0  # one value holds a third of the rows
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select(F.lit("a").alias("k"), "x")
    probs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    row = B.quantiles(df, ["k"], "x", probs).first()
    for name, p in probs.items():
        assert row[name] == pytest.approx(np.quantile(x, p), abs=1e-9)


@pytest.mark.parametrize("few_groups", [True, False])
def test_quantiles_by_rounds_of_selection(spark, monkeypatch, few_groups):
    """Nothing is folded by the sketch; rounds alone bring each key down to what one task may sort."""
    monkeypatch.setattr(B, "KEEP", 60)
    monkeypatch.setattr(B, "CELLS", 16)
    rng = np.random.default_rng(3)
    x = {"a": rng.normal(size=6_000), "b": np.round(rng.gamma(2.0, 10.0, 3_000), 1), "c": np.full(2_000, 4.0), "d": np.array([1.0, 2.0]), "e": np.arange(61.0)}
    rows = [(k, float(v)) for k, values in x.items() for v in values] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    probs = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.999, "f": 1.0}
    for nearest in (False, True):
        got = {r["k"]: r for r in B.quantiles(df, ["k"], "x", probs, nearest=nearest, few_groups=few_groups).collect()}
        for k, values in x.items():
            values = np.sort(values)
            for name, p in probs.items():
                want = values[int(np.floor(p * (len(values) - 1) + 0.5))] if nearest else np.quantile(values, p)
                assert got[k][name] == pytest.approx(want, abs=1e-9), (k, name)
            assert got[k]["n"] == len(values)


def test_a_round_keeps_a_small_share_and_all_weight(spark):
    df = spark.range(40_000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("_v"), F.lit(False).alias("_out"), F.lit(2).cast("long").alias("_n"),
                                    F.lit(80_000).cast("long").alias("_total"))
    ranks, kept = [F.lit(20_000), F.lit(60_001)], [40_000]
    for _ in range(3):
        df = B.refine_once(df, ["k"], ranks, 32)
        kept.append(df.where("not _out").count())
        assert df.agg(F.sum("_n")).first()[0] == 80_000
    assert all(b <= a / 8 for a, b in zip(kept[:3], kept[1:], strict=False) if a > 200) and kept[-1] < 50
    assert df.where("not _out and _v in (10000, 30000)").count() == 2


@pytest.mark.parametrize("partitions", [1, 8])
def test_average_ranks_do_not_depend_on_partitions(spark, partitions):
    x = [3.0, 1.0, 1.0, 2.0, 3.0, 3.0, 7.0]
    df = spark.createDataFrame([("g", v) for v in x], "k string, x double").repartition(partitions)
    counts = df.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    got = {r["x"]: r["rank"] for r in B.avg_ranks(counts, ["k"], "x").collect()}
    assert got == {1.0: 1.5, 2.0: 3.0, 3.0: 5.0, 7.0: 7.0}


def test_ordered_has_no_single_partition_exchange(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("x"))
    o = B.ordered(df, ["k"], ["x"])
    assert "SinglePartition" not in o._jdf.queryExecution().executedPlan().toString()
    assert [r["_rn"] for r in o.orderBy("x").collect()] == list(range(1, 1001))


def test_blocks_copy_the_halo(spark):
    df = spark.range(1, 11).select(F.lit("a").alias("k"), F.col("id").alias("_rn"))
    got = B.blocks(df, ["k"], 4, 1, 1).groupBy("_block").agg(F.sort_array(F.collect_list("_rn")).alias("r")).collect()
    got = {r["_block"]: r["r"] for r in got}
    assert got[0] == [1, 2, 3, 4, 5] and got[1] == [4, 5, 6, 7, 8, 9] and got[2][:3] == [8, 9, 10]


def test_distribution_functions(spark):
    # Table values: chi-square .05 at 3, t .05 at 10, F .05 at (3, 20), normal .05.
    row = spark.range(1).select(
        F.lit(7.814728).alias("c"), F.lit(3.0).alias("k"), F.lit(2.228139).alias("t"), F.lit(10.0).alias("v"),
        F.lit(3.098391).alias("f"), F.lit(20.0).alias("w"), F.lit(1.959964).alias("z")).select(
        ST.chi2_sf(F.col("c"), F.col("k")).alias("c"), ST.t_two_sided(F.col("t"), F.col("v")).alias("t"),
        ST.f_sf(F.col("f"), F.col("k"), F.col("w")).alias("f"), ST.normal_two_sided(F.col("z")).alias("z"),
        ST.normal_quantile(F.lit(0.975)).alias("q")).first()
    assert [row["c"], row["t"], row["f"], row["z"]] == pytest.approx([0.05] * 4, abs=1e-6)
    assert row["q"] == pytest.approx(1.959964, abs=1e-6)


def test_moments_of_pairs_equal_numpy_without_copies_of_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6)) * [1, 10, 0.1, 5, 1, 0] + [1e9, 0, 3, -1e6, 0, 7]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[3, 4] = np.inf
    names = ["a", "b", "c.d", "e", "f", "same"]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`{c}` double" for c in names)).repartition(7)
    pairs = [(names[i], names[j]) for i in range(6) for j in range(6) if i != j]
    out = B.pair_moments(df, pairs)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["var_a"], r["var_b"]): r for r in out.collect()}
    assert len(got) == 30
    for a, b in pairs:
        p, q = x[:, names.index(a)], x[:, names.index(b)]
        both = ~np.isnan(p) & ~np.isnan(q)
        p, q, r = p[both], q[both], got[a, b]
        assert r["n"] == both.sum()
        if np.isinf(p).any() or np.isinf(q).any():
            assert np.isnan(r["sxy"])
            continue
        assert r["mean_a"] == pytest.approx(p.mean()) and r["mean_b"] == pytest.approx(q.mean())
        assert r["sxx"] == pytest.approx(((p - p.mean()) ** 2).sum(), rel=1e-6, abs=1e-9)
        assert r["sxy"] == pytest.approx(((p - p.mean()) * (q - q.mean())).sum(), rel=1e-5, abs=1e-6)
    assert B.pair_moments(df.limit(0), pairs).count() == 0


def test_rows_of_large_groups_are_not_shuffled_for_shapiro(spark):
    from tablescope.operators import univariate as U
    rng = np.random.default_rng(2)
    rows = [("large", float(v)) for v in rng.normal(size=6_000)] + [("small", float(v)) for v in rng.normal(size=50)] + [("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    out = U.shapiro_wilk(df, ["k"])
    assert [(r["k"], r["n"]) for r in out.collect()] == [("small", 50)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "strategy=broadcast" in plan
