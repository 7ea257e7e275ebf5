"""Numeric by group: the shared plan of group statistics, ANOVA, Kruskal-Wallis, Welch and Mann-Whitney."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions import expr as X
from tablescope.functions import stats as ST
from tablescope.plans import blocks as B
from tablescope.session import cut_lineage

KEYS = ["num", "cat"]
# A table of so many groups is broadcast (about 100 bytes each).
BROADCAST_GROUPS = 50_000


def grouped_long(df: DataFrame, nums: list[str], cats: list[str], max_groups: int | None = None) -> DataFrame:
    """(num, cat, grp, x); with ``max_groups`` only the alphabetically first levels of each category."""
    long = (df.select(X.rows(*[
        F.struct(F.lit(n).alias("num"), F.lit(c).alias("cat"), X.text(df, c).alias("grp"), X.double(df, n).alias("x"))
        for n in nums for c in cats]))
        .where(F.col("grp").isNotNull() & F.col("x").isNotNull()))
    return _first_levels(long, df, cats, max_groups)


def _first_levels(long: DataFrame, df: DataFrame, cats: list[str], max_groups: int | None) -> DataFrame:
    if max_groups is None:
        return long
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    levels = (B.freq(df, cats).withColumn("r", place).where(F.col("r") <= max_groups)
              .select(F.col("column").alias("cat"), F.col("value").alias("grp")))
    # At most max_groups rows per category.
    return long.join(F.broadcast(levels), ["cat", "grp"])


def value_counts(df: DataFrame, nums: list[str], cats: list[str]) -> DataFrame:
    """(num, x, g0, g1, .., c): rows of every number and combination of levels, checkpointed.

    The one pass over the rows behind rank tests and group statistics. A row becomes one row per number here, not one per
    number and category; what follows spreads only what is left after merging equal rows.
    """
    levels = [f"g{i}" for i in range(len(cats))]
    rows = df.select(*[X.text(df, c).alias(g) for c, g in zip(cats, levels, strict=True)],
                     *[X.double(df, n).alias(f"x{i}") for i, n in enumerate(nums)])
    rows = rows.select(*levels, X.rows(*[F.struct(F.lit(n).alias("num"), F.col(f"x{i}").alias("x")) for i, n in enumerate(nums)]))
    return cut_lineage(rows.where("x is not null").groupBy("num", "x", *levels).agg(F.count(F.lit(1)).alias("c")))


def spread(counts: DataFrame, df: DataFrame, cats: list[str], max_groups: int | None = None) -> DataFrame:
    """``grouped_long`` of ``value_counts``: (num, cat, grp, x, c); a value may have several rows in a group."""
    each = [F.struct(F.lit(c).alias("cat"), F.col(f"g{i}").alias("grp")) for i, c in enumerate(cats)]
    long = counts.select("num", X.rows(*each), "x", "c").where("grp is not null")
    return _first_levels(long, df, cats, max_groups)


def weighted_moments(long: DataFrame, min_n: int) -> DataFrame:
    """``moments`` of the rows of ``spread``, checkpointed: squares are summed around the mean in a second pass."""
    by = [*KEYS, "grp"]
    x, c = F.col("x"), F.col("c")
    mean = F.when(F.min(x) == F.max(x), F.min(x)).otherwise(F.sum(c * x) / F.sum(c))
    first = cut_lineage(long.groupBy(*by).agg(F.sum(c).alias("n"), mean.alias("mean"), F.min(x).alias("min"), F.max(x).alias("max")).where(F.col("n") >= min_n))
    first = first.join(F.broadcast(first.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("k")).where("k >= 2")), KEYS)
    squares = _with_groups(long, first.select(*by, "mean")).groupBy(*by).agg(F.sum(c * (x - F.col("mean")) ** 2).alias("ss"))
    return cut_lineage(first.join(squares, by).select(*by, "n", "mean", F.sqrt(F.col("ss") / F.col("n")).alias("std"), "min", "max", "ss", "k"))


def _with_groups(long: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the given groups with their columns."""
    few = groups.count() <= BROADCAST_GROUPS
    return long.join(F.broadcast(groups) if few else groups, [*KEYS, "grp"])


def moments(long: DataFrame, min_n: int) -> DataFrame:
    """Count, mean, central sum of squares per group; only pairs left with two groups or more."""
    m = long.groupBy(*KEYS, "grp").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.regr_sxx("x", "x").alias("ss")).where(F.col("n") >= min_n)
    # one row per pair of columns
    pairs = m.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    return m.join(F.broadcast(pairs), KEYS)


def anova(groups: DataFrame) -> DataFrame:
    """F test from the group moments."""
    grand = groups.groupBy(*KEYS).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    g = groups.join(F.broadcast(grand), KEYS)
    s = g.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ssb"), F.sum("ss").alias("ssw"))
    s = s.where(F.col("n") > F.col("k")).select(
        *KEYS, "n", "k", (F.col("k") - 1).cast("double").alias("d1"), (F.col("n") - F.col("k")).cast("double").alias("d2"),
        "ssb", "ssw")
    s = s.withColumn("statistic", X.div(F.col("ssb") / F.col("d1"), F.col("ssw") / F.col("d2")))
    return s.select(*KEYS, "n", "k", "statistic", ST.f_sf(F.col("statistic"), F.col("d1"), F.col("d2")).alias("pvalue"),
                    F.coalesce(X.div(F.col("ssb"), F.col("ssb") + F.col("ssw")), F.lit(0.0)).alias("effect_size"))


def rank_sums(long: DataFrame, groups: DataFrame) -> DataFrame:
    """Rank sum per group (average ranks over all kept groups of the pair) with the tie term, from the rows of ``spread``.

    Values are merged per (pair, group) before the global order, so a value shared by a third of
    the rows is one row per group.
    """
    counts = _with_groups(long, groups.select(*KEYS, "grp")).groupBy(*KEYS, "grp", "x").agg(F.sum("c").alias("c"))
    ranked = B.avg_ranks(counts, KEYS, "x", "c")
    t = F.col("_peers").cast("double")
    return ranked.groupBy(*KEYS, "grp").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("rank_sum"),
        F.sum(F.col("c") * (t * t - 1)).alias("ties"))


def kruskal(sums: DataFrame) -> DataFrame:
    """H with tie correction."""
    s = sums.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum("ties").alias("ties"),
                                F.sum(F.col("rank_sum") ** 2 / F.col("n")).alias("r2"))
    n = F.col("total").cast("double")
    h = 12.0 / (n * (n + 1)) * F.col("r2") - 3 * (n + 1)
    s = s.select(*KEYS, F.col("total").alias("n"), "k", X.div(h, 1 - F.col("ties") / (n * n * n - n)).alias("statistic"),
                 (F.col("k") - 1).cast("double").alias("dof"))
    return s.withColumn("pvalue", ST.chi2_sf(F.col("statistic"), F.col("dof"))).drop("dof")


def two_samples(table: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with exactly two groups, side by side: ``<column>_1`` and ``<column>_2`` in level order."""
    first = F.struct("grp", *columns)
    both = table.groupBy(*KEYS).agg(F.min(first).alias("a"), F.max(first).alias("b"), F.count(F.lit(1)).alias("k")).where("k = 2")
    return both.select(*KEYS, F.col("a.grp").alias("grp_1"), F.col("b.grp").alias("grp_2"),
                       *[F.col(f"a.{c}").alias(f"{c}_1") for c in columns], *[F.col(f"b.{c}").alias(f"{c}_2") for c in columns])


# Without ties and with a group of at most so many rows the p-value is exact, up to so many rows of both.
EXACT_GROUP, EXACT_ROWS = 8, 1_000


def _arrangements(n1: int, n2: int) -> np.ndarray:
    """Orders of two groups by their U = 0 .. n1 * n2, counted one row of the smaller group at a time."""
    out = np.zeros(n1 * n2 + 1)
    out[0] = 1.0
    for i in range(1, n1 + 1):
        # times (1 - q^(n2 + i)) / (1 - q^i)
        out[n2 + i:] -= out[:-(n2 + i)].copy() if n2 + i < len(out) else 0.0
        for r in range(i):
            out[r::i] = np.cumsum(out[r::i])
    return out


def _exact_p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Two-sided p of U = ``u`` under all orders being equally likely; one value per test."""
    out = []
    for x, a, b in zip(u, n1, n2, strict=True):
        a, b = sorted((int(a), int(b)))
        if not 0 < a <= EXACT_GROUP or a + b > EXACT_ROWS:
            out.append(None)
            continue
        ways = _arrangements(a, b)
        at = int(round(max(x, a * b - x)))
        out.append(min(1.0, 2 * float(ways[at:].sum() / ways.sum())))
    return pd.Series(out, dtype="float64")


def mann_whitney(sums: DataFrame) -> DataFrame:
    """Two-sided U of the first group: exact without ties if a group has at most 8 rows, else the normal
    approximation with tie and continuity correction."""
    s = two_samples(sums, ["n", "rank_sum", "ties"])
    n1, n2 = F.col("n_1").cast("double"), F.col("n_2").cast("double")
    n = n1 + n2
    u1 = F.col("rank_sum_1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - (F.col("ties_1") + F.col("ties_2")) / (n * (n - 1))))
    z = X.div(F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5, spread)
    small = (F.least("n_1", "n_2") <= EXACT_GROUP) & (F.col("ties_1") + F.col("ties_2") == 0)
    s = s.select(*KEYS, "grp_1", "grp_2", "n_1", "n_2", u1.alias("statistic"), z.alias("z"), F.when(small, F.pandas_udf(_exact_p, "double")(u1, n1, n2)).alias("exact"))
    p = F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("z") <= 0, 1.0).otherwise(F.least(F.lit(1.0), ST.normal_two_sided(F.col("z"))))
    return s.withColumn("pvalue", F.coalesce(p, F.lit(1.0))).drop("z", "exact")


def welch(groups: DataFrame) -> DataFrame:
    """t statistic with unequal variances, Welch-Satterthwaite degrees of freedom, two-sided p."""
    s = two_samples(groups, ["n", "mean", "std", "ss"])
    v1, v2 = (F.col(f"ss_{i}") / (F.col(f"n_{i}") - 1) / F.col(f"n_{i}") for i in (1, 2))
    s = s.withColumn("v1", v1).withColumn("v2", v2)
    a, b = F.col("v1"), F.col("v2")
    s = s.withColumn("statistic", X.div(F.col("mean_1") - F.col("mean_2"), F.sqrt(a + b))).withColumn(
        "dof", X.div((a + b) ** 2, a * a / (F.col("n_1") - 1) + b * b / (F.col("n_2") - 1)))
    return s.withColumn("pvalue", ST.t_two_sided(F.col("statistic"), F.col("dof"))).drop("v1", "v2", "ss_1", "ss_2")


def cohens_d(groups: DataFrame) -> DataFrame:
    """Mean difference over the root mean of the two population variances, with its label."""
    s = two_samples(groups, ["n", "mean", "std"])
    pooled = F.sqrt((F.col("std_1") ** 2 + F.col("std_2") ** 2) / 2)
    s = s.withColumn("effect_size", F.coalesce(X.div(F.col("mean_1") - F.col("mean_2"), pooled), F.lit(0.0)))
    d = F.abs("effect_size")
    label = F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").otherwise("large")
    return s.withColumn("effect_label", label)
