"""Hypothesis tests of numerics by group, with false-discovery control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions import expr as X
from tablescope.operators import groups as G
from tablescope.plans import blocks as B

# Sizes of the test family.
MIN_GROUP, MIN_LEVELS, ALPHA = 5, 2, 0.05
KEYS = ["num", "cat"]


def usable_groupings(df: DataFrame, groupings: list[str], max_levels: int | None = None) -> list[str]:
    """Grouping columns with 2 levels or more, at most ``max_levels`` if given (column metadata)."""
    u = B.freq(df, groupings, hashed=True).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    ok = {r[0] for r in u.where((F.col("n") >= MIN_LEVELS) & (F.col("n") <= (max_levels or F.col("n")))).select("column").collect()}
    return [g for g in groupings if g in ok]


def _setup(df: DataFrame, nums: list[str], groupings: list[str], max_levels: int | None = None):
    cats = usable_groupings(df, groupings, max_levels)
    if not cats or not nums:
        return None, None
    long = G.grouped_long(df, nums, cats)
    return long, G.moments(long, MIN_GROUP)


def _ranked_setup(df: DataFrame, nums: list[str], groupings: list[str], max_levels: int | None = None):
    """``_setup`` from the counts of equal values, which the rank tests need anyway: the rows are read once."""
    cats = usable_groupings(df, groupings, max_levels)
    if not cats or not nums:
        return None, None
    long = G.spread(G.value_counts(df, nums, cats), df, cats)
    return long, G.weighted_moments(long, MIN_GROUP)


def welch_t_test(df: DataFrame, nums: list[str], groupings: list[str]) -> DataFrame:
    """I1"""
    _, groups = _setup(df, nums, groupings)
    return G.welch(groups)


def mann_whitney_u(df: DataFrame, nums: list[str], groupings: list[str]) -> DataFrame:
    """I2"""
    long, groups = _ranked_setup(df, nums, groupings)
    return G.mann_whitney(G.rank_sums(long, groups.where("k = 2")))


def cohens_d(df: DataFrame, nums: list[str], groupings: list[str]) -> DataFrame:
    """I3"""
    _, groups = _setup(df, nums, groupings)
    return G.cohens_d(groups)


def _many(groups: DataFrame, kw: DataFrame) -> DataFrame:
    an = G.anova(groups.where("k > 2")).select(*KEYS, F.col("statistic").alias("anova_f"), F.col("pvalue").alias("anova_p"))
    means = groups.where("k > 2").groupBy(*KEYS).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("grp", "mean"))), lambda s: F.concat(s["grp"], F.lit("="), F.format_string("%.4f", s["mean"]))), ", ").alias("group_means"))
    return (kw.select(*KEYS, "n", "k", F.col("statistic").alias("kruskal_h"), F.col("pvalue").alias("kruskal_p"))
            .join(an, KEYS).join(means, KEYS))


def multi_group_tests(df: DataFrame, nums: list[str], groupings: list[str]) -> DataFrame:
    """I4: three or more groups: ANOVA and Kruskal-Wallis (whose p is the reported one)."""
    long, groups = _ranked_setup(df, nums, groupings)
    return _many(groups, G.kruskal(G.rank_sums(long, groups.where("k > 2"))))


def all_tests(df: DataFrame, nums: list[str], groupings: list[str], max_levels: int | None = None) -> DataFrame:
    """One row per (feature, grouping) with the reported p rounded to four decimals."""
    long, groups = _ranked_setup(df, nums, groupings, max_levels)
    if long is None:
        return X.lit_rows(df, [], "feature string, target string, test string, pvalue double, effect_size double, "
                                  "effect_label string, significant boolean, position int")
    sums = G.rank_sums(long, groups).join(groups.select(*KEYS, "grp", "k"), [*KEYS, "grp"])
    two = G.mann_whitney(sums.where("k = 2").drop("k")).join(G.cohens_d(groups), [*KEYS]).select(
        *KEYS, F.lit("t_test_mann_whitney").alias("test"), "pvalue", "effect_size", "effect_label")
    more = G.kruskal(sums.where("k > 2").drop("k")).select(
        *KEYS, F.lit("anova_kruskal_wallis").alias("test"), "pvalue", F.lit(None).cast("double").alias("effect_size"),
        F.lit(None).cast("string").alias("effect_label"))
    order = [(n, c) for n in nums for c in groupings]
    position = F.array_position(F.array(*[F.lit(f"{n}\x00{c}") for n, c in order]), F.concat_ws("\x00", "num", "cat"))
    return two.unionByName(more).select(
        F.col("num").alias("feature"), F.col("cat").alias("target"), "test", F.round("pvalue", 4).alias("pvalue"),
        "effect_size", "effect_label", (F.col("pvalue") < ALPHA).alias("significant"), position.cast("int").alias("position"))


def tested_groups(df: DataFrame, nums: list[str], groupings: list[str], max_levels: int | None = None) -> DataFrame:
    """The groups behind every test of ``all_tests``: (feature, target, grp, n, mean, std), groups of at least 5 values."""
    _, groups = _setup(df, nums, groupings, max_levels)
    if groups is None:
        return X.lit_rows(df, [], "feature string, target string, grp string, n bigint, mean double, std double")
    return groups.select(F.col("num").alias("feature"), F.col("cat").alias("target"), "grp", "n", "mean", "std")


def fdr_bh(tests: DataFrame, pvalue: str = "pvalue", alpha: float = ALPHA) -> DataFrame:
    """Benjamini-Hochberg step-up; one row per test, so the family is small whatever the data."""
    family = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(family.orderBy(F.col(pvalue), "position"))
    t = tests.withColumn("rank", rank).withColumn("m", F.count(F.lit(1)).over(family))
    t = t.withColumn("last", F.max(F.when(F.col(pvalue) <= F.col("rank") / F.col("m") * alpha, F.col("rank"))).over(family))
    return t.withColumn("significant_fdr", F.coalesce(F.col("rank") <= F.col("last"), F.lit(False))).drop("rank", "m", "last")


def inference_table(df: DataFrame, nums: list[str], groupings: list[str], max_levels: int | None = None) -> DataFrame:
    """I5 over all tests in column order."""
    return fdr_bh(all_tests(df, nums, groupings, max_levels)).orderBy("position")


def inference_summary(df: DataFrame, nums: list[str], groupings: list[str], max_levels: int | None = None, tests: DataFrame | None = None) -> DataFrame:
    """I6; ``tests`` is the ``inference_table`` of the same columns, if it is known."""
    hit = F.col("significant_fdr")
    first = F.min_by(F.when(hit, F.concat_ws(" x ", "feature", "target")), F.when(hit, F.col("position")))
    tests = fdr_bh(all_tests(df, nums, groupings, max_levels)) if tests is None else tests
    return tests.agg(
        F.count(F.lit(1)).alias("n_tests"), X.count_if(hit).alias("significant_after_fdr"), first.alias("first_significant"))
