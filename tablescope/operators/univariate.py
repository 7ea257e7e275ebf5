"""Univariate statistics and chart data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions import expr as X
from tablescope.functions import keywords as K
from tablescope.functions import stats as ST
from tablescope.functions.shapiro import shapiro_groups
from tablescope.plans import blocks as B

# Quantiles of the numeric summary; limits of the plots and tests.
PERCENTILES = {"p1": 0.01, "p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
SHAPIRO_MAX, KDE_POINTS, QQ_POINTS, ECDF_POINTS = 5_000, 240, 1_500, 2_000
TOP_LEVELS, TOP_CATEGORIES, TEXT_BINS = 30, 15, 40
# Ranks handled per task step when a run of equal values is expanded.
RANK_CHUNK = 50_000


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    metrics = {}
    for c in columns:
        x = X.double(df, c)
        metrics[c] = {"n_rows": F.count(F.lit(1)), "n_null": X.count_if(X.ref(c).isNull()), "count": F.count(x),
                      "mean": F.avg(x), "std": F.stddev_pop(x), "min": F.min(x), "max": F.max(x),
                      "skewness": F.skewness(x), "kurtosis": F.kurtosis(x)}
    return B.wide(df, metrics)


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments from one aggregate, exact percentiles from the bracketed quantile plan."""
    q = B.quantiles(B.long_numeric(df, columns), ["column"], "x", PERCENTILES).drop("n")
    m = _moments(df, columns)
    return m.join(q, "column", "left").select(
        "column", "count", X.pct2(F.col("n_null"), F.col("n_rows")).alias("pct_missing"), "mean", "median", "std",
        X.div(F.col("std"), F.col("mean")).alias("cv"), "min", "p1", "p5", "q1", "q3", "p95", "p99", "max",
        (F.col("q3") - F.col("q1")).alias("iqr"), "skewness", "kurtosis")


def _fenced(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x, quartiles, fences); the quartile table has one row per column and is broadcast."""
    long = B.long_numeric(df, columns)
    q = B.quantiles(long, ["column"], "x", QUARTILES).drop("n")
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumn("lo", F.col("q1") - 1.5 * iqr).withColumn("hi", F.col("q3") + 1.5 * iqr)
    return long.join(F.broadcast(q), "column")


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """U2"""
    x = F.col("x")
    return _fenced(df, columns).groupBy("column").agg(
        F.count(x).alias("n"), X.count_if((x < F.col("lo")) | (x > F.col("hi"))).alias("n_outliers")).withColumn(
        "pct_outliers", X.pct2(F.col("n_outliers"), F.col("n")))


def jarque_bera(df: DataFrame, columns: list[str]) -> DataFrame:
    """The p-value of a chi-square with two degrees of freedom is exp(-JB / 2)."""
    jb = F.col("count") / 6.0 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4.0)
    return _moments(df, columns).select("column", F.col("count").alias("n"), jb.alias("statistic")).withColumn(
        "pvalue", F.exp(-F.col("statistic") / 2)).withColumn("normal", F.col("pvalue") > 0.05)


def shapiro_wilk(long: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """U4: Shapiro-Wilk per group of 3 to 5,000 values; larger groups are left to Jarque-Bera.

    Groups are counted first and only those within the limit reach a Python task. The larger ones are few (one for 5,000 rows
    at most), so they are taken out by a broadcast and their rows are never shuffled.
    """
    rows = long.dropna(subset=[*keys, value])
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(F.broadcast(size.where(F.col("_n") > SHAPIRO_MAX).drop("_n")), keys, "left_anti")
    return shapiro_groups(rows.select(*keys, F.col(value).cast("double").alias("x")), keys).where("n >= 3")


def _bins_of(n: Column) -> Column:
    return F.least(F.lit(50), F.greatest(F.lit(10), F.floor(n / 100))).cast("bigint")


def binned(long: DataFrame, bins: Column | int | None = None, weight: str | None = None) -> DataFrame:
    """Equal-width counts of (column, x): every bin is reported, empty ones with 0."""
    one = F.col(weight) if weight else F.lit(1).cast("bigint")
    ends = long.groupBy("column").agg(F.sum(one).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    count = _bins_of(F.col("n")) if bins is None else (bins if isinstance(bins, Column) else F.lit(bins)).cast("bigint")
    flat = F.col("lo") == F.col("hi")
    ends = ends.select("column", count.alias("bins"), F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    place = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1)
    counts = long.select("column", "x", one.alias("one")).join(F.broadcast(ends), "column").groupBy("column", (place + 1).cast("bigint").alias("bin")).agg(
        F.sum("one").alias("n"))
    grid = ends.select("column", "lo", "hi", "bins", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("bins"))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    return grid.join(counts, ["column", "bin"], "left").select(
        "column", "bin", (F.col("lo") + step * (F.col("bin") - 1)).alias("x_left"),
        (F.col("lo") + step * F.col("bin")).alias("x_right"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """min(50, max(10, n / 100)) bins per column."""
    return binned(B.long_numeric(df, columns))


def kde(df: DataFrame, columns: list[str], points: int = KDE_POINTS) -> DataFrame:
    """Gaussian kernel density at ``points`` grid points, scaled to histogram counts.

    Equal values are merged first; a value only visits the grid points within nine bandwidths
    (the kernel is below 1e-17 of its peak outside), so the work shrinks as n grows.
    """
    long = B.long_numeric(df, columns)
    ends = long.groupBy("column").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                                      F.stddev_samp("x").alias("sd")).where("sd > 0")
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    ends = ends.select("column", "n", "lo", step.alias("step"), h.alias("h"),
                       ((F.col("hi") - F.col("lo")) / _bins_of(F.col("n"))).alias("bin_width"))
    values = long.groupBy("column", "x").agg(F.count(F.lit(1)).alias("w")).join(F.broadcast(ends), "column")
    first = F.greatest(F.lit(0), F.ceil((F.col("x") - 9 * F.col("h") - F.col("lo")) / F.col("step"))).cast("int")
    last = F.least(F.lit(points - 1), F.floor((F.col("x") + 9 * F.col("h") - F.col("lo")) / F.col("step"))).cast("int")
    near = values.where(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    z = (F.col("lo") + F.col("step") * F.col("i") - F.col("x")) / F.col("h")
    sums = near.groupBy("column", "i").agg(F.sum(F.col("w") * F.exp(-z * z / 2)).alias("s"))
    grid = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    y = F.coalesce("s", F.lit(0.0)) / (F.col("h") * np.sqrt(2 * np.pi)) * F.col("bin_width")
    return grid.join(sums, ["column", "i"], "left").select(
        "column", "i", (F.col("lo") + F.col("step") * F.col("i")).alias("x"), y.alias("y"))


def boxplot_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, whiskers (extremes inside the fences), mean and population sd."""
    x = F.col("x")
    inside = F.when((x >= F.col("lo")) & (x <= F.col("hi")), x)
    return _fenced(df, columns).groupBy("column").agg(
        *[F.first(q).alias(q) for q in QUARTILES], F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"),
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def _ordered_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values in order with the ranks they cover: (column, x, n, _before, _total)."""
    counts = B.long_numeric(df, columns).groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    return B.ordered(counts, ["column"], ["x"], weight="n")


def _plotted(values: DataFrame, points: int) -> DataFrame:
    """Evenly spaced order statistics (all of them up to ``points``): adds ``i``, the 0-based rank."""
    n, before, last = F.col("_total"), F.col("_before"), F.col("_before") + F.col("n") - 1
    spread = (n - 1).cast("double")
    # Plot point j shows rank floor(j * (n - 1) / (points - 1)); collect the j whose rank is in this run.
    lo = F.ceil(before * (points - 1) / spread)
    hi = F.least(F.ceil((last + 1) * (points - 1) / spread) - 1, F.lit(points - 1))
    js = F.when(lo <= hi, F.sequence(lo.cast("bigint"), hi.cast("bigint")))
    ranks = F.when(n <= points, F.sequence(before.cast("bigint"), last.cast("bigint"))).otherwise(
        F.array_distinct(F.transform(js, lambda j: F.floor(j * spread / (points - 1)).cast("bigint"))))
    return values.withColumn("i", F.explode(ranks)).where((F.col("i") >= before) & (F.col("i") <= last))


def _filliben(i: Column, n: Column) -> Column:
    """Median of the i-th (0-based) of n uniform order statistics, Filliben's estimate."""
    edge = F.pow(F.lit(0.5), 1.0 / n)
    return F.when(i == n - 1, edge).when(i == 0, 1.0 - edge).otherwise((i + 1 - 0.3175) / (n + 0.365))


def _qq_line(values: DataFrame) -> DataFrame:
    """Least-squares line of all order statistics on their normal scores, per column.

    A run of equal values is cut into chunks of ranks and spread over the tasks before the ranks
    are expanded, so a value that fills a third of the column does not sit in one task.
    """
    last = F.col("_before") + F.col("n") - 1
    chunks = values.withColumn("start", F.explode(F.sequence(F.col("_before").cast("bigint"), last.cast("bigint"),
                                                             F.lit(RANK_CHUNK).cast("bigint"))))
    chunks = chunks.withColumn("stop", F.least(last, F.col("start") + RANK_CHUNK - 1)).repartition("column", "start")
    ranks = chunks.withColumn("i", F.explode(F.sequence(F.col("start"), F.col("stop").cast("bigint"))))
    score = ST.normal_quantile(_filliben(F.col("i"), F.col("_total")))
    return ranks.select("column", "x", score.alias("score")).groupBy("column").agg(
        F.regr_slope("x", "score").alias("slope"), F.regr_intercept("x", "score").alias("intercept"))


def qq_points(df: DataFrame, columns: list[str], points: int = QQ_POINTS) -> DataFrame:
    """U8: normal probability plot with the line fitted on all values."""
    values = _ordered_values(df, columns).persist()
    shown = _plotted(values, points)
    score = ST.normal_quantile(_filliben(F.col("i"), F.col("_total")))
    return shown.select("column", "i", F.col("_total").alias("n"), score.alias("theoretical"), F.col("x").alias("sample")
                        ).join(F.broadcast(_qq_line(values)), "column")


def qq_band(df: DataFrame, columns: list[str], points: int = QQ_POINTS) -> DataFrame:
    """95 % band from Beta(i, n - i + 1); bisection on the at most 1,500 plotted ranks."""
    def band(pdf: pd.DataFrame) -> pd.DataFrame:
        from tablescope.functions.special import beta_quantile
        i, n = pdf["i"].to_numpy(float) + 1, pdf["n"].to_numpy(float)
        for side, p in (("lower_u", 0.025), ("upper_u", 0.975)):
            pdf[side] = np.clip(beta_quantile(p, i, n - i + 1), 1e-6, 1 - 1e-6)
        return pdf

    q = qq_points(df, columns, points)
    schema = "column string, i bigint, n bigint, theoretical double, sample double, slope double, intercept double, " \
             "lower_u double, upper_u double"
    out = q.select("column", F.col("i").cast("bigint").alias("i"), F.col("n").cast("bigint").alias("n"), "theoretical",
                   "sample", "slope", "intercept").groupBy("column").applyInPandas(band, schema)
    return out.select("column", "i", "theoretical",
                      (ST.normal_quantile(F.col("lower_u")) * F.col("slope") + F.col("intercept")).alias("lower"),
                      (ST.normal_quantile(F.col("upper_u")) * F.col("slope") + F.col("intercept")).alias("upper"))


def ecdf(df: DataFrame, columns: list[str], points: int = ECDF_POINTS) -> DataFrame:
    """Empirical distribution function at evenly spaced order statistics."""
    return _plotted(_ordered_values(df, columns), points).select(
        "column", F.col("i").cast("bigint").alias("i"), "x", ((F.col("i") + 1) / F.col("_total")).alias("y"))


def transform_suggestions(df: DataFrame, columns: list[str]) -> DataFrame:
    """U11"""
    m = _moments(df, columns).select("column", "skewness", X.div(F.col("std"), F.col("mean")).alias("cv"))
    one = iqr_outliers(df, columns).join(m, "column")
    rules = [("skewed", "log_or_box_cox", "high", F.abs("skewness") > 1, F.col("skewness")),
             ("many_outliers", "winsorize_p1_p99", "high", F.col("n_outliers") > F.col("n") * 0.05, F.col("pct_outliers")),
             ("high_variability", "standard_or_robust_scaler", "medium", F.col("cv") > 1, F.col("cv"))]
    return one.select("column", X.rows(*[
        F.struct(F.lit(r).alias("reason"), F.lit(t).alias("transformation"), F.lit(p).alias("priority"),
                 cond.alias("hit"), v.cast("double").alias("value")) for r, t, p, cond, v in rules])).where("hit").drop("hit")


def _top(f: DataFrame, k: int) -> DataFrame:
    """k most frequent values per column; each task keeps only its own top k before the shuffle."""
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return f.withColumn("rank", place).where(F.col("rank") <= k)


def _freq_stats(f: DataFrame) -> DataFrame:
    n = F.col("n")
    return f.groupBy("column").agg(
        F.sum(n).alias("n_valid"), F.count(F.lit(1)).alias("n_distinct"), F.max(n).alias("top_n"),
        F.min_by("value", F.struct(-n, F.col("value"))).alias("mode"))


def discrete_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """U12"""
    ends = B.wide(df, {c: {"n_rows": F.count(F.lit(1)), "n_null": X.count_if(X.ref(c).isNull()),
                           "min": F.min(X.double(df, c)), "max": F.max(X.double(df, c))} for c in columns})
    s = _freq_stats(B.freq(df, columns))
    return ends.join(s, "column", "left").select(
        "column", F.col("n_valid").alias("count"), X.pct2(F.col("n_null"), F.col("n_rows")).alias("pct_missing"),
        "n_distinct", "mode", "min", "max", X.pct2(F.col("top_n"), F.col("n_valid")).alias("dominant_pct"))


def _levels(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    f = B.freq(df, columns)
    total = f.groupBy("column").agg(F.sum("n").alias("total"))
    return _top(f, k).join(F.broadcast(total), "column").select(
        "column", "rank", "value", "n", X.pct2(F.col("n"), F.col("total")).alias("pct"))


def discrete_levels(df: DataFrame, columns: list[str], top: int = TOP_LEVELS) -> DataFrame:
    """The ``top`` most frequent levels."""
    return _levels(df, columns, top)


def categorical_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Everything from one FREQ shuffle; entropy uses the n-weighted log sum."""
    f = B.freq(df, columns)
    total = f.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_distinct"))
    p = F.col("n") / F.col("total")
    s = f.join(F.broadcast(total), "column").groupBy("column").agg(
        F.first("total").alias("count"), F.first("n_distinct").alias("n_distinct"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
        F.max("n").alias("top_n"), F.min("n").alias("last_n"),
        F.sum(-p * F.log2(p + 1e-10)).alias("entropy"), X.count_if(p * 100 < 1).alias("n_rare"))
    nulls = B.wide(df, {c: {"n_rows": F.count(F.lit(1)), "n_null": X.count_if(X.ref(c).isNull())} for c in columns})
    u = F.col("n_distinct")
    card = F.round(X.pct(u, F.col("count")), 2)
    return s.join(nulls, "column").select(
        "column", "count", X.pct2(F.col("n_null"), F.col("n_rows")).alias("pct_missing"), "n_distinct",
        card.alias("cardinality_pct"), "mode", X.pct2(F.col("top_n"), F.col("count")).alias("mode_pct"),
        F.round(F.col("entropy") / F.when(u > 1, F.log2(u.cast("double"))).otherwise(1.0), 3).alias("normalized_entropy"),
        F.round(F.when(u > 1, F.col("top_n") / F.col("last_n")).otherwise(1.0), 2).alias("imbalance"), "n_rare",
        (card > 50).alias("high_cardinality"), (F.col("n_rare") > 0).alias("has_rare"), (card > 90).alias("quasi_id"))


def pareto(df: DataFrame, columns: list[str], top: int = TOP_CATEGORIES) -> DataFrame:
    """The ``top`` most frequent categories with cumulative percent (of the rounded percents)."""
    upto = Window.partitionBy("column").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return _levels(df, columns, top).withColumn("cum_pct", F.round(F.sum("pct").over(upto), 2))


def boolean_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """true/false words; if none occurs, the two most frequent values stand in."""
    f = (B.freq(df, columns).groupBy("column", F.lower("value").alias("value")).agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    top = f.withColumn("r", place).where("r <= 2").groupBy("column").agg(
        F.max(F.when(F.col("r") == 1, F.col("n"))).alias("first_n"), F.max(F.when(F.col("r") == 2, F.col("n"))).alias("second_n"))
    zero = F.lit(0).cast("bigint")
    words = f.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.coalesce(F.sum(F.when(F.col("value").isin(*K.TRUE_WORDS), F.col("n"))), zero).alias("t"),
        F.coalesce(F.sum(F.when(F.col("value").isin(*K.FALSE_WORDS), F.col("n"))), zero).alias("f"))
    none = (F.col("t") == 0) & (F.col("f") == 0)
    out = words.join(top, "column").select(
        "column", "count", F.when(none, F.col("first_n")).otherwise(F.col("t")).alias("n_true"),
        F.when(none, F.coalesce("second_n", zero)).otherwise(F.col("f")).alias("n_false"))
    out = (out.withColumn("pct_true", X.pct2(F.col("n_true"), F.col("count")))
           .withColumn("pct_false", X.pct2(F.col("n_false"), F.col("count"))))
    big, small = F.greatest("pct_true", "pct_false"), F.least("pct_true", "pct_false")
    return out.withColumn("imbalance", F.round(X.div(big, small), 2))


def datetime_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """U16"""
    stats = B.wide(df, {c: {"count": F.count(X.timestamp(df, c)), "min": F.min(X.timestamp(df, c)),
                            "max": F.max(X.timestamp(df, c))} for c in columns})
    u = B.freq(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    days = F.floor(F.timestamp_diff("SECOND", F.col("min"), F.col("max")) / 86400).cast("bigint")
    return stats.join(u, "column", "left").select("column", "count", "min", "max", days.alias("range_days"), "n_distinct")


def counts_by_year(df: DataFrame, column: str) -> DataFrame:
    """U17"""
    t = X.timestamp(df, column)
    return df.where(t.isNotNull()).groupBy(F.year(t).cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def counts_by_month(df: DataFrame, column: str) -> DataFrame:
    """U17"""
    t = X.timestamp(df, column)
    return df.where(t.isNotNull()).groupBy(F.month(t).cast("bigint").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def _lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(X.rows(*[F.struct(F.lit(c).alias("column"), F.char_length(X.ref(c)).cast("double").alias("x"))
                              for c in columns])).where(F.col("x").isNotNull())


def text_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """The 95th percentile is the nearest order statistic."""
    stats = B.wide(df, {c: {"count": F.count(X.ref(c)), "avg_length": F.avg(F.char_length(X.ref(c))),
                            "n_blank": X.count_if(X.strip(X.ref(c)) == "")} for c in columns})
    lengths = _lengths(df, columns)
    median = B.quantiles(lengths, ["column"], "x", {"median_length": 0.5}).drop("n")
    p95 = B.quantiles(lengths, ["column"], "x", {"p95_length": 0.95}, nearest=True).drop("n")
    u = B.freq(df, columns, hashed=True).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    return stats.join(u, "column").join(median, "column").join(p95, "column").select(
        "column", "count", "n_distinct", X.pct2(F.col("n_distinct"), F.col("count")).alias("cardinality_pct"),
        "avg_length", "median_length", "p95_length", X.pct2(F.col("n_blank"), F.col("count")).alias("pct_blank"))


def text_length_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """U19"""
    return binned(_lengths(df, columns), TEXT_BINS)


def id_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """U20"""
    rows = B.wide(df, {c: {"n_rows": F.count(F.lit(1))} for c in columns})
    u = B.freq(df, columns, hashed=True).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    return rows.join(u, "column", "left").na.fill(0, ["n_distinct"]).select(
        "column", "n_rows", "n_distinct", X.pct2(F.col("n_distinct"), F.col("n_rows")).alias("unique_pct"),
        (F.col("n_rows") - F.col("n_distinct")).alias("n_duplicates"))


def geo_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Range check at 180 degrees, plus a stricter count at 90."""
    metrics = {}
    for c in columns:
        x = X.double(df, c)
        metrics[c] = {"count": F.count(X.ref(c)), "min": F.min(x), "max": F.max(x),
                      "n_out_of_range": X.count_if(F.abs(x) > 180), "n_beyond_90": X.count_if(F.abs(x) > 90)}
    u = (B.long_numeric(df, columns).groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
         .groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")))
    return B.wide(df, metrics).join(u, "column", "left").drop("position")


def univariate_findings(df: DataFrame, numeric: list[str] = (), categorical: list[str] = (),
                        boolean: list[str] = ()) -> DataFrame:
    """Coded findings."""
    parts = []

    def coded(frame, rules):
        return frame.select("column", X.rows(*[
            F.struct(F.lit(code).alias("code"), F.coalesce(cond, F.lit(False)).alias("hit"), v.cast("double").alias("value"))
            for code, cond, v in rules])).where("hit").drop("hit")
    if numeric:
        s, k = F.col("skewness"), F.col("kurtosis")
        jb = F.col("count") / 6.0 * (s ** 2 + k ** 2 / 4.0)
        m = _moments(df, list(numeric)).join(iqr_outliers(df, list(numeric)).drop("n"), "column")
        parts.append(coded(m, [
            ("symmetric", F.abs(s) < 0.5, s), ("right_tail", s > 0.5, s), ("left_tail", s <= -0.5, s),
            ("heavy_tails", k > 3, k), ("outliers", F.col("n_outliers") > 0, F.col("n_outliers")),
            ("non_normal", (F.col("count") > SHAPIRO_MAX) & (F.exp(-jb / 2) <= 0.05), jb)]))
        sw = shapiro_wilk(B.long_numeric(df, list(numeric)), ["column"])
        parts.append(coded(sw, [("non_normal", F.col("pvalue") <= 0.05, F.col("statistic"))]))
    if categorical:
        c = categorical_summary(df, list(categorical))
        parts.append(coded(c, [
            ("quasi_id", F.col("quasi_id"), F.col("cardinality_pct")),
            ("high_cardinality", F.col("high_cardinality") & ~F.col("quasi_id"), F.col("cardinality_pct")),
            ("imbalanced", F.col("imbalance") > 10, F.col("imbalance")),
            ("rare_classes", F.col("n_rare") > 0, F.col("n_rare"))]))
    if boolean:
        parts.append(coded(boolean_summary(df, list(boolean)), [("imbalanced_boolean", F.col("imbalance") > 3, F.col("imbalance"))]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
