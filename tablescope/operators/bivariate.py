"""Pairs of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions import expr as X
from tablescope.functions import stats as ST
from tablescope.operators import groups as G
from tablescope.operators import univariate as U
from tablescope.plans import blocks as B
from tablescope.session import cut_lineage

# Result sizes and thresholds.
MIN_N, TOP_SCATTERS, SCATTER_POINTS, MIN_GROUP = 10, 5, 2_000, 3
HIGH, COLLINEAR, STRONG = 0.7, 0.85, 0.3
# Rows per distinct combination from which quartiles come from the counts.
MERGED = 4


def column_pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


def pearson_all(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Every pair with its r; a constant side gives 0 (never a division by zero)."""
    r = F.coalesce(X.div(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))), F.lit(0.0))
    return B.pair_moments(df, pairs).withColumn("r", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pearson_pairs(df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """B1: all pairs, or the ``top`` strongest, pairwise-complete, at least 10 rows."""
    p = pearson_all(df, column_pairs(columns)).where(F.col("n") >= MIN_N)
    p = p.select("var_a", "var_b", "n", F.col("r").alias("pearson_r"), (F.abs("r") > HIGH).alias("high"))
    p = p.orderBy(F.abs("pearson_r").desc(), "var_a", "var_b")
    return p if top is None else p.limit(top)


# A rank table up to this many distinct values is broadcast (about 16 bytes each).
BROADCAST_VALUES = 500_000


def _rho(moments: DataFrame) -> DataFrame:
    rho = F.coalesce(X.div(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))), F.lit(0.0))
    return moments.where(F.col("n") >= MIN_N).select("var_a", "var_b", "n", rho.alias("spearman_rho"))


def _spearman_complete(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Columns without gaps have one rank per value whatever the partner: rank each column once, look the
    ranks up by value (broadcast while the rank table is small, else a shuffle join), one pass for all pairs."""
    counts = B.long_numeric(df, columns).groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    ranks = cut_lineage(B.avg_ranks(counts, ["column"], "x").select("column", "x", "rank"))
    sizes = {r["column"]: r["n"] for r in ranks.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = df.select(*[X.double(df, c).alias(c) for c in columns])
    for c in columns:
        table = ranks.where(F.col("column") == c).select(F.col("x").alias(c), F.col("rank").alias("_rank"))
        table = F.broadcast(table) if sizes.get(c, 0) <= BROADCAST_VALUES else table
        rows = rows.join(table, c).select(*[F.col("_rank").alias(c) if o == c else X.ref(o) for o in columns])
    return _rho(B.pair_moments(rows, pairs))


def _spearman_pairwise(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Ranks among the complete rows of each pair: both sides are merged to (pair, x, y) counts, each
    side's distinct values are ranked by the global order, then joined back on the value."""
    keys = ["var_a", "var_b"]
    joint = cut_lineage(B.pair_rows(df, pairs).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("c")))
    sides = [joint.groupBy(*keys, F.lit(s).alias("side"), F.col(s).alias("v")).agg(F.sum("c").alias("n")) for s in ("x", "y")]
    ranks = cut_lineage(B.avg_ranks(sides[0].unionByName(sides[1]), [*keys, "side"], "v").select(*keys, "side", "v", "rank", "_total"))
    rx = ranks.where("side = 'x'").select(*keys, F.col("v").alias("x"), F.col("rank").alias("rx"), "_total")
    ry = ranks.where("side = 'y'").select(*keys, F.col("v").alias("y"), F.col("rank").alias("ry"))
    j = joint.join(rx, [*keys, "x"]).join(ry, [*keys, "y"])
    mid = (F.col("_total") + 1) / F.lit(2.0)
    a, b, c = F.col("rx") - mid, F.col("ry") - mid, F.col("c")
    return _rho(j.groupBy(*keys).agg(F.sum(c).alias("n"), F.sum(c * a * a).alias("sxx"), F.sum(c * b * b).alias("syy"),
                                     F.sum(c * a * b).alias("sxy")))


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """B2: Pearson of the average ranks, per pair of complete rows."""
    gaps = B.wide(df, {c: {"gaps": X.count_if(X.double(df, c).isNull())} for c in columns}).collect()
    whole = [r["column"] for r in gaps if r["gaps"] == 0]
    pairs = column_pairs(columns)
    fast = [p for p in pairs if p[0] in whole and p[1] in whole]
    slow = [p for p in pairs if p not in fast]
    parts = []
    if fast:
        parts.append(_spearman_complete(df, [c for c in whole if any(c in p for p in fast)], fast))
    if slow:
        parts.append(_spearman_pairwise(df, slow))
    return reduce(DataFrame.unionByName, parts)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Square matrix in long form; pairs below 10 rows are 0, the diagonal is 1."""
    p = pearson_all(df, column_pairs(columns)).where(F.col("n") >= MIN_N)
    cells = X.lit_rows(df, [(a, b) for a in columns for b in columns], "var_a string, var_b string")
    both = p.select("var_a", "var_b", "r").unionByName(p.select(F.col("var_b").alias("var_a"), F.col("var_a").alias("var_b"), "r"))
    value = F.when(F.col("var_a") == F.col("var_b"), 1.0).otherwise(F.coalesce("r", F.lit(0.0)))
    return cells.join(both, ["var_a", "var_b"], "left").select("var_a", "var_b", value.alias("value"))


def correlation_matrix_wide(df: DataFrame, columns: list[str]) -> DataFrame:
    """B3 as a table: one row per column."""
    return correlation_matrix(df, columns).groupBy("var_a").pivot("var_b", columns).agg(F.first("value"))


def top_pairs(df: DataFrame, columns: list[str], k: int = TOP_SCATTERS) -> list[tuple[str, str]]:
    """The k strongest pairs (column metadata)."""
    return [(r["var_a"], r["var_b"]) for r in pearson_pairs(df, columns).limit(k).collect()]


def scatter_sample(df: DataFrame, columns: list[str], points: int = SCATTER_POINTS, seed: int = 42, top: int = TOP_SCATTERS) -> DataFrame:
    """Up to ``points`` points of each of the ``top`` strongest pairs, chosen by hash."""
    pairs, parts = top_pairs(df, columns, top), []
    rows = B.pair_rows(df, pairs).withColumn("h", F.xxhash64(F.lit(seed), "x", "y"))
    share = {(r["var_a"], r["var_b"]): min(1.0, 4 * points / r["n"]) for r in B.pair_moments(df, pairs).select("var_a", "var_b", "n").collect()}
    while share:
        # values below a bound of the hash, counted; a pair whose bound holds too few points gets a wider one
        bound = X.lit_rows(df, [(a, b, min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * p))) for (a, b), p in share.items()], "var_a string, var_b string, bound bigint")
        low = rows.join(F.broadcast(bound), ["var_a", "var_b"]).where(F.col("h") <= F.col("bound"))
        low = cut_lineage(low.groupBy("var_a", "var_b", "x", "y", "h").agg(F.least(F.count(F.lit(1)), F.lit(points)).alias("w")))
        got = {(r["var_a"], r["var_b"]): r["w"] for r in low.groupBy("var_a", "var_b").agg(F.sum("w").alias("w")).collect()}
        done = [p for p in share if got.get(p, 0) >= points or share[p] >= 1.0]
        if done:
            parts.append(low.join(F.broadcast(X.lit_rows(df, done, "var_a string, var_b string")), ["var_a", "var_b"]))
        share = {p: min(1.0, 16 * v) for p, v in share.items() if p not in done}
    if not parts:
        return rows.drop("h")
    first = Window.partitionBy("var_a", "var_b").orderBy("h", "x", "y").rowsBetween(Window.unboundedPreceding, -1)
    low = reduce(DataFrame.unionByName, parts).withColumn("before", F.coalesce(F.sum("w").over(first), F.lit(0)))
    low = low.where(F.col("before") < points).withColumn("w", F.least(F.col("w"), points - F.col("before")))
    return low.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).select("var_a", "var_b", "x", "y")


def trend_line(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least-squares line of every pair over all rows."""
    slope = X.div(F.col("sxy"), F.col("sxx"))
    return B.pair_moments(df, column_pairs(columns)).select("var_a", "var_b", "n", slope.alias("slope")
        , (F.col("mean_b") - slope * F.col("mean_a")).alias("intercept"))


def group_stats(df: DataFrame, nums: list[str], cats: list[str], levels: int | None = None) -> DataFrame:
    """Count, mean, median, population sd and outlier flag per group; of all levels, or of the ``levels`` first in order."""
    keys, quartiles = ["num", "cat", "grp"], {"q1": 0.25, "median": 0.5, "q3": 0.75}
    counts = G.value_counts(df, nums, cats)
    long = G.spread(counts, df, cats, levels)
    m = G.weighted_moments(long, MIN_GROUP)
    merged, rows = counts.agg(F.count(F.lit(1)), F.sum("c")).first()
    if merged * MERGED <= (rows or 0):  # repeated values: order what merging left, else bracket the rows themselves
        q = B.weighted_quantiles(long.groupBy(*keys, "x").agg(F.sum("c").alias("c")), keys, "x", "c", quartiles)
    else:
        q = B.quantiles(G.grouped_long(df, nums, cats, levels), keys, "x", quartiles, few_groups=levels is not None).drop("n")
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("min") < F.col("q1") - 1.5 * iqr) | (F.col("max") > F.col("q3") + 1.5 * iqr)
    return m.join(q, keys).select(*keys, "n", "mean", "median", "std", out.alias("has_outliers"))


def _skew_kurt(long: DataFrame) -> DataFrame:
    s, k = F.skewness("x"), F.kurtosis("x")
    return long.groupBy("num", "cat", "grp").agg(F.count(F.lit(1)).alias("n"), s.alias("s"), k.alias("k"))


def normality_gate(df: DataFrame, nums: list[str], cats: list[str], levels: int | None = None) -> DataFrame:
    """ANOVA if every group looks normal at .05, otherwise Kruskal-Wallis.

    Groups up to 5,000 values by Shapiro-Wilk, larger ones by Jarque-Bera. Both are reported, so a verdict that only follows the size
    shows: ``lowest_shapiro`` of the ``n_shapiro`` groups within its limit, ``lowest_jarque_bera`` of all groups, and whether the gate would
    choose the same test by Jarque-Bera alone (``agree``).
    """
    keys = ["num", "cat", "grp"]
    long = G.grouped_long(df, nums, cats, levels)
    kept = G.moments(long, MIN_GROUP).select(*keys, "n")
    small = U.shapiro_wilk(long, keys).select(*keys, F.col("pvalue").alias("sw"))
    shape = F.col("n") / 6.0 * (F.col("s") ** 2 + F.col("k") ** 2 / 4.0)
    # a constant group has neither skewness nor kurtosis and is left to the other test
    moments = _skew_kurt(long).select(*keys, F.exp(-shape / 2).alias("jb"))
    jb = F.when(~F.isnan("jb"), F.col("jb"))
    p = F.coalesce("sw", F.when(F.col("n") > U.SHAPIRO_MAX, jb), F.lit(1.0))
    out = kept.join(small, keys, "left").join(moments, keys, "left").groupBy("num", "cat").agg(
        F.count(F.lit(1)).alias("n_groups"), F.min(p).alias("lowest_p"), F.count("sw").alias("n_shapiro"), F.min("sw").alias("lowest_shapiro"),
        F.min(jb).alias("lowest_jarque_bera"))

    def anova(lowest):
        return F.coalesce(F.col(lowest), F.lit(1.0)) >= 0.05
    return out.withColumn("test", F.when(anova("lowest_p"), "anova").otherwise("kruskal_wallis")).withColumn(
        "agree", anova("lowest_p") == anova("lowest_jarque_bera"))


def anova_oneway(df: DataFrame, nums: list[str], cats: list[str], levels: int | None = None) -> DataFrame:
    """B8"""
    groups = G.moments(G.grouped_long(df, nums, cats, levels), MIN_GROUP)
    return G.anova(groups).withColumn("significant", F.col("pvalue") < 0.05)


def kruskal_wallis(df: DataFrame, nums: list[str], cats: list[str], levels: int | None = None) -> DataFrame:
    """B9"""
    long = G.spread(G.value_counts(df, nums, cats), df, cats, levels)
    return G.kruskal(G.rank_sums(long, G.weighted_moments(long, MIN_GROUP))).withColumn("significant", F.col("pvalue") < 0.05)


def num_cat_tests(df: DataFrame, nums: list[str], cats: list[str], levels: int | None = None) -> DataFrame:
    """B7-B9 together: the test the gate chooses, one row per pair."""
    gate = normality_gate(df, nums, cats, levels).select("num", "cat", "test")
    a = anova_oneway(df, nums, cats, levels).withColumn("test", F.lit("anova"))
    k = kruskal_wallis(df, nums, cats, levels).withColumn("test", F.lit("kruskal_wallis")).withColumn("effect_size", F.lit(None).cast("double"))
    return a.unionByName(k).join(gate, ["num", "cat", "test"])


def contingency_levels(df: DataFrame, b: str) -> DataFrame:
    """(level, position, n_levels): the levels of a column in code-point order from 0, by a distributed order."""
    levels = df.select(X.text(df, b).alias("level")).dropna().distinct().select(F.lit("").alias("_all"), "level", F.lit(1).alias("_one"))
    o = B.ordered(levels, ["_all"], ["level"], weight="_one", totals=True)
    return o.select("level", F.col("_before").cast("bigint").alias("position"), F.col("_total").cast("bigint").alias("n_levels"))


def contingency_blocks(df: DataFrame, a: str, b: str, width: int = 1_000) -> DataFrame:
    """B10 for any number of levels: (row, block, counts), where counts[i] is the cell of level ``block * width + i`` of
    ``contingency_levels``. A block without a filled cell has no row. Only filled cells are shuffled, and no
    task or driver holds more than one block of a row; rows with a null on either side do not count."""
    cells = df.select(X.text(df, a).alias("row"), X.text(df, b).alias("level")).dropna().groupBy("row", "level").agg(F.count(F.lit(1)).alias("n"))
    placed = cells.join(contingency_levels(df, b), "level")
    blocks = placed.groupBy("row", F.floor(F.col("position") / width).cast("int").alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("position") % width).cast("int"), "n"))).alias("found"), F.max("n_levels").alias("n_levels"))
    last = F.least(F.lit(width), F.col("n_levels") - F.col("block").cast("bigint") * width).cast("int") - 1
    return blocks.select("row", "block", F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.col("found")[i], F.lit(0))).alias("counts"))


def contingency_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """Wide table of counts, one column per level of ``b`` (their names, nothing else, reach the driver), absent cells 0.

    Cells are counted first and then spread, so the data are read once per pass and never sorted by level. Beyond some
    thousand levels ``contingency_blocks`` is the better form.
    """
    rows = df.select(X.text(df, a).alias("_row"), X.text(df, b).alias("_level")).dropna()
    names = [r[0] for r in rows.select("_level").distinct().orderBy("_level").collect()]
    cells = rows.groupBy("_row", "_level").agg(F.count(F.lit(1)).alias("_n"))
    found = cells.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_level", "_n"))).alias("_m"))
    return found.select(F.col("_row").alias(a), *[F.coalesce(F.col("_m")[F.lit(v)], F.lit(0)).alias(v) for v in names])


def contingency_cells(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Non-empty cells of many tables in one pass: (var_a, var_b, a, b, n)."""
    return (df.select(X.rows(*[F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), X.text(df, a).alias("a"),
                                        X.text(df, b).alias("b")) for a, b in pairs]))
            .dropna().groupBy("var_a", "var_b", "a", "b").agg(F.count(F.lit(1)).alias("n")))


def chi2_test(df: DataFrame, columns: list[str]) -> DataFrame:
    """Chi-square with Yates' correction for one degree of freedom.

    Only non-empty cells are needed: sum((o - e)^2 / e) = N * (sum(o^2 / (row * column)) - 1), and in a
    2 x 2 table every cell has the same |o - e|.
    """
    keys = ["var_a", "var_b"]
    cells = contingency_cells(df, column_pairs(columns))
    ra = cells.groupBy(*keys, "a").agg(F.sum("n").alias("ra"))
    cb = cells.groupBy(*keys, "b").agg(F.sum("n").alias("cb"))
    totals = ra.groupBy(*keys).agg(F.sum("ra").alias("total"), F.count(F.lit(1)).alias("r"),
                                   F.sum(1.0 / F.col("ra")).alias("inv_r"))
    columns_of = cb.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.sum(1.0 / F.col("cb")).alias("inv_c"))
    # One row per pair of columns.
    totals = F.broadcast(totals.join(columns_of, keys))
    o, e = F.col("n").cast("double"), F.col("ra") * F.col("cb").cast("double") / F.col("total")
    s = cells.join(ra, [*keys, "a"]).join(cb, [*keys, "b"]).join(totals, keys).groupBy(*keys).agg(
        F.first("total").alias("n"), F.first("r").alias("n_rows"), F.first("c").alias("n_cols"),
        F.sum(o * o / e).alias("oe"), F.max(F.abs(o - e)).alias("gap"),
        F.first(F.col("inv_r") * F.col("inv_c")).alias("inv"))
    n = F.col("n").cast("double")
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    short = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    s = s.withColumn("dof", dof.cast("bigint")).withColumn("chi2", F.when(F.col("dof") == 0, 0.0).when(
        F.col("dof") == 1, short * short * n * F.col("inv")).otherwise(F.greatest(F.col("oe") - n, F.lit(0.0))))
    s = s.withColumn("d", F.greatest(F.col("dof"), F.lit(1)).cast("double"))
    return s.select(*keys, "n", "n_rows", "n_cols", "chi2", "dof",
                    F.when(F.col("dof") == 0, 1.0).otherwise(ST.chi2_sf(F.col("chi2"), F.col("d"))).alias("pvalue"))


def cramers_v(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bias-corrected association in the k = min(rows, columns) form."""
    n, k = F.col("n").cast("double"), F.least("n_rows", "n_cols").cast("double")
    phi = F.col("chi2") / n
    phi = F.when(n > k, F.greatest(F.lit(0.0), phi - (k - 1) / (n - 1))).otherwise(phi)
    kc = F.when(n > k, k - (k - 1) ** 2 / (n - 1)).otherwise(k)
    v = F.when((k < 2) | (kc <= 1), 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(X.div(phi, kc - 1))))
    return chi2_test(df, columns).select("var_a", "var_b", "n", v.alias("cramers_v"), "pvalue").withColumn(
        "strong", F.col("cramers_v") > STRONG)


def bivariate_findings(df: DataFrame, nums: list[str], cats: list[str], pearson: DataFrame | None = None, tests: DataFrame | None = None,
                       groups: DataFrame | None = None, association: DataFrame | None = None) -> DataFrame:
    """Coded findings, from the results of the operators of these names where they are known."""
    found = []
    if len(nums) >= 2:
        p = pearson_pairs(df, nums) if pearson is None else pearson
        one = p.agg(F.max_by(F.struct("var_a", "var_b", "pearson_r"), F.abs("pearson_r")).alias("top"),
                    X.count_if(F.col("high")).alias("n_high"), X.count_if(F.abs("pearson_r") > COLLINEAR).alias("n_multi"))
        name = F.concat_ws(" x ", "top.var_a", "top.var_b")
        found.append(one.select(X.rows(
            F.struct(F.lit("top_correlation").alias("code"), name.alias("subject"), F.col("top.pearson_r").alias("value"), (F.col("n_high") > 0).alias("hit")),
            F.struct(F.lit("multicollinearity").alias("code"), F.lit(None).cast("string").alias("subject"), F.col("n_multi").cast("double").alias("value"), (F.col("n_multi") > 0).alias("hit")),
            F.struct(F.lit("no_strong_correlation").alias("code"), F.lit(None).cast("string").alias("subject"), F.lit(0.0).alias("value"), (F.col("n_high") == 0).alias("hit")))))
    if nums and cats:
        t = (num_cat_tests(df, nums, cats) if tests is None else tests).where("significant")
        best = t.agg(F.max_by(F.struct("num", "cat", "pvalue"), F.struct(F.coalesce("effect_size", F.lit(0.0)), F.col("statistic"))).alias("top"))
        found.append(best.where("top is not null").select(
            F.lit("group_difference").alias("code"), F.concat_ws(" x ", "top.num", "top.cat").alias("subject"),
            F.col("top.pvalue").alias("value"), F.lit(True).alias("hit")))
        o = (group_stats(df, nums, cats) if groups is None else groups).where("has_outliers").select("num", "cat").distinct()
        found.append(o.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("num", "cat")).alias("first")).where("n > 0").select(
            F.lit("influential_outliers").alias("code"), F.concat_ws(" x ", "first.num", "first.cat").alias("subject"),
            F.col("n").cast("double").alias("value"), F.lit(True).alias("hit")))
    if len(cats) >= 2:
        v = (cramers_v(df, cats) if association is None else association).where("strong").agg(F.max_by(F.struct("var_a", "var_b", "cramers_v"), "cramers_v").alias("top"))
        found.append(v.where("top is not null").select(
            F.lit("strong_association").alias("code"), F.concat_ws(" x ", "top.var_a", "top.var_b").alias("subject"),
            F.col("top.cramers_v").alias("value"), F.lit(True).alias("hit")))
    return reduce(DataFrame.unionByName, found).where("hit").drop("hit")
