"""Data quality of the whole table (Q1-Q16)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import expr as X
from tablescope.functions import keywords as K
from tablescope.plans import blocks as B

# Missing-share bands and other thresholds, in percent.
BANDS = ((0, "none"), (5, "low"), (20, "moderate"), (40, "high"))
QUASI_CONSTANT, TOO_MANY_MISSING, MANY_DUPLICATES = 99, 60, 5
EXAMPLES = 5
# Up to so many pairs of columns are counted by expressions, more by products of masks.
PAIR_EXPRESSIONS = 120


def severity(pct: Column) -> Column:
    out = F.when(pct <= BANDS[0][0], BANDS[0][1])
    for limit, label in BANDS[1:]:
        out = out.when(pct <= limit, label)
    return out.otherwise("critical")


def issue_severity(band: Column) -> Column:
    return (F.when(band.isin("none", "low"), "low").when(band.isin("high", "critical"), "high").otherwise("medium"))


def _pct2(part, whole) -> Column:
    return X.pct2(part, whole)


def _null_counts(df: DataFrame) -> DataFrame:
    return B.wide(df, {c: {"n_rows": F.count(F.lit(1)), "n_missing": X.count_if(X.ref(c).isNull())} for c in df.columns})


def missing_by_column(df: DataFrame) -> DataFrame:
    """Q1"""
    return (_null_counts(df).withColumn("pct_missing", _pct2(F.col("n_missing"), F.col("n_rows")))
            .withColumn("severity", severity(F.col("pct_missing"))).drop("n_rows"))


def _nulls_in_row(df: DataFrame) -> Column:
    return reduce(lambda a, b: a + b, [X.ref(c).isNull().cast("int") for c in df.columns])


def missing_global(df: DataFrame) -> DataFrame:
    """Q2"""
    k = _nulls_in_row(df)
    n, rows, cells = F.count(F.lit(1)), X.count_if(k > 0), F.coalesce(F.sum(k), F.lit(0)).cast("bigint")
    return df.agg(n.alias("n_rows"), rows.alias("rows_with_missing"), cells.alias("missing_cells")).select(
        "*", _pct2(F.col("rows_with_missing"), F.col("n_rows")).alias("pct_rows"),
        _pct2(F.col("missing_cells"), F.col("n_rows") * len(df.columns)).alias("pct_cells"))


def missing_per_row_distribution(df: DataFrame) -> DataFrame:
    """Q3: number of rows by number of nulls."""
    return df.groupBy(_nulls_in_row(df).cast("bigint").alias("n_null")).agg(F.count(F.lit(1)).alias("n"))


def missing_per_row(df: DataFrame) -> DataFrame:
    """Q3: mean and median nulls per row, from the distribution (at most columns + 1 rows)."""
    d = missing_per_row_distribution(df)
    upto = Window.orderBy("n_null").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy()))

    def at(i):
        return F.max(F.when((F.col("upto") > i) & (F.col("upto") - F.col("n") <= i), F.col("n_null")))
    mid = (F.col("total") - 1) / 2
    return d.agg(F.sum("n").alias("n_rows"), (F.sum(F.col("n") * F.col("n_null")) / F.sum("n")).alias("mean_null"),
                 ((at(F.floor(mid)) + at(F.ceil(mid))) / 2).alias("median_null"))


def worst_columns(df: DataFrame, k: int | None = None) -> list[str]:
    """All columns with missing values, or the ``k`` worst, most first (column metadata)."""
    rows = _null_counts(df).where("n_missing > 0").orderBy(F.desc("n_missing"), "position").select("column").collect()
    return [r[0] for r in rows][:k]


def missing_heatmap(df: DataFrame, order_by: str, n_blocks: int = 50, columns: list[str] | None = None) -> DataFrame:
    """Q4: null share per block of rows and column; blocks are equal ranges of a numeric column."""
    columns = worst_columns(df) if columns is None else columns
    if not columns:
        return X.lit_rows(df, [], "block bigint, column string, n bigint, null_share double")
    key = X.double(df, order_by)
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    width = F.coalesce(X.div(key - lo, hi - lo), F.lit(0.0))
    block = F.least(F.floor(width * n_blocks), F.lit(n_blocks - 1)).cast("bigint")
    flags = [F.avg(X.ref(c).isNull().cast("int")).alias(f"c{i}") for i, c in enumerate(columns)]
    blocks = df.where(key.isNotNull()).groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"), *flags)
    return blocks.select("block", "n", X.rows(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("null_share")) for i, c in enumerate(columns)]))


def missing_cooccurrence(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q5: rows where both columns are null, for all columns with missing values; one scan for all pairs."""
    columns = worst_columns(df) if columns is None else columns
    if not columns:
        return X.lit_rows(df, [], "var_a string, var_b string, n bigint, n_a bigint, n_b bigint, n_both bigint")
    isnull = {c: X.ref(c).isNull() for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    if len(pairs) > PAIR_EXPRESSIONS:
        flags = df.select(*[F.when(isnull[c], 1.0).alias(f"c{i}") for i, c in enumerate(columns)])
        counts = B.moments_of_pairs(flags, flags.columns).select("var_a", "var_b", "n")
        place = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (f"c{i}", c)])
        counts = counts.select(place[F.col("var_a")].alias("var_a"), place[F.col("var_b")].alias("var_b"), F.col("n").alias("n_both"))
        own = counts.where("var_a = var_b")
        both = counts.union(counts.where("var_a <> var_b").select("var_b", "var_a", "n_both"))
        every = X.lit_rows(df, [(a, b) for a in columns for b in columns], "var_a string, var_b string")
        total = df.agg(F.count(F.lit(1)).alias("n"))
        return (every.join(both, ["var_a", "var_b"], "left").join(own.select("var_a", F.col("n_both").alias("n_a")), "var_a")
                .join(own.select("var_b", F.col("n_both").alias("n_b")), "var_b")
                .select("var_a", "var_b", total.select("n").scalar().alias("n"), "n_a", "n_b", F.coalesce("n_both", F.lit(0).cast("long")).alias("n_both")))
    one = df.agg(F.count(F.lit(1)).alias("n"), *[
        X.count_if(isnull[a] & isnull[b]).alias(f"p{columns.index(a)}_{columns.index(b)}") for a, b in pairs])
    cells = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            cells.append(F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col("n"),
                                  F.col(f"p{i}_{i}").alias("n_a"), F.col(f"p{j}_{j}").alias("n_b"),
                                  F.col(f"p{min(i, j)}_{max(i, j)}").alias("n_both")))
    return one.select(X.rows(*cells))


def missing_correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q6: Pearson of the null indicators from the counts of Q5; undefined is 0, the diagonal 1."""
    n, a, b = (F.col(c).cast("double") for c in ("n", "n_a", "n_b"))
    spread = F.sqrt(a * (n - a) * b * (n - b))
    r = F.coalesce(X.div(n * F.col("n_both") - a * b, spread), F.lit(0.0))
    return missing_cooccurrence(df, columns).select(
        "var_a", "var_b", F.when(F.col("var_a") == F.col("var_b"), 1.0).otherwise(r).alias("value"))


def missing_clusters(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q7: complete-linkage merges of the columns by null pattern.

    The distances come from the counts of Q5; merging runs on that matrix of columns.
    """
    counts = missing_cooccurrence(df, columns).collect()
    gap = {(r["var_a"], r["var_b"]): math.sqrt(r["n_a"] + r["n_b"] - 2 * r["n_both"]) for r in counts}
    groups = [(c,) for c in dict.fromkeys(r["var_a"] for r in counts)]
    merges = []
    while len(groups) > 1:
        height, left, right = min(
            (max(gap[a, b] for a in g for b in h), g, h)
            for i, g in enumerate(groups) for h in groups[i + 1:])
        groups = [g for g in groups if g not in (left, right)] + [left + right]
        merges.append((len(merges) + 1, ", ".join(left), ", ".join(right), float(height), len(left + right)))
    return X.lit_rows(df, merges, "step int, left_columns string, right_columns string, height double, size int")


def row_patterns(df: DataFrame) -> DataFrame:
    """(missing, duplicated, n, n_groups): rows by null flag and by having an exact copy; at most four rows,
    worth keeping because several operators accept it as ``patterns``.

    The only shuffle groups whole rows (long text hashed); copies collapse in the map tasks.
    """
    keys = B.row_key(df)
    has_null = F.greatest(F.lit(False), *[F.col(f"k{i}").isNull() for i in range(len(keys))])
    names = [f"k{i}" for i in range(len(keys))]
    groups = df.select(*keys).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return (groups.select("n", has_null.alias("missing"), (F.col("n") > 1).alias("duplicated"))
            .groupBy("missing", "duplicated").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_groups")))


def duplicate_rows(df: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Q8: all members of duplicate groups; plus the rows a deduplication would really remove."""
    dup = F.col("duplicated")
    p = row_patterns(df) if patterns is None else patterns
    zero = F.lit(0).cast("bigint")
    members = F.coalesce(F.sum(F.when(dup, F.col("n"))), zero)
    groups = F.coalesce(F.sum(F.when(dup, F.col("n_groups"))), zero)
    return p.agg(F.coalesce(F.sum("n"), zero).alias("n_rows"), members.alias("n_duplicate_rows"),
                 (members - groups).alias("n_removed_by_dedup")).select(
        "*", (F.col("n_rows") - F.col("n_duplicate_rows")).alias("n_unique_rows"),
        _pct2(F.col("n_duplicate_rows"), F.col("n_rows")).alias("pct_duplicate_rows"))


def _shares(df: DataFrame) -> DataFrame:
    f = B.freq(df, B.countable(df), hashed=True)
    return f.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("top_n"),
                                   F.sum("n").alias("n_valid"), F.max_by("value", F.struct("n", "value")).alias("top_value")
                                   ).withColumn("dominant_pct", _pct2(F.col("top_n"), F.col("n_valid")))


def _constant_flag() -> Column:
    return (F.when(F.col("n_distinct") == 1, "constant")
            .when((F.col("dominant_pct") >= QUASI_CONSTANT) & (F.col("n_distinct") <= 2), "quasi_constant"))


def near_constant(df: DataFrame) -> DataFrame:
    """Q9"""
    return (_shares(df).withColumn("flag", _constant_flag()).where("flag is not null")
            .select("column", "n_distinct", "dominant_pct", "flag"))


def exclusion_candidates(df: DataFrame) -> DataFrame:
    """Q10: near-constant columns, and columns that are more than 60 % null."""
    flat = (_shares(df).withColumn("reason", _constant_flag()).where("reason is not null")
            .select("column", "reason", "dominant_pct", F.when(F.col("reason") == "constant", F.col("top_value")).alias("only_value")))
    missing = (_null_counts(df).withColumn("pct_missing", X.pct(F.col("n_missing"), F.col("n_rows")))
               .where(F.col("pct_missing") > TOO_MANY_MISSING).select("column", "pct_missing"))
    joined = flat.join(missing, "column", "full")
    return joined.select(
        "column", F.coalesce("reason", F.lit("too_many_missing")).alias("reason"),
        F.when(F.col("reason").isNotNull(), F.col("dominant_pct")).otherwise(F.round("pct_missing", 1)).alias("evidence_pct"),
        "only_value")


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _dirty(df: DataFrame, masked: bool) -> DataFrame:
    """(column, value, clean) of the affected cells only; everything else is dropped before any shuffle."""
    cells = B.unpivot_text(df, _strings(df)).where(F.col("value").isNotNull())
    cells = cells.withColumn("clean", X.strip(F.col("value")))
    token = F.lower("clean").isin(*K.MASKED_MISSING)
    return cells.where(token) if masked else cells.where((F.col("value") != F.col("clean")) & ~token)


def _with_share(df: DataFrame, found: DataFrame) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (found.withColumn("pct", _pct2(F.col("n"), total)).withColumn("severity", severity(F.col("pct"))))


def masked_missing(df: DataFrame) -> DataFrame:
    """Q11: texts that stand for a missing value: count, tokens, up to five raw spellings."""
    if not _strings(df):
        return X.lit_rows(df, [], "column string, n bigint, tokens string, examples string, pct double, severity string")
    spelled = _dirty(df, True).groupBy("column", "value", "clean").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    examples = (spelled.withColumn("r", place).where(F.col("r") <= EXAMPLES).groupBy("column")
                .agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("examples")))
    counts = spelled.groupBy("column").agg(
        F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_set(F.lower("clean"))), "|").alias("tokens"))
    return _with_share(df, counts.join(examples, "column"))


def whitespace_issues(df: DataFrame) -> DataFrame:
    """Q12: white space at the edges: count and up to five before/after pairs."""
    if not _strings(df):
        return X.lit_rows(df, [], "column string, n bigint, examples string, pct double, severity string")
    cells = _dirty(df, False)
    counts = cells.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    shown = F.concat(F.lit("["), "value", F.lit("]->["), "clean", F.lit("]"))
    examples = (cells.withColumn("r", place).where(F.col("r") <= EXAMPLES).groupBy("column")
                .agg(F.array_join(F.sort_array(F.collect_list(shown)), "|").alias("examples")))
    return _with_share(df, counts.join(examples, "column"))


def _overlap(patterns: DataFrame) -> DataFrame:
    m, d, n = F.col("missing"), F.col("duplicated"), F.col("n")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")
    one = patterns.agg(total(m & ~d).alias("a"), total(d & ~m).alias("b"), total(m & d).alias("c"),
                       total(~m & ~d).alias("e"), F.sum("n").alias("total"))
    return one.select("total", X.rows(*[F.struct(F.lit(k).alias("pattern"), F.col(c).alias("n")) for k, c in (
        ("only_missing", "a"), ("only_duplicate", "b"), ("missing_and_duplicate", "c"), ("none", "e"))])).select(
        "pattern", "n", X.pct2(F.col("n"), F.col("total")).alias("pct"))


def anomaly_overlap(df: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Q13: rows only missing, only duplicated, both, none; over all rows."""
    return _overlap(row_patterns(df) if patterns is None else patterns)


def _issue(df, module, issue, column, severity_col, value, action, impact) -> DataFrame:
    c = column.cast("string")
    return df.select(
        F.concat_ws(":", F.lit(module), F.lit(issue), F.coalesce(c, F.lit("dataset"))).alias("id"),
        F.lit(module).alias("module"), F.lit(issue).alias("issue"), c.alias("column"),
        severity_col.alias("severity"), value.cast("double").alias("value"), F.lit(action).alias("action"),
        impact.cast("bigint").alias("impact"))


def _standardized(df: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    patterns = row_patterns(df) if patterns is None else patterns
    dup = patterns.where("duplicated").agg(F.sum("n").alias("n"), F.sum("n_groups").alias("g"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    dup = dup.where("n > 0").withColumn("pct", _pct2(F.col("n"), total))
    none = F.lit(None)
    overlap = _overlap(patterns).where("n > 0 and pattern <> 'none'").agg(F.sum("n").alias("n")).where("n > 0")
    candidates = exclusion_candidates(df)
    return reduce(DataFrame.unionByName, [
        _issue(dup, "duplicates", "duplicate_rows", none,
               F.when(F.col("pct") >= MANY_DUPLICATES, "high").otherwise("medium"), F.col("pct"), "drop_duplicate_rows",
               F.col("n") - F.col("g")),
        _issue(candidates, "inconsistencies", "candidate_exclusion", F.col("column"),
               F.when(F.col("reason") == "too_many_missing", "high").otherwise("medium"), F.col("evidence_pct"),
               "exclude_column", F.lit(1)),
        _issue(masked_missing(df), "text_cleaning", "masked_missing_values", F.col("column"),
               issue_severity(F.col("severity")), F.col("pct"), "replace_values", F.col("n")),
        _issue(whitespace_issues(df), "text_cleaning", "leading_trailing_whitespace", F.col("column"),
               issue_severity(F.col("severity")), F.col("pct"), "trim_whitespace", F.col("n")),
        _issue(overlap, "anomalies", "anomaly_row_patterns", none, F.lit("low"), F.col("n"), "review_only", F.lit(0)),
    ])


def standardized_issues(df: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Q14: all findings as issue rows, worst first; ``impact`` is rows removed, columns removed or cells changed."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return _standardized(df, patterns).orderBy(rank, F.coalesce("column", F.lit("")), "issue")


def cleaning_summary(df: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Q15; ``issues`` may be an earlier result of ``standardized_issues``."""
    review = F.col("action") == "review_only"
    return (_standardized(df) if issues is None else issues).agg(
        F.count(F.lit(1)).alias("issues_total"), X.count_if(~review).alias("actionable_total"),
        X.count_if(review).alias("review_only_total"),
        F.array_join(F.sort_array(F.collect_set(F.when(~review, F.col("column")))), ", ").alias("columns_impacted"),
        X.count_if(~review & F.col("column").isNull()).alias("dataset_level_actions"))


def issues_by_severity(df: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Q16"""
    return (_standardized(df) if issues is None else issues).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
