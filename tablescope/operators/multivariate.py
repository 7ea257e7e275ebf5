"""Many columns at once (M1-M8). The linear algebra runs on matrices of columns x columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import expr as X
from tablescope.operators import bivariate as BI
from tablescope.plans import blocks as B

# Thresholds.
PCA_MIN_ROWS, VIF_MIN_ROWS, HIGH_VIF, LEAKAGE_R = 20, 10, 10.0, 0.98


def variance_rank(df: DataFrame, columns: list[str], top_n: int | None = None) -> DataFrame:
    """M1: columns by sample variance, all or the ``top_n`` first."""
    v = B.wide(df, {c: {"variance": F.var_samp(X.double(df, c))} for c in columns})
    v = v.where("variance is not null").orderBy(F.desc("variance"), "column").select("column", "variance")
    return v if top_n is None else v.limit(top_n)


def ranked(df: DataFrame, columns: list[str], top_n: int | None = None) -> list[str]:
    """M1 collected (column metadata); all-null columns are out, they would empty every complete case."""
    return [r["column"] for r in variance_rank(df, columns, top_n).collect()]


def high_correlation_pairs(df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """M2: pairs above .7, flagged above .85, all or the ``top`` strongest."""
    p = BI.pearson_all(df, BI.column_pairs(columns)).where((F.col("n") >= BI.MIN_N) & (F.abs("r") > BI.HIGH))
    p = p.select("var_a", "var_b", "n", F.col("r").alias("correlation"), (F.abs("r") > BI.COLLINEAR).alias("flag"))
    p = p.orderBy(F.abs("correlation").desc(), "var_a", "var_b")
    return p if top is None else p.limit(top)


def global_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """M3: upper triangle with a mark on pairs above .7."""
    p = BI.pearson_all(df, BI.column_pairs(columns)).where(F.col("n") >= BI.MIN_N)
    return p.select("var_a", "var_b", "n", F.col("r").alias("value"), (F.abs("r") > BI.HIGH).alias("high"))


def correlation_of_complete_rows(df: DataFrame, columns: list[str]):
    """(n, means, population sds, correlation matrix) of the complete rows, from one aggregate."""
    cells = B.gram(df, columns).collect()
    k = len(columns)
    at = {c: i for i, c in enumerate(columns)}
    cov, mean, n = np.zeros((k, k)), np.zeros(k), 0
    for r in cells:
        i, j = at[r["var_a"]], at[r["var_b"]]
        n = r["n"]
        cov[i, j] = cov[j, i] = r["sxy"] / n
        mean[i], mean[j] = r["mean_a"], r["mean_b"]
    sd = np.sqrt(np.diag(cov))
    scale = np.where(sd > 0, sd, 1.0)
    return n, mean, sd, cov / np.outer(scale, scale)


def pca_model(df: DataFrame, columns: list[str]):
    """(columns, means, sds, variances, loadings by row) or None if there is too little data.

    The sign of a component makes its largest loading positive.
    """
    if len(columns) < 4:
        return None
    n, mean, sd, corr = correlation_of_complete_rows(df, columns)
    if n < PCA_MIN_ROWS:
        return None
    values, vectors = np.linalg.eigh(corr)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    peak = np.abs(vectors).argmax(axis=1)
    vectors *= np.sign(vectors[np.arange(len(vectors)), peak])[:, None]
    return columns, mean, np.where(sd > 0, sd, 1.0), values, vectors


PCA_SCHEMA = "component string, explained_pct double, cumulative_pct double, top_variables string, loadings string"


def pca(df: DataFrame, columns: list[str], components: int | None = None) -> DataFrame:
    """M4: standardised principal components, all or the first ``components``; top three loadings of the first five."""
    model = pca_model(df, columns)
    rows = []
    if model:
        names, _, _, values, vectors = model
        share = values / values.sum() * 100
        for i in range(min(len(names), components or len(names))):
            top = np.argsort(-np.abs(vectors[i]), kind="stable")[:3]
            rows.append((f"PC{i + 1}", float(share[i]), float(share[:i + 1].sum()),
                         ", ".join(names[j] for j in top) if i < 5 else None,
                         ", ".join(f"{c}={v:.6f}" for c, v in zip(names, vectors[i]))))
    return X.lit_rows(df, rows, PCA_SCHEMA)


def pca_scores(df: DataFrame, columns: list[str], keep: list[str] = (), components: int = 2) -> DataFrame:
    """M5: component scores of every complete row, next to the ``keep`` columns."""
    model = pca_model(df, columns)
    if model is None:
        return df.select(*[X.ref(c) for c in keep]).limit(0)
    names, mean, sd, _, vectors = model
    z = [(X.double(df, c) - F.lit(float(mean[i]))) / F.lit(float(sd[i])) for i, c in enumerate(names)]
    scores = [sum((zi * F.lit(float(v)) for zi, v in zip(z[1:], vectors[p][1:])), z[0] * F.lit(float(vectors[p][0]))).alias(f"pc{p + 1}")
              for p in range(components)]
    return df.select(*[X.ref(c) for c in keep], *scores).where(F.col("pc1").isNotNull())


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """M6: diagonal of the inverse correlation matrix of the complete rows; constants are left out."""
    schema = "feature string, vif double, high boolean"
    if len(columns) < 2:
        return X.lit_rows(df, [], schema)
    n, _, sd, corr = correlation_of_complete_rows(df, columns)
    if n < VIF_MIN_ROWS:
        return X.lit_rows(df, [], schema)
    use = [i for i in range(len(columns)) if sd[i] > 0]
    sub = corr[np.ix_(use, use)]
    try:
        inverse = np.diag(np.linalg.inv(sub))
    except np.linalg.LinAlgError:
        inverse = np.full(len(use), np.inf)
    return X.lit_rows(df, [(columns[i], float(v), bool(v > HIGH_VIF)) for i, v in zip(use, inverse)], schema)


def target_leakage_corr(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """M7: features whose correlation with a numeric target exceeds .98."""
    schema = "column string, n bigint, correlation double"
    others = [c for c in columns if c != target]
    if not others or not isinstance(X.dtype(df, target), (T.FloatType, T.DoubleType, T.IntegerType, T.LongType)):
        return X.lit_rows(df, [], schema)
    p = BI.pearson_all(df, [(c, target) for c in others]).where((F.col("n") > 10) & (F.abs("r") > LEAKAGE_R))
    return p.select(F.col("var_a").alias("column"), "n", F.col("r").alias("correlation"))


def ml_warnings(df: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """M8: collinear columns and target leaks with the advised action; one row if there is nothing."""
    rows = vif(df, columns).where("high").select(
        F.lit("multicollinearity").alias("type"), F.col("feature").alias("column"), F.col("vif").alias("value"), F.lit("drop_one").alias("action"))
    if target is not None:
        rows = rows.unionByName(target_leakage_corr(df, columns, target).select(
            F.lit("potential_target_leakage").alias("type"), "column", F.col("correlation").alias("value"), F.lit("investigate").alias("action")))
    empty = rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit("no_anomaly").alias("type"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("double").alias("value"),
        F.lit("none").alias("action"))
    return rows.unionByName(empty)
