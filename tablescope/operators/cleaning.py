"""Cleaning actions (C1-C7); every action is ``DataFrame -> DataFrame`` and stays lazy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.context import CleaningAction
from tablescope.functions import expr as X


def _is_text(df: DataFrame, column: str | None) -> bool:
    return column in df.columns and isinstance(X.dtype(df, column), T.StringType)


def _replace(df: DataFrame, column: str, value) -> DataFrame:
    return df.select(*[value.alias(c) if c == column else X.ref(c) for c in df.columns])


def exclude_column(df: DataFrame, column: str) -> DataFrame:
    """Dropped if present."""
    return df.select(*[X.ref(c) for c in df.columns if c != column])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One copy of every distinct row; copies are merged in the map tasks before the shuffle."""
    return df.dropDuplicates()


def replace_values_exact(df: DataFrame, column: str, values: list) -> DataFrame:
    """Listed texts become null; other column types are left alone."""
    wanted = [str(v) for v in values if v is not None]
    if not wanted or not _is_text(df, column):
        return df
    return _replace(df, column, F.when(~F.coalesce(X.ref(column).isin(wanted), F.lit(False)), X.ref(column)))


def replace_values_normalized(df: DataFrame, column: str, values: list) -> DataFrame:
    """C4: as C3 after trim and lower case on both sides."""
    wanted = [str(v).strip().lower() for v in values if v is not None]
    if not wanted or not _is_text(df, column):
        return df
    match = F.lower(X.strip(X.ref(column))).isin(wanted)
    return _replace(df, column, F.when(~F.coalesce(match, F.lit(False)), X.ref(column)))


def trim_whitespace(df: DataFrame, column: str) -> DataFrame:
    """C5"""
    return _replace(df, column, X.strip(X.ref(column))) if _is_text(df, column) else df


def apply_action(df: DataFrame, action: CleaningAction | None) -> DataFrame:
    if action is None:
        return df
    if action.type == "drop_duplicate_rows":
        return drop_duplicate_rows(df)
    if action.column not in df.columns:
        return df
    if action.type == "exclude_column":
        return exclude_column(df, action.column)
    if action.type == "trim_whitespace":
        return trim_whitespace(df, action.column)
    if action.type == "replace_values":
        values = (action.params or {}).get("values") or []
        trimmed = (action.params or {}).get("match_mode") == "exact_case_insensitive_trimmed"
        return (replace_values_normalized if trimmed else replace_values_exact)(df, action.column, values)
    return df


def apply_cleaning(df: DataFrame, actions: list[CleaningAction]) -> DataFrame:
    """Actions in order; unknown types change nothing."""
    return reduce(apply_action, actions, df)


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and columns before, after and removed."""
    def sized(df, name):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    both = sized(before, "before").unionByName(sized(after, "after"))
    rb = F.max(F.when(F.col("side") == "before", F.col("n")))
    ra = F.max(F.when(F.col("side") == "after", F.col("n")))
    cb, ca = len(before.columns), len(after.columns)
    return both.agg(rb.alias("rows_before"), ra.alias("rows_after"), (rb - ra).alias("rows_removed")).select(
        "*", F.lit(cb).cast("bigint").alias("columns_before"), F.lit(ca).cast("bigint").alias("columns_after"),
        F.lit(cb - ca).cast("bigint").alias("columns_removed"))
