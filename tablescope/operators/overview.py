"""Table overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions import expr as X
from tablescope.operators import semantic as S
from tablescope.plans import blocks as B
from tablescope.sources.files import bytes_of

LARGE_TABLE = 500_000


def table_overview(df: DataFrame) -> DataFrame:
    """O1"""
    cols = B.wide(df, {c: {"n_rows": F.count(F.lit(1)), "n_null": X.count_if(X.ref(c).isNull()),
                           "n_bytes": bytes_of(df, c)} for c in df.columns})
    return cols.agg(F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"),
                    F.sum("n_rows").alias("n_cells"), F.sum("n_null").alias("n_missing"),
                    F.sum("n_bytes").alias("n_bytes")).withColumn(
        "pct_missing", X.pct2(F.col("n_missing"), F.col("n_cells")))


def column_role(semantic_type: Column) -> Column:
    """O3"""
    return (F.when(semantic_type == "id", "key").when(semantic_type == "datetime", "temporal")
            .when(semantic_type == "geographic", "spatial").otherwise("feature"))


def column_overview(df: DataFrame, overrides: dict | None = None, typed: DataFrame | None = None) -> DataFrame:
    """O2"""
    return S.typed(df, overrides, typed).select(
        "position", "column", "dtype", "semantic_type", "n_distinct",
        X.pct2(F.col("n_null"), F.col("n_rows")).alias("pct_missing"),
        column_role(F.col("semantic_type")).alias("role"))


def overview_flags(df: DataFrame, overrides: dict | None = None, typed: DataFrame | None = None) -> DataFrame:
    """Table-level flags, one row per flag that applies, with the value behind it."""
    t = F.col("semantic_type")
    one = S.typed(df, overrides, typed).agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_cols"),
        X.pct(F.sum("n_null"), F.sum("n_rows")).alias("pct_missing"),
        X.count_if(t == "id").alias("n_id"), X.count_if(t.startswith("categorical")).alias("n_cat"),
        X.count_if(t.startswith("numeric")).alias("n_num"), X.count_if(t == "text").alias("n_text"))
    n = F.col("n_cols")
    flags = [("high_missing", F.col("pct_missing"), F.col("pct_missing") > 20),
             ("many_ids", F.col("n_id"), F.col("n_id") > n * 0.3),
             ("mostly_categorical", F.col("n_cat"), F.col("n_cat") > n * 0.5),
             ("no_numeric", F.col("n_num"), F.col("n_num") == 0),
             ("large_table", F.col("n_rows"), F.col("n_rows") > LARGE_TABLE),
             ("text_present", F.col("n_text"), F.col("n_text") > 0)]
    return one.select(X.rows(*[F.struct(F.lit(code).alias("flag"), value.cast("double").alias("value"),
                                        cond.alias("raised")) for code, value, cond in flags])
                      ).where("raised").drop("raised")
