"""Optional sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions import expr as X

# Above THRESHOLD rows, SAMPLE_ROWS are drawn with SEED.
THRESHOLD, SAMPLE_ROWS, SEED = 100_000, 50_000, 42


def sample_fixed(df: DataFrame, n: int = SAMPLE_ROWS, threshold: int = THRESHOLD, seed: int = SEED) -> DataFrame:
    """Exactly n rows without replacement when the table is larger than the threshold.

    Rows are ordered by a seeded hash, so the sample does not depend on partitioning. A sketch of
    the hash first drops rows that cannot be among the n smallest, so each task keeps few rows.
    """
    total = df.count()
    if total <= threshold:
        return df
    hashed = df.withColumn("_h", X.row_hash(df, F.lit(seed)))
    # The n smallest of N uniform hashes lie below 2n/N of the range with overwhelming probability;
    # the cut is only used if enough rows are below it.
    span = min(1.0, 2.0 * n / total + 1e-9)
    cut = int(-(2 ** 63) + span * (2 ** 64 - 1))
    near = hashed.where(F.col("_h") <= F.lit(min(cut, 2 ** 63 - 1)))
    if span < 1.0 and near.count() < n:
        near = hashed
    sortable = [X.ref(f.name) for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return near.orderBy("_h", *sortable).limit(n).drop("_h")


def sample_info(df: DataFrame, n: int = SAMPLE_ROWS, threshold: int = THRESHOLD) -> DataFrame:
    """S9"""
    rows = F.col("original_rows")
    return df.agg(F.count(F.lit(1)).alias("original_rows")).select(
        (rows > threshold).alias("will_sample"), "original_rows",
        F.when(rows > threshold, F.lit(n)).otherwise(rows).cast("bigint").alias("sample_rows"),
        F.lit(threshold).cast("bigint").alias("threshold"))
