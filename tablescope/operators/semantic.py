"""What each column means: semantic types (T1, T2) and scored detectors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import expr as X
from tablescope.functions import keywords as K
from tablescope.plans import blocks as B

# The ten labels, in reporting order.
SEMANTIC_TYPES = (
    "numeric_continuous", "numeric_discrete", "categorical_nominal", "categorical_ordinal", "boolean",
    "datetime", "text", "id", "geographic", "unknown",
)
# Thresholds of the typing rules.
TEXT_MIN_LENGTH, ID_SHARE, ID_NAME_SHARE, ID_MIN_DISTINCT = 30, 0.95, 0.90, 100
TEXT_SHARE, DISCRETE_MAX = 0.50, 30

DETECTORS = ("price", "quantity", "id", "date", "percentage", "categorical", "text")


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, X.TEMPORAL_TYPES):
        return "temporal"
    if isinstance(kind, X.INTEGER_TYPES):
        return "integer"
    if isinstance(kind, X.FLOAT_TYPES + (T.DecimalType,)):
        return "float"
    if isinstance(kind, T.StringType):
        return "string"
    return "other"


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact (column, n_distinct, top_n, not_boolean) from one FREQ shuffle."""
    columns = B.countable(df) if columns is None else columns
    if not columns:
        return X.lit_rows(df, [], "column string, n_distinct bigint, top_n bigint, not_boolean bigint")
    f = B.freq(df, columns, hashed=True)
    odd = ~F.lower("value").isin(*K.BOOLEAN)
    return f.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("top_n"),
        X.count_if(odd).alias("not_boolean"))


def column_stats(df: DataFrame, overrides: dict | None = None, extra=None) -> DataFrame:
    """One row per column: the measurements the typing rules need, in two scans of the table.

    ``extra(column)`` may add aggregates to the first scan.
    """
    metrics = {}
    for f in df.schema.fields:
        c, v, kind = f.name, X.ref(f.name), kind_of(f.dataType)
        is_text = kind == "string"
        metrics[c] = {
            "dtype": F.lit(f.dataType.simpleString()), "kind": F.lit(kind),
            "override": F.lit((overrides or {}).get(c)).cast("string"),
            "named_id": F.lit(bool(re.search(K.ID_NAME, c, re.I))),
            "named_geo": F.lit(bool(re.search(K.GEO_NAME, c, re.I))),
            "n_rows": F.count(F.lit(1)), "n_null": X.count_if(v.isNull()),
            "avg_length": F.avg(F.char_length(v)) if is_text else F.lit(None).cast("double"),
            "n_parsed": X.count_if(v.try_cast("timestamp_ntz").isNotNull()) if is_text else F.lit(0).cast("bigint"),
            "n_nan": X.count_if(F.isnan(v)) if isinstance(f.dataType, X.FLOAT_TYPES) else F.lit(0).cast("bigint"),
            **(extra(c) if extra else {}),
        }
    stats = B.wide(df, metrics)
    return (stats.join(distinct_counts(df), "column", "left")
            .na.fill(0, ["n_distinct", "top_n", "not_boolean"]))


def type_rule() -> Column:
    """The typing rules in order, over a ``column_stats`` row."""
    valid = F.col("n_rows") - F.col("n_null")
    share = F.coalesce(X.div(F.col("n_distinct"), F.col("n_rows")), F.lit(0.0))
    kind, u = F.col("kind"), F.col("n_distinct")
    return (F.when(F.col("override").isNotNull(), F.col("override"))
            .when(kind == "temporal", "datetime")
            .when(kind == "boolean", "boolean")
            .when(kind == "other", "unknown")
            .when((u <= 2) & (F.col("not_boolean") == 0), "boolean")
            .when(F.col("named_geo"), "geographic")
            .when(F.col("named_id") & (share >= ID_NAME_SHARE), "id")
            .when((share >= ID_SHARE) & (u > ID_MIN_DISTINCT), "id")
            .when(kind == "float", "numeric_continuous")
            .when((kind == "integer") & (u <= DISCRETE_MAX), "numeric_discrete")
            .when(kind == "integer", "numeric_continuous")
            .when(F.col("n_parsed") > valid * 0.5, "datetime")
            .when((F.col("avg_length") >= TEXT_MIN_LENGTH) & (share >= TEXT_SHARE), "text")
            .otherwise("categorical_nominal"))


def typed_stats(df: DataFrame, overrides: dict | None = None, extra=None) -> DataFrame:
    return column_stats(df, overrides, extra).withColumn("semantic_type", type_rule())


def typed(df: DataFrame, overrides: dict | None = None, known: DataFrame | None = None) -> DataFrame:
    """``known``, or the typed column statistics of the table (one row per column)."""
    return typed_stats(df, overrides) if known is None else known


def semantic_types(df: DataFrame, overrides: dict | None = None) -> DataFrame:
    """(column, semantic_type); ``overrides`` win over the rules."""
    return typed_stats(df, overrides).select("position", "column", "semantic_type")


def type_map(df: DataFrame, overrides: dict | None = None) -> dict[str, str]:
    """T1 collected: one row per column, in column order."""
    rows = semantic_types(df, overrides).orderBy("position").collect()
    return {r["column"]: r["semantic_type"] for r in rows}


def group_map(types: dict[str, str]) -> dict[str, list[str]]:
    groups = {k: [] for k in SEMANTIC_TYPES}
    for c, t in types.items():
        groups[t if t in groups else "unknown"].append(c)
    return groups


def semantic_groups(df: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Columns per semantic type, in column order."""
    known = F.when(F.col("semantic_type").isin(*SEMANTIC_TYPES), F.col("semantic_type")).otherwise("unknown")
    return (semantic_types(df, overrides).groupBy(known.alias("semantic_type"))
            .agg(F.count(F.lit(1)).alias("n_columns"),
                 F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "column"))),
                                          lambda s: s["column"]), ", ").alias("columns")))


def _detector_stats(df: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    metrics = {}
    for f in df.schema.fields:
        c, v, kind = f.name, X.ref(f.name), kind_of(f.dataType)
        number, is_text = kind in ("integer", "float"), kind == "string"
        none, x = F.lit(None).cast("double"), v.cast("double") if kind in ("integer", "float") else None
        lower = c.lower()
        affix = any(lower.startswith(a) or lower.endswith(a) for a in K.ID_AFFIXES)
        looks = v.rlike(r"[-/.]") & v.rlike("[0-9]") & (F.char_length(v) >= 8) if is_text else None
        metrics[c] = {
            "kind": F.lit(kind), "n_rows": F.count(F.lit(1)), "n_valid": F.count(v),
            "min_value": F.min(x) if number else none, "max_value": F.max(x) if number else none,
            "std_value": F.stddev_samp(x) if number else none,
            "integer_share": F.avg((x == F.floor(x)).cast("int")) if number else none,
            "avg_length": F.avg(F.char_length(v)) if is_text else none,
            "max_length": F.max(F.char_length(v)).cast("double") if is_text else none,
            "date_share": F.avg(looks.cast("int")) if is_text else none,
            "name_price": F.lit(K.first_word_score(c, K.PRICE, 0.6, 0.4)),
            "name_quantity": F.lit(K.first_word_score(c, K.QUANTITY, 0.6, 0.4)),
            "name_id": F.lit(0.5 if affix else K.first_word_score(c, K.ID, 0.55, 0.35)),
            "name_date": F.lit(K.first_word_score(c, K.DATE, 0.5, 0.35)),
            "name_percentage": F.lit(0.6 if "%" in c else K.first_word_score(c, K.PERCENTAGE, 0.45, 0.3)),
            "name_categorical": F.lit(K.first_word_score(c, K.CATEGORICAL, 0.4, 0.25)),
            "name_text": F.lit(K.first_word_score(c, K.TEXT, 0.5, 0.3)),
        }
    stats = B.wide(df, metrics)
    if set(wanted) <= {"date", "percentage"}:
        return stats.withColumn("n_distinct", F.lit(None).cast("bigint"))
    return stats.join(distinct_counts(df).select("column", "n_distinct"), "column", "left").na.fill(0, ["n_distinct"])


def _points(cond: Column, value: float) -> Column:
    return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))


def _first(*cases: tuple[Column, float]) -> Column:
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for cond, value in cases[1:]:
        out = out.when(cond, F.lit(value))
    return out.otherwise(F.lit(0.0))


def _scores() -> dict[str, Column]:
    kind = F.col("kind")
    number = kind.isin("integer", "float")
    filled = F.col("n_valid") > 0
    u = F.col("n_distinct")
    u_null = u + F.when(F.col("n_rows") > F.col("n_valid"), 1).otherwise(0)
    ratio = F.coalesce(X.div(u_null, F.col("n_rows")), F.lit(0.0))
    lo, hi = F.col("min_value"), F.col("max_value")
    some = F.col("n_rows") > 0
    is_text = kind == "string"
    return {
        "price": F.col("name_price") + _points(number, 0.2) + _points(number & (lo >= 0), 0.1)
        + _points(number & filled & (u > 10), 0.1) + _points(F.col("std_value") > 0, 0.1)
        + _points(hi < 1_000_000, 0.05),
        "quantity": F.col("name_quantity") + _points(number, 0.15) + _points(kind == "integer", 0.1)
        + _points(lo >= 0, 0.15) + _points(number & filled & (u > 2), 0.1)
        + _points((kind == "float") & (F.col("integer_share") > 0.95), 0.1),
        "id": F.col("name_id") + _first((some & (ratio > 0.95), 0.4), (some & (ratio > 0.8), 0.25),
                                        (some & (ratio > 0.6), 0.1))
        + _points(some & (u_null == F.col("n_rows")), 0.1) - _points(number & (u_null < 20), 0.3),
        "date": F.col("name_date") + _points(kind == "temporal", 0.6)
        + _first((F.col("date_share") > 0.8, 0.4), (F.col("date_share") > 0.5, 0.25)),
        "percentage": F.col("name_percentage") + _points(number, 0.1)
        + _first(((lo >= 0) & (hi <= 1), 0.45), ((lo >= 0) & (hi <= 100), 0.35), ((lo >= -100) & (hi <= 100), 0.2)),
        "categorical": F.col("name_categorical")
        + _first((some & (u_null <= 2), 0.2), (some & (u_null <= 10), 0.4), (some & (u_null <= 20), 0.3),
                 (some & (ratio < 0.05), 0.2))
        + _first((is_text, 0.3), (kind == "boolean", 0.5)) - _points(is_text & some & (ratio > 0.5), 0.3),
        "text": F.col("name_text") + _points(is_text, 0.2)
        + _first((F.col("avg_length") > 80, 0.5), (F.col("avg_length") > 25, 0.35), (F.col("avg_length") > 10, 0.1))
        + _points(is_text & filled & (X.div(u, F.col("n_valid")) > 0.7), 0.1),
    }


def _meta(detector: str) -> Column:
    pairs = {
        "price": ("min_value", "max_value", "n_distinct"), "quantity": ("min_value", "max_value", "integer_share"),
        "id": ("n_distinct", "n_rows"), "date": ("date_share",), "percentage": ("min_value", "max_value", "scale"),
        "categorical": ("n_distinct", "n_rows"), "text": ("avg_length", "max_length", "n_distinct"),
    }[detector]
    lo, hi = F.col("min_value"), F.col("max_value")
    scale = (F.when((lo >= 0) & (hi <= 1), "0-1").when((lo >= 0) & (hi <= 100), "0-100")
             .when((lo >= -100) & (hi <= 100), "-100/100"))
    items = []
    for p in pairs:
        items += [F.lit(p), scale if p == "scale" else F.col(p).cast("string")]
    return F.create_map(*items)


def detect_all(df: DataFrame, detectors: tuple[str, ...] = DETECTORS) -> DataFrame:
    """Every detector's verdict on every column, from one pass and one FREQ shuffle."""
    stats = _detector_stats(df, detectors)
    scores = _scores()
    verdicts = [F.struct(F.lit(DETECTORS.index(d)).alias("rank"), F.lit(d).alias("detector"),
                         F.least(F.greatest(F.round(scores[d], 6), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
                         _meta(d).alias("meta")) for d in detectors]
    return (stats.select("position", "column", X.rows(*verdicts)))


def detect_price(df: DataFrame) -> DataFrame:
    """T3"""
    return detect_all(df, ("price",)).drop("rank", "position")


def detect_quantity(df: DataFrame) -> DataFrame:
    """T4"""
    return detect_all(df, ("quantity",)).drop("rank", "position")


def detect_id(df: DataFrame) -> DataFrame:
    """T5: here a null counts as one more distinct value."""
    return detect_all(df, ("id",)).drop("rank", "position")


def detect_date(df: DataFrame) -> DataFrame:
    """Strings are judged on all rows."""
    return detect_all(df, ("date",)).drop("rank", "position")


def detect_percentage(df: DataFrame) -> DataFrame:
    """T7"""
    return detect_all(df, ("percentage",)).drop("rank", "position")


def detect_categorical(df: DataFrame) -> DataFrame:
    """T8"""
    return detect_all(df, ("categorical",)).drop("rank", "position")


def detect_text(df: DataFrame) -> DataFrame:
    """T9"""
    return detect_all(df, ("text",)).drop("rank", "position")


def best_semantic(df: DataFrame) -> DataFrame:
    """The most confident verdict per column; ties go to the earlier detector."""
    return (detect_all(df).groupBy("position", "column")
            .agg(F.max_by(F.struct("detector", "confidence", "meta"),
                          F.struct("confidence", -F.col("rank"))).alias("best"))
            .select("position", "column", F.col("best.detector").alias("semantic_type"),
                    F.col("best.confidence").alias("confidence"), F.col("best.meta").alias("meta")))
