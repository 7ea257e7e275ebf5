"""Suggested and derived columns.

Suggestions are joins of the verdict table of ``best_semantic``: one row per column of the input,
so every table in the suggestion rules is column metadata, not data.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.context import AcceptedFeature
from tablescope.functions import expr as X
from tablescope.functions import keywords as K
from tablescope.operators import semantic as S

SUGGESTION = ("name", "type", "source_columns", "formula", "confidence", "status")


def _hits(name: Column, words) -> Column:
    return reduce(lambda a, b: a + b, [F.lower(name).contains(w).cast("int") for w in dict.fromkeys(words)])


def _hint(name: Column, words) -> Column:
    return F.least(_hits(name, words) / F.lit(2.0), F.lit(1.0))


def _crossed(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of two column-metadata tables, as an equi-join on one key."""
    a = left.select(F.lit(1).alias("k"), *[F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.select(F.lit(1).alias("k"), *[F.col(c).alias(f"b_{c}") for c in right.columns])
    return a.join(b, "k").drop("k")


def _of(verdicts: DataFrame, *kinds: str) -> DataFrame:
    return verdicts.where(F.col("semantic_type").isin(*kinds)).select("position", "column", "confidence")


def _both(fmt: str) -> Column:
    return F.format_string(fmt, F.col("a_column"), F.col("b_column"))


def _suggestion(df: DataFrame, name, kind: str, formula, confidence, sources=None) -> DataFrame:
    return df.select(name.alias("name"), F.lit(kind).alias("type"),
                     (sources if sources is not None else _both("%s, %s")).alias("source_columns"),
                     formula.alias("formula"), F.round(confidence, 3).alias("confidence"),
                     F.lit("pending").alias("status"))


def _first(rows: DataFrame, top: int | None) -> DataFrame:
    return rows if top is None else rows.limit(top)


def suggest_revenue(verdicts: DataFrame, top: int | None = None) -> DataFrame:
    """price x quantity, unit prices preferred; all, or the first ``top`` in column order."""
    unit = (_hits(F.col("column"), K.UNIT_PRICE) > 0) & (_hits(F.col("column"), K.TOTAL_PRICE) == 0)
    whole = Window.partitionBy(F.lit(1))
    prices = (_of(verdicts, "price").withColumn("unit", unit.cast("int"))
              .withColumn("best", F.max("unit").over(whole)).withColumn("n", F.count(F.lit(1)).over(whole))
              .where(F.col("unit") == F.col("best")))
    quantities = _of(verdicts, "quantity").withColumn("n", F.count(F.lit(1)).over(whole))
    pairs = _crossed(prices, quantities)
    p = F.regexp_replace(F.regexp_replace(F.lower("a_column"), "price|prezzo|costo", ""), "^_+|_+$", "")
    q = F.regexp_replace(F.regexp_replace(F.lower("b_column"), "qty|quantity|quantita", ""), "^_+|_+$", "")
    bonus = (F.when((p == "") | (q == ""), 0.0).when(p.startswith(q) | q.startswith(p), 0.1)
             .when((F.char_length(p) >= 3) & (F.left(p, F.lit(3)) == F.left(q, F.lit(3))), 0.08).otherwise(0.0))
    name = F.when((F.col("a_n") > 1) | (F.col("b_n") > 1), _both("revenue_%s_x_%s")).otherwise("revenue")
    conf = F.least((F.col("a_confidence") + F.col("b_confidence")) / 2 + bonus, F.lit(1.0))
    return _suggestion(_first(pairs.orderBy("a_position", "b_position"), top), name, "revenue",
                       _both("%s * %s"), conf)


def suggest_margin(verdicts: DataFrame) -> DataFrame:
    """(selling price, cost) pairs told apart by name -> absolute and relative margin."""
    prices = _of(verdicts, "price")
    edge = _hint(F.col("column"), K.SELLING) - _hint(F.col("column"), K.COST)
    prices = prices.withColumn("edge", edge)
    pairs = _crossed(prices.where("edge > 0"), prices.where("edge < 0"))
    conf = F.round((F.col("a_confidence") + F.col("b_confidence")) / 2, 3)
    absolute = _suggestion(pairs, F.concat(F.lit("margin_"), F.col("a_column")), "margin", _both("%s - %s"), conf)
    sell = F.col("a_column")
    formula = F.concat(F.lit("("), _both("%s - %s"), F.lit(") / NULLIF("), sell, F.lit(", 0) * 100"))
    relative = _suggestion(pairs, F.concat(F.lit("margin_pct_"), sell), "margin_pct", formula, conf * 0.95)
    return absolute.unionByName(relative)


def suggest_discount(verdicts: DataFrame) -> DataFrame:
    """price and discount-named column -> net price; needs two prices, skips margin pairs."""
    prices = _of(verdicts, "price")
    enough = Window.partitionBy(F.lit(1))
    prices = (prices.withColumn("n", F.count(F.lit(1)).over(enough)).where("n >= 2")
              .withColumn("edge", _hint(F.col("column"), K.SELLING) - _hint(F.col("column"), K.COST)))
    discounts = (verdicts.where(F.col("semantic_type").isin("price", "percentage"))
                 .where(_hits(F.col("column"), K.DISCOUNT) > 0)
                 .select("position", "column", "confidence", F.col("meta")["scale"].alias("scale"),
                         F.when(F.col("semantic_type") == "price",
                                _hint(F.col("column"), K.SELLING) - _hint(F.col("column"), K.COST)).alias("edge")))
    pairs = _crossed(prices, discounts).where("a_column <> b_column")
    margin_pair = F.coalesce(F.col("a_edge") * F.col("b_edge") < 0, F.lit(False))
    once = Window.partitionBy(F.least("a_column", "b_column"), F.greatest("a_column", "b_column")).orderBy("a_position")
    pairs = pairs.where(~margin_pair).withColumn("r", F.row_number().over(once)).where("r = 1")
    formula = F.when(F.col("b_scale") == "0-1", _both("%s * (1 - %s)")).otherwise(_both("%s * (1 - %s / 100)"))
    return _suggestion(pairs, F.concat(F.lit("net_price_"), F.col("a_column")), "discount", formula,
                       (F.col("a_confidence") + F.col("b_confidence")) / 2 * 0.9)


def suggest_ratio(verdicts: DataFrame, top: int | None = None) -> DataFrame:
    """keyword pairs of quantities; if none fits, all pairs by confidence, or the first ``top``."""
    quantities = _of(verdicts, "quantity")
    pairs = _crossed(quantities, quantities).where("a_column <> b_column")
    low, high = F.least("a_column", "b_column"), F.greatest("a_column", "b_column")

    def hits(col, words):
        return _hits(F.col(col), words) > 0

    rule = F.lit(None).cast("int")
    for i, (num, den, _) in reversed(list(enumerate(K.RATIO_PAIRS))):
        rule = F.when(hits("a_column", num) & hits("b_column", den), F.lit(i)).otherwise(rule)
    label = F.element_at(F.array(*[F.lit(n) for _, _, n in K.RATIO_PAIRS]), F.col("rule") + 1)
    first = Window.partitionBy(low, high).orderBy("rule", "a_position")
    named = (pairs.withColumn("rule", rule).where("rule is not null")
             .withColumn("r", F.row_number().over(first)).where("r = 1").withColumn("label", label)
             .withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("rule", "a_position", "b_position"))))
    name = F.when(F.col("nth") == 1, F.col("label")).otherwise(F.concat_ws("_", "label", "a_column"))
    meaningful = _suggestion(named, name, "ratio", _both("%s / NULLIF(%s, 0)"),
                             (F.col("a_confidence") + F.col("b_confidence")) / 2)
    ranked = quantities.withColumn("pos", F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(F.desc("confidence"), "position")))
    fallback = _first(_crossed(ranked, ranked).where("a_pos < b_pos").orderBy("a_pos", "b_pos"), top)
    fallback = _suggestion(fallback, _both("ratio_%s_per_%s"), "ratio", _both("%s / NULLIF(%s, 0)"),
                           (F.col("a_confidence") + F.col("b_confidence")) / 2 * 0.7)
    both = meaningful.withColumn("tier", F.lit(1)).unionByName(fallback.withColumn("tier", F.lit(2)))
    return (both.withColumn("best", F.min("tier").over(Window.partitionBy(F.lit(1))))
            .where("tier = best").select(*SUGGESTION))


def suggest_datetime(verdicts: DataFrame) -> DataFrame:
    """year and month of every date column."""
    dates = _of(verdicts, "date").select("position", "column", F.explode(F.array(F.lit("year"), F.lit("month"))).alias("part"))
    return _suggestion(dates, F.concat_ws("_", "column", "part"), "derived_feature",
                       F.format_string("%s(%s)", "part", "column"), F.lit(0.9), sources=F.col("column"))


def suggest_features(df: DataFrame) -> DataFrame:
    """F1-F5 on one table; the verdicts are computed once."""
    verdicts = S.best_semantic(df).persist()
    rules = (suggest_revenue, suggest_margin, suggest_discount, suggest_ratio, suggest_datetime)
    return reduce(DataFrame.unionByName, [rule(verdicts) for rule in rules])


def _pair(df: DataFrame, sources) -> tuple[Column, Column]:
    return X.loose_double(df, sources[0]), X.loose_double(df, sources[1])


def derive_revenue(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """a x b"""
    x, y = _pair(df, (a, b))
    return df.withColumn(name, x * y)


def derive_margin(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """a - b"""
    x, y = _pair(df, (a, b))
    return df.withColumn(name, x - y)


def derive_margin_pct(df: DataFrame, name: str, sell: str, cost: str) -> DataFrame:
    """F8: (sell - cost) / sell x 100, null for a zero price"""
    x, y = _pair(df, (sell, cost))
    return df.withColumn(name, X.div(x - y, x) * 100)


def derive_ratio(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """a / b, null for a zero denominator"""
    x, y = _pair(df, (a, b))
    return df.withColumn(name, X.div(x, y))


def derive_discount(df: DataFrame, name: str, price: str, discount: str) -> DataFrame:
    """price after discount; the discount is a fraction if its maximum is at most 1, else percent.

    The maximum is one scalar (a scalar subquery in the plan, computed from one pruned column).
    """
    x, y = _pair(df, (price, discount))
    top = df.select(y.alias("d")).agg(F.max("d").alias("d"))
    fraction = F.coalesce(top.scalar() <= 1.0, F.lit(False))
    return df.withColumn(name, F.when(fraction, x * (1 - y)).otherwise(x * (1 - y / 100)))


def derive_year(df: DataFrame, name: str, source: str) -> DataFrame:
    """F11"""
    return df.withColumn(name, F.year(X.timestamp(df, source)))


def derive_month(df: DataFrame, name: str, source: str) -> DataFrame:
    """F11"""
    return df.withColumn(name, F.month(X.timestamp(df, source)))


CALENDAR = re.compile(r"\s*(year|month)\s*\(\s*(.+?)\s*\)\s*", re.IGNORECASE)
TWO_COLUMN = {"revenue": derive_revenue, "margin": derive_margin, "margin_pct": derive_margin_pct,
              "ratio": derive_ratio, "discount": derive_discount}


def _problem(df: DataFrame, f: AcceptedFeature) -> str | None:
    if not f.name or not f.formula:
        return "name or formula missing"
    if any(c not in df.columns for c in f.source_columns):
        return "source columns not in the table"
    return None


def apply_feature(df: DataFrame, f: AcceptedFeature) -> DataFrame:
    if _problem(df, f):
        return df
    if f.type in TWO_COLUMN and len(f.source_columns) == 2:
        return TWO_COLUMN[f.type](df, f.name, *f.source_columns)
    if f.type == "derived_feature":
        calendar = CALENDAR.fullmatch(f.formula)
        if calendar and calendar[2] in df.columns:
            derive = derive_year if calendar[1].lower() == "year" else derive_month
            return derive(df, f.name, calendar[2])
    return df


def apply_features(df: DataFrame, accepted: list[AcceptedFeature]) -> tuple[DataFrame, DataFrame]:
    """(table with the derived columns, warnings); a feature may use an earlier one."""
    warnings = []
    for f in accepted:
        reason = _problem(df, f)
        if reason:
            warnings.append((f.name or "unknown", reason))
        df = apply_feature(df, f)
    return df, X.lit_rows(df, warnings, "feature string, reason string")
