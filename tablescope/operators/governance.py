"""Quality score, privacy, fairness and preparation advice.

Everything after the first scans works on column metadata: one row per column of the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.context import AcceptedFeature
from tablescope.functions import expr as X
from tablescope.functions import keywords as K
from tablescope.operators import overview as O
from tablescope.operators import quality as Q
from tablescope.operators import semantic as S
from tablescope.operators import univariate as U
from tablescope.plans import blocks as B
from tablescope.sources.files import bytes_of

# Weights (percent), benchmarks and the limits of "ok" and "warning".
DIMENSIONS = (
    ("Completeness", 25, ">95", 95, 85), ("Uniqueness", 20, ">99", 99, 95), ("Validity", 20, ">90", 90, 80),
    ("Consistency", 15, ">85", 85, 70), ("Accuracy", 10, ">85", 85, 75), ("Timeliness", 10, ">90", 90, 80),
)
# Points and limits of the score and the advice.
CONSTANT_PENALTY, MAX_PENALTY, ACCURACY_GAP, TIMELY, UNTIMELY = 4.0, 30.0, 2.0, 92.0, 70.0
HIGH_BAND, MEDIUM_BAND, READY_SCORE = 85, 70, 80
NAME_CONFIDENCE, EMAIL_CONFIDENCE, PHONE_CONFIDENCE, PII_SHARE, PII_MIN = 96.0, 90.0, 82.0, 0.25, 2
PSEUDONYMIZE = ("email", "phone", "financial", "government_id")
MANY_LEVELS, MANY_OUTLIERS, SEGMENT_MISSING = 20, 5, 20
FAIR_GROUP, FAIR_ROWS, FAIR_CLASSES = 10, 20, 6
SPLIT = (70, 15, 15)


def _pct_missing() -> Column:
    return X.pct2(F.col("n_null"), F.col("n_rows"))


def _near_constant() -> Column:
    valid = F.col("n_rows") - F.col("n_null")
    return (F.col("n_distinct") == 1) | ((F.col("n_distinct") == 2) & (X.pct2(F.col("top_n"), valid) >= Q.QUASI_CONSTANT))


def _dimension_scores(df: DataFrame, typed: DataFrame, patterns: DataFrame | None) -> DataFrame:
    """One row with the six unrounded scores."""
    t = F.col("semantic_type")
    numeric = t.startswith("numeric")
    cols = typed.agg(
        X.pct2(F.sum("n_null"), F.sum("n_rows")).alias("missing"), X.count_if(_near_constant()).alias("constant"),
        X.pct(F.sum(F.when(numeric, F.col("n_nan"))), F.sum(F.when(numeric, F.col("n_rows")))).alias("invalid"),
        F.max((t == "datetime").cast("int")).alias("dated"))
    dup = Q.duplicate_rows(df, patterns).select("pct_duplicate_rows").scalar()
    c, u = 100.0 - F.col("missing"), 100.0 - dup
    return cols.select(
        c.alias("Completeness"), u.alias("Uniqueness"), F.greatest(F.lit(0.0), 100.0 - F.col("invalid")).alias("Validity"),
        (100.0 - F.least(F.col("constant") * CONSTANT_PENALTY, F.lit(MAX_PENALTY))).alias("Consistency"),
        F.greatest(F.lit(0.0), F.least(c, u) - ACCURACY_GAP).alias("Accuracy"),
        F.when(F.col("dated") == 1, TIMELY).otherwise(UNTIMELY).alias("Timeliness"))


def quality_dimensions(df: DataFrame, overrides: dict | None = None, typed: DataFrame | None = None,
                       patterns: DataFrame | None = None) -> DataFrame:
    """G1"""
    one = _dimension_scores(df, S.typed(df, overrides, typed), patterns)
    return one.select(X.rows(*[F.struct(
        F.lit(i).alias("position"), F.lit(name).alias("dimension"), F.lit(w).alias("weight"), F.round(F.col(name), 2).alias("score"),
        F.lit(bench).alias("benchmark"),
        F.when(F.col(name) >= ok, "ok").when(F.col(name) >= warn, "warning").otherwise("critical").alias("status"))
        for i, (name, w, bench, ok, warn) in enumerate(DIMENSIONS)]))


def quality_score(df: DataFrame, overrides: dict | None = None, typed: DataFrame | None = None,
                  patterns: DataFrame | None = None) -> DataFrame:
    """G2"""
    one = _dimension_scores(df, S.typed(df, overrides, typed), patterns)
    total = reduce(lambda a, b: a + b, [F.col(name) * (w / 100) for name, w, *_ in DIMENSIONS])
    one = one.select(total.alias("total"))
    band = F.when(F.col("total") >= HIGH_BAND, "high").when(F.col("total") >= MEDIUM_BAND, "medium").otherwise("low")
    return one.select(F.round("total", 2).alias("total_score"), band.alias("quality_band"))


def _named(column: str, words: dict) -> tuple[str, str] | None:
    return next(((w, words[w]) for w in words if w in column.lower()), None)


PII_SCHEMA = "position int, column string, pii_type string, confidence double, reason string, action string, n_valid bigint"


def _pii_action(pii_type: Column) -> Column:
    return F.when(pii_type.isin(*PSEUDONYMIZE), "pseudonymize").otherwise("review")


def _pii_rows(stats: DataFrame) -> DataFrame:
    return stats.select("position", "column", "pii_type", F.col("confidence").cast("double").alias("confidence"), "reason",
                        _pii_action(F.col("pii_type")).alias("action"), "n_valid")


def pii_by_name(df: DataFrame) -> DataFrame:
    """The first listed word that the column name contains decides; with the values exposed."""
    hits = {c: _named(c, K.PII) for c in df.columns}
    hits = {c: h for c, h in hits.items() if h}
    if not hits:
        return X.lit_rows(df, [], PII_SCHEMA)
    stats = B.wide(df, {c: {"pii_type": F.lit(kind), "confidence": F.lit(NAME_CONFIDENCE), "reason": F.lit(f"keyword:{word}"),
                            "n_valid": F.count(X.ref(c)), "at": F.lit(df.columns.index(c))} for c, (word, kind) in hits.items()})
    return _pii_rows(stats.drop("position").withColumnRenamed("at", "position"))


def pii_by_pattern(df: DataFrame) -> DataFrame:
    """Strings not caught by name whose values look like e-mail addresses or phone numbers, over all rows."""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not _named(f.name, K.PII)]
    if not columns:
        return X.lit_rows(df, [], PII_SCHEMA)
    metrics = {}
    for c in columns:
        v = X.strip(X.ref(c))
        metrics[c] = {"n_valid": F.count(X.ref(c)), "emails": X.count_if(v.rlike(K.EMAIL_PATTERN)),
                      "phones": X.count_if(v.rlike(K.PHONE_PATTERN)), "at": F.lit(df.columns.index(c))}
    limit = F.greatest(F.lit(PII_MIN), F.col("n_valid") * PII_SHARE)
    kind = F.when(F.col("emails") >= limit, "email").when(F.col("phones") >= limit, "phone")
    s = B.wide(df, metrics).drop("position").withColumnRenamed("at", "position").withColumn("pii_type", kind).where("pii_type is not null")
    s = s.withColumn("confidence", F.when(F.col("pii_type") == "email", EMAIL_CONFIDENCE).otherwise(PHONE_CONFIDENCE))
    return _pii_rows(s.withColumn("reason", F.concat(F.lit("pattern:"), "pii_type")))


def pii_candidates(df: DataFrame) -> DataFrame:
    """G3 and G4 together, in column order."""
    return pii_by_name(df).unionByName(pii_by_pattern(df)).orderBy("position")


def profile_stats(df: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Typed column statistics with sizes: what all metadata operators here accept as ``typed``."""
    return S.typed_stats(df, overrides, extra=lambda c: {"n_bytes": bytes_of(df, c)})


def column_schema_profile(df: DataFrame, overrides: dict | None = None, typed: DataFrame | None = None,
                          pii: DataFrame | None = None) -> DataFrame:
    """G5; ``typed`` is a result of ``profile_stats``."""
    typed = profile_stats(df, overrides) if typed is None else typed
    pii = (pii_candidates(df) if pii is None else pii).select("column", "pii_type")
    t = F.col("semantic_type")
    status = (F.when(F.col("pct_missing") >= 40, "critical").when(F.col("pct_missing") >= 10, "warning")
              .when(t == "id", "attention").otherwise("ready"))
    sure = F.when(t.isin("id", "datetime", "boolean"), 98).otherwise(88)
    return (typed.withColumn("pct_missing", _pct_missing()).join(pii, "column", "left").select(
        (F.col("position") + 1).alias("index"), "column", "dtype", "semantic_type", "n_distinct",
        X.pct2(F.col("n_distinct"), F.col("n_rows")).alias("uniqueness_pct"), "pct_missing", "n_bytes",
        O.column_role(t).alias("role"), status.alias("status"), "pii_type",
        F.when(F.col("pii_type").isNotNull(), F.greatest(sure, F.lit(95))).otherwise(sure).alias("confidence"),
        F.when(F.col("pii_type").isNotNull(), F.concat(F.lit("pii:"), "pii_type"))
        .when(t.isin("id", "geographic"), "name-based").otherwise("dtype-profile").alias("pattern")))


def semantic_summary(df: DataFrame, overrides: dict | None = None, typed: DataFrame | None = None) -> DataFrame:
    """G6"""
    typed = S.typed(df, overrides, typed)
    names = F.transform(F.sort_array(F.collect_list(F.struct("position", "column"))), lambda s: s["column"])
    return typed.groupBy("semantic_type").agg(
        F.count(F.lit(1)).alias("n_columns"), F.array_join(F.slice(names, 1, 3), ", ").alias("examples")).withColumn(
        "pct", X.pct2(F.col("n_columns"), F.lit(len(df.columns))))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Counts per class with the imbalance of the whole target."""
    counts = df.select(X.text(df, target).alias("class")).dropna().groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.min("n").alias("last"), F.count(F.lit(1)).alias("k"))
    ratio = F.when(F.col("k") > 1, F.round(F.col("top") / F.col("last"), 2))
    one = one.select("total", ratio.alias("imbalance_ratio")).withColumn(
        "severity", F.when(F.col("imbalance_ratio") >= 10, "critical").when(F.col("imbalance_ratio") >= 3, "warning").otherwise("ok"))
    # One row, joined on a constant key.
    joined = counts.withColumn("key", F.lit(1)).join(F.broadcast(one.withColumn("key", F.lit(1))), "key")
    return joined.select("class", "n", X.pct2(F.col("n"), F.col("total")).alias("pct"), "imbalance_ratio", "severity")


def leakage_risks(df: DataFrame, target: str, overrides: dict | None = None, typed: DataFrame | None = None) -> DataFrame:
    """From the types and names of the columns."""
    typed = S.typed(df, overrides, typed)
    name, t = F.lower("column"), F.col("semantic_type")
    late = reduce(lambda a, b: a | b, [name.contains(w) for w in K.POST_EVENT])
    risk = (F.when(t == "id", "identifier_leakage").when((t == "datetime") & late, "post_event_timestamp")
            .when(name.contains(target.lower()) & (name != target.lower()), "target_like_proxy"))
    rows = typed.where(F.col("column") != target).withColumn("risk", risk).where("risk is not null")
    proxy = F.col("risk") == "target_like_proxy"
    return rows.select(
        "position", "column", "risk", F.when(proxy, "medium").otherwise("high").alias("severity"),
        F.when(F.col("risk") == "identifier_leakage", "exclude from modeling")
        .when(proxy, "manual review").otherwise("review timeline before training").alias("action"))


def _positive_class(df: DataFrame, target: str) -> str | None:
    """Positive class of a target with 2 to 6 values, else None (at most seven values are fetched)."""
    values = [r[0] for r in df.select(X.text(df, target).alias("v")).dropna().distinct().orderBy("v").limit(FAIR_CLASSES + 1).collect()]
    if not 2 <= len(values) <= FAIR_CLASSES:
        return None
    return next((v for v in values if v.strip().lower() in K.POSITIVE_CLASS), values[-1])


FAIR_SCHEMA = "attribute string, attribute_type string, positive_class string, grp string, n bigint, positive_rate double"


def fairness_groups(df: DataFrame, target: str) -> DataFrame:
    """Positive rate per group of every protected column; ages in four bands.

    A null or unreadable age belongs to no band. The first eight groups by name count, those with
    fewer than ten rows are left out.
    """
    positive = _positive_class(df, target)
    protected = {c: _named(c, K.PROTECTED) for c in df.columns}
    protected = {c: h[1] for c, h in protected.items() if h}
    if positive is None or not protected:
        return X.lit_rows(df, [], FAIR_SCHEMA)

    def group(c, kind):
        if kind != "age":
            return X.text(df, c)
        x = X.double(df, c)
        return F.when(x < 25, "<25").when(x < 45, "25-44").when(x < 65, "45-64").when(x >= 65, "65+")
    hit = (X.text(df, target) == positive).cast("int")
    long = df.where(X.ref(target).isNotNull()).select(X.rows(*[
        F.struct(F.lit(c).alias("attribute"), F.lit(k).alias("attribute_type"), group(c, k).alias("grp"), hit.alias("hit"))
        for c, k in protected.items()])).where(F.col("grp").isNotNull())
    g = long.groupBy("attribute", "attribute_type", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    rows = g.groupBy("attribute").agg(F.sum("n").alias("total")).where(F.col("total") >= FAIR_ROWS)
    return (g.join(rows, "attribute").where(F.col("n") >= FAIR_GROUP)
            .select("attribute", "attribute_type", F.lit(positive).alias("positive_class"), "grp", "n",
                    X.pct2(F.col("hits"), F.col("n")).alias("positive_rate")))


def fairness(df: DataFrame, target: str) -> DataFrame:
    """Disparate impact per protected column."""
    di = F.round(F.col("low") / F.greatest(F.col("high"), F.lit(1e-6)), 3)
    return (fairness_groups(df, target).groupBy("attribute", "attribute_type", "positive_class")
            .agg(F.count(F.lit(1)).alias("n_groups"), F.min("positive_rate").alias("low"), F.max("positive_rate").alias("high"))
            .where("n_groups >= 2").withColumn("disparate_impact", di)
            .withColumn("severity", F.when(F.col("disparate_impact") >= 0.8, "ok").when(F.col("disparate_impact") >= 0.6, "warning").otherwise("critical"))
            .drop("low", "high"))


def encoding_advice(df: DataFrame, overrides: dict | None = None, typed: DataFrame | None = None) -> DataFrame:
    """G10"""
    t = F.col("semantic_type")
    strategy = (F.when((t == "categorical_nominal") & (F.col("n_distinct") > MANY_LEVELS), "target_or_frequency")
                .when(t == "categorical_nominal", "one_hot").when(t == "categorical_ordinal", "ordinal").when(t == "boolean", "binary"))
    return (S.typed(df, overrides, typed).withColumn("strategy", strategy).where("strategy is not null")
            .select("column", "strategy", _pct_missing().alias("pct_missing")))


def scaling_advice(df: DataFrame, overrides: dict | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """G11"""
    groups = S.group_map(types or S.type_map(df, overrides))
    parts = []
    if groups["numeric_continuous"]:
        o = U.iqr_outliers(df, groups["numeric_continuous"])
        parts.append(o.select("column", F.when(F.col("pct_outliers") > MANY_OUTLIERS, "robust").otherwise("standard").alias("strategy"), "pct_outliers"))
    if groups["numeric_discrete"]:
        parts.append(B.wide(df, {c: {"n": F.count(X.ref(c))} for c in groups["numeric_discrete"]}).select(
            "column", F.lit("optional").alias("strategy"), F.lit(None).cast("double").alias("pct_outliers")))
    return reduce(DataFrame.unionByName, parts, X.lit_rows(df, [], "column string, strategy string, pct_outliers double"))


def imputation_advice(df: DataFrame, overrides: dict | None = None, typed: DataFrame | None = None) -> DataFrame:
    """G12"""
    t, p = F.col("semantic_type"), F.col("pct_missing")
    strategy = (F.when(t.startswith("numeric") & (p < SEGMENT_MISSING), "median").when(t.startswith("numeric"), "segment_median_or_drop")
                .when(t.startswith("categorical") | (t == "boolean"), "most_frequent_or_bucket")
                .when(t == "datetime", "calendar_aware_or_flag").otherwise("explicit_token_or_review"))
    return (S.typed(df, overrides, typed).where("n_null > 0").withColumn("pct_missing", _pct_missing())
            .select("column", "pct_missing", Q.severity(p).alias("severity"), strategy.alias("strategy")))


def split_advice(df: DataFrame, problem_type: str | None = None, overrides: dict | None = None,
                 typed: DataFrame | None = None) -> DataFrame:
    """The recommended split."""
    dated = F.max((F.col("semantic_type") == "datetime").cast("int")) == 1
    other = "stratified" if problem_type == "classification" else "random"
    return S.typed(df, overrides, typed).agg(F.when(dated, "time").otherwise(other).alias("recommended")).select(
        "recommended", *[F.lit(v).alias(n) for n, v in zip(("train_pct", "validation_pct", "test_pct"), SPLIT)])


def split_by_time(df: DataFrame, column: str) -> DataFrame:
    """G13 carried out in time order: the cuts are two exact order statistics, so nothing is sorted globally
    and equal timestamps stay together."""
    micros = F.unix_micros(X.timestamp(df, column).cast("timestamp")).cast("double")
    long = df.select(F.lit("t").alias("key"), micros.alias("t"))
    cuts = B.quantiles(long, ["key"], "t", {"a": SPLIT[0] / 100, "b": (SPLIT[0] + SPLIT[1]) / 100}, nearest=True)
    a, b = cuts.select("a").scalar(), cuts.select("b").scalar()
    return df.where(X.ref(column).isNotNull()).withColumn(
        "split", F.when(micros <= a, "train").when(micros <= b, "validation").otherwise("test"))


def _part_sizes(n: Column) -> tuple[Column, Column]:
    """Rows of a stratum of ``n`` that go to validation and to test, half up; three rows or more meet all parts."""
    share = [F.floor(n * F.lit(p) / 100 + 0.5) for p in SPLIT[1:]]
    return F.when(n >= 3, F.greatest(F.lit(1), share[0])).otherwise(0), F.when(n >= 2, F.greatest(F.lit(1), share[1])).otherwise(0)


def train_valid_test_split(df: DataFrame, key: list[str], stratum: str | None = None, seed: int = 42) -> DataFrame:
    """G13 without a time column: by a seeded hash of the row key.

    Without ``stratum`` the hash alone decides: no shuffle at all, and a row keeps its split when the table grows. With it
    every stratum (nulls are one) is cut at exact ranks of the hash, so each part holds its share of each stratum to the
    row. Hashes are counted first and ranked in one global order; no stratum has to fit into one task. Rows with equal keys
    stay together.
    """
    h = F.xxhash64(F.lit(seed), *[X.ref(c) for c in key])
    if stratum is None:
        place = F.pmod(h, F.lit(100))
        return df.withColumn("split", F.when(place < SPLIT[0], "train").when(place < SPLIT[0] + SPLIT[1], "validation").otherwise("test"))
    group = F.coalesce(F.concat(F.lit("="), X.text(df, stratum)), F.lit("null"))
    counts = df.select(group.alias("_g"), h.alias("_h")).groupBy("_g", "_h").agg(F.count(F.lit(1)).alias("n"))
    placed = B.ordered(counts, ["_g"], ["_h"], weight="n")
    valid, test = _part_sizes(F.col("_total"))
    train = F.col("_total") - valid - test
    cuts = placed.groupBy("_g").agg(F.max(F.when(F.col("_before") < train, F.col("_h"))).alias("_train"),
                                    F.max(F.when(F.col("_before") < train + valid, F.col("_h"))).alias("_valid"))
    rows = df.withColumn("_g", group).withColumn("_h", h).join(cuts, "_g")
    split = F.when(F.col("_h") <= F.col("_train"), "train").when(F.col("_h") <= F.col("_valid"), "validation").otherwise("test")
    return rows.select(*[X.ref(c) for c in df.columns], split.alias("split"))


def feature_advice(df: DataFrame, accepted: list[AcceptedFeature] = (), overrides: dict | None = None,
                   typed: DataFrame | None = None) -> DataFrame:
    """Accepted features, plus a calendar decomposition per datetime column."""
    rows = [(f.name, ", ".join(f.source_columns), f.formula or f.type or "derived", f.status or "accepted") for f in accepted if f.name]
    taken = X.lit_rows(df, rows, "feature string, source_columns string, formula string, status string")
    dates = S.typed(df, overrides, typed).where("semantic_type = 'datetime'")
    return taken.unionByName(dates.select(F.concat("column", F.lit("_year/month")).alias("feature"), F.col("column").alias("source_columns"),
                                          F.lit("calendar decomposition").alias("formula"), F.lit("recommended").alias("status")))


def analysis_applicability(df: DataFrame, overrides: dict | None = None, typed: DataFrame | None = None) -> DataFrame:
    """G15"""
    t = F.col("semantic_type")

    def has(cond):
        return F.coalesce(F.max(cond.cast("int")), F.lit(0)) == 1
    one = S.typed(df, overrides, typed).agg(has(t == "datetime").alias("d"), has(t == "id").alias("i"),
                                              has(t == "boolean").alias("b"), has(t.startswith("numeric")).alias("n"))
    d = F.col("d")
    return one.select(X.rows(*[F.struct(F.lit(a).alias("analysis"), cond.alias("applicable")) for a, cond in (
        ("cohort", d & F.col("i")), ("survival", d & F.col("b")), ("time_decomposition", d & F.col("n")))]))


def _owner(issue: Column) -> Column:
    name = F.lower(issue)
    return (F.when(name.contains("missing"), "Data Engineer").when(name.contains("leakage"), "ML Lead")
            .when(name.contains("privacy") | name.contains("pii"), "Privacy Officer")
            .when(name.contains("imbalance"), "Data Scientist").otherwise("Analytics Lead"))


def _alerts(df: DataFrame, target: str | None, typed: DataFrame, pii: DataFrame) -> DataFrame:
    tiers = []

    def tier(rows, severity, issue, column, action):
        tiers.append(rows.select(F.lit(len(tiers)).alias("tier"), F.col("at").cast("bigint").alias("at"), severity.alias("severity"),
                                 issue.alias("issue"), column.alias("columns"), action.alias("action")))
    top = Window.partitionBy(F.lit(1)).orderBy(F.desc("pct_missing"), "position")
    missing = (typed.withColumn("pct_missing", _pct_missing()).withColumn("at", F.row_number().over(top))
               .where(F.col("pct_missing") >= 10))
    tier(missing, F.when(F.col("pct_missing") >= 30, "critical").otherwise("high"), F.lit("high_missing"), F.col("column"), F.lit("impute or exclude"))
    if target is not None:
        tier(leakage_risks(df, target, typed=typed).withColumn("at", F.col("position")), F.col("severity"), F.col("risk"), F.col("column"), F.col("action"))
        balance = class_balance(df, target).groupBy("severity").agg(F.lit(0).alias("at")).where("severity <> 'ok'")
        tier(balance, F.col("severity"), F.lit("class_imbalance"), F.lit(target), F.lit("stratified split, reweighting or resampling"))
    first = Window.partitionBy(F.lit(1)).orderBy("position")
    tier(pii.withColumn("at", F.row_number().over(first)), F.lit("high"),
         F.concat(F.lit("pii_"), F.col("pii_type")), F.col("column"), F.col("action"))
    every = reduce(DataFrame.unionByName, tiers)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("tier", "at"))
    return (every.withColumn("rank", place)
            .select("rank", "severity", "issue", "columns", "action", _owner(F.col("issue")).alias("owner")))


def critical_alerts(df: DataFrame, target: str | None = None, overrides: dict | None = None,
                    typed: DataFrame | None = None, pii: DataFrame | None = None) -> DataFrame:
    """All alerts in order: missing values, leakage, imbalance, personal data."""
    return _alerts(df, target, S.typed(df, overrides, typed), pii_candidates(df) if pii is None else pii)


def executive_metrics(df: DataFrame, overrides: dict | None = None, typed: DataFrame | None = None,
                      patterns: DataFrame | None = None) -> DataFrame:
    """The score and five of its dimensions."""
    typed = S.typed(df, overrides, typed)
    d = quality_dimensions(df, typed=typed, patterns=patterns).where("dimension <> 'Accuracy'").select(
        (F.col("position") + 1).alias("position"), F.col("dimension").alias("metric"), F.col("score").alias("value"), "benchmark", "status")
    s = quality_score(df, typed=typed, patterns=patterns).select(
        F.lit(0).alias("position"), F.lit("Data Quality Score").alias("metric"), F.col("total_score").alias("value"), F.lit(">80").alias("benchmark"),
        F.when(F.col("total_score") >= READY_SCORE, "ok").otherwise("warning").alias("status"))
    return s.unionByName(d)


def decision_matrix(df: DataFrame, target: str | None = None, overrides: dict | None = None, typed: DataFrame | None = None,
                    patterns: DataFrame | None = None, pii: DataFrame | None = None) -> DataFrame:
    """Three decisions with status, evidence and confidence; readiness needs a score of 80 and no high leakage."""
    typed = S.typed(df, overrides, typed)
    pii = pii_candidates(df) if pii is None else pii
    score = quality_score(df, typed=typed, patterns=patterns).select("total_score").scalar()
    leaks = (leakage_risks(df, target, typed=typed).where("severity = 'high'") if target is not None else typed.limit(0))
    n_leaks = leaks.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_pii = pii.agg(F.count(F.lit(1)).alias("n")).scalar()
    one = typed.agg(X.count_if(_pct_missing() > 0).alias("missing")).select(
        "missing", score.alias("score"), n_leaks.alias("leaks"), n_pii.alias("pii"))
    ready, gaps, private = (F.col("score") >= READY_SCORE) & (F.col("leaks") == 0), F.col("missing") > 0, F.col("pii") > 0

    def row(name, cond, yes, no, value, sure, unsure):
        return F.struct(F.lit(name).alias("decision"), F.when(cond, yes).otherwise(no).alias("status"),
                        value.cast("double").alias("evidence"), F.when(cond, sure).otherwise(unsure).alias("confidence"))
    return one.select(X.rows(row("proceed_with_modeling", ready, "yes", "pending", F.col("score"), 85, 62),
                             row("request_more_data", gaps, "pending", "no", F.col("missing"), 78, 40),
                             row("escalate_privacy", private, "pending", "no", F.col("pii"), 88, 25)))


def action_items(df: DataFrame, target: str | None = None, overrides: dict | None = None,
                 typed: DataFrame | None = None, pii: DataFrame | None = None) -> DataFrame:
    """The alerts as actions with owner and deadline."""
    return critical_alerts(df, target, overrides, typed, pii).select(
        F.col("rank").alias("priority"), F.col("issue").alias("title"), "owner",
        F.when(F.col("severity") == "critical", "immediate").otherwise(F.concat(F.lit("sprint "), F.col("rank").cast("string"))).alias("deadline"), "action")
