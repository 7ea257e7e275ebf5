"""Data quality and univariate statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.catalog.common import duck, per_column, query, table
from tablescope.catalog.typing import COLUMNS, quoted
from tablescope.functions import keywords as K
from tablescope.operators import quality as Q
from tablescope.operators import univariate as U
from tablescope.plans import blocks as B

OM = [c for c, _ in COLUMNS["orders_missing"]]
BAND = "CASE WHEN {p} = 0 THEN 'none' WHEN {p} <= 5 THEN 'low' WHEN {p} <= 20 THEN 'moderate' WHEN {p} <= 40 THEN 'high' ELSE 'critical' END"
MISSING = f"""SELECT *, {BAND.format(p='pct_missing')} AS severity FROM ({per_column(OM, '''SELECT {i} AS position, '{c}' AS "column",
    count(*) - count({c}) AS n_missing, (floor((2 * 10000 * ((count(*) - count({c}))) + (count(*))) / (2.0 * (count(*)))) / 100) AS pct_missing
    FROM ''' + duck('orders_missing'))})"""
NULLS = " + ".join(f"CAST({c} IS NULL AS INT)" for c in OM)


@query("missing_by_column", MISSING, "pct_missing")
def _(spark, sf):
    return Q.missing_by_column(table(spark, sf, "orders_missing"))


@query("missing_global", f"""SELECT count(*) AS n_rows, count(*) FILTER (k > 0) AS rows_with_missing, CAST(sum(k) AS BIGINT) AS missing_cells,
    (floor((2 * 10000 * (count(*) FILTER (k > 0)) + (count(*))) / (2.0 * (count(*)))) / 100) AS pct_rows, (floor((2 * 10000 * (sum(k)) + ((count(*) * 6))) / (2.0 * ((count(*) * 6)))) / 100) AS pct_cells
    FROM (SELECT {NULLS} AS k FROM {duck('orders_missing')})""", "pct_rows pct_cells")
def _(spark, sf):
    return Q.missing_global(table(spark, sf, "orders_missing"))


@query("missing_per_row", f"""SELECT count(*) AS n_rows, avg(k) AS mean_null, quantile_cont(k, 0.5) AS median_null
    FROM (SELECT {NULLS} AS k FROM {duck('orders_missing')})""", "mean_null median_null")
def _(spark, sf):
    return Q.missing_per_row(table(spark, sf, "orders_missing"))


@query("missing_per_row_distribution", f"SELECT CAST({NULLS} AS BIGINT) AS n_null, count(*) AS n FROM {duck('orders_missing')} GROUP BY 1")
def _(spark, sf):
    return Q.missing_per_row_distribution(table(spark, sf, "orders_missing"))


WITH_NULLS = ["o_orderdate", "o_orderpriority", "o_totalprice"]


@query("missing_heatmap", f"""WITH e AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders),
    b AS (SELECT least(floor(CAST(o_orderkey - lo AS DOUBLE) / (hi - lo) * 50), 49) AS block, t.* FROM {duck('orders_missing')} t, e)
    {per_column(WITH_NULLS, '''SELECT CAST(block AS BIGINT) AS block, count(*) AS n, '{c}' AS "column",
    avg(CAST({c} IS NULL AS INT)) AS null_share FROM b GROUP BY block''')}""", "null_share")
def _(spark, sf):
    return Q.missing_heatmap(table(spark, sf, "orders_missing"), "o_orderkey")


PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, count(*) AS n, count(*) FILTER ({a} IS NULL) AS n_a, count(*) FILTER ({b} IS NULL) AS n_b,"
    f" count(*) FILTER ({a} IS NULL AND {b} IS NULL) AS n_both FROM {duck('orders_missing')}" for a in WITH_NULLS for b in WITH_NULLS)


@query("missing_cooccurrence", PAIRS)
def _(spark, sf):
    return Q.missing_cooccurrence(table(spark, sf, "orders_missing"))


@query("missing_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr(CAST({a} IS NULL AS INT), CAST({b} IS NULL AS INT)) AS value FROM {duck('orders_missing')}"
    for a in WITH_NULLS for b in WITH_NULLS), "value")
def _(spark, sf):
    return Q.missing_correlation(table(spark, sf, "orders_missing"))


@query("missing_clusters")
def _(spark, sf):
    return Q.missing_clusters(table(spark, sf, "orders_missing"))


@query("duplicate_rows", f"""SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_duplicate_rows,
    CAST(sum(n - 1) AS BIGINT) AS n_removed_by_dedup, CAST(coalesce(sum(n) FILTER (n = 1), 0) AS BIGINT) AS n_unique_rows,
    (floor((2 * 10000 * (coalesce(sum(n) FILTER (n > 1), 0)) + (sum(n))) / (2.0 * (sum(n)))) / 100) AS pct_duplicate_rows
    FROM (SELECT count(*) AS n FROM {duck('orders_dup')} GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"),
       "pct_duplicate_rows")
def _(spark, sf):
    return Q.duplicate_rows(table(spark, sf, "orders_dup"))


@query("duplicate_documents", """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_duplicate_rows,
    CAST(sum(n - 1) AS BIGINT) AS n_removed_by_dedup, CAST(coalesce(sum(n) FILTER (n = 1), 0) AS BIGINT) AS n_unique_rows,
    (floor((2 * 10000 * (coalesce(sum(n) FILTER (n > 1), 0)) + (sum(n))) / (2.0 * (sum(n)))) / 100) AS pct_duplicate_rows
    FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)""", "pct_duplicate_rows")
def _(spark, sf):
    return Q.duplicate_rows(table(spark, sf, "documents").select("text", "lang"))


LC = [c for c, _ in COLUMNS["lineitem"]] + ["fixed", "quasi"]


def near_sql(name, cols):
    return f"""SELECT "column", n_distinct, dominant_pct, CASE WHEN n_distinct = 1 THEN 'constant' ELSE 'quasi_constant' END AS flag, only_value FROM (
      {per_column(cols, '''SELECT '{c}' AS "column", count(*) AS n_distinct, (floor((2 * 10000 * (max(n)) + (sum(n))) / (2.0 * (sum(n)))) / 100) AS dominant_pct, max(v) AS only_value
      FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM ''' + duck(name) + ''' WHERE {c} IS NOT NULL GROUP BY 1)''')})
      WHERE n_distinct = 1 OR (dominant_pct >= 99 AND n_distinct <= 2)"""


@query("near_constant", f"""SELECT "column", n_distinct, dominant_pct, flag FROM ({near_sql('lineitem_const', LC)})""", "dominant_pct")
def _(spark, sf):
    return Q.near_constant(table(spark, sf, "lineitem_const"))


@query("exclusion_candidates", f"""SELECT "column", flag AS reason, dominant_pct AS evidence_pct,
      CASE WHEN flag = 'constant' THEN only_value END AS only_value FROM ({near_sql('orders_missing', OM)}) UNION ALL
    SELECT "column", 'too_many_missing', round(n_missing * 100.0 / (SELECT count(*) FROM orders), 1), NULL FROM ({MISSING})
    WHERE n_missing * 100.0 / (SELECT count(*) FROM orders) > 60""", "evidence_pct")
def _(spark, sf):
    return Q.exclusion_candidates(table(spark, sf, "orders_missing"))


TOKENS = quoted(K.MASKED_MISSING)


def masked_sql(name, cols):
    return f"""SELECT *, {BAND.format(p='pct')} AS severity FROM ({per_column(cols, '''SELECT '{c}' AS "column", count(*) AS n,
      string_agg(DISTINCT lower(trim({c})), '|' ORDER BY lower(trim({c}))) AS tokens,
      string_agg(DISTINCT {c}, '|' ORDER BY {c}) AS examples,
      (floor((2 * 10000 * (count(*)) + ((SELECT count(*) FROM ''' + duck(name) + '''))) / (2.0 * ((SELECT count(*) FROM ''' + duck(name) + ''')))) / 100) AS pct
      FROM ''' + duck(name) + ''' WHERE lower(trim({c})) IN (''' + TOKENS + ''')''')}) WHERE n > 0"""


def space_sql(name, cols):
    return f"""SELECT *, {BAND.format(p='pct')} AS severity FROM ({per_column(cols, '''SELECT '{c}' AS "column", count(*) AS n,
      string_agg('[' || {c} || ']->[' || trim({c}) || ']', '|' ORDER BY {c}) FILTER (k <= 5) AS examples,
      (floor((2 * 10000 * (count(*)) + ((SELECT count(*) FROM ''' + duck(name) + '''))) / (2.0 * ((SELECT count(*) FROM ''' + duck(name) + ''')))) / 100) AS pct
      FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS k FROM ''' + duck(name) + '''
        WHERE {c} <> trim({c}) AND lower(trim({c})) NOT IN (''' + TOKENS + '''))''')}) WHERE n > 0"""


@query("masked_missing", masked_sql("customer_dirty", ["c_name", "c_mktsegment"]), "pct")
def _(spark, sf):
    return Q.masked_missing(table(spark, sf, "customer_dirty"))


@query("whitespace_issues", space_sql("customer_dirty", ["c_name", "c_mktsegment"]), "pct")
def _(spark, sf):
    return Q.whitespace_issues(table(spark, sf, "customer_dirty"))


BOTH = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
OVERLAP = f"""WITH g AS (SELECT {', '.join(BOTH)}, count(*) AS n FROM {duck('orders_both')} GROUP BY {', '.join(BOTH)}),
    p AS (SELECT n, n > 1 AS d, ({' OR '.join(c + ' IS NULL' for c in BOTH)}) AS m FROM g)
    SELECT pattern, CAST(coalesce((SELECT sum(n) FROM p WHERE p.m = t.m AND p.d = t.d), 0) AS BIGINT) AS n,
      (floor((2 * 10000 * (coalesce((SELECT sum(n) FROM p WHERE p.m = t.m AND p.d = t.d), 0)) + ((SELECT sum(n) FROM p))) / (2.0 * ((SELECT sum(n) FROM p)))) / 100) AS pct
    FROM (VALUES ('only_missing', true, false), ('only_duplicate', false, true), ('missing_and_duplicate', true, true),
      ('none', false, false)) AS t(pattern, m, d)"""


@query("anomaly_overlap", OVERLAP, "pct")
def _(spark, sf):
    return Q.anomaly_overlap(table(spark, sf, "orders_both"))


ISSUE_SEVERITY = "CASE WHEN severity IN ('none', 'low') THEN 'low' WHEN severity IN ('high', 'critical') THEN 'high' ELSE 'medium' END"


def issues_sql(name, cols, strings):
    keys = ", ".join(cols)
    return f"""WITH base AS (SELECT * FROM {duck(name)}), g AS (SELECT {keys}, count(*) AS n FROM base GROUP BY {keys}),
     total AS (SELECT count(*) AS n FROM base), dup AS (SELECT sum(n) AS n, count(*) AS g FROM g WHERE n > 1),
     nulls AS ({per_column(cols, '''SELECT '{c}' AS "column", (count(*) - count({c})) * 100.0 / count(*) AS pct FROM base''')}),
     odd AS (SELECT sum(n) AS n FROM g WHERE n > 1 OR {' OR '.join(c + ' IS NULL' for c in cols)})
    SELECT 'duplicates:duplicate_rows:dataset' AS id, 'duplicates' AS module, 'duplicate_rows' AS issue, CAST(NULL AS VARCHAR) AS "column",
      CASE WHEN (floor((2 * 10000 * (dup.n) + (total.n)) / (2.0 * (total.n))) / 100) >= 5 THEN 'high' ELSE 'medium' END AS severity,
      CAST((floor((2 * 10000 * (dup.n) + (total.n)) / (2.0 * (total.n))) / 100) AS DOUBLE) AS value, 'drop_duplicate_rows' AS action, CAST(dup.n - dup.g AS BIGINT) AS impact
      FROM dup, total WHERE dup.n > 0 UNION ALL
    SELECT 'inconsistencies:candidate_exclusion:' || "column", 'inconsistencies', 'candidate_exclusion', "column", 'medium', dominant_pct,
      'exclude_column', 1 FROM ({near_sql(name, cols)}) UNION ALL
    SELECT 'inconsistencies:candidate_exclusion:' || "column", 'inconsistencies', 'candidate_exclusion', "column", 'high', round(pct, 1),
      'exclude_column', 1 FROM nulls WHERE pct > 60 UNION ALL
    SELECT 'text_cleaning:masked_missing_values:' || "column", 'text_cleaning', 'masked_missing_values', "column", {ISSUE_SEVERITY}, pct,
      'replace_values', n FROM ({masked_sql(name, strings)}) UNION ALL
    SELECT 'text_cleaning:leading_trailing_whitespace:' || "column", 'text_cleaning', 'leading_trailing_whitespace', "column",
      {ISSUE_SEVERITY}, pct, 'trim_whitespace', n FROM ({space_sql(name, strings)}) UNION ALL
    SELECT 'anomalies:anomaly_row_patterns:dataset', 'anomalies', 'anomaly_row_patterns', NULL, 'low', odd.n, 'review_only', 0
      FROM odd WHERE odd.n > 0"""


ISSUES = {"customer_dirty": issues_sql("customer_dirty", [c for c, _ in COLUMNS["customer_dirty"]], ["c_name", "c_mktsegment"]),
          "orders_missing": issues_sql("orders_missing", OM, ["o_orderstatus", "o_orderpriority"]),
          "orders_both": issues_sql("orders_both", BOTH, ["o_orderstatus"])}
for _t, _sql in ISSUES.items():
    @query(f"standardized_issues_{_t}", _sql, "value")
    def _(spark, sf, name=_t):
        return Q.standardized_issues(table(spark, sf, name))


@query("cleaning_summary", f"""SELECT count(*) AS issues_total, count(*) FILTER (action <> 'review_only') AS actionable_total,
    count(*) FILTER (action = 'review_only') AS review_only_total,
    string_agg(DISTINCT CASE WHEN action <> 'review_only' THEN "column" END, ', ') AS columns_impacted,
    count(*) FILTER (action <> 'review_only' AND "column" IS NULL) AS dataset_level_actions FROM ({ISSUES['customer_dirty']})""")
def _(spark, sf):
    return Q.cleaning_summary(table(spark, sf, "customer_dirty"))


@query("issues_by_severity", f"SELECT severity, count(*) AS n FROM ({ISSUES['orders_both']}) GROUP BY severity")
def _(spark, sf):
    return Q.issues_by_severity(table(spark, sf, "orders_both"))


# ── univariate ────────────────────────────────────────────────────────────────────────────────

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PCTS = {"p1": .01, "p5": .05, "q1": .25, "median": .5, "q3": .75, "p95": .95, "p99": .99}


def moments_sql(cols, t):
    return per_column(cols, """SELECT '{c}' AS "column", count({c}) AS n, avg({c}) AS m, stddev_pop({c}) AS sd,
      (avg({c}*{c}*{c}) - 3*avg({c})*avg({c}*{c}) + 2*avg({c})^3) / nullif(stddev_pop({c}),0)^3 AS skew,
      kurtosis_pop({c}) AS kurt FROM """ + t)


SUMMARY_D = "pct_missing mean median std cv min p1 p5 q1 q3 p95 p99 max iqr skewness kurtosis"


def summary_sql(cols, t):
    qs = ", ".join(f"quantile_cont({{c}}, {p}) AS {n}" for n, p in PCTS.items())
    return f"""SELECT s.*, m.skew AS skewness, m.kurt AS kurtosis FROM ({per_column(cols, '''SELECT '{c}' AS "column", count({c}) AS count,
      (floor((2 * 10000 * ((count(*) - count({c}))) + (count(*))) / (2.0 * (count(*)))) / 100) AS pct_missing, avg({c}) AS mean, stddev_pop({c}) AS std,
      stddev_pop({c}) / nullif(avg({c}), 0) AS cv, min({c}) AS min, max({c}) AS max,
      quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, ''' + qs + ' FROM ' + t)}) s JOIN ({moments_sql(cols, t)}) m USING ("column")"""


@query("numeric_summary", summary_sql(NUM, "lineitem"), SUMMARY_D)
def _(spark, sf):
    return U.numeric_summary(table(spark, sf, "lineitem"), NUM)


@query("numeric_summary_missing", summary_sql(["o_totalprice"], duck("orders_missing")), SUMMARY_D)
def _(spark, sf):
    return U.numeric_summary(table(spark, sf, "orders_missing"), ["o_totalprice"])


def fenced(cols, t):
    return per_column(cols, """SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS x, q1, median, q3, q1 - 1.5*(q3-q1) AS lo, q3 + 1.5*(q3-q1) AS hi
      FROM """ + t + """, (SELECT quantile_cont({c}, .25) AS q1, quantile_cont({c}, .5) AS median, quantile_cont({c}, .75) AS q3 FROM """ + t
                      + """) WHERE {c} IS NOT NULL""")


EV = ["value"]
OUT_SQL = """SELECT "column", count(*) AS n, count(*) FILTER (x < lo OR x > hi) AS n_outliers,
    (floor((2 * 10000 * (count(*) FILTER (x < lo OR x > hi)) + (count(*))) / (2.0 * (count(*)))) / 100) AS pct_outliers FROM ({f}) GROUP BY "column" """


@query("iqr_outliers", OUT_SQL.format(f=fenced(["value", "event_id"], "events")), "pct_outliers")
def _(spark, sf):
    return U.iqr_outliers(table(spark, sf, "events"), ["value", "event_id"])


@query("jarque_bera", f"""SELECT "column", n, n / 6.0 * (skew^2 + kurt^2 / 4) AS statistic, exp(-n / 12.0 * (skew^2 + kurt^2 / 4)) AS pvalue,
    exp(-n / 12.0 * (skew^2 + kurt^2 / 4)) > 0.05 AS normal FROM ({moments_sql(NUM, 'lineitem')})""", "statistic pvalue")
def _(spark, sf):
    return U.jarque_bera(table(spark, sf, "lineitem"), NUM)


@query("shapiro_wilk")
def _(spark, sf):
    li = table(spark, sf, "customer").select("c_mktsegment", F.col("c_acctbal").alias("x"))
    return U.shapiro_wilk(li, ["c_mktsegment"])


def hist_sql(source, bins):
    """``source`` yields ("column", x)."""
    return f"""WITH v AS ({source}), e AS (SELECT "column", {bins} AS bins,
      CASE WHEN min(x) = max(x) THEN min(x) - .5 ELSE min(x) END AS lo, CASE WHEN min(x) = max(x) THEN max(x) + .5 ELSE max(x) END AS hi
      FROM v GROUP BY 1), g AS (SELECT *, unnest(range(1, CAST(bins + 1 AS BIGINT))) AS bin FROM e),
      k AS (SELECT v."column", least(floor((x - lo) / (hi - lo) * bins), bins - 1) + 1 AS bin, count(*) AS n FROM v JOIN e USING ("column") GROUP BY 1, 2)
    SELECT g."column", g.bin, lo + (hi - lo) / bins * (g.bin - 1) AS x_left, lo + (hi - lo) / bins * g.bin AS x_right, coalesce(k.n, 0) AS n
    FROM g LEFT JOIN k ON g."column" = k."column" AND g.bin = k.bin"""


def long_sql(cols, t):
    return per_column(cols, """SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS x FROM """ + t + " WHERE {c} IS NOT NULL")


BINS = "least(50, greatest(10, floor(count(*) / 100)))"


@query("histogram", hist_sql(long_sql(["l_extendedprice", "l_quantity"], "lineitem"), BINS), "x_left x_right")
def _(spark, sf):
    return U.histogram(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])


@query("kde", f"""WITH v AS ({long_sql(['l_quantity', 'l_discount'], 'lineitem')}), w AS (SELECT "column", x, count(*) AS k FROM v GROUP BY 1, 2),
    e AS (SELECT "column", count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(*), -0.2) AS h, {BINS} AS bins FROM v GROUP BY 1),
    g AS (SELECT *, unnest(range(0, 240)) AS i FROM e)
    SELECT g."column", i, lo + (hi - lo) / 239 * i AS x,
      sum(k * exp(-pow((lo + (hi - lo) / 239 * i - w.x) / h, 2) / 2)) / (h * sqrt(2 * pi())) * ((hi - lo) / bins) AS y
    FROM g JOIN w ON g."column" = w."column" GROUP BY g."column", i, lo, hi, h, bins""", "x y")
def _(spark, sf):
    return U.kde(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])


@query("boxplot_stats", f"""SELECT "column", any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
    min(x) FILTER (x >= lo AND x <= hi) AS whisker_low, max(x) FILTER (x >= lo AND x <= hi) AS whisker_high, avg(x) AS mean,
    stddev_pop(x) AS std FROM ({fenced(['value'], 'events')}) GROUP BY 1""", "q1 median q3 whisker_low whisker_high mean std")
def _(spark, sf):
    return U.boxplot_stats(table(spark, sf, "events"), ["value"])


# Acklam's approximation again, for the twin of the probability plot.
A, Bq, Cq, D = (__import__("tablescope.functions.stats", fromlist=["x"]).__dict__[f"QUANTILE_{k}"] for k in "ABCD")


def _horner(coefs, x):
    out = str(coefs[0])
    for c in coefs[1:]:
        out = f"({out}) * {x} + ({c})"
    return f"({out})"


TAIL = f"{_horner(Cq, 'lq')} / ({_horner(D, 'lq')} * lq + 1)"
CENTRE = f"{_horner(A, 'r2')} * q / ({_horner(Bq, 'r2')} * r2 + 1)"
QQ_ROWS = f"""SELECT "column", i, n, x, CASE WHEN p < 0.02425 THEN {TAIL} WHEN p > 0.97575 THEN -({TAIL}) ELSE {CENTRE} END AS score FROM (
    SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS lq, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS r2 FROM (
    SELECT *, CASE WHEN i = n - 1 THEN pow(0.5, 1.0 / n) WHEN i = 0 THEN 1 - pow(0.5, 1.0 / n) ELSE (i + 1 - 0.3175) / (n + 0.365) END AS p FROM (
    SELECT "column", x, row_number() OVER (PARTITION BY "column" ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY "column") AS n
    FROM ({long_sql(['value'], 'events')}))))"""


def _shown(points):
    return f"""SELECT DISTINCT CASE WHEN n <= {points} THEN j ELSE CAST(floor(j * (n - 1.0::DOUBLE) / {points - 1}) AS BIGINT) END AS i
      FROM (SELECT count(*) AS n, unnest(range(0, least(count(*), {points}))) AS j FROM events)"""


@query("qq_points", f"""WITH r AS ({QQ_ROWS}), f AS (SELECT regr_slope(x, score) AS slope, regr_intercept(x, score) AS intercept FROM r)
    SELECT "column", i, n, score AS theoretical, x AS sample, slope, intercept FROM r, f WHERE i IN ({_shown(1500)})""",
       "theoretical sample slope intercept")
def _(spark, sf):
    return U.qq_points(table(spark, sf, "events"), ["value"])


@query("qq_band")
def _(spark, sf):
    return U.qq_band(table(spark, sf, "events"), ["value"])


@query("ecdf", f"""WITH r AS (SELECT 'value' AS "column", value AS x, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
    SELECT "column", i, x, (i + 1.0) / n AS y FROM r WHERE i IN ({_shown(2000)})""", "x y")
def _(spark, sf):
    return U.ecdf(table(spark, sf, "events"), ["value"])


@query("transform_suggestions", f"""WITH o AS ({OUT_SQL.format(f=fenced(['value', 'event_id'], 'events'))}), m AS ({moments_sql(['value', 'event_id'], 'events')})
    SELECT "column", 'skewed' AS reason, 'log_or_box_cox' AS transformation, 'high' AS priority, skew AS value FROM m WHERE abs(skew) > 1 UNION ALL
    SELECT "column", 'many_outliers', 'winsorize_p1_p99', 'high', pct_outliers FROM o WHERE n_outliers > n * 0.05 UNION ALL
    SELECT "column", 'high_variability', 'standard_or_robust_scaler', 'medium', sd / m FROM m WHERE sd / m > 1""", "value")
def _(spark, sf):
    return U.transform_suggestions(table(spark, sf, "events"), ["value", "event_id"])


def freq_sql(cols, t):
    return per_column(cols, """SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n,
      row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS k, sum(count(*)) OVER () AS total,
      min(count(*)) OVER () AS last_n, count(*) OVER () AS u FROM """ + t + " WHERE {c} IS NOT NULL GROUP BY 2")


@query("discrete_summary", f"""SELECT f."column", CAST(total AS BIGINT) AS count, r.pm AS pct_missing, u AS n_distinct, value AS mode, lo AS min, hi AS max,
    (floor((2 * 10000 * (n) + (total)) / (2.0 * (total))) / 100) AS dominant_pct FROM ({freq_sql(['l_linenumber', 'l_suppkey'], 'lineitem')}) f
    JOIN ({per_column(['l_linenumber', 'l_suppkey'], '''SELECT '{c}' AS "column", (floor((2 * 10000 * ((count(*) - count({c}))) + (count(*))) / (2.0 * (count(*)))) / 100) AS pm, min({c}) AS lo, max({c}) AS hi FROM lineitem''')}) r
    USING ("column") WHERE k = 1""", "pct_missing min max dominant_pct")
def _(spark, sf):
    return U.discrete_summary(table(spark, sf, "lineitem"), ["l_linenumber", "l_suppkey"])


@query("discrete_levels", f"""SELECT "column", k AS rank, value, n, (floor((2 * 10000 * (n) + (total)) / (2.0 * (total))) / 100) AS pct
    FROM ({freq_sql(['l_linenumber', 'l_suppkey'], 'lineitem')}) WHERE k <= 30""", "pct")
def _(spark, sf):
    return U.discrete_levels(table(spark, sf, "lineitem"), ["l_linenumber", "l_suppkey"])


CATS = ["o_orderstatus", "o_orderpriority", "o_custkey"]
CAT_SQL = f"""SELECT "column", CAST(any_value(total) AS BIGINT) AS count, any_value(pm) AS pct_missing, any_value(u) AS n_distinct,
    (floor((2 * 10000 * (any_value(u)) + (any_value(total))) / (2.0 * (any_value(total)))) / 100) AS cardinality_pct, min(value) FILTER (k = 1) AS mode,
    (floor((2 * 10000 * (max(n)) + (any_value(total))) / (2.0 * (any_value(total)))) / 100) AS mode_pct,
    round(sum(-(n / total) * log2(n / total + 1e-10)) / CASE WHEN any_value(u) > 1 THEN log2(any_value(u)) ELSE 1 END, 3) AS normalized_entropy,
    round(CASE WHEN any_value(u) > 1 THEN max(n) / min(n) ELSE 1 END, 2) AS imbalance, count(*) FILTER (n * 100.0 / total < 1) AS n_rare,
    (floor((2 * 10000 * (any_value(u)) + (any_value(total))) / (2.0 * (any_value(total)))) / 100) > 50 AS high_cardinality, count(*) FILTER (n * 100.0 / total < 1) > 0 AS has_rare,
    (floor((2 * 10000 * (any_value(u)) + (any_value(total))) / (2.0 * (any_value(total)))) / 100) > 90 AS quasi_id
    FROM ({freq_sql(CATS, duck('orders_missing'))}) f JOIN ({per_column(CATS, '''SELECT '{c}' AS "column",
      (floor((2 * 10000 * ((count(*) - count({c}))) + (count(*))) / (2.0 * (count(*)))) / 100) AS pm FROM ''' + duck('orders_missing'))}) USING ("column") GROUP BY "column" """


@query("categorical_summary", CAT_SQL, "pct_missing cardinality_pct mode_pct normalized_entropy imbalance")
def _(spark, sf):
    return U.categorical_summary(table(spark, sf, "orders_missing"), CATS)


@query("pareto", f"""SELECT "column", k AS rank, value, n, (floor((2 * 10000 * (n) + (total)) / (2.0 * (total))) / 100) AS pct,
    round(sum((floor((2 * 10000 * (n) + (total)) / (2.0 * (total))) / 100)) OVER (PARTITION BY "column" ORDER BY k), 2) AS cum_pct FROM ({freq_sql(CATS, duck('orders_missing'))}) WHERE k <= 15""",
       "pct cum_pct")
def _(spark, sf):
    return U.pareto(table(spark, sf, "orders_missing"), CATS)


BOOL_SQL = per_column(["quality", "toxic", "lang"], f"""SELECT *, round(greatest(pct_true, pct_false) / nullif(least(pct_true, pct_false), 0), 2) AS imbalance FROM (
    SELECT '{{c}}' AS "column", count, CASE WHEN t + f = 0 THEN a ELSE t END AS n_true, CASE WHEN t + f = 0 THEN b ELSE f END AS n_false,
      (floor((2 * 10000 * (CASE WHEN t + f = 0 THEN a ELSE t END) + (count)) / (2.0 * (count))) / 100) AS pct_true, (floor((2 * 10000 * (CASE WHEN t + f = 0 THEN b ELSE f END) + (count)) / (2.0 * (count))) / 100) AS pct_false FROM (
    SELECT CAST(sum(n) AS BIGINT) AS count, CAST(coalesce(sum(n) FILTER (v IN ({quoted(K.TRUE_WORDS)})), 0) AS BIGINT) AS t,
      CAST(coalesce(sum(n) FILTER (v IN ({quoted(K.FALSE_WORDS)})), 0) AS BIGINT) AS f, max(n) FILTER (k = 1) AS a, coalesce(max(n) FILTER (k = 2), 0) AS b
    FROM (SELECT lower(CAST({{c}} AS VARCHAR)) AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lower(CAST({{c}} AS VARCHAR))) AS k
      FROM {duck('documents_labelled')} WHERE {{c}} IS NOT NULL GROUP BY 1)))""")


@query("boolean_summary", BOOL_SQL, "pct_true pct_false imbalance")
def _(spark, sf):
    return U.boolean_summary(table(spark, sf, "documents_labelled"), ["quality", "toxic", "lang"])


@query("datetime_summary", per_column(["o_orderdate"], f"""SELECT '{{c}}' AS "column", count({{c}}) AS count, CAST(min({{c}}) AS VARCHAR) AS min,
    CAST(max({{c}}) AS VARCHAR) AS max, CAST(floor(date_diff('second', min({{c}}), max({{c}})) / 86400) AS BIGINT) AS range_days,
    count(DISTINCT {{c}}) AS n_distinct FROM {duck('orders_missing')}"""))
def _(spark, sf):
    return U.datetime_summary(table(spark, sf, "orders_missing"), ["o_orderdate"])


@query("counts_by_year", f"SELECT year(o_orderdate) AS year, count(*) AS n FROM {duck('orders_missing')} WHERE o_orderdate IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return U.counts_by_year(table(spark, sf, "orders_missing"), "o_orderdate")


@query("counts_by_month", "SELECT month(ts) AS month, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return U.counts_by_month(table(spark, sf, "events"), "ts")


@query("text_summary", per_column(["text", "source"], """SELECT '{c}' AS "column", count({c}) AS count, count(DISTINCT {c}) AS n_distinct,
    (floor((2 * 10000 * (count(DISTINCT {c})) + (count({c}))) / (2.0 * (count({c})))) / 100) AS cardinality_pct, avg(length({c})) AS avg_length, quantile_cont(length({c}), 0.5) AS median_length,
    (SELECT l FROM (SELECT length({c}) AS l, row_number() OVER (ORDER BY length({c})) - 1 AS i, count(*) OVER () AS n FROM documents)
      WHERE i = floor(0.95 * (n - 1) + 0.5)) AS p95_length, (floor((2 * 10000 * (count(*) FILTER (trim({c}) = '')) + (count({c}))) / (2.0 * (count({c})))) / 100) AS pct_blank FROM documents"""),
       "cardinality_pct avg_length median_length p95_length pct_blank")
def _(spark, sf):
    return U.text_summary(table(spark, sf, "documents"), ["text", "source"])


@query("text_length_histogram", hist_sql("SELECT 'text' AS \"column\", CAST(length(text) AS DOUBLE) AS x FROM documents", "40"), "x_left x_right")
def _(spark, sf):
    return U.text_length_histogram(table(spark, sf, "documents"), ["text"])


@query("id_summary", per_column(["o_orderkey", "o_custkey", "o_orderdate"], f"""SELECT '{{c}}' AS "column", count(*) AS n_rows, count(DISTINCT {{c}}) AS n_distinct,
    (floor((2 * 10000 * (count(DISTINCT {{c}})) + (count(*))) / (2.0 * (count(*)))) / 100) AS unique_pct, count(*) - count(DISTINCT {{c}}) AS n_duplicates FROM {duck('orders_missing')}"""), "unique_pct")
def _(spark, sf):
    return U.id_summary(table(spark, sf, "orders_missing"), ["o_orderkey", "o_custkey", "o_orderdate"])


@query("geo_summary", per_column(["c_acctbal", "c_nationkey"], """SELECT '{c}' AS "column", count({c}) AS count, min({c}) AS min, max({c}) AS max,
    count(*) FILTER (abs({c}) > 180) AS n_out_of_range, count(*) FILTER (abs({c}) > 90) AS n_beyond_90, count(DISTINCT {c}) AS n_distinct FROM customer"""), "min max")
def _(spark, sf):
    return U.geo_summary(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])


@query("univariate_findings", f"""WITH m AS ({moments_sql(NUM, 'lineitem')}), o AS ({OUT_SQL.format(f=fenced(NUM, 'lineitem'))}),
      c AS ({CAT_SQL}), b AS ({BOOL_SQL})
    SELECT "column", 'symmetric' AS code, skew AS value FROM m WHERE abs(skew) < .5 UNION ALL SELECT "column", 'right_tail', skew FROM m WHERE skew > .5 UNION ALL
    SELECT "column", 'left_tail', skew FROM m WHERE skew <= -.5 UNION ALL SELECT "column", 'heavy_tails', kurt FROM m WHERE kurt > 3 UNION ALL
    SELECT "column", 'outliers', n_outliers FROM o WHERE n_outliers > 0 UNION ALL
    SELECT "column", 'non_normal', n / 6.0 * (skew^2 + kurt^2 / 4) FROM m WHERE n > 5000 AND exp(-n / 12.0 * (skew^2 + kurt^2 / 4)) <= 0.05""", "value")
def _(spark, sf):
    return U.univariate_findings(table(spark, sf, "lineitem"), NUM)


@query("univariate_findings_categories", f"""WITH c AS ({CAT_SQL})
    SELECT "column", 'quasi_id' AS code, cardinality_pct AS value FROM c WHERE quasi_id UNION ALL
    SELECT "column", 'high_cardinality', cardinality_pct FROM c WHERE high_cardinality AND NOT quasi_id UNION ALL
    SELECT "column", 'imbalanced', imbalance FROM c WHERE imbalance > 10 UNION ALL SELECT "column", 'rare_classes', n_rare FROM c WHERE n_rare > 0""", "value")
def _(spark, sf):
    return U.univariate_findings(table(spark, sf, "orders_missing"), categorical=CATS)


@query("univariate_findings_booleans", f"""SELECT "column", 'imbalanced_boolean' AS code, imbalance AS value FROM ({BOOL_SQL}) WHERE imbalance > 3""", "value")
def _(spark, sf):
    return U.univariate_findings(table(spark, sf, "documents_labelled"), boolean=["quality", "toxic", "lang"])


@query("exact_quantiles_by_group", """SELECT l_returnflag AS "group", count(*) AS n, quantile_cont(l_extendedprice, .1) AS p10, quantile_cont(l_extendedprice, .9) AS p90
    FROM lineitem GROUP BY 1""", "p10 p90")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("group"), "l_extendedprice")
    return B.quantiles(li, ["group"], "l_extendedprice", {"p10": .1, "p90": .9})
