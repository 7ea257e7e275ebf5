"""Bivariate, multivariate and inference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.catalog.common import duck, query, table
from tablescope.operators import bivariate as BI
from tablescope.operators import inference as I
from tablescope.operators import multivariate as M
from tablescope.operators import quality as Q

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = BI.column_pairs(NUM)


def chi2_p(x, dof):
    a = f"(({dof}) / 2.0)"
    return (f"CASE WHEN {x} > 1400 THEN 0.0 WHEN {x} <= 0 THEN 1.0 ELSE greatest(0, 1 - (SELECT sum(exp({a} * ln({x} / 2) - {x} / 2 + si * ln({x} / 2)"
            f" - lgamma({a} + si + 1))) FROM range(0, 1500) series(si))) END")


def beta_p(y, a, b):
    """1 - I_y(a, b) by its power series."""
    return (f"CASE WHEN {y} <= 0 THEN 1.0 ELSE greatest(0, 1 - (SELECT sum(exp(({a}) * ln({y}) + ({b}) * ln(1 - {y}) + lgamma(({a}) + ({b}) + si)"
            f" - lgamma(({a}) + si + 1) - lgamma({b}) + si * ln({y}))) FROM range(0, 1500) series(si))) END")


def pearson_sql(pairs, t):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, coalesce(corr({a}, {b}), 0) AS r FROM {t}"
        for a, b in pairs)


@query("pearson_pairs", f"SELECT var_a, var_b, n, r AS pearson_r, abs(r) > 0.7 AS high FROM ({pearson_sql(PAIRS, 'lineitem')}) ORDER BY abs(r) DESC LIMIT 30", "pearson_r")
def _(spark, sf):
    return BI.pearson_pairs(table(spark, sf, "lineitem"), NUM)


SALES_NUM = ["retail_price", "supplier_cost", "discount_share", "sold_units", "stock_units"]


@query("pearson_pairs_missing", "SELECT var_a, var_b, n, r AS pearson_r, abs(r) > 0.7 AS high FROM (" + pearson_sql(
    BI.column_pairs(["o_custkey", "o_totalprice", "o_orderkey"]), duck("orders_missing")) + ")", "pearson_r")
def _(spark, sf):
    return BI.pearson_pairs(table(spark, sf, "orders_missing"), ["o_custkey", "o_totalprice", "o_orderkey"])


def spearman_sql(pairs, t):
    avg = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, count(*) AS n, corr(ra, rb) AS spearman_rho FROM (SELECT {avg.format(c=a)} AS ra, {avg.format(c=b)} AS rb"
        f" FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in pairs)


@query("spearman_pairs", spearman_sql(PAIRS, "lineitem"), "spearman_rho")
def _(spark, sf):
    return BI.spearman_pairs(table(spark, sf, "lineitem"), NUM)


@query("spearman_pairs_missing", spearman_sql(BI.column_pairs(["o_custkey", "o_totalprice", "o_orderkey"]), duck("orders_missing")), "spearman_rho")
def _(spark, sf):
    return BI.spearman_pairs(table(spark, sf, "orders_missing"), ["o_custkey", "o_totalprice", "o_orderkey"])


def matrix_sql(cols, t):
    return " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, " + ("1.0" if a == b else f"coalesce(corr({a}, {b}), 0)") + f" AS value FROM {t}"
                              for a in cols for b in cols)


@query("correlation_matrix", f"SELECT var_a, var_b, any_value(value) AS value FROM ({matrix_sql(NUM, 'lineitem')}) GROUP BY 1, 2", "value")
def _(spark, sf):
    return BI.correlation_matrix(table(spark, sf, "lineitem"), NUM)


@query("correlation_matrix_wide", "SELECT var_a, " + ", ".join(f"max(value) FILTER (var_b = '{c}') AS {c}" for c in NUM)
       + f" FROM ({matrix_sql(NUM, 'lineitem')}) GROUP BY 1", " ".join(NUM))
def _(spark, sf):
    return BI.correlation_matrix_wide(table(spark, sf, "lineitem"), NUM)


@query("scatter_sample")
def _(spark, sf):
    return BI.scatter_sample(table(spark, sf, "lineitem"), NUM)


@query("trend_line", " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, count(*) AS n, regr_slope({b}, {a}) AS slope, regr_intercept({b}, {a}) AS intercept FROM lineitem"
                                        for a, b in PAIRS), "slope intercept")
def _(spark, sf):
    return BI.trend_line(table(spark, sf, "lineitem"), NUM)


NUMS, CATS = ["l_quantity", "l_extendedprice"], ["l_returnflag", "l_linestatus", "l_linenumber"]


def long_sql(nums, cats, t, levels=8):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS num, '{c}' AS cat, CAST({c} AS VARCHAR) AS grp, CAST({n} AS DOUBLE) AS x FROM {t} WHERE {n} IS NOT NULL AND CAST({c} AS VARCHAR) IN "
        f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY v LIMIT {levels})" for n in nums for c in cats)


LONG = long_sql(NUMS, CATS, "lineitem")


@query("group_stats", f"""SELECT num, cat, grp, n, mean, median, std, lo < q1 - 1.5 * (q3 - q1) OR hi > q3 + 1.5 * (q3 - q1) AS has_outliers FROM (
    SELECT num, cat, grp, count(*) AS n, avg(x) AS mean, quantile_cont(x, .5) AS median, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi,
    quantile_cont(x, .25) AS q1, quantile_cont(x, .75) AS q3 FROM ({LONG}) GROUP BY 1, 2, 3) WHERE n >= 3""", "mean median std")
def _(spark, sf):
    return BI.group_stats(table(spark, sf, "lineitem"), NUMS, CATS)


@query("normality_gate")
def _(spark, sf):
    return BI.normality_gate(table(spark, sf, "lineitem"), NUMS, CATS)


def anova_sql(long):
    return f"""SELECT num, cat, n, k, f AS statistic, {beta_p('(d1 * f / (d1 * f + d2))', 'd1 / 2.0', 'd2 / 2.0')} AS pvalue, eta AS effect_size FROM (
      SELECT num, cat, CAST(sum(n) AS BIGINT) AS n, count(*) AS k, count(*) - 1 AS d1, sum(n) - count(*) AS d2,
        (sum(n * (m - g)^2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f, sum(n * (m - g)^2) / (sum(n * (m - g)^2) + sum(n * v)) AS eta
      FROM (SELECT *, sum(n * m) OVER (PARTITION BY num, cat) / sum(n) OVER (PARTITION BY num, cat) AS g FROM (
        SELECT num, cat, grp, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM ({long}) GROUP BY 1, 2, 3)) GROUP BY 1, 2)"""


def kruskal_sql(long):
    return f"""SELECT num, cat, n, k, h AS statistic, {chi2_p('h', 'k - 1')} AS pvalue FROM (
      SELECT num, cat, CAST(sum(c) AS BIGINT) AS n, count(*) AS k,
        (12.0 / (sum(c) * (sum(c) + 1.0)) * sum(r * r / c) - 3 * (sum(c) + 1)) / (1 - sum(t) / (sum(c) * 1.0 * sum(c) * sum(c) - sum(c))) AS h
      FROM (SELECT num, cat, grp, CAST(count(*) AS DOUBLE) AS c, sum(r) AS r, sum(t * t - 1.0) AS t FROM (
        SELECT num, cat, grp, rank() OVER (PARTITION BY num, cat ORDER BY x) + (count(*) OVER (PARTITION BY num, cat, x) - 1) / 2.0 AS r,
          count(*) OVER (PARTITION BY num, cat, x) AS t FROM ({long})) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("anova_oneway", f"SELECT *, pvalue < 0.05 AS significant FROM ({anova_sql(LONG)})", "statistic pvalue effect_size")
def _(spark, sf):
    return BI.anova_oneway(table(spark, sf, "lineitem"), NUMS, CATS)


@query("kruskal_wallis", f"SELECT *, pvalue < 0.05 AS significant FROM ({kruskal_sql(LONG)})", "statistic pvalue")
def _(spark, sf):
    return BI.kruskal_wallis(table(spark, sf, "lineitem"), NUMS, CATS)


@query("num_cat_tests")
def _(spark, sf):
    return BI.num_cat_tests(table(spark, sf, "lineitem"), NUMS, CATS)


@query("contingency_table", """SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O"
    FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return BI.contingency_table(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("contingency_blocks", """WITH levels AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS place FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders)),
    cells AS (SELECT o_orderpriority AS p, CAST(o_custkey AS VARCHAR) AS v, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT p AS "row", CAST(place // 150 AS INTEGER) AS block, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY place) AS counts
    FROM (SELECT DISTINCT p FROM cells) CROSS JOIN levels LEFT JOIN cells USING (p, v) GROUP BY 1, 2 HAVING sum(n) > 0""")
def _(spark, sf):
    blocks = BI.contingency_blocks(table(spark, sf, "orders"), "o_orderpriority", "o_custkey", width=150)
    return blocks.withColumn("counts", F.array_join("counts", ","))


CAT_COLS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def chi2_sql(cols, t):
    cells = " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b FROM {t}"
                               for a, b in BI.column_pairs(cols))
    return f"""WITH raw AS ({cells}), o AS (SELECT var_a, var_b, a, b, count(*) AS n FROM raw WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3, 4),
      ra AS (SELECT var_a, var_b, a, sum(n) AS ra FROM o GROUP BY 1, 2, 3), cb AS (SELECT var_a, var_b, b, sum(n) AS cb FROM o GROUP BY 1, 2, 3),
      tot AS (SELECT var_a, var_b, sum(ra) AS n, count(*) AS r FROM ra GROUP BY 1, 2), tc AS (SELECT var_a, var_b, count(*) AS c FROM cb GROUP BY 1, 2),
      full_cells AS (SELECT ra.var_a, ra.var_b, tot.n, r, c, coalesce(o.n, 0) AS o, ra * cb * 1.0 / tot.n AS e
        FROM ra JOIN cb ON ra.var_a = cb.var_a AND ra.var_b = cb.var_b JOIN tot ON tot.var_a = ra.var_a AND tot.var_b = ra.var_b
        JOIN tc ON tc.var_a = ra.var_a AND tc.var_b = ra.var_b
        LEFT JOIN o ON o.var_a = ra.var_a AND o.var_b = ra.var_b AND o.a = ra.a AND o.b = cb.b)
      SELECT var_a, var_b, CAST(n AS BIGINT) AS n, r AS n_rows, c AS n_cols, x AS chi2, dof, CASE WHEN dof = 0 THEN 1.0 ELSE {chi2_p('x', 'dof')} END AS pvalue
      FROM (SELECT var_a, var_b, n, r, c, (r - 1) * (c - 1) AS dof, CASE WHEN (r - 1) * (c - 1) = 0 THEN 0.0
          ELSE sum(pow(greatest(abs(o - e) - CASE WHEN (r - 1) * (c - 1) = 1 THEN 0.5 ELSE 0 END, 0), 2) / e) END AS x FROM full_cells GROUP BY 1, 2, 3, 4, 5)"""


@query("chi2_test", chi2_sql(CAT_COLS, "lineitem"), "chi2 pvalue")
def _(spark, sf):
    return BI.chi2_test(table(spark, sf, "lineitem"), CAT_COLS)


@query("chi2_test_yates", chi2_sql(["quality", "toxic"], duck("documents_labelled")), "chi2 pvalue")
def _(spark, sf):
    return BI.chi2_test(table(spark, sf, "documents_labelled"), ["quality", "toxic"])


@query("cramers_v", f"""SELECT var_a, var_b, n, v AS cramers_v, pvalue, v > 0.3 AS strong FROM (SELECT *,
      CASE WHEN k < 2 THEN 0.0 ELSE least(1.0, sqrt(greatest(0, chi2 / n - (k - 1.0) / (n - 1)) / (k - (k - 1.0)^2 / (n - 1) - 1))) END AS v
      FROM (SELECT *, least(n_rows, n_cols) AS k FROM ({chi2_sql(CAT_COLS, 'lineitem')})))""", "cramers_v pvalue")
def _(spark, sf):
    return BI.cramers_v(table(spark, sf, "lineitem"), CAT_COLS)


@query("bivariate_findings", f"""WITH p AS ({pearson_sql(BI.column_pairs(["supplier_cost", "retail_price", "discount_share"]), duck('sales'))})
    SELECT 'top_correlation' AS code, arg_max(var_a || ' x ' || var_b, abs(r)) AS subject, arg_max(r, abs(r)) AS value FROM p HAVING count(*) FILTER (abs(r) > 0.7) > 0 UNION ALL
    SELECT 'multicollinearity', NULL, count(*) FILTER (abs(r) > 0.85) FROM p HAVING count(*) FILTER (abs(r) > 0.85) > 0 UNION ALL
    SELECT 'no_strong_correlation', NULL, 0 FROM p HAVING count(*) FILTER (abs(r) > 0.7) = 0""", "value")
def _(spark, sf):
    return BI.bivariate_findings(table(spark, sf, "sales"), ["supplier_cost", "retail_price", "discount_share"], [])


@query("bivariate_findings_groups")
def _(spark, sf):
    return BI.bivariate_findings(table(spark, sf, "lineitem"), NUMS, ["l_returnflag", "l_linestatus"])


# ── multivariate ──────────────────────────────────────────────────────────────────────────────

@query("variance_rank", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", var_samp({c}) AS variance FROM lineitem" for c in NUM), "variance")
def _(spark, sf):
    return M.variance_rank(table(spark, sf, "lineitem"), NUM)


@query("high_correlation_pairs", f"""SELECT var_a, var_b, n, r AS correlation, abs(r) > 0.85 AS flag FROM (
    {pearson_sql(BI.column_pairs(SALES_NUM), duck('sales'))}) WHERE abs(r) > 0.7""", "correlation")
def _(spark, sf):
    return M.high_correlation_pairs(table(spark, sf, "sales"), SALES_NUM)


@query("global_correlation", f"SELECT var_a, var_b, n, r AS value, abs(r) > 0.7 AS high FROM ({pearson_sql(PAIRS, 'lineitem')})", "value")
def _(spark, sf):
    return M.global_correlation(table(spark, sf, "lineitem"), NUM)


@query("pca")
def _(spark, sf):
    return M.pca(table(spark, sf, "lineitem"), NUM).drop("loadings")


@query("pca_scores")
def _(spark, sf):
    return M.pca_scores(table(spark, sf, "lineitem"), NUM, ["l_orderkey", "l_linenumber"])


VIF3 = ["l_quantity", "l_extendedprice", "l_discount"]


@query("vif", """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS g FROM lineitem),
    d AS (SELECT *, 1 + 2*a*b*g - a*a - b*b - g*g AS det FROM c)
    SELECT 'l_quantity' AS feature, (1 - g*g) / det AS vif, (1 - g*g) / det > 10 AS high FROM d UNION ALL
    SELECT 'l_extendedprice', (1 - b*b) / det, (1 - b*b) / det > 10 FROM d UNION ALL SELECT 'l_discount', (1 - a*a) / det, (1 - a*a) / det > 10 FROM d""", "vif")
def _(spark, sf):
    return M.vif(table(spark, sf, "lineitem"), VIF3)


LEAK = pearson_sql([("retail_price", "sold_units"), ("discount_share", "sold_units"), ("stock_units", "sold_units")], duck("sales"))


@query("target_leakage_corr", f"SELECT var_a AS \"column\", n, r AS correlation FROM ({LEAK}) WHERE abs(r) > 0.98", "correlation")
def _(spark, sf):
    return M.target_leakage_corr(table(spark, sf, "sales"), ["retail_price", "discount_share", "stock_units"], "sold_units")


@query("ml_warnings", f"SELECT 'potential_target_leakage' AS type, var_a AS \"column\", r AS value, 'investigate' AS action FROM ({LEAK}) WHERE abs(r) > 0.98 AND var_a <> 'stock_units'", "value")
def _(spark, sf):
    return M.ml_warnings(table(spark, sf, "sales"), ["retail_price", "discount_share"], "sold_units")


@query("ml_warnings_none", "SELECT 'no_anomaly' AS type, CAST(NULL AS VARCHAR) AS \"column\", CAST(NULL AS DOUBLE) AS value, 'none' AS action", "value")
def _(spark, sf):
    return M.ml_warnings(table(spark, sf, "lineitem"), VIF3)


# ── inference ─────────────────────────────────────────────────────────────────────────────────

G2 = ["l_linestatus"]
TWO = long_sql(NUM, G2, "lineitem", 10)
PAIRED = f"""SELECT num, cat, min(grp) AS grp_1, max(grp) AS grp_2, max(n) FILTER (k = 1) AS n_1, max(n) FILTER (k = 2) AS n_2,
    max(m) FILTER (k = 1) AS mean_1, max(m) FILTER (k = 2) AS mean_2, max(sd) FILTER (k = 1) AS std_1, max(sd) FILTER (k = 2) AS std_2,
    max(v) FILTER (k = 1) AS v_1, max(v) FILTER (k = 2) AS v_2 FROM (
    SELECT num, cat, grp, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd, var_samp(x) AS v, row_number() OVER (PARTITION BY num, cat ORDER BY grp) AS k
    FROM ({TWO}) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query("welch_t_test", f"""SELECT num, cat, grp_1, grp_2, n_1, n_2, mean_1, mean_2, std_1, std_2, t AS statistic, v AS dof,
      {beta_p('(t * t / (v + t * t))', '0.5', 'v / 2')} AS pvalue FROM (SELECT *, (mean_1 - mean_2) / sqrt(a + b) AS t,
      (a + b)^2 / (a * a / (n_1 - 1) + b * b / (n_2 - 1)) AS v FROM (SELECT *, v_1 / n_1 AS a, v_2 / n_2 AS b FROM ({PAIRED})))""",
       "mean_1 mean_2 std_1 std_2 statistic dof pvalue")
def _(spark, sf):
    return I.welch_t_test(table(spark, sf, "lineitem"), NUM, G2)


MWU = f"""SELECT num, cat, grp_1, grp_2, n_1, n_2, u AS statistic, CASE WHEN z <= 0 THEN 1.0 ELSE {chi2_p('(z * z)', '1')} END AS pvalue FROM (
    SELECT *, (greatest(u, n_1 * n_2 - u) - n_1 * n_2 / 2.0 - 0.5) / sqrt(n_1 * n_2 / 12.0 * ((n_1 + n_2 + 1) - t / ((n_1 + n_2) * 1.0 * (n_1 + n_2 - 1)))) AS z FROM (
    SELECT num, cat, min(grp) AS grp_1, max(grp) AS grp_2, max(n) FILTER (k = 1) AS n_1, max(n) FILTER (k = 2) AS n_2,
      max(r) FILTER (k = 1) - max(n) FILTER (k = 1) * (max(n) FILTER (k = 1) + 1) / 2.0 AS u, sum(t) AS t FROM (
      SELECT num, cat, grp, count(*) AS n, sum(r) AS r, sum(t * t - 1.0) AS t, row_number() OVER (PARTITION BY num, cat ORDER BY grp) AS k FROM (
        SELECT num, cat, grp, rank() OVER (PARTITION BY num, cat ORDER BY x) + (count(*) OVER (PARTITION BY num, cat, x) - 1) / 2.0 AS r,
          count(*) OVER (PARTITION BY num, cat, x) AS t FROM ({TWO})) GROUP BY 1, 2, 3) GROUP BY 1, 2))"""


@query("mann_whitney_u", MWU, "statistic pvalue")
def _(spark, sf):
    return I.mann_whitney_u(table(spark, sf, "lineitem"), NUM, G2)


SMALL = ("SELECT s_suppkey, part, small_a, small_b FROM (SELECT s_suppkey, s_suppkey % 7 < 3 AS part, s_acctbal AS small_a, -s_acctbal * s_suppkey AS small_b, "
               "row_number() OVER (PARTITION BY s_suppkey % 7 < 3 ORDER BY s_acctbal, s_suppkey) AS r FROM {supplier}) WHERE r <= CASE WHEN part THEN 6 ELSE 8 END")


@query("mann_whitney_u_small", f"""WITH t AS ({SMALL.format(supplier="supplier")}),
    x AS (SELECT 'small_a' AS num, CAST(part AS VARCHAR) AS grp, small_a AS v FROM t UNION ALL SELECT 'small_b', CAST(part AS VARCHAR), small_b FROM t),
    r AS (SELECT num, grp, rank() OVER (PARTITION BY num ORDER BY v) AS r FROM x),
    g AS (SELECT num, count(*) FILTER (grp = 'false') AS n_1, count(*) FILTER (grp = 'true') AS n_2, sum(r) FILTER (grp = 'false') AS s FROM r GROUP BY num),
    u AS (SELECT num, n_1, n_2, s - n_1 * (n_1 + 1) / 2.0 AS u FROM g),
    m AS (SELECT u.*, (SELECT sum(CASE WHEN (o.mask >> p) & 1 = 1 THEN p + 1 ELSE 0 END) FROM range(14) q(p)) - n_1 * (n_1 + 1) / 2.0 AS w
          FROM u JOIN range(16384) o(mask) ON bit_count(o.mask) = u.n_1)
    SELECT num, 'part' AS cat, 'false' AS grp_1, 'true' AS grp_2, n_1, n_2, u AS statistic,
      least(1.0, 2.0 * count(*) FILTER (w >= greatest(u, n_1 * n_2 - u)) / count(*)) AS pvalue FROM m GROUP BY num, n_1, n_2, u""", "statistic pvalue")
def _(spark, sf):
    small = spark.sql(SMALL, supplier=table(spark, sf, "supplier"))
    return I.mann_whitney_u(small, ["small_a", "small_b"], ["part"])


COHEN = f"""SELECT *, CASE WHEN abs(effect_size) < .2 THEN 'negligible' WHEN abs(effect_size) < .5 THEN 'small' WHEN abs(effect_size) < .8 THEN 'medium'
    ELSE 'large' END AS effect_label FROM (SELECT num, cat, grp_1, grp_2, n_1, n_2, mean_1, mean_2, std_1, std_2,
    (mean_1 - mean_2) / sqrt((std_1^2 + std_2^2) / 2) AS effect_size FROM ({PAIRED}))"""


@query("cohens_d", COHEN, "mean_1 mean_2 std_1 std_2 effect_size")
def _(spark, sf):
    return I.cohens_d(table(spark, sf, "lineitem"), NUM, G2)


G3 = ["l_returnflag", "l_linenumber"]
THREE = long_sql(NUM, G3, "lineitem", 10)
MULTI = f"""SELECT k.num, k.cat, k.n, k.k, k.statistic AS kruskal_h, k.pvalue AS kruskal_p, a.statistic AS anova_f, a.pvalue AS anova_p
    FROM ({kruskal_sql(THREE)}) k JOIN ({anova_sql(THREE)}) a ON a.num = k.num AND a.cat = k.cat"""


@query("multi_group_tests", MULTI, "kruskal_h kruskal_p anova_f anova_p")
def _(spark, sf):
    return I.multi_group_tests(table(spark, sf, "lineitem"), NUM, G3).drop("group_means")


TESTS = f"""SELECT *, coalesce(k <= (SELECT max(k) FROM t AS u WHERE pvalue <= k / m * 0.05), false) AS significant_fdr FROM t"""
WITH_TESTS = f"""WITH raw AS (SELECT w.num AS feature, w.cat AS target, 't_test_mann_whitney' AS test, w.pvalue AS p, c.effect_size, c.effect_label
      FROM ({MWU}) w JOIN ({COHEN}) c ON c.num = w.num AND c.cat = w.cat UNION ALL
      SELECT num, cat, 'anova_kruskal_wallis', pvalue, NULL, NULL FROM ({kruskal_sql(THREE)})),
    t AS (SELECT feature, target, test, round(p, 4) AS pvalue, effect_size, effect_label, p < 0.05 AS significant, position,
      CAST(row_number() OVER (ORDER BY round(p, 4), position) AS DOUBLE) AS k, CAST(count(*) OVER () AS DOUBLE) AS m
      FROM (SELECT *, list_position([{', '.join(f"'{n}{c}'" for n in NUM for c in G2 + G3)}], feature || target) AS position FROM raw))"""


@query("fdr_bh", f"{WITH_TESTS} SELECT feature, target, test, pvalue, effect_size, effect_label, significant, position, significant_fdr FROM ({TESTS})", "pvalue effect_size")
def _(spark, sf):
    return I.inference_table(table(spark, sf, "lineitem"), NUM, G2 + G3)


@query("tested_groups", f"""SELECT num AS feature, cat AS target, grp, n, mean, std FROM (SELECT num, cat, grp, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std
    FROM ({long_sql(NUM, G2 + G3, "lineitem", 10)}) GROUP BY 1, 2, 3) WHERE n >= 5""", "mean std")
def _(spark, sf):
    return I.tested_groups(table(spark, sf, "lineitem"), NUM, G2 + G3)


@query("inference_summary", f"""{WITH_TESTS} SELECT count(*) AS n_tests, count(*) FILTER (significant_fdr) AS significant_after_fdr,
    arg_min(feature || ' x ' || target, position) FILTER (significant_fdr) AS first_significant FROM ({TESTS})""")
def _(spark, sf):
    return I.inference_summary(table(spark, sf, "lineitem"), NUM, G2 + G3)


# ── wide tables and many levels: nothing is cut off ───────────────────────────────────────────

WIDE = [f"c{i}" for i in range(30)]
WIDE_SQL = "SELECT " + ", ".join(f"CASE WHEN (o_orderkey * {7 + i} + o_custkey) % {11 + i} <> 0 THEN (o_orderkey * {i + 3} + o_custkey * {31 - i}) % {101 + 7 * i} + 0.25 END AS c{i}"
                                 for i in range(30)) + ", o_custkey % 12 AS g12, o_orderkey % 25 AS g25, o_custkey % 2 AS g2, o_orderpriority AS g5 FROM {orders}"


def wide(spark, sf):
    return spark.sql(WIDE_SQL, orders=table(spark, sf, "orders"))


WIDE_FROM = "(" + WIDE_SQL.format(orders="orders") + ")"
WIDE_PAIRS = BI.column_pairs(WIDE)
#: One scan for all pairs.
WIDE_MOMENTS = f"""SELECT t.a AS var_a, t.b AS var_b, t.n AS n, t.r AS r FROM (SELECT unnest([{', '.join(
    f"{{'a': '{a}', 'b': '{b}', 'n': count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL), 'r': coalesce(corr({a}, {b}), 0)}}" for a, b in WIDE_PAIRS)}]) AS t FROM {WIDE_FROM})"""


@query("pearson_pairs_wide", f"SELECT var_a, var_b, n, r AS pearson_r, abs(r) > 0.7 AS high FROM ({WIDE_MOMENTS})", "pearson_r")
def _(spark, sf):
    return BI.pearson_pairs(wide(spark, sf), WIDE)


@query("correlation_matrix_wide_table", f"""SELECT var_a, var_b, r AS value FROM ({WIDE_MOMENTS}) UNION ALL SELECT var_b, var_a, r FROM ({WIDE_MOMENTS})
    UNION ALL SELECT unnest({WIDE}) AS var_a, unnest({WIDE}) AS var_b, 1.0""", "value")
def _(spark, sf):
    return BI.correlation_matrix(wide(spark, sf), WIDE)


@query("global_correlation_wide", f"SELECT var_a, var_b, n, r AS value, abs(r) > 0.7 AS high FROM ({WIDE_MOMENTS})", "value")
def _(spark, sf):
    return M.global_correlation(wide(spark, sf), WIDE)


@query("trend_line_wide", "SELECT t.* FROM (SELECT unnest([" + ", ".join(
    f"{{'var_a': '{a}', 'var_b': '{b}', 'n': regr_count({b}, {a}), 'slope': regr_slope({b}, {a}), 'intercept': regr_intercept({b}, {a})}}" for a, b in WIDE_PAIRS)
    + f"]) AS t FROM {WIDE_FROM})", "slope intercept")
def _(spark, sf):
    return BI.trend_line(wide(spark, sf), WIDE)


@query("variance_rank_wide", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", var_samp({c}) AS variance FROM {WIDE_FROM}" for c in WIDE), "variance")
def _(spark, sf):
    return M.variance_rank(wide(spark, sf), WIDE)


def null_pairs_sql(value):
    cells = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'na': count(*) - count({a}), 'nb': count(*) - count({b}), 'nab': count(*) FILTER ({a} IS NULL AND {b} IS NULL), 'n': count(*)}}"
                      for a in WIDE for b in WIDE)
    return f"SELECT t.a AS var_a, t.b AS var_b, {value} FROM (SELECT unnest([{cells}]) AS t FROM {WIDE_FROM})"


@query("missing_cooccurrence_wide", null_pairs_sql("t.n AS n, t.na AS n_a, t.nb AS n_b, t.nab AS n_both"))
def _(spark, sf):
    return Q.missing_cooccurrence(wide(spark, sf), WIDE)


@query("missing_correlation_wide", null_pairs_sql("CASE WHEN t.a = t.b THEN 1.0 ELSE coalesce((t.n * 1.0 * t.nab - t.na * 1.0 * t.nb) / nullif(sqrt(t.na * 1.0 * (t.n - t.na) * t.nb * (t.n - t.nb)), 0), 0) END AS value"), "value")
def _(spark, sf):
    return Q.missing_correlation(wide(spark, sf), WIDE)


WIDE_NUM, WIDE_CAT = ["c0", "c5", "c9", "c14", "c20", "c29"], ["g12", "g25", "g2", "g5"]
WIDE_LONG = long_sql(WIDE_NUM, WIDE_CAT, WIDE_FROM, 1000)


@query("anova_oneway_wide", f"SELECT *, pvalue < 0.05 AS significant FROM ({anova_sql(WIDE_LONG)})", "statistic pvalue effect_size")
def _(spark, sf):
    return BI.anova_oneway(wide(spark, sf), WIDE_NUM, WIDE_CAT)


@query("kruskal_wallis_wide", f"SELECT *, pvalue < 0.05 AS significant FROM ({kruskal_sql(WIDE_LONG)})", "statistic pvalue")
def _(spark, sf):
    return BI.kruskal_wallis(wide(spark, sf), WIDE_NUM, WIDE_CAT)


@query("group_stats_wide", f"""SELECT num, cat, grp, n, mean, median, std, lo < q1 - 1.5 * (q3 - q1) OR hi > q3 + 1.5 * (q3 - q1) AS has_outliers FROM (
    SELECT num, cat, grp, count(*) AS n, avg(x) AS mean, quantile_cont(x, .5) AS median, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi,
    quantile_cont(x, .25) AS q1, quantile_cont(x, .75) AS q3 FROM ({WIDE_LONG}) GROUP BY 1, 2, 3) WHERE n >= 3""", "mean median std")
def _(spark, sf):
    return BI.group_stats(wide(spark, sf), WIDE_NUM, WIDE_CAT)


@query("chi2_test_wide", chi2_sql(["g12", "g25", "g2", "g5"], WIDE_FROM), "chi2 pvalue")
def _(spark, sf):
    return BI.chi2_test(wide(spark, sf), ["g12", "g25", "g2", "g5"])
