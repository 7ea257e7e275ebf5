"""Exploratory machine-learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.catalog.common import duck, per_column, query, table
from tablescope.operators import ml as ML

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("validate_target", f"SELECT 'toxic' AS target, count(toxic) > 0 AS valid, CASE WHEN count(toxic) = 0 THEN 'target is all null' END AS reason FROM {duck('documents_labelled')}")
def _(spark, sf):
    return ML.validate_target(table(spark, sf, "documents_labelled"), "toxic", "classification")


def psi_sql(n):
    z = f"(({n}) + 6.0)"
    steps = " + ".join(f"1.0 / (({n}) + {j}.0)" for j in range(6))
    return f"(ln({z}) - 1.0 / (2.0 * {z}) - 1.0 / (12.0 * pow({z}, 2)) + 1.0 / (120.0 * pow({z}, 4)) - 1.0 / (252.0 * pow({z}, 6)) - ({steps}))"


def mi_classes_sql(features, target, t):
    """All pairs of distinct values within a class, then all distinct values inside each radius."""
    rows = per_column(features, f"SELECT '{{c}}' AS feature, CAST({target} AS VARCHAR) AS y, CAST({{c}} AS DOUBLE) AS x FROM {t}")
    return f"""WITH v AS (SELECT feature, y, x, count(*) AS w FROM ({rows}) GROUP BY 1, 2, 3),
      c AS (SELECT *, sum(w) OVER (PARTITION BY feature, y) AS nc FROM v QUALIFY nc > 1),
      d AS (SELECT a.feature, a.y, a.x, a.w, a.nc, abs(a.x - b.x) AS d, sum(b.w - CASE WHEN a.x = b.x THEN 1 ELSE 0 END)
              OVER (PARTITION BY a.feature, a.y, a.x ORDER BY abs(a.x - b.x)) AS reached FROM c a JOIN c b ON a.feature = b.feature AND a.y = b.y),
      r AS (SELECT feature, y, x, w, nc, min(d) FILTER (reached >= least(3, nc - 1)) AS r FROM d GROUP BY ALL),
      f AS (SELECT feature, x, sum(w) AS w FROM c GROUP BY 1, 2),
      m AS (SELECT r.feature, r.y, r.x, r.w, r.nc, r.r, sum(f.w) AS inside FROM r JOIN f ON f.feature = r.feature
              AND (f.x = r.x OR abs(f.x - r.x) < r.r * (1 - 1e-12)) GROUP BY ALL),
      s AS (SELECT feature, CAST(sum(w) AS BIGINT) AS n, greatest(0.0, {psi_sql('sum(w)')} + sum(w * ({psi_sql('CASE WHEN r = 0 THEN w - 1 ELSE least(3, nc - 1) END')}
              - {psi_sql('nc')} - {psi_sql('inside')})) / sum(w)) AS mi_score FROM m GROUP BY feature)
      SELECT *, row_number() OVER (ORDER BY round(mi_score, 9) DESC, feature) AS rank FROM s"""


def mi_numbers_sql(features, target, t):
    rows = per_column(features, f"SELECT '{{c}}' AS feature, CAST({{c}} AS DOUBLE) / (SELECT stddev_pop({{c}}) FROM {t}) AS x, CAST({target} AS DOUBLE) / (SELECT stddev_pop({target}) FROM {t}) AS y FROM {t}")
    far = "greatest(abs(a.x - b.x), abs(a.y - b.y))"

    def inside(axis):
        return (f"(SELECT r.feature, r.x, r.y, sum(f.w) AS n{axis} FROM r JOIN (SELECT feature, {axis}, sum(w) AS w FROM v GROUP BY 1, 2) f ON f.feature = r.feature "
                f"AND (f.{axis} = r.{axis} OR abs(f.{axis} - r.{axis}) < r.r * (1 - 1e-12)) GROUP BY 1, 2, 3)")
    return f"""WITH v AS MATERIALIZED (SELECT feature, x, y, count(*) AS w FROM ({rows}) GROUP BY 1, 2, 3),
      d AS (SELECT a.feature, a.x, a.y, a.w, {far} AS d, sum(b.w - CASE WHEN a.x = b.x AND a.y = b.y THEN 1 ELSE 0 END)
              OVER (PARTITION BY a.feature, a.x, a.y ORDER BY {far}) AS reached FROM v a JOIN v b ON a.feature = b.feature),
      r AS MATERIALIZED (SELECT feature, x, y, w, min(d) FILTER (reached >= 3) AS r FROM d GROUP BY ALL),
      s AS (SELECT feature, CAST(sum(w) AS BIGINT) AS n, greatest(0.0, {psi_sql('sum(w)')} + sum(w * ({psi_sql('CASE WHEN r = 0 THEN w - 1 ELSE 3 END')}
              - {psi_sql('nx')} - {psi_sql('ny')})) / sum(w)) AS mi_score FROM r JOIN {inside('x')} USING (feature, x, y) JOIN {inside('y')} USING (feature, x, y) GROUP BY feature)
      SELECT *, row_number() OVER (ORDER BY round(mi_score, 9) DESC, feature) AS rank FROM s"""


@query("mutual_information", mi_classes_sql(["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_returnflag", "lineitem"), "mi_score")
def _(spark, sf):
    return ML.mutual_information(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_returnflag", "classification")


@query("mutual_information_customer", mi_classes_sql(["c_acctbal", "c_nationkey", "c_custkey"], "c_mktsegment", "customer"), "mi_score")
def _(spark, sf):
    return ML.mutual_information(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey", "c_custkey"], "c_mktsegment", "classification")


@query("mutual_information_regression", mi_numbers_sql(["retail_price", "discount_share", "stock_units"], "supplier_cost", duck("sales")), "mi_score")
def _(spark, sf):
    return ML.mutual_information(table(spark, sf, "sales"), ["retail_price", "discount_share", "stock_units"], "supplier_cost", "regression")


@query("kmeans_sweep")
def _(spark, sf):
    return ML.kmeans_sweep(table(spark, sf, "lineitem"), NUM)


@query("kmeans_best")
def _(spark, sf):
    return ML.kmeans_best(table(spark, sf, "lineitem"), NUM)


@query("cluster_projection")
def _(spark, sf):
    return ML.cluster_projection(table(spark, sf, "lineitem"), NUM, k=3)


@query("isolation_forest")
def _(spark, sf):
    return ML.isolation_forest(table(spark, sf, "lineitem"), NUM)


@query("local_outlier_factor")
def _(spark, sf):
    return ML.local_outlier_factor(table(spark, sf, "lineitem"), NUM)


def lof_sql(columns, t, k=20):
    """All pairs; LOF from the k nearest of every row. Rows must be distinct and distances untied."""
    z = ", ".join(f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(columns))
    gap = " + ".join(f"pow(a.z{i} - b.z{i}, 2)" for i in range(len(columns)))
    names = ", ".join(f"z{i}" for i in range(len(columns)))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {', '.join(columns)}) AS id, {z} FROM {t}),
      nn AS MATERIALIZED (SELECT a.id, b.id AS nid, sqrt({gap}) AS d FROM v a JOIN v b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {gap}) <= {k}),
      kd AS (SELECT id, max(d) AS kd FROM nn GROUP BY id),
      lrd AS MATERIALIZED (SELECT nn.id, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.id = nn.nid GROUP BY nn.id),
      lof AS (SELECT nn.id, avg(o.lrd) / any_value(m.lrd) AS lof FROM nn JOIN lrd o ON o.id = nn.nid JOIN lrd m ON m.id = nn.id GROUP BY nn.id)
      SELECT {names}, CAST(1 AS BIGINT) AS w, lof, lof > (SELECT quantile_cont(lof, 0.95) FROM lof) AS anomaly FROM v JOIN lof USING (id)"""


@query("local_outlier_factor_customer", lof_sql(["c_acctbal", "c_custkey"], "customer"), "z0 z1 lof")
def _(spark, sf):
    return ML.local_outlier_factor(table(spark, sf, "customer"), ["c_acctbal", "c_custkey"], leaf_size=60).select("z0", "z1", "w", "lof", "anomaly")


@query("anomaly_consensus")
def _(spark, sf):
    return ML.anomaly_consensus(table(spark, sf, "lineitem"), NUM).withColumn("pct", F.col("pct"))


@query("anomaly_score_histogram")
def _(spark, sf):
    return ML.anomaly_score_histogram(table(spark, sf, "lineitem"), NUM)
