"""Time-series queries on events: one long series, and one series per event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.catalog.common import per_column, query, table
from tablescope.operators import timeseries as TS


def _series(spark, sf, key="event_type"):
    return TS.series_prepare(table(spark, sf, "events"), "ts", "value", key)


RANKED = """SELECT event_type AS series_key, ts, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS rn,
    count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER (PARTITION BY event_type) AS m FROM events"""


#: Every user is a series; the value is null in nine of ten events, so that most series are too short.
@query("series_status", """SELECT CAST(user_id AS VARCHAR) AS series_key, 'value' AS value, count(*) FILTER (event_id % 10 = 0 AND "value" IS NOT NULL AND ts IS NOT NULL) AS n,
    CASE WHEN count(*) FILTER (event_id % 10 = 0 AND "value" IS NOT NULL AND ts IS NOT NULL) < 10 THEN 'too short' ELSE 'ok' END AS status FROM events GROUP BY user_id""")
def _(spark, sf):
    events = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 10 == 0, F.col("value")))
    return TS.series_status(events, "ts", ["value"], "user_id")


@query("series_prepare", f"SELECT series_key, CAST(ts AS VARCHAR) AS ts, x, rn, n, m AS mean FROM ({RANKED})", "x mean")
def _(spark, sf):
    return _series(spark, sf).select("series_key", "ts", "x", "rn", "n", "mean")


@query("series_metadata", """SELECT event_type AS series_key, count(*) AS n, CAST(min(ts) AS VARCHAR) AS min_ts, CAST(max(ts) AS VARCHAR) AS max_ts
    FROM events GROUP BY 1""")
def _(spark, sf):
    return TS.series_metadata(_series(spark, sf))


@query("rolling_mean", f"""SELECT series_key, a.rn, CAST(a.ts AS VARCHAR) AS ts, w, (p - coalesce(q, 0)) / w AS rolling_mean FROM
    (SELECT *, greatest(3, floor(n / 10)) AS w, sum(x) OVER (PARTITION BY series_key ORDER BY rn) AS p FROM ({RANKED})) a
    LEFT JOIN (SELECT series_key AS k, rn AS r, sum(x) OVER (PARTITION BY series_key ORDER BY rn) AS q FROM ({RANKED})) b
    ON k = series_key AND r = rn - w WHERE rn >= w""".replace("SELECT series_key, a.rn,", "SELECT series_key, CAST(rn AS BIGINT) AS rn,").replace("CAST(a.ts", "CAST(ts").replace(", w, (p", ", CAST(w AS BIGINT) AS w, (p"), "rolling_mean")
def _(spark, sf):
    return TS.rolling_mean(_series(spark, sf))


#: Row by row: both sums, an alarm beyond five, and from an alarm on the mean and deviation of the rest of the series.
CUSUM = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT series_key, CAST(rn AS BIGINT) AS rn, x - m AS c, avg(x - m) OVER rest AS tail_mean, stddev_pop(x - m) OVER rest AS tail_sd FROM ({RANKED})
      WINDOW rest AS (PARTITION BY series_key ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    st AS (SELECT series_key, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS lo, tail_mean AS mean, tail_sd AS sd, false AS alarm FROM d WHERE rn = 1 UNION ALL
      SELECT series_key, rn, CASE WHEN h > 5 OR l > 5 THEN 0.0 ELSE h END, CASE WHEN h > 5 OR l > 5 THEN 0.0 ELSE l END,
        CASE WHEN h > 5 OR l > 5 THEN tail_mean ELSE mean END, CASE WHEN h > 5 OR l > 5 THEN tail_sd ELSE sd END, h > 5 OR l > 5
      FROM (SELECT d.*, st.mean, st.sd, greatest(0.0, st.hi + (d.c - st.mean) / st.sd - 0.5) AS h, greatest(0.0, st.lo - (d.c - st.mean) / st.sd - 0.5) AS l
            FROM st JOIN d ON d.series_key = st.series_key AND d.rn = st.rn + 1 WHERE st.sd > 0))
    SELECT series_key, rn FROM st WHERE alarm"""


@query("cusum_change_points", CUSUM)
def _(spark, sf):
    return TS.cusum_change_points(_series(spark, sf))


LAGS = """SELECT series_key, unnest(range(0, CAST(least(40, floor(n / 3)) + 1 AS BIGINT))) AS lag, n, ss FROM
    (SELECT event_type AS series_key, count(*) AS n, sum(value * value) - count(*) * avg(value) * avg(value) AS ss FROM events GROUP BY 1)"""


@query("acf", f"""WITH d AS (SELECT *, x - m AS dev FROM ({RANKED})), l AS ({LAGS}),
    p AS (SELECT l.series_key, l.lag, l.n, sum(a.dev * b.dev) AS s FROM l JOIN d a ON a.series_key = l.series_key
      JOIN d b ON b.series_key = a.series_key AND b.rn = a.rn - l.lag GROUP BY 1, 2, 3),
    z AS (SELECT series_key, sum(dev * dev) AS ss FROM d GROUP BY 1)
    SELECT p.series_key, p.n, p.lag, s / ss AS acf, 1.96 / sqrt(p.n) AS bound, p.lag > 0 AND abs(s / ss) > 0.2 AS notable
    FROM p JOIN z ON z.series_key = p.series_key""", "acf bound")
def _(spark, sf):
    return TS.acf(_series(spark, sf))


@query("pacf")
def _(spark, sf):
    return TS.pacf(_series(spark, sf))


@query("adf_test")
def _(spark, sf):
    return TS.adf_test(_series(spark, sf))


#: Lag products by self-joins, the lag rule, then the table of critical values.
KPSS = f"""WITH d AS MATERIALIZED (SELECT series_key, rn, n, x - m AS dev FROM ({RANKED})),
    f AS (SELECT series_key, any_value(n) AS n, sum(dev * dev) AS ss, sum(drift * drift) AS eta FROM (SELECT *, sum(dev) OVER (PARTITION BY series_key ORDER BY rn) AS drift FROM d) GROUP BY 1),
    p AS MATERIALIZED (SELECT a.series_key, l.k, sum(a.dev * b.dev) AS p FROM range(1, 200) l(k) JOIN d a ON a.rn > l.k JOIN d b ON b.series_key = a.series_key AND b.rn = a.rn - l.k GROUP BY 1, 2),
    c AS (SELECT f.series_key, f.n, ss, eta, (sum(p * k) / (f.n / 2.0)) / (ss / f.n + sum(p) / (f.n / 2.0)) AS ratio FROM f JOIN p ON p.series_key = f.series_key AND k <= floor(pow(f.n, 2.0 / 9.0)) GROUP BY 1, 2, 3, 4),
    g AS (SELECT *, CAST(least(floor(1.1447 * pow(ratio * ratio, 1.0 / 3.0) * pow(n, 1.0 / 3.0)), n - 1) AS BIGINT) AS lags FROM c),
    v AS (SELECT g.series_key, lags, eta / (n * 1.0 * n) / ((ss + 2 * coalesce(sum(p * (1 - k / (lags + 1.0))), 0)) / n) AS statistic FROM g LEFT JOIN p ON p.series_key = g.series_key AND k <= lags GROUP BY 1, 2, n, eta, ss),
    q AS (SELECT *, CASE WHEN statistic >= 0.739 THEN 0.01 WHEN statistic >= 0.574 THEN 0.025 - (statistic - 0.574) * 0.015 / 0.165
      WHEN statistic >= 0.463 THEN 0.05 - (statistic - 0.463) * 0.025 / 0.111 WHEN statistic >= 0.347 THEN 0.1 - (statistic - 0.347) * 0.05 / 0.116 ELSE 0.1 END AS pvalue FROM v)
    SELECT series_key, statistic, lags, pvalue, pvalue >= 0.05 AS stationary FROM q"""


@query("kpss_test", KPSS, "statistic pvalue")
def _(spark, sf):
    return TS.kpss_test(_series(spark, sf))


@query("stationarity")
def _(spark, sf):
    return TS.stationarity(_series(spark, sf, None))


@query("stl_decompose")
def _(spark, sf):
    return TS.stl_decompose(_series(spark, sf))


@query("datetime_gaps", per_column(["ts"], """SELECT '{c}' AS "column", ms AS median_ms, CASE WHEN ms >= 86400000 THEN CAST(CAST(floor(ms / 86400000) AS BIGINT) AS VARCHAR) || 'D'
    WHEN ms >= 3600000 THEN CAST(CAST(floor(ms / 3600000) AS BIGINT) AS VARCHAR) || 'H' WHEN ms >= 60000 THEN CAST(CAST(floor(ms / 60000) AS BIGINT) AS VARCHAR) || 'min'
    ELSE CAST(ms AS VARCHAR) || 'ms' END AS inferred_frequency, g AS n_gaps, g > 0 AS has_gaps FROM (
    SELECT any_value(med) AS ms, count(*) FILTER (floor(step / 1000) > med * 1.5) AS g FROM (SELECT step, quantile_cont(step, 0.5) OVER () / 1000 AS med FROM (
    SELECT CAST(epoch_us({c}) - lag(epoch_us({c})) OVER (ORDER BY {c}) AS DOUBLE) AS step FROM events) WHERE step IS NOT NULL))""".replace(
        "quantile_cont(step, 0.5) OVER () / 1000 AS med FROM (", "(SELECT quantile_cont(s2, 0.5) / 1000 FROM (SELECT CAST(epoch_us({c}) - lag(epoch_us({c})) OVER (ORDER BY {c}) AS DOUBLE) AS s2 FROM events)) AS med FROM (")), "median_ms")
def _(spark, sf):
    return TS.datetime_gaps(table(spark, sf, "events"), ["ts"])


@query("timeseries_findings")
def _(spark, sf):
    return TS.timeseries_findings(_series(spark, sf)).withColumn("value", F.col("value"))
