import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tablescope.functions import series as SE
from tablescope.operators import timeseries as TS

START = dt.datetime(2024, 1, 1)


def prepared(spark, x, key="a"):
    pdf = pd.DataFrame({"k": key, "t": [START + dt.timedelta(hours=i) for i in range(len(x))], "v": x})
    return TS.series_prepare(spark.createDataFrame(pdf).repartition(5), "t", "v", "k").persist()


def walk(n=400, seed=0):
    return np.cumsum(np.random.default_rng(seed).normal(size=n))


def naive_cusum(x):
    alarms, hi, lo, mean, sd = [], 0.0, 0.0, x.mean(), x.std()
    for i, v in enumerate(x):
        z = (v - mean) / sd
        hi, lo = max(0.0, hi + z - 0.5), max(0.0, lo - z - 0.5)
        if hi > 5 or lo > 5:
            alarms.append(i + 1)
            hi = lo = 0.0
            mean, sd = x[i:].mean(), x[i:].std()
            if sd == 0:
                break
    return alarms


@pytest.mark.parametrize("block", [37, 100_000])
def test_cusum_over_blocks_equals_the_sequential_scan(spark, block):
    x = np.concatenate([np.random.default_rng(7).normal(size=300), np.random.default_rng(8).normal(3.0, size=200)])
    got = sorted(r["rn"] for r in TS.cusum_change_points(prepared(spark, x), block).collect())
    assert got == naive_cusum(x) and len(got) > 3


def test_short_series_are_dropped(spark):
    assert TS.series_prepare(spark.createDataFrame([(START, float(i)) for i in range(9)], "t timestamp_ntz, v double"), "t", "v").count() == 0


def test_acf_and_pacf_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(TS, "BLOCK", 60)
    x = walk()
    s = prepared(spark, x)
    d = x - x.mean()
    want = np.array([(d[k:] * d[:len(d) - k]).sum() / (d * d).sum() for k in range(41)])
    got = [r["acf"] for r in TS.acf(s).orderBy("lag").collect()]
    assert got == pytest.approx(want, abs=1e-10)
    pacf = [r["pacf"] for r in TS.pacf(s).orderBy("lag").collect()]
    for k in (1, 2, 5, 10):
        toeplitz = np.array([[want[abs(i - j)] for j in range(k)] for i in range(k)])
        assert pacf[k] == pytest.approx(np.linalg.solve(toeplitz, want[1:k + 1])[-1], abs=1e-8)


def direct_adf(x):
    n = len(x)
    max_lag = min(n // 2 - 2, int(np.ceil(12 * (n / 100) ** 0.25)))
    d = np.diff(x)

    def fit(lag, start):
        y = d[start:]
        cols = [x[start:-1], np.ones(len(y))] + [d[start - j:len(d) - j] for j in range(1, lag + 1)]
        a = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        ssr = ((y - a @ beta) ** 2).sum()
        aic = len(y) * (np.log(2 * np.pi) + np.log(ssr / len(y)) + 1) + 2 * a.shape[1]
        se = np.sqrt(ssr / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[0, 0])
        return aic, beta[0] / se
    lag = min(range(max_lag + 1), key=lambda p: fit(p, max_lag)[0])
    return fit(lag, lag)[1], lag


@pytest.mark.parametrize("x", [walk(300, 1), np.random.default_rng(2).normal(size=300)])
def test_adf_from_blocks_equals_direct_regression(spark, monkeypatch, x):
    monkeypatch.setattr(TS, "BLOCK", 70)
    r = TS.adf_test(prepared(spark, x)).first()
    tau, lag = direct_adf(x)
    assert r["statistic"] == pytest.approx(tau, rel=1e-6) and r["lag"] == lag


def test_adf_pvalue_at_critical_values():
    # MacKinnon's asymptotic 1 %, 5 % and 10 % points with a constant.
    assert [SE.adf_pvalue(t) for t in (-3.43, -2.86, -2.57)] == pytest.approx([0.01, 0.05, 0.10], abs=0.002)


def direct_kpss(x):
    n, e = len(x), x - x.mean()
    cov = int(n ** (2 / 9))
    s0, s1 = (e ** 2).sum() / n, 0.0
    for i in range(1, cov + 1):
        p = e[i:] @ e[:n - i] / (n / 2)
        s0, s1 = s0 + p, s1 + i * p
    lags = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)))
    s = (e ** 2).sum() + 2 * sum(e[i:] @ e[:n - i] * (1 - i / (lags + 1)) for i in range(1, lags + 1))
    return (np.cumsum(e) ** 2).sum() / n ** 2 / (s / n), lags


@pytest.mark.parametrize("x", [walk(300, 3), np.random.default_rng(4).normal(size=300)])
def test_kpss_from_blocks_equals_direct_sums(spark, monkeypatch, x):
    monkeypatch.setattr(TS, "BLOCK", 70)
    r = TS.kpss_test(prepared(spark, x)).first()
    stat, lags = direct_kpss(x)
    assert r["statistic"] == pytest.approx(stat, rel=1e-8) and r["lags"] == lags


def test_stationarity_tells_noise_from_walk(spark):
    noise = TS.stationarity(prepared(spark, np.random.default_rng(6).normal(size=500))).first()
    moving = TS.stationarity(prepared(spark, walk(500, 9))).first()
    assert noise["stationary"] and not moving["stationary"]


def test_stl_blocks_equal_the_whole_series(spark):
    n = 6000
    x = 0.01 * np.arange(n) + np.sin(np.arange(n) * 2 * np.pi / 13) * 3 + np.random.default_rng(1).normal(scale=0.2, size=n)
    rows = TS.stl_decompose(prepared(spark, x), block=1500).orderBy("rn").collect()
    trend, season = SE.stl(x, 13, n)
    assert [r["trend"] for r in rows] == pytest.approx(trend, abs=1e-6)
    assert [r["seasonal"] for r in rows] == pytest.approx(season, abs=1e-6)
    assert np.std([r["resid"] for r in rows]) < 0.35


def test_gaps_and_frequency(spark):
    hours = [h for h in range(100) if h not in (20, 21, 50)]
    df = spark.createDataFrame([(START + dt.timedelta(hours=h),) for h in hours], "t timestamp_ntz")
    r = TS.datetime_gaps(df, ["t"]).first()
    assert (r["inferred_frequency"], r["n_gaps"], r["has_gaps"]) == ("1H", 2, True)


def test_rolling_mean_matches_pandas(spark):
    x = walk(200, 5)
    got = {r["rn"]: r["rolling_mean"] for r in TS.rolling_mean(prepared(spark, x)).collect()}
    want = pd.Series(x).rolling(20).mean()
    assert len(got) == 181 and all(got[i + 1] == pytest.approx(want[i], abs=1e-9) for i in range(19, 200))


@pytest.mark.parametrize("chunk", [7, 1_000_000])
def test_copies_of_one_row_are_all_kept(spark, monkeypatch, chunk):
    monkeypatch.setattr(TS, "COPY_CHUNK", chunk)
    x = [1.0] * 30 + [2.0] * 20 + [float(i) for i in range(10)]
    t = [START] * 50 + [START + dt.timedelta(days=1 + i) for i in range(10)]
    s = TS.series_prepare(spark.createDataFrame(list(zip(t, x)), "t timestamp_ntz, v double"), "t", "v")
    rows = s.orderBy("rn").collect()
    assert [r["rn"] for r in rows] == list(range(1, 61)) and [r["x"] for r in rows] == x
    d = np.array(x) - np.mean(x)
    assert [r["drift"] for r in rows] == pytest.approx(np.cumsum(d), abs=1e-9)
    gaps = TS.datetime_gaps(spark.createDataFrame([(v,) for v in t], "t timestamp_ntz"), ["t"])
    assert gaps.count() == 0  # the median step is zero


def test_cusum_alarms_inside_copies(spark):
    x = np.concatenate([np.zeros(150), np.full(150, 1.0), np.random.default_rng(1).normal(size=50)])
    assert sorted(r["rn"] for r in TS.cusum_change_points(prepared(spark, x), 40).collect()) == naive_cusum(x)


def test_series_on_different_levels_keep_their_moments(spark):
    import numpy as np

    from tablescope.operators import timeseries as TS
    x = np.random.default_rng(1).normal(size=3000)
    rows = [(key, i, float(v + level)) for key, level in (("a", 0.0), ("b", 1e9)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, t long, v double").selectExpr("k", "timestamp_seconds(t) as ts", "v")
    s = TS.series_prepare(df, "ts", "v", "k")
    ss = {r["series_key"]: r["ss"] for r in s.groupBy("series_key").agg({"ss": "max"}).withColumnRenamed("max(ss)", "ss").collect()}
    want = float(((x - x.mean()) ** 2).sum())
    assert abs(ss["a"] - want) < 1e-6 * want and abs(ss["b"] - want) < 1e-3 * want
    lag = {r["series_key"]: r["acf"] for r in TS.acf(s).where("lag = 1").collect()}
    assert abs(lag["a"] - lag["b"]) < 1e-4


def test_a_quiet_stretch_is_one_round(spark, monkeypatch):
    """One early alarm, then many quiet blocks: checkpoints do not follow the blocks."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(8.0, 1.0, size=30), np.tile([0.4, -0.4], 600)])
    s = prepared(spark, x)
    made = []
    cut = TS.cut_lineage
    monkeypatch.setattr(TS, "cut_lineage", lambda df: made.append(1) or cut(df))
    counts = {}
    for block in (100, 25):
        made.clear()
        got = sorted(r["rn"] for r in TS.cusum_change_points(s, block).collect())
        assert got == naive_cusum(x) and got
        counts[block] = len(made)
    assert counts[25] <= counts[100] + 8  # 4 times the blocks; only the rounds of the first alarms may differ


def test_cusum_of_random_series_at_many_block_sizes(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(m, 1.0, size=n) for m, n in ((0, 90), (2, 30), (0, 200), (-1, 60), (0.2, 120))])
    s = prepared(spark, x)
    for block in (10, 64, 499):
        assert sorted(r["rn"] for r in TS.cusum_change_points(s, block).collect()) == naive_cusum(x), block
