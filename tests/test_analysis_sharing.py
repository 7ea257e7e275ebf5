"""Results of one analysis that need the same step share it, and differ in nothing from the operators alone."""

from collections import Counter
from datetime import datetime, timedelta

import numpy as np

from tablescope.context import AnalysisContext
from tablescope.operators import bivariate as BI
from tablescope.operators import ml as ML
from tablescope.operators import timeseries as TS
from tablescope.plans.pipeline import run_analysis


def rows_of(df):
    def plain(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in df.collect())


def test_models_share_their_steps(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 300
    x = rng.normal(size=n)
    data = [(datetime(2024, 1, 1) + timedelta(hours=i), float(a), float(a + b), "uvw"[i % 3], "pq"[i % 2]) for i, (a, b) in enumerate(zip(x, rng.normal(size=n), strict=True))]
    df = spark.createDataFrame(data, "t timestamp_ntz, a double, b double, c string, d string").repartition(3)
    types = {"t": "datetime", "a": "numeric_continuous", "b": "numeric_continuous", "c": "categorical_nominal", "d": "categorical_nominal"}
    calls = Counter()
    for module, names in ((ML, ("kmeans_sweep", "kmeans_assign", "lof_scores", "isolation_scores")), (BI, ("num_cat_tests", "group_stats", "cramers_v")),
                          (TS, ("stationarity", "cusum_change_points", "acf"))):
        for name in names:
            def counted(*args, _made=getattr(module, name), _name=name, **named):
                calls[_name] += 1
                return _made(*args, **named)
            monkeypatch.setattr(module, name, counted)
    found = run_analysis(df, AnalysisContext(semantic_overrides=types, max_series=1), ["bivariate", "timeseries", "ml"])
    assert calls == dict.fromkeys(calls, 1) and len(calls) == 10
    assert not [m for m in found if "error" in found[m]]
    monkeypatch.undo()
    nums, cats = ["a", "b"], ["c", "d"]
    assert rows_of(found["bivariate"]["findings"]) == rows_of(BI.bivariate_findings(df, nums, cats))
    assert rows_of(found["ml"]["clusters"]) == rows_of(ML.kmeans_best(df, nums))
    assert rows_of(found["ml"]["anomalies"]) == rows_of(ML.anomaly_consensus(df, nums))
    assert rows_of(found["ml"]["anomaly_scores"]) == rows_of(ML.anomaly_score_histogram(df, nums))
    series = [name.split(":")[1] for name in found["timeseries"] if name.startswith("findings:")]
    prepared = TS.series_prepare(df, "t", series[0])
    assert rows_of(found["timeseries"][f"findings:{series[0]}"]) == rows_of(TS.timeseries_findings(prepared))
    assert rows_of(found["timeseries"][f"pacf:{series[0]}"]) == rows_of(TS.pacf(prepared))
    found.release()
