"""The whole analysis of one table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from functools import cached_property
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablescope.context import AnalysisContext
from tablescope.functions import expr as X
from tablescope.operators import bivariate as BI
from tablescope.operators import cleaning as C
from tablescope.operators import features as FE
from tablescope.operators import governance as G
from tablescope.operators import inference as I
from tablescope.operators import ml as ML
from tablescope.operators import multivariate as M
from tablescope.operators import overview as O
from tablescope.operators import quality as Q
from tablescope.operators import semantic as S
from tablescope.operators import timeseries as TS
from tablescope.operators import univariate as U
from tablescope.sources.sampling import sample_fixed, sample_info

class _Run:
    """What the modules share: the prepared table, the raw result of typing, the request. ``kept`` lists what is persisted."""

    def __init__(self, full: DataFrame, table: DataFrame, ctx: AnalysisContext, kept: list[DataFrame]):
        self.full, self.table, self.ctx = full, table, ctx
        self._kept, self._made, self._lock, self._locks = kept, {}, Lock(), {}
        # One row per column; kept, because most of overview and governance is a projection of it.
        self.typed = self.kept("typed", lambda: G.profile_stats(full, ctx.semantic_overrides))()
        rows = self.typed.select("position", "column", "semantic_type").orderBy("position").collect()
        self.types = {r["column"]: r["semantic_type"] for r in rows}
        self.groups = S.group_map(self.types)
        self.numeric = self.groups["numeric_continuous"] + self.groups["numeric_discrete"]
        self.categorical = self.groups["categorical_nominal"] + self.groups["categorical_ordinal"]
        self.target = ctx.target if ctx.target in full.columns else None

    def once(self, name: str, make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        """A table that several results share, planned on first use; results are planned at the same time."""
        def get():
            with self._lock:
                lock = self._locks.setdefault(name, Lock())
            with lock:
                if name not in self._made:
                    self._made[name] = make()
            return self._made[name]
        return get

    def kept(self, name: str, make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        """The same, persisted."""
        def persisted():
            table = make().persist()
            self._kept.append(table)
            return table
        return self.once(name, persisted)

    @property
    def patterns(self) -> DataFrame:
        """At most four rows behind the one whole-row shuffle."""
        return self.kept("patterns", lambda: Q.row_patterns(self.full))()

    @property
    def pii(self) -> DataFrame:
        return self.kept("pii", lambda: G.pii_candidates(self.full))()

    @property
    def issues(self) -> DataFrame:
        return self.kept("issues", lambda: Q.standardized_issues(self.full, self.patterns))()

    @cached_property
    def worst(self) -> list[str]:
        return Q.worst_columns(self.full)


def _overview(r: _Run):
    yield "table", lambda: O.table_overview(r.full)
    yield "columns", lambda: O.column_overview(r.full, typed=r.typed)
    yield "flags", lambda: O.overview_flags(r.full, typed=r.typed)


def _data_quality(r: _Run):
    df = r.full
    yield "missing_by_column", lambda: Q.missing_by_column(df)
    yield "missing_global", lambda: Q.missing_global(df)
    yield "missing_per_row", lambda: Q.missing_per_row(df)
    order = next((c for c in [*r.groups["id"], *r.numeric] if isinstance(X.dtype(df, c), X.NUMERIC_TYPES)), None)
    if order:  # blocks of rows need an order of the rows
        yield "missing_heatmap", lambda: Q.missing_heatmap(df, order)
    yield "missing_cooccurrence", lambda: Q.missing_cooccurrence(df, r.worst)
    yield "missing_correlation", lambda: Q.missing_correlation(df, r.worst)
    yield "missing_clusters", lambda: Q.missing_clusters(df, r.worst)
    yield "duplicates", lambda: Q.duplicate_rows(df, r.patterns)
    yield "near_constant", lambda: Q.near_constant(df)
    yield "exclusion_candidates", lambda: Q.exclusion_candidates(df)
    yield "masked_missing", lambda: Q.masked_missing(df)
    yield "whitespace", lambda: Q.whitespace_issues(df)
    yield "overlap", lambda: Q.anomaly_overlap(df, r.patterns)
    yield "issues", lambda: r.issues
    yield "cleaning_summary", lambda: Q.cleaning_summary(df, r.issues)
    yield "issues_by_severity", lambda: Q.issues_by_severity(df, r.issues)


def _univariate(r: _Run):
    df, g = r.table, r.groups
    c = g["numeric_continuous"]
    if c:
        for name, operator in {"numeric": U.numeric_summary, "outliers": U.iqr_outliers, "normality": U.jarque_bera, "histogram": U.histogram,
                               "kde": U.kde, "boxplot": U.boxplot_stats, "qq": U.qq_points, "qq_band": U.qq_band, "ecdf": U.ecdf,
                               "suggestions": U.transform_suggestions}.items():
            yield name, lambda operator=operator: operator(df, c)
    if g["numeric_discrete"]:
        yield "discrete", lambda: U.discrete_summary(df, g["numeric_discrete"])
        yield "levels", lambda: U.discrete_levels(df, g["numeric_discrete"])
    if r.categorical:
        yield "categorical", lambda: U.categorical_summary(df, r.categorical)
        yield "pareto", lambda: U.pareto(df, r.categorical)
    if g["boolean"]:
        yield "boolean", lambda: U.boolean_summary(df, g["boolean"])
    if g["datetime"]:
        yield "datetime", lambda: U.datetime_summary(df, g["datetime"])
        for d in g["datetime"]:
            yield f"year:{d}", lambda d=d: U.counts_by_year(df, d)
            yield f"month:{d}", lambda d=d: U.counts_by_month(df, d)
    if g["text"]:
        yield "text", lambda: U.text_summary(df, g["text"])
        yield "text_lengths", lambda: U.text_length_histogram(df, g["text"])
    if g["id"]:
        yield "id", lambda: U.id_summary(df, g["id"])
    if g["geographic"]:
        yield "geographic", lambda: U.geo_summary(df, g["geographic"])
    if r.numeric or r.categorical or g["boolean"]:
        yield "findings", lambda: U.univariate_findings(df, c, r.categorical, g["boolean"])


def _bivariate(r: _Run):
    df, known = r.table, {}
    if len(r.numeric) >= 2:
        known["pearson"] = r.kept("pearson", lambda: BI.pearson_pairs(df, r.numeric))
        yield "pearson", known["pearson"]
        for name, operator in {"spearman": BI.spearman_pairs, "matrix": BI.correlation_matrix, "scatter": BI.scatter_sample, "trend": BI.trend_line}.items():
            yield name, lambda operator=operator: operator(df, r.numeric)
    if r.numeric and r.categorical:
        known["groups"] = r.kept("group_stats", lambda: BI.group_stats(df, r.numeric, r.categorical))
        known["tests"] = r.kept("num_cat_tests", lambda: BI.num_cat_tests(df, r.numeric, r.categorical))
        yield "group_stats", known["groups"]
        yield "tests", known["tests"]
    if len(r.categorical) >= 2:
        known["association"] = r.kept("association", lambda: BI.cramers_v(df, r.categorical))
        yield "contingency", lambda: BI.contingency_cells(df, BI.column_pairs(r.categorical))
        yield "association", known["association"]
    if len(r.numeric) >= 2 or len(r.categorical) >= 2 or (r.numeric and r.categorical):
        yield "findings", lambda: BI.bivariate_findings(df, r.numeric, r.categorical, **{name: made() for name, made in known.items()})


def _multivariate(r: _Run):
    if len(r.numeric) < 3:
        return
    df, target = r.table, r.target
    ranked = M.ranked(df, r.numeric)
    yield "variance_rank", lambda: M.variance_rank(df, r.numeric)
    yield "high_pairs", lambda: M.high_correlation_pairs(df, ranked)
    yield "correlation", lambda: M.global_correlation(df, ranked)
    yield "pca", lambda: M.pca(df, ranked)
    yield "pca_scores", lambda: M.pca_scores(df, ranked, [target] if target else [])
    yield "vif", lambda: M.vif(df, ranked)
    yield "warnings", lambda: M.ml_warnings(df, ranked, target)


def _timeseries(r: _Run):
    dates = r.groups["datetime"]
    if not dates:
        return
    values = TS.value_columns(r.numeric, r.ctx.max_series)
    yield "gaps", lambda: TS.datetime_gaps(r.table, dates)
    if values:
        yield "status", lambda: TS.series_status(r.table, dates[0], values)
    for c in values:
        prepared = r.kept(f"series:{c}", lambda c=c: TS.series_prepare(r.table, dates[0], c))
        changes, lags, tests = (r.kept(f"{name}:{c}", lambda operator=operator, prepared=prepared: operator(prepared())) for name, operator in (
            ("change_points", TS.cusum_change_points), ("acf", TS.acf), ("stationarity", TS.stationarity)))
        for name, operator in {"metadata": TS.series_metadata, "rolling": TS.rolling_mean, "stl": TS.stl_decompose}.items():
            yield f"{name}:{c}", lambda operator=operator, prepared=prepared: operator(prepared())
        yield f"change_points:{c}", changes
        yield f"acf:{c}", lags
        yield f"pacf:{c}", lambda prepared=prepared, lags=lags: TS.pacf(prepared(), lags=lags())
        yield f"stationarity:{c}", tests
        yield f"findings:{c}", lambda prepared=prepared, shared=(tests, lags, changes): TS.timeseries_findings(prepared(), *[made() for made in shared])


def _ml(r: _Run):
    df, ctx = r.table, r.ctx
    check = ML.validate_target(df, ctx.target, ctx.problem_type)
    yield "target", lambda: check
    features = M.ranked(df, [c for c in r.numeric if c != ctx.target]) if r.numeric else []
    features = [c for c in r.numeric if c in features]
    # only feature importance needs a target; clusters and anomalies are found without one
    if features and check.first()["valid"]:
        yield "mutual_information", lambda: ML.mutual_information(df, features, ctx.target, ctx.problem_type)
    if len(features) >= 2:
        sweep = r.once("kmeans_sweep", lambda: ML.kmeans_sweep(df, features))
        assigned = r.once("clusters", lambda: ML.kmeans_assign(df, features, sweep=sweep()))
        flagged = r.once("anomalies", lambda: ML.anomaly_table(df, features))  # settled
        yield "anomalies", lambda: ML.anomaly_consensus(df, features, found=flagged())
        yield "anomaly_scores", lambda: ML.anomaly_score_histogram(df, features, found=flagged())
        yield "kmeans_sweep", sweep
        yield "clusters", lambda: ML.kmeans_best(df, features, assigned=assigned())
        yield "cluster_projection", lambda: ML.cluster_projection(df, features, assigned=assigned())


def _inference(r: _Run):
    groupings = I.usable_groupings(r.table, r.groups["boolean"] + r.categorical, r.ctx.max_levels)[:r.ctx.max_groupings]
    if not r.numeric or not groupings:
        return
    tests = r.kept("tests", lambda: I.inference_table(r.table, r.numeric, groupings))  # a row per test
    yield "tests", tests
    yield "groups", lambda: I.tested_groups(r.table, r.numeric, groupings)
    yield "summary", lambda: I.inference_summary(r.table, r.numeric, groupings, tests=tests())


def _governance(r: _Run):
    df, ctx, typed, target = r.full, r.ctx, r.typed, r.target
    def known():
        return {"typed": typed, "patterns": r.patterns}
    yield "dimensions", lambda: G.quality_dimensions(df, **known())
    yield "score", lambda: G.quality_score(df, **known())
    yield "pii", lambda: r.pii
    yield "schema", lambda: G.column_schema_profile(df, typed=typed, pii=r.pii)
    yield "types", lambda: G.semantic_summary(df, typed=typed)
    yield "encoding", lambda: G.encoding_advice(df, typed=typed)
    yield "scaling", lambda: G.scaling_advice(df, types=r.types)
    yield "imputation", lambda: G.imputation_advice(df, typed=typed)
    yield "split", lambda: G.split_advice(df, ctx.problem_type, typed=typed)
    yield "features", lambda: G.feature_advice(df, list(ctx.accepted_features), typed=typed)
    yield "applicability", lambda: G.analysis_applicability(df, typed=typed)
    yield "alerts", lambda: G.critical_alerts(df, target, typed=typed, pii=r.pii)
    yield "metrics", lambda: G.executive_metrics(df, **known())
    yield "decisions", lambda: G.decision_matrix(df, target, pii=r.pii, **known())
    yield "actions", lambda: G.action_items(df, target, typed=typed, pii=r.pii)
    if target:
        yield "class_balance", lambda: G.class_balance(df, target)
        yield "leakage", lambda: G.leakage_risks(df, target, typed=typed)
        if ctx.problem_type == "classification":
            yield "fairness_groups", lambda: G.fairness_groups(df, target)
            yield "fairness", lambda: G.fairness(df, target)


#: A module yields (result, function that plans it).
MODULES: dict[str, Callable[[_Run], Iterable[tuple[str, Callable[[], DataFrame]]]]] = {
    "overview": _overview, "data_quality": _data_quality, "univariate": _univariate, "bivariate": _bivariate,
    "multivariate": _multivariate, "timeseries": _timeseries, "ml": _ml, "inference": _inference, "governance": _governance,
}


class Analysis(dict):
    """``{module: {result: DataFrame}}`` with the shared tables behind it; ``release`` gives their storage back."""

    def __init__(self, kept: list[DataFrame]):
        super().__init__()
        self._kept = kept

    def release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def run_analysis(df: DataFrame, ctx: AnalysisContext | None = None, modules: list[str] | None = None,
                 sample: bool = False, parallel: int = 8) -> Analysis:
    """Derived columns, cleaning, optional sample, typing, then the modules.

    Returns ``{module: {result: DataFrame}}``. A result that cannot be planned is reported in the ``error`` table of its
    module (module, result, error; result null if the module itself failed), and all others go on; errors of
    running a result are reported by ``summary`` and ``write_analysis``. ``meta`` holds the facts of the run: the size of the
    table, the sample, target and problem type. The analysis reads the whole table unless ``sample`` is asked
    for; overview, data quality and governance always do. Planning a result may run jobs; ``parallel`` results are planned at
    a time, and what several of them need is made once. Call ``release()`` on the result when it is no longer needed.
    """
    ctx = ctx or AnalysisContext()
    kept: list[DataFrame] = []
    results = Analysis(kept)
    full, warnings = FE.apply_features(df, list(ctx.accepted_features))
    cleaned = C.apply_cleaning(full, list(ctx.cleaning_actions))
    prepare = {"feature_warnings": warnings}
    if ctx.cleaning_actions:
        prepare["cleaning"] = C.cleaning_report(full, cleaned)
    full = cleaned
    if ctx.selected_features:
        wanted = {*ctx.selected_features, ctx.target}
        full = full.select(*[X.ref(c) for c in full.columns if c in wanted])
    if ctx.accepted_features or ctx.cleaning_actions:
        full = full.persist()
        kept.append(full)
    run = _Run(full, sample_fixed(full) if sample else full, ctx, kept)
    results["prepare"] = prepare | {"types": X.lit_rows(df, list(run.types.items()), "column string, semantic_type string")}
    results["meta"] = {"run": _metadata(run, sample)}
    with ThreadPoolExecutor(parallel) as pool:
        threaded = inheritable_thread_target(df.sparkSession)
        planned, broken = {}, {}
        for name in modules or MODULES:
            planned[name] = []
            try:
                for result, plan in MODULES[name](run):
                    planned[name].append((result, pool.submit(threaded(plan))))
            except Exception as error:  # noqa: BLE001 - one module must not stop the others
                broken[name] = _reason(error)
        for name, plans in planned.items():
            found, errors = {}, []
            for result, plan in plans:
                try:
                    found[result] = plan.result()
                except Exception as error:  # noqa: BLE001 - one result must not stop the others
                    errors.append((name, result, _reason(error)))
            if name in broken:
                errors.append((name, None, broken[name]))
            if errors:
                found["error"] = X.lit_rows(df, errors, "module string, result string, error string")
            results[name] = found
    return results


def _metadata(r: _Run, sample: bool) -> DataFrame:
    """One row: n_rows, n_columns, sampled, sample_n, target, problem_type, generated_at."""
    sampled = F.lit(sample) & F.col("will_sample")
    return sample_info(r.full).select(
        F.col("original_rows").alias("n_rows"), F.lit(len(r.full.columns)).cast("bigint").alias("n_columns"), sampled.alias("sampled"),
        F.when(sampled, F.col("sample_rows")).otherwise(F.col("original_rows")).alias("sample_n"),
        F.lit(r.ctx.target).cast("string").alias("target"), F.lit(r.ctx.problem_type).cast("string").alias("problem_type"),
        F.lit(datetime.now(UTC).isoformat()).alias("generated_at"))


def _run_each(results: dict[str, dict[str, DataFrame]], action: Callable[[str, str, DataFrame], int | None], parallel: int) -> list[tuple]:
    """(module, result, rows, seconds, error) of every result; independent jobs, submitted from a few threads."""
    frames = [(module, name, frame) for module, found in results.items() for name, frame in found.items()]

    def one(item):
        start = time.monotonic()
        try:
            return *item[:2], action(*item), time.monotonic() - start, None
        except Exception as error:  # noqa: BLE001 - reported, the others go on
            return *item[:2], None, time.monotonic() - start, _reason(error)
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(inheritable_thread_target(frames[0][2].sparkSession)(one), frames))


def write_analysis(results: dict[str, dict[str, DataFrame]], path: str, parallel: int = 4) -> dict[str, str]:
    """Write every result as Parquet under ``path/module/result`` and the log (module, result, seconds, error) under
    ``path/meta/results``; returns the failures by result."""
    log = _run_each(results, lambda module, name, frame: frame.write.mode("overwrite").parquet(f"{path}/{module}/{name.replace(':', '=')}"), parallel)
    first = next(iter(next(iter(results.values())).values()))
    X.lit_rows(first, [(m, n, s, e) for m, n, _, s, e in log], "module string, result string, seconds double, error string").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/meta/results")
    return {f"{module}/{name}": error for module, name, _, _, error in log if error}


def summary(results: dict[str, dict[str, DataFrame]], parallel: int = 8) -> DataFrame:
    """Run every result whole, all columns, and report its size: (module, result, n_rows, error), n_rows null where it failed."""
    def rows(module, name, frame):
        seen = Observation()
        frame.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        return seen.get.get("n", 0)
    log = _run_each(results, rows, parallel)
    first = next(iter(next(iter(results.values())).values()))
    return X.lit_rows(first, [(m, n, rows, e) for m, n, rows, _, e in log], "module string, result string, n_rows bigint, error string")
