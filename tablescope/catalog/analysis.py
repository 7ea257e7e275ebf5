"""The whole analysis as one query."""

from __future__ import annotations

from tablescope.catalog.common import query, table
from tablescope.context import AnalysisContext, CleaningAction
from tablescope.plans.pipeline import run_analysis, summary


def _analysis(spark, sf, modules):
    ctx = AnalysisContext(target="o_orderstatus", problem_type="classification", cleaning_actions=(CleaningAction("drop_duplicate_rows"),))
    results = run_analysis(table(spark, sf, "orders_missing"), ctx, modules)
    out = summary(results)
    results.release()
    return out


@query("run_analysis")
def _(spark, sf):
    return _analysis(spark, sf, ["overview", "data_quality", "univariate", "inference", "governance"])


@query("run_analysis_models")
def _(spark, sf):
    """The other four modules: two queries, as each module runs dozens of jobs."""
    return _analysis(spark, sf, ["bivariate", "multivariate", "timeseries", "ml"])
