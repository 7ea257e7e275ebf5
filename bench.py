"""Headline queries at $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tablescope.catalog import load  # noqa: E402
from tablescope.session import local_session  # noqa: E402

HEADLINE = (
    "read_parquet", "semantic_types_lineitem", "best_semantic", "column_overview_lineitem", "table_overview", "missing_by_column",
    "duplicate_rows", "near_constant", "standardized_issues_customer_dirty", "numeric_summary", "iqr_outliers", "histogram", "kde",
    "boxplot_stats", "qq_points", "ecdf", "categorical_summary", "pareto", "text_summary", "pearson_pairs", "spearman_pairs", "group_stats",
    "anova_oneway", "kruskal_wallis", "cramers_v", "vif", "pca", "mann_whitney_u", "fdr_bh", "quality_score", "pii_candidates", "fairness",
    "series_prepare", "rolling_mean", "acf", "adf_test", "stl_decompose", "cusum_change_points", "datetime_gaps", "mutual_information",
    "isolation_forest", "tokenize", "term_stats", "bm25_topk",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = load()[0]
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    only = sys.argv[1:]
    for name in only or HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
