"""Quality score, privacy, fairness, advice, text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.catalog.columns import BAND, OUT_SQL, fenced
from tablescope.catalog.common import duck, per_column, query, table
from tablescope.catalog.typing import COLUMNS, DTYPES, types_sql, verdicts_sql  # noqa: F401
from tablescope.context import AcceptedFeature
from tablescope.functions import keywords as K
from tablescope.operators import governance as G
from tablescope.operators import search as SR


def p2(part, whole):
    return f"(floor((2 * 10000 * ({part}) + ({whole})) / (2.0 * ({whole}))) / 100)"


def dims_sql(name, nan="0.0"):
    cols = [c for c, _ in COLUMNS[name]]
    tops = per_column(cols, """SELECT '{c}' AS "column", max(n) AS top FROM (SELECT count(*) AS n FROM """ + duck(name) + """ WHERE {c} IS NOT NULL GROUP BY {c})""")
    return f"""(WITH t AS ({types_sql(name)}), tops AS ({tops}), dup AS (SELECT {p2('coalesce(sum(n) FILTER (n > 1), 0)', 'sum(n)')} AS pct
        FROM (SELECT count(*) AS n FROM {duck(name)} GROUP BY {', '.join(cols)})),
      a AS (SELECT {p2('sum(n_rows - n_valid)', 'sum(n_rows)')} AS missing, bool_or(semantic_type = 'datetime') AS dated,
        count(*) FILTER (u = 1 OR (u = 2 AND {p2('top', 'n_valid')} >= 99)) AS flat FROM t JOIN tops USING ("column"))
      SELECT 100 - missing AS c, 100 - dup.pct AS u, 100.0 - {nan} AS v, 100 - least(flat * 4.0, 30) AS s,
        greatest(0, least(100 - missing, 100 - dup.pct) - 2) AS a, CASE WHEN dated THEN 92.0 ELSE 70.0 END AS t FROM a, dup)"""


ROWS = (("Completeness", 25, ">95", 95, 85, "c"), ("Uniqueness", 20, ">99", 99, 95, "u"), ("Validity", 20, ">90", 90, 80, "v"),
        ("Consistency", 15, ">85", 85, 70, "s"), ("Accuracy", 10, ">85", 85, 75, "a"), ("Timeliness", 10, ">90", 90, 80, "t"))


def dimension_rows(name):
    return " UNION ALL ".join(f"""SELECT {i} AS position, '{d}' AS dimension, {w} AS weight, round({c}, 2) AS score, '{b}' AS benchmark,
      CASE WHEN {c} >= {ok} THEN 'ok' WHEN {c} >= {wa} THEN 'warning' ELSE 'critical' END AS status FROM {dims_sql(name)} AS d{i}"""
                              for i, (d, w, b, ok, wa, c) in enumerate(ROWS))


def score_sql(name):
    return f"""SELECT round(x, 2) AS total_score, CASE WHEN x >= 85 THEN 'high' WHEN x >= 70 THEN 'medium' ELSE 'low' END AS quality_band
      FROM (SELECT c * .25 + u * .2 + v * .2 + s * .15 + a * .1 + t * .1 AS x FROM {dims_sql(name)} AS d)"""


@query("quality_dimensions", dimension_rows("orders_missing"), "score")
def _(spark, sf):
    return G.quality_dimensions(table(spark, sf, "orders_missing"))


@query("quality_score", score_sql("orders_missing"), "total_score")
def _(spark, sf):
    return G.quality_score(table(spark, sf, "orders_missing"))


def pii_name_sql(name, hits):
    """``hits``: (position, column, keyword, type, action) found by reading the column names."""
    return " UNION ALL ".join(f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS pii_type, 96.0 AS confidence, 'keyword:{w}' AS reason,
      '{a}' AS action, count({c}) AS n_valid FROM {duck(name)}""" for i, c, w, t, a in hits)


def pii_pattern_sql(name, columns):
    return f"""SELECT position, "column", pii_type, CASE pii_type WHEN 'email' THEN 90.0 ELSE 82.0 END AS confidence, 'pattern:' || pii_type AS reason,
      'pseudonymize' AS action, n_valid FROM (SELECT *, CASE WHEN e >= greatest(2, n_valid * .25) THEN 'email' WHEN p >= greatest(2, n_valid * .25) THEN 'phone' END AS pii_type
      FROM ({' UNION ALL '.join(f'''SELECT {i} AS position, '{c}' AS "column", count({c}) AS n_valid,
        count(*) FILTER (regexp_matches(trim({c}), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS e,
        count(*) FILTER (regexp_matches(trim({c}), '^\\+?[0-9][0-9\\-\\s]{{7,}}$')) AS p FROM {duck(name)}''' for i, c in columns)})) WHERE pii_type IS NOT NULL"""


PEOPLE_NAMED = pii_name_sql("people", [(3, "c_name", "name", "name", "review")])
PEOPLE_PATTERN = pii_pattern_sql("people", [(1, "contact"), (2, "reachable"), (4, "home_region"), (5, "age"), (6, "churn"), (7, "churn_note")])


@query("pii_by_name", PEOPLE_NAMED, "confidence")
def _(spark, sf):
    return G.pii_by_name(table(spark, sf, "people"))


@query("pii_by_pattern", PEOPLE_PATTERN, "confidence")
def _(spark, sf):
    return G.pii_by_pattern(table(spark, sf, "people"))


@query("pii_candidates", f"{PEOPLE_NAMED} UNION ALL {PEOPLE_PATTERN}", "confidence")
def _(spark, sf):
    return G.pii_candidates(table(spark, sf, "people"))


def sizes_sql(name):
    width = {"bigint": 8, "int": 4, "double": 8, "timestamp_ntz": 8}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({f'coalesce(sum(strlen({c})), 0)' if d == 'string' else f'count(*) * {width[d]}'} AS BIGINT) AS n_bytes FROM {duck(name)}"
        for (c, _), d in zip(COLUMNS[name], DTYPES[name]))


_kinds = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DTYPES["orders_missing"]))


@query("column_schema_profile", f"""SELECT position + 1 AS index, "column", CASE position {_kinds} END AS dtype, semantic_type, u AS n_distinct,
    {p2('u', 'n_rows')} AS uniqueness_pct, pm AS pct_missing, n_bytes,
    CASE semantic_type WHEN 'id' THEN 'key' WHEN 'datetime' THEN 'temporal' WHEN 'geographic' THEN 'spatial' ELSE 'feature' END AS role,
    CASE WHEN pm >= 40 THEN 'critical' WHEN pm >= 10 THEN 'warning' WHEN semantic_type = 'id' THEN 'attention' ELSE 'ready' END AS status,
    CAST(NULL AS VARCHAR) AS pii_type, CASE WHEN semantic_type IN ('id', 'datetime', 'boolean') THEN 98 ELSE 88 END AS confidence,
    CASE WHEN semantic_type IN ('id', 'geographic') THEN 'name-based' ELSE 'dtype-profile' END AS pattern
    FROM (SELECT *, {p2('n_rows - n_valid', 'n_rows')} AS pm FROM ({types_sql('orders_missing')})) JOIN ({sizes_sql('orders_missing')}) USING ("column")""",
       "uniqueness_pct pct_missing")
def _(spark, sf):
    return G.column_schema_profile(table(spark, sf, "orders_missing"))


@query("semantic_summary", f"""SELECT semantic_type, count(*) AS n_columns, string_agg("column", ', ' ORDER BY position) FILTER (k <= 3) AS examples,
    {p2('count(*)', '11')} AS pct FROM (SELECT *, row_number() OVER (PARTITION BY semantic_type ORDER BY position) AS k FROM ({types_sql('lineitem')})) GROUP BY 1""", "pct")
def _(spark, sf):
    return G.semantic_summary(table(spark, sf, "lineitem"))


def balance_sql(name, target):
    return f"""SELECT class, n, {p2('n', 'total')} AS pct, r AS imbalance_ratio, CASE WHEN r >= 10 THEN 'critical' WHEN r >= 3 THEN 'warning' ELSE 'ok' END AS severity
      FROM (SELECT *, sum(n) OVER () AS total, CASE WHEN count(*) OVER () > 1 THEN round(max(n) OVER () * 1.0 / min(n) OVER (), 2) END AS r
      FROM (SELECT CAST({target} AS VARCHAR) AS class, count(*) AS n FROM {duck(name)} WHERE {target} IS NOT NULL GROUP BY 1))"""


@query("class_balance", balance_sql("documents_labelled", "toxic"), "pct imbalance_ratio")
def _(spark, sf):
    return G.class_balance(table(spark, sf, "documents_labelled"), "toxic")


def leak_sql(name, target):
    return f"""SELECT position, "column", risk, CASE WHEN risk = 'target_like_proxy' THEN 'medium' ELSE 'high' END AS severity,
      CASE risk WHEN 'identifier_leakage' THEN 'exclude from modeling' WHEN 'target_like_proxy' THEN 'manual review' ELSE 'review timeline before training' END AS action
      FROM (SELECT *, CASE WHEN semantic_type = 'id' THEN 'identifier_leakage' WHEN semantic_type = 'datetime' AND regexp_matches(lower("column"), 'updated|closed|resolved|approved|deleted')
        THEN 'post_event_timestamp' WHEN contains(lower("column"), '{target}') AND lower("column") <> '{target}' THEN 'target_like_proxy' END AS risk
        FROM ({types_sql(name)}) WHERE "column" <> '{target}') WHERE risk IS NOT NULL"""


@query("leakage_risks", leak_sql("people", "churn"))
def _(spark, sf):
    return G.leakage_risks(table(spark, sf, "people"), "churn")


FAIR = f"""SELECT * FROM (SELECT attribute, attribute_type, 'yes' AS positive_class, grp, n, {p2('hits', 'n')} AS positive_rate FROM (
    SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY grp) AS k FROM (
    SELECT 'home_region' AS attribute, 'geography' AS attribute_type, home_region AS grp, count(*) AS n, count(*) FILTER (churn = 'yes') AS hits FROM {duck('people')} GROUP BY 3
    UNION ALL SELECT 'age', 'age', CASE WHEN a < 25 THEN '<25' WHEN a < 45 THEN '25-44' WHEN a < 65 THEN '45-64' ELSE '65+' END, count(*), count(*) FILTER (churn = 'yes')
    FROM (SELECT *, CAST(age AS DOUBLE) AS a FROM {duck('people')}) GROUP BY 3)) WHERE n >= 10)"""


@query("fairness_groups", FAIR, "positive_rate")
def _(spark, sf):
    return G.fairness_groups(table(spark, sf, "people"), "churn")


@query("fairness", f"""SELECT *, CASE WHEN disparate_impact >= .8 THEN 'ok' WHEN disparate_impact >= .6 THEN 'warning' ELSE 'critical' END AS severity FROM (
    SELECT attribute, attribute_type, positive_class, count(*) AS n_groups, round(min(positive_rate) / greatest(max(positive_rate), 1e-6), 3) AS disparate_impact
    FROM ({FAIR}) GROUP BY 1, 2, 3 HAVING count(*) >= 2)""", "disparate_impact")
def _(spark, sf):
    return G.fairness(table(spark, sf, "people"), "churn")


PM = p2("n_rows - n_valid", "n_rows")


@query("encoding_advice", f"""SELECT "column", CASE semantic_type WHEN 'boolean' THEN 'binary' WHEN 'categorical_ordinal' THEN 'ordinal'
    ELSE CASE WHEN u > 20 THEN 'target_or_frequency' ELSE 'one_hot' END END AS strategy, {PM} AS pct_missing FROM ({types_sql('documents_labelled')})
    WHERE semantic_type IN ('boolean', 'categorical_ordinal', 'categorical_nominal')""", "pct_missing")
def _(spark, sf):
    return G.encoding_advice(table(spark, sf, "documents_labelled"))


CONTINUOUS = [c for c in "l_orderkey l_partkey l_suppkey l_quantity l_discount l_tax".split()]


@query("scaling_advice", f"""SELECT "column", CASE WHEN pct_outliers > 5 THEN 'robust' ELSE 'standard' END AS strategy, pct_outliers
    FROM ({OUT_SQL.format(f=fenced(CONTINUOUS, 'lineitem'))}) UNION ALL SELECT 'l_linenumber', 'optional', NULL""", "pct_outliers")
def _(spark, sf):
    return G.scaling_advice(table(spark, sf, "lineitem"))


@query("imputation_advice", f"""SELECT "column", pm AS pct_missing, {BAND.format(p='pm')} AS severity, CASE WHEN semantic_type LIKE 'numeric%' AND pm < 20 THEN 'median'
    WHEN semantic_type LIKE 'numeric%' THEN 'segment_median_or_drop' WHEN semantic_type LIKE 'categorical%' OR semantic_type = 'boolean' THEN 'most_frequent_or_bucket'
    WHEN semantic_type = 'datetime' THEN 'calendar_aware_or_flag' ELSE 'explicit_token_or_review' END AS strategy
    FROM (SELECT *, {PM} AS pm FROM ({types_sql('orders_missing')})) WHERE n_rows > n_valid""", "pct_missing")
def _(spark, sf):
    return G.imputation_advice(table(spark, sf, "orders_missing"))


@query("split_advice", f"""SELECT CASE WHEN bool_or(semantic_type = 'datetime') THEN 'time' ELSE 'stratified' END AS recommended, 70 AS train_pct, 15 AS validation_pct, 15 AS test_pct
    FROM ({types_sql('people')})""")
def _(spark, sf):
    return G.split_advice(table(spark, sf, "people"), "classification")


@query("split_by_time", """SELECT event_id, CASE WHEN i <= floor(.7 * (n - 1) + .5) THEN 'train' WHEN i <= floor(.85 * (n - 1) + .5) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM events)""")
def _(spark, sf):
    return G.split_by_time(table(spark, sf, "events"), "ts").select("event_id", "split")


@query("split_proportions", f"""SELECT toxic, n, n - v - t AS n_train, v AS n_validation, t AS n_test FROM (SELECT toxic, n,
      CASE WHEN n >= 3 THEN greatest(1, CAST(floor(n * 0.15 + 0.5) AS BIGINT)) ELSE 0 END AS v, CASE WHEN n >= 2 THEN greatest(1, CAST(floor(n * 0.15 + 0.5) AS BIGINT)) ELSE 0 END AS t
      FROM (SELECT toxic, count(*) AS n FROM {duck('documents_labelled')} GROUP BY 1))""")
def _(spark, sf):
    parts = G.train_valid_test_split(table(spark, sf, "documents_labelled"), ["doc_id"], "toxic")
    return parts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("split") == p).cast("bigint")).alias(f"n_{p}") for p in ("train", "validation", "test")])


@query("train_valid_test_split")
def _(spark, sf):
    return G.train_valid_test_split(table(spark, sf, "documents_labelled"), ["doc_id"], "toxic").select("doc_id", "toxic", "split")


@query("feature_advice", f"""SELECT 'gross' AS feature, 'l_quantity, l_extendedprice' AS source_columns, 'l_quantity * l_extendedprice' AS formula, 'accepted' AS status UNION ALL
    SELECT "column" || '_year/month', "column", 'calendar decomposition', 'recommended' FROM ({types_sql('lineitem')}) WHERE semantic_type = 'datetime'""")
def _(spark, sf):
    return G.feature_advice(table(spark, sf, "lineitem"), [
        AcceptedFeature("gross", "revenue", ("l_quantity", "l_extendedprice"), "l_quantity * l_extendedprice")])


@query("analysis_applicability", f"""WITH t AS (SELECT bool_or(semantic_type = 'datetime') AS d, bool_or(semantic_type = 'id') AS i, bool_or(semantic_type = 'boolean') AS b,
    bool_or(semantic_type LIKE 'numeric%') AS n FROM ({types_sql('lineitem')})) SELECT 'cohort' AS analysis, d AND i AS applicable FROM t UNION ALL
    SELECT 'survival', d AND b FROM t UNION ALL SELECT 'time_decomposition', d AND n FROM t""")
def _(spark, sf):
    return G.analysis_applicability(table(spark, sf, "lineitem"))


ALERTS = f"""SELECT CAST(row_number() OVER (ORDER BY tier, pos) AS BIGINT) AS rank, severity, issue, columns, action, owner FROM (
    SELECT 0 AS tier, pos, CASE WHEN pm >= 30 THEN 'critical' ELSE 'high' END AS severity, 'high_missing' AS issue, "column" AS columns, 'impute or exclude' AS action, 'Data Engineer' AS owner
      FROM (SELECT *, row_number() OVER (ORDER BY pm DESC, position) AS pos FROM (SELECT *, {PM} AS pm FROM ({types_sql('orders_missing')}))) WHERE pos <= 3 AND pm >= 10 UNION ALL
    SELECT 1, position, severity, risk, "column", action, CASE WHEN risk = 'identifier_leakage' THEN 'ML Lead' ELSE 'Analytics Lead' END FROM ({leak_sql('orders_missing', 'o_orderstatus')}) UNION ALL
    SELECT 2, 0, severity, 'class_imbalance', 'o_orderstatus', 'stratified split, reweighting or resampling', 'Data Scientist'
      FROM (SELECT DISTINCT severity FROM ({balance_sql('orders_missing', 'o_orderstatus')})) WHERE severity <> 'ok') ORDER BY tier, pos LIMIT 8"""


@query("critical_alerts", ALERTS)
def _(spark, sf):
    return G.critical_alerts(table(spark, sf, "orders_missing"), "o_orderstatus")


@query("executive_metrics", f"""SELECT 0 AS position, 'Data Quality Score' AS metric, total_score AS value, '>80' AS benchmark, CASE WHEN total_score >= 80 THEN 'ok' ELSE 'warning' END AS status
    FROM ({score_sql('orders_missing')}) UNION ALL SELECT position + 1, dimension, score, benchmark, status FROM ({dimension_rows('orders_missing')}) WHERE dimension <> 'Accuracy'""", "value")
def _(spark, sf):
    return G.executive_metrics(table(spark, sf, "orders_missing"))


@query("decision_matrix", f"""WITH s AS ({score_sql('orders_missing')}), l AS (SELECT count(*) AS n FROM ({leak_sql('orders_missing', 'o_orderstatus')}) WHERE severity = 'high'),
      m AS (SELECT count(*) AS n FROM ({types_sql('orders_missing')}) WHERE n_rows > n_valid)
    SELECT 'proceed_with_modeling' AS decision, CASE WHEN total_score >= 80 AND l.n = 0 THEN 'yes' ELSE 'pending' END AS status, total_score AS evidence,
      CASE WHEN total_score >= 80 AND l.n = 0 THEN 85 ELSE 62 END AS confidence FROM s, l UNION ALL
    SELECT 'request_more_data', CASE WHEN m.n > 0 THEN 'pending' ELSE 'no' END, m.n, CASE WHEN m.n > 0 THEN 78 ELSE 40 END FROM m UNION ALL
    SELECT 'escalate_privacy', 'no', 0, 25""", "evidence")
def _(spark, sf):
    return G.decision_matrix(table(spark, sf, "orders_missing"), "o_orderstatus")


@query("action_items", f"""SELECT rank AS priority, issue AS title, owner, CASE WHEN severity = 'critical' THEN 'immediate' ELSE 'sprint ' || rank END AS deadline, action
    FROM ({ALERTS}) WHERE rank <= 5""")
def _(spark, sf):
    return G.action_items(table(spark, sf, "orders_missing"), "o_orderstatus")


# ── text search ───────────────────────────────────────────────────────────────────────────────

def tokens_sql(t, doc, text):
    return f"""SELECT {doc} AS doc, term FROM (SELECT {doc}, unnest(regexp_split_to_array(regexp_replace(lower({text}), '[^\\pL\\pN\\pM\\p{{Pc}}\\s]', ' ', 'g'), '\\s+')) AS term FROM {t}) WHERE length(term) > 2"""


@query("tokenize", f"SELECT doc, term, count(*) AS n FROM ({tokens_sql('documents', 'doc_id', 'text')}) GROUP BY 1, 2")
def _(spark, sf):
    return SR.tokenize(table(spark, sf, "documents"), "doc_id", "text").groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))


@query("term_stats", f"""SELECT term, count(DISTINCT doc) AS doc_freq, ln((max(n) - count(DISTINCT doc) + .5) / (count(DISTINCT doc) + .5) + 1) AS idf
    FROM ({tokens_sql('documents', 'doc_id', 'text')}), (SELECT count(*) AS n FROM documents) GROUP BY 1""", "idf")
def _(spark, sf):
    return SR.term_stats(table(spark, sf, "documents"), "doc_id", "text")


@query("corpus_stats", f"""SELECT count(*) AS n_docs, avg(coalesce(n, 0)) AS avg_length FROM documents LEFT JOIN
    (SELECT doc, count(*) AS n FROM ({tokens_sql('documents', 'doc_id', 'text')}) GROUP BY 1) ON doc = doc_id""", "avg_length")
def _(spark, sf):
    return SR.corpus_stats(table(spark, sf, "documents"), "doc_id", "text")


QUERY = "The river, the market and the old bridge"


@query("bm25_topk", f"""WITH tok AS ({tokens_sql('documents', 'doc_id', 'text')}), len AS (SELECT d.doc_id AS doc, count(tok.term) AS l FROM documents d LEFT JOIN tok ON tok.doc = d.doc_id GROUP BY 1),
      c AS (SELECT count(*) AS n, avg(l) AS a FROM len), q AS (SELECT * FROM (VALUES ('the', 3), ('river', 1), ('market', 1), ('and', 1), ('old', 1), ('bridge', 1)) AS v(term, times)),
      tf AS (SELECT tok.doc, tok.term, times, count(*) AS f FROM tok JOIN q ON q.term = tok.term GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS d FROM tf GROUP BY 1)
    SELECT tf.doc, sum(times * ln((n - d + .5) / (d + .5) + 1) * f * 2.5 / (f + 1.5 * (.25 + .75 * l / a))) AS score
    FROM tf JOIN df ON df.term = tf.term JOIN len ON len.doc = tf.doc, c GROUP BY 1 ORDER BY score DESC, tf.doc LIMIT 3""", "score")
def _(spark, sf):
    return SR.bm25_topk(table(spark, sf, "documents"), "doc_id", "text", QUERY)


LABELS = {"contact": ["email", "phone", "call", "address"], "legal": ["license", "copyright", "terms of use", "rights"],
          "web": ["http", "www", "click", "page"], "trade": ["market", "price", "sale", "shop"]}


def _label_sql():
    hits = ", ".join("(" + " + ".join(f"CAST(regexp_matches(lower(text), '\\b{w}\\b') AS INT)" for w in ws) + f") AS {n}" for n, ws in LABELS.items())
    best = f"greatest({', '.join(LABELS)})"
    pick = " ".join(f"WHEN {n} = {best} THEN '{n}'" for n in LABELS)
    return f"SELECT doc_id AS doc, CASE WHEN {best} = 0 THEN 'other' {pick} END AS label, {best} AS hits FROM (SELECT doc_id, {hits} FROM documents)"


@query("keyword_label", _label_sql())
def _(spark, sf):
    return SR.keyword_label(table(spark, sf, "documents"), "doc_id", "text", LABELS, "other")
