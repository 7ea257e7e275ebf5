"""Semantic types, detectors, suggestions, overview."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tablescope.catalog.common import duck, query, table
from tablescope.functions import keywords as K
from tablescope.operators import features as FE
from tablescope.operators import overview as O
from tablescope.operators import semantic as S

# Column kinds of the tables used below (the twins must not ask Spark).
COLUMNS = {
    "lineitem": [("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"),
                 ("l_linenumber", "integer"), ("l_quantity", "float"), ("l_extendedprice", "float"),
                 ("l_discount", "float"), ("l_tax", "float"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "temporal")],
    "orders_missing": [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"),
                       ("o_totalprice", "float"), ("o_orderdate", "temporal"), ("o_orderpriority", "string")],
    "documents_labelled": [("doc_id", "integer"), ("text", "string"), ("lang", "string"), ("source", "string"),
                           ("n_chars", "integer"), ("quality", "integer"), ("toxic", "integer")],
    "sales": [("p_partkey", "integer"), ("p_brand", "string"), ("retail_price", "float"), ("supplier_cost", "float"),
              ("discount_share", "float"), ("sold_units", "integer"), ("stock_units", "integer"),
              ("size_text", "string")],
    "people": [("c_custkey", "integer"), ("contact", "string"), ("reachable", "string"), ("c_name", "string"),
               ("home_region", "string"), ("age", "string"), ("churn", "string"), ("churn_note", "string")],
    "events": [("event_id", "integer"), ("ts", "temporal"), ("user_id", "integer"), ("event_type", "string"),
               ("value", "float"), ("props", "string")],
    "customer_dirty": [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"),
                       ("c_acctbal", "float"), ("c_mktsegment", "string")],
}
DTYPES = {"lineitem": "bigint bigint bigint int double double double double string string timestamp_ntz".split(),
          "orders_missing": "bigint bigint string double timestamp_ntz string".split(),
          "documents_labelled": "bigint string string string bigint int int".split()}


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def stats_sql(name: str) -> str:
    """One row per column: the same measurements as the typer, by plain aggregates."""
    out = []
    for i, (c, kind) in enumerate(COLUMNS[name]):
        number, text = kind in ("integer", "float"), kind == "string"
        lower = c.lower()
        affix = any(lower.startswith(a) or lower.endswith(a) for a in K.ID_AFFIXES)
        null = "CAST(NULL AS DOUBLE)"
        looks = f"(regexp_matches({c}, '[-/.]') AND regexp_matches({c}, '[0-9]') AND length({c}) >= 8)"
        out.append(f"""SELECT {i} AS position, '{c}' AS "column", '{kind}' AS kind, count(*) AS n_rows, count({c}) AS n_valid,
          count(DISTINCT {c}) AS u,
          count(DISTINCT CASE WHEN lower(CAST({c} AS VARCHAR)) NOT IN ({quoted(K.BOOLEAN)}) THEN {c} END) AS odd,
          {f'CAST(min({c}) AS DOUBLE)' if number else null} AS lo, {f'CAST(max({c}) AS DOUBLE)' if number else null} AS hi,
          {f'stddev_samp({c})' if number else null} AS sd,
          {f'avg(CASE WHEN {c} = floor({c}) THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END)' if number else null} AS whole,
          {f'avg(length({c}))' if text else null} AS avg_len,
          {f'avg(CASE WHEN {looks} THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END)' if text else null} AS looks,
          {f'count(TRY_CAST({c} AS TIMESTAMP))' if text else 0} AS parsed,
          {bool(re.search(K.ID_NAME, c, re.I))} AS named_id, {bool(re.search(K.GEO_NAME, c, re.I))} AS named_geo,
          {K.first_word_score(c, K.PRICE, .6, .4)} AS price, {K.first_word_score(c, K.QUANTITY, .6, .4)} AS quantity,
          {.5 if affix else K.first_word_score(c, K.ID, .55, .35)} AS id, {K.first_word_score(c, K.DATE, .5, .35)} AS "date",
          {.6 if '%' in c else K.first_word_score(c, K.PERCENTAGE, .45, .3)} AS percentage,
          {K.first_word_score(c, K.CATEGORICAL, .4, .25)} AS categorical, {K.first_word_score(c, K.TEXT, .5, .3)} AS txt
          FROM {duck(name)} AS t""")
    return " UNION ALL ".join(out)


def types_sql(name: str, overrides: dict | None = None) -> str:
    pinned = "".join(f"WHEN \"column\" = '{c}' THEN '{t}' " for c, t in (overrides or {}).items())
    return f"""SELECT *, CASE {pinned} WHEN kind = 'temporal' THEN 'datetime' WHEN u <= 2 AND odd = 0 THEN 'boolean'
        WHEN named_geo THEN 'geographic' WHEN named_id AND u >= 0.90 * n_rows THEN 'id'
        WHEN u >= 0.95 * n_rows AND u > 100 THEN 'id' WHEN kind = 'float' THEN 'numeric_continuous'
        WHEN kind = 'integer' AND u <= 30 THEN 'numeric_discrete' WHEN kind = 'integer' THEN 'numeric_continuous'
        WHEN parsed > 0.5 * n_valid THEN 'datetime' WHEN avg_len >= 30 AND u >= 0.5 * n_rows THEN 'text'
        ELSE 'categorical_nominal' END AS semantic_type FROM ({stats_sql(name)}) AS s"""


def verdicts_sql(name: str) -> str:
    num = "kind IN ('integer','float')"
    un = "(u + CASE WHEN n_rows > n_valid THEN 1 ELSE 0 END)"

    def pts(cond, value):
        return f"CASE WHEN {cond} THEN {value} ELSE 0 END"
    score = {
        "price": f"price + {pts(num, .2)} + {pts('lo >= 0', .1)} + {pts(num + ' AND n_valid > 0 AND u > 10', .1)}"
                 f" + {pts('sd > 0', .1)} + {pts('hi < 1000000', .05)}",
        "quantity": f"quantity + {pts(num, .15)} + {pts("kind = 'integer'", .1)}"
                    f" + {pts('lo >= 0', .15)} + {pts(num + ' AND n_valid > 0 AND u > 2', .1)}"
                    f" + CASE WHEN kind = 'float' AND whole > 0.95 THEN .1 ELSE 0 END",
        "id": f"id + CASE WHEN {un} > .95 * n_rows THEN .4 WHEN {un} > .8 * n_rows THEN .25"
              f" WHEN {un} > .6 * n_rows THEN .1 ELSE 0 END + {pts(un + ' = n_rows', .1)} - {pts(num + ' AND ' + un + ' < 20', .3)}",
        "date": "\"date\" + CASE WHEN kind = 'temporal' THEN .6 WHEN looks > .8 THEN .4 WHEN looks > .5 THEN .25 ELSE 0 END",
        "percentage": f"percentage + {pts(num, .1)} + CASE WHEN lo >= 0 AND hi <= 1 THEN .45 WHEN lo >= 0 AND hi <= 100"
                      f" THEN .35 WHEN lo >= -100 AND hi <= 100 THEN .2 ELSE 0 END",
        "categorical": f"categorical + CASE WHEN {un} <= 2 THEN .2 WHEN {un} <= 10 THEN .4 WHEN {un} <= 20 THEN .3"
                       f" WHEN {un} < .05 * n_rows THEN .2 ELSE 0 END + CASE WHEN kind = 'string' THEN .3 ELSE 0 END"
                       f" - CASE WHEN kind = 'string' AND {un} > .5 * n_rows THEN .3 ELSE 0 END",
        "text": "txt + CASE WHEN kind = 'string' THEN .2 ELSE 0 END + CASE WHEN avg_len > 80 THEN .5 WHEN avg_len > 25"
                " THEN .35 WHEN avg_len > 10 THEN .1 ELSE 0 END"
                " + CASE WHEN kind = 'string' AND n_valid > 0 AND u > .7 * n_valid THEN .1 ELSE 0 END",
    }
    return " UNION ALL ".join(
        f"""SELECT position, "column", {r} AS rnk, '{d}' AS detector,
            round(least(greatest(CAST({score[d]} AS DOUBLE), 0), 1), 6) AS confidence,
            CASE WHEN lo >= 0 AND hi <= 1 THEN '0-1' WHEN lo >= 0 AND hi <= 100 THEN '0-100'
                 WHEN lo >= -100 AND hi <= 100 THEN '-100/100' END AS scale FROM s{name}"""
        for r, d in enumerate(S.DETECTORS))


def with_verdicts(name: str, tail: str) -> str:
    return (f"WITH s{name} AS ({stats_sql(name)}), v AS ({verdicts_sql(name)}), "
            "best AS (SELECT position, \"column\" AS c, detector, confidence, scale FROM (SELECT *, row_number() OVER "
            "(PARTITION BY position ORDER BY confidence DESC, rnk) AS k FROM v) WHERE k = 1), "
            "price AS (SELECT * FROM best WHERE detector = 'price'), "
            "qty AS (SELECT * FROM best WHERE detector = 'quantity') " + tail)


for _name in ("lineitem", "orders_missing", "documents_labelled", "people"):
    @query(f"semantic_types_{_name}", f'SELECT position, "column", semantic_type FROM ({types_sql(_name)})')
    def _(spark, sf, name=_name):
        return S.semantic_types(table(spark, sf, name))

OVERRIDE = {"o_totalprice": "numeric_continuous", "o_orderstatus": "categorical_ordinal"}


@query("semantic_types_overrides", f'SELECT position, "column", semantic_type FROM ({types_sql("orders_missing", OVERRIDE)})')
def _(spark, sf):
    return S.semantic_types(table(spark, sf, "orders_missing"), OVERRIDE)


@query("semantic_groups", f"""SELECT semantic_type, count(*) AS n_columns, string_agg("column", ', ' ORDER BY position) AS columns
    FROM ({types_sql('lineitem')}) GROUP BY semantic_type""")
def _(spark, sf):
    return S.semantic_groups(table(spark, sf, "lineitem"))


for _d, _fn in (("price", S.detect_price), ("quantity", S.detect_quantity), ("id", S.detect_id), ("date", S.detect_date),
                ("categorical", S.detect_categorical), ("text", S.detect_text)):
    _t = "documents_labelled" if _d in ("text", "date") else ("people" if _d == "id" else "lineitem")

    @query(f"detect_{_d}", f"WITH s{_t} AS ({stats_sql(_t)}) SELECT \"column\", detector, confidence FROM "
           f"({verdicts_sql(_t)}) WHERE detector = '{_d}'", "confidence")
    def _(spark, sf, name=_t, fn=_fn):
        return fn(table(spark, sf, name)).drop("meta")


@query("detect_percentage", f"""WITH slineitem AS ({stats_sql('lineitem')}) SELECT "column", detector, confidence, scale
    FROM ({verdicts_sql('lineitem')}) WHERE detector = 'percentage'""", "confidence")
def _(spark, sf):
    return S.detect_percentage(table(spark, sf, "lineitem")).select(
        "column", "detector", "confidence", F.col("meta")["scale"].alias("scale"))


@query("detect_all", f"""WITH sevents AS ({stats_sql('events')}) SELECT "column", detector, confidence
    FROM ({verdicts_sql('events')})""", "confidence")
def _(spark, sf):
    return S.detect_all(table(spark, sf, "events")).select("column", "detector", "confidence")


@query("best_semantic", with_verdicts("lineitem", 'SELECT position, c AS "column", detector AS semantic_type, confidence FROM best'),
       "confidence")
def _(spark, sf):
    return S.best_semantic(table(spark, sf, "lineitem")).drop("meta")


# ── suggestions ───────────────────────────────────────────────────────────────────────────────

def _verdicts(spark, sf, name):
    """One row per column, read several times by each rule."""
    return S.best_semantic(table(spark, sf, name)).persist()


def _hits(col, words):
    return "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INT)" for w in dict.fromkeys(words)) + ")"


def _edge(col):
    return f"(least({_hits(col, K.SELLING)} / 2.0, 1) - least({_hits(col, K.COST)} / 2.0, 1))"


@query("suggest_revenue", with_verdicts("lineitem", """
    SELECT 'revenue_' || p.c || '_x_' || q.c AS name, 'revenue' AS type, p.c || ', ' || q.c AS source_columns,
      p.c || ' * ' || q.c AS formula,
      round(least((p.confidence + q.confidence) / 2 + CASE WHEN p.s = '' OR q.s = '' THEN 0
        WHEN starts_with(p.s, q.s) OR starts_with(q.s, p.s) THEN .1
        WHEN length(p.s) >= 3 AND p.s[1:3] = q.s[1:3] THEN .08 ELSE 0 END, 1), 3) AS confidence, 'pending' AS status
    FROM (SELECT *, trim(regexp_replace(lower(c), 'price|prezzo|costo', '', 'g'), '_') AS s FROM price) p,
         (SELECT *, trim(regexp_replace(lower(c), 'qty|quantity|quantita', '', 'g'), '_') AS s FROM qty) q ORDER BY p.position, q.position LIMIT 6"""), "confidence")
def _(spark, sf):
    return FE.suggest_revenue(_verdicts(spark, sf, "lineitem"), top=6)


@query("suggest_margin", with_verdicts("sales", f""", m AS (SELECT a.c AS s, b.c AS k,
      round((a.confidence + b.confidence) / 2, 3) AS f FROM price a, price b WHERE {_edge('a.c')} > 0 AND {_edge('b.c')} < 0)
    SELECT 'margin_' || s AS name, 'margin' AS type, s || ', ' || k AS source_columns, s || ' - ' || k AS formula,
      f AS confidence, 'pending' AS status FROM m UNION ALL
    SELECT 'margin_pct_' || s, 'margin_pct', s || ', ' || k, '(' || s || ' - ' || k || ') / NULLIF(' || s || ', 0) * 100',
      round(f * 0.95, 3), 'pending' FROM m"""), "confidence")
def _(spark, sf):
    return FE.suggest_margin(_verdicts(spark, sf, "sales"))


@query("suggest_discount", with_verdicts("sales", f"""
    SELECT 'net_price_' || p.c AS name, 'discount' AS type, p.c || ', ' || d.c AS source_columns,
      CASE WHEN d.scale = '0-1' THEN p.c || ' * (1 - ' || d.c || ')' ELSE p.c || ' * (1 - ' || d.c || ' / 100)' END AS formula,
      round((p.confidence + d.confidence) / 2 * 0.9, 3) AS confidence, 'pending' AS status
    FROM price p, best d WHERE d.detector IN ('price', 'percentage') AND {_hits('d.c', K.DISCOUNT)} > 0 AND p.c <> d.c
      AND (SELECT count(*) FROM price) >= 2"""), "confidence")
def _(spark, sf):
    return FE.suggest_discount(_verdicts(spark, sf, "sales"))


@query("suggest_ratio", with_verdicts("sales", """
    SELECT 'sell_through_rate' AS name, 'ratio' AS type, a.c || ', ' || b.c AS source_columns,
      a.c || ' / NULLIF(' || b.c || ', 0)' AS formula, round((a.confidence + b.confidence) / 2, 3) AS confidence,
      'pending' AS status FROM qty a, qty b WHERE contains(a.c, 'sold') AND contains(b.c, 'stock')"""), "confidence")
def _(spark, sf):
    return FE.suggest_ratio(_verdicts(spark, sf, "sales"))


@query("suggest_ratio_fallback", with_verdicts("lineitem", """, r AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, position) AS k FROM qty)
    SELECT 'ratio_' || a.c || '_per_' || b.c AS name, 'ratio' AS type, a.c || ', ' || b.c AS source_columns,
      a.c || ' / NULLIF(' || b.c || ', 0)' AS formula, round((a.confidence + b.confidence) / 2 * 0.7, 3) AS confidence,
      'pending' AS status FROM r a, r b WHERE a.k < b.k ORDER BY a.k, b.k LIMIT 3"""), "confidence")
def _(spark, sf):
    return FE.suggest_ratio(_verdicts(spark, sf, "lineitem"))


@query("suggest_datetime", with_verdicts("lineitem", """
    SELECT c || '_' || part AS name, 'derived_feature' AS type, c AS source_columns, part || '(' || c || ')' AS formula,
      0.9 AS confidence, 'pending' AS status FROM best, (VALUES ('year'), ('month')) AS p(part) WHERE detector = 'date'"""),
       "confidence")
def _(spark, sf):
    return FE.suggest_datetime(_verdicts(spark, sf, "lineitem"))


# ── overview ──────────────────────────────────────────────────────────────────────────────────

def _size(name):
    parts = []
    width = {"bigint": 8, "int": 4, "double": 8, "timestamp_ntz": 8}
    for (c, _), d in zip(COLUMNS[name], DTYPES[name]):
        parts.append(f"coalesce(sum(strlen({c})), 0)" if d == "string" else f"count(*) * {width[d]}")
    return " + ".join(parts)


@query("table_overview", f"""SELECT count(*) AS n_rows, 6 AS n_columns, count(*) * 6 AS n_cells,
    {' + '.join(f'(count(*) - count({c}))' for c, _ in COLUMNS['orders_missing'])} AS n_missing,
    CAST({_size('orders_missing')} AS BIGINT) AS n_bytes,
    (floor((2 * 10000 * (({' + '.join(f'(count(*) - count({c}))' for c, _ in COLUMNS['orders_missing'])})) + ((count(*) * 6))) / (2.0 * ((count(*) * 6)))) / 100) AS pct_missing
    FROM {duck('orders_missing')}""", "pct_missing")
def _(spark, sf):
    return O.table_overview(table(spark, sf, "orders_missing"))


def overview_sql(name):
    kinds = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DTYPES[name]))
    return f"""SELECT position, "column", CASE position {kinds} END AS dtype, semantic_type, u AS n_distinct,
        (floor((2 * 10000 * ((n_rows - n_valid)) + (n_rows)) / (2.0 * (n_rows))) / 100) AS pct_missing,
        CASE semantic_type WHEN 'id' THEN 'key' WHEN 'datetime' THEN 'temporal' WHEN 'geographic' THEN 'spatial'
        ELSE 'feature' END AS role FROM ({types_sql(name)})"""


for _name in ("lineitem", "orders_missing", "documents_labelled"):
    @query(f"column_overview_{_name}", overview_sql(_name), "pct_missing")
    def _(spark, sf, name=_name):
        return O.column_overview(table(spark, sf, name))


@query("column_role", f"""SELECT role, count(*) AS n FROM ({overview_sql('lineitem')}) GROUP BY role""")
def _(spark, sf):
    typed = S.semantic_types(table(spark, sf, "lineitem"))
    return typed.groupBy(O.column_role(F.col("semantic_type")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("overview_flags", f"""WITH t AS ({types_sql('documents_labelled')}), a AS (SELECT max(n_rows) AS n_rows, count(*) AS n,
      sum(n_rows - n_valid) * 100.0 / sum(n_rows) AS pm, count(*) FILTER (semantic_type = 'id') AS ids,
      count(*) FILTER (semantic_type LIKE 'categorical%') AS cats, count(*) FILTER (semantic_type LIKE 'numeric%') AS nums,
      count(*) FILTER (semantic_type = 'text') AS texts FROM t)
    SELECT 'high_missing' AS flag, CAST(pm AS DOUBLE) AS value FROM a WHERE pm > 20
    UNION ALL SELECT 'many_ids', ids FROM a WHERE ids > n * 0.3 UNION ALL SELECT 'mostly_categorical', cats FROM a WHERE cats > n * 0.5
    UNION ALL SELECT 'no_numeric', nums FROM a WHERE nums = 0 UNION ALL SELECT 'large_table', n_rows FROM a WHERE n_rows > 500000
    UNION ALL SELECT 'text_present', texts FROM a WHERE texts > 0""", "value")
def _(spark, sf):
    return O.overview_flags(table(spark, sf, "documents_labelled"))
