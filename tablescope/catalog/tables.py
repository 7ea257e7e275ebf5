"""Sources, sinks, sampling, cleaning, derived columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablescope.catalog.common import VIEWS, duck, query, table
from tablescope.context import AcceptedFeature, CleaningAction
from tablescope.operators import cleaning as C
from tablescope.operators import features as FE
from tablescope.session import shared_folder
from tablescope.sources import files as SF
from tablescope.sources import sampling as SA


def _folder(spark, kind):
    return f"{shared_folder(spark)}/tablescope-{kind}-{uuid.uuid4().hex}"


ORDERS_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                 "o_orderdate timestamp_ntz, o_orderpriority string")
BY_STATUS = """SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, sum(o_totalprice) AS total,
    CAST(min(o_orderdate) AS VARCHAR) AS first_date, CAST(max(o_orderdate) AS VARCHAR) AS last_date
    FROM orders GROUP BY o_orderstatus"""


def _by_status(df):
    return df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"),
        F.sum("o_totalprice").alias("total"), F.min("o_orderdate").cast("string").alias("first_date"),
        F.max("o_orderdate").cast("string").alias("last_date"))


@query("read_csv_strict", BY_STATUS, "total")
def _(spark, sf):
    path = _folder(spark, "csv")
    table(spark, sf, "orders").write.option("header", True).csv(path)
    return _by_status(SF.read_csv_strict(spark, path, ORDERS_SCHEMA))


@query("read_csv_lenient", BY_STATUS, "total")
def _(spark, sf):
    path = _folder(spark, "csv2")
    table(spark, sf, "orders").write.option("header", True).option("sep", ";").csv(path)
    df = SF.read_csv_lenient(spark, path)
    return _by_status(df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")))


@query("csv_report", """
    SELECT position, "column", dtype, count(*) AS n_rows, count(cell) AS n_filled,
        count(*) FILTER (dtype = 'bigint' AND NOT regexp_full_match(cell, '[0-9]+') OR dtype = 'date' AND TRY_CAST(cell AS DATE) IS NULL) AS n_bad,
        min(cell) FILTER (dtype = 'bigint' AND NOT regexp_full_match(cell, '[0-9]+') OR dtype = 'date' AND TRY_CAST(cell AS DATE) IS NULL) AS example
    FROM (SELECT unnest([
        {'position': 0, 'column': 'o_orderkey', 'dtype': 'bigint', 'cell': CAST(o_orderkey AS VARCHAR)},
        {'position': 1, 'column': 'customer', 'dtype': 'bigint', 'cell': CASE WHEN o_orderkey % 97 = 0 THEN 'n/a ' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END},
        {'position': 2, 'column': 'day', 'dtype': 'date', 'cell': CASE WHEN o_orderkey % 89 = 0 THEN '2024-02-30' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END},
        {'position': 3, 'column': 'o_orderstatus', 'dtype': 'string', 'cell': CASE WHEN o_orderkey % 83 <> 0 THEN o_orderstatus END},
        {'position': 4, 'column': NULL, 'dtype': 'line', 'cell': ''}], recursive := true) FROM orders) GROUP BY ALL""")
def _(spark, sf):
    path = _folder(spark, "csv3")
    key = F.col("o_orderkey")
    table(spark, sf, "orders").select(
        key, F.when(key % 97 == 0, F.concat(F.lit("n/a "), key.cast("string"))).otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(key % 89 == 0, "2024-02-30").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("day"),
        F.when(key % 83 != 0, F.col("o_orderstatus")).alias("o_orderstatus")).write.option("header", True).csv(path)
    return SF.csv_report(spark, path, bad_share=0.05)


@query("read_json", BY_STATUS, "total")
def _(spark, sf):
    path = _folder(spark, "json")
    table(spark, sf, "orders").write.json(path)
    return _by_status(SF.read_json(spark, path, ORDERS_SCHEMA))


@query("read_parquet", BY_STATUS, "total")
def _(spark, sf):
    return _by_status(SF.read_parquet(spark, f"{sf}/orders.parquet"))


@query("write_parquet", BY_STATUS, "total")
def _(spark, sf):
    path = SF.write_parquet(table(spark, sf, "orders"), _folder(spark, "parquet"))
    return _by_status(SF.read_parquet(spark, path))


@query("schema_summary", """
    SELECT (SELECT count(*) FROM orders) AS n_rows, 6 AS n_columns, * FROM (VALUES
      (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'),
      (3, 'o_totalprice', 'double'), (4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string'))
      AS t(position, "column", dtype)""")
def _(spark, sf):
    return SF.schema_summary(table(spark, sf, "orders"))


@query("preview", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20")
def _(spark, sf):
    return SF.preview(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), 20, ["o_orderkey"])


@query("estimated_size", """
    SELECT 0 AS position, 'doc_id' AS "column", CAST(count(*) * 8 AS BIGINT) AS n_bytes, count(*) * 8 / 1048576.0 AS mb
    FROM documents UNION ALL
    SELECT 1, 'text', CAST(sum(strlen(text)) AS BIGINT), sum(strlen(text)) / 1048576.0 FROM documents UNION ALL
    SELECT 2, 'lang', CAST(sum(strlen(lang)) AS BIGINT), sum(strlen(lang)) / 1048576.0 FROM documents UNION ALL
    SELECT 3, 'source', CAST(sum(strlen(source)) AS BIGINT), sum(strlen(source)) / 1048576.0 FROM documents UNION ALL
    SELECT 4, 'n_chars', CAST(count(*) * 8 AS BIGINT), count(*) * 8 / 1048576.0 FROM documents""", "mb")
def _(spark, sf):
    return SF.estimated_size(table(spark, sf, "documents"))


@query("sample_fixed")
def _(spark, sf):
    return SA.sample_fixed(table(spark, sf, "lineitem"), n=1_000, threshold=2_000)


@query("sample_info", """SELECT count(*) > 100000 AS will_sample, count(*) AS original_rows,
    CAST(CASE WHEN count(*) > 100000 THEN 50000 ELSE count(*) END AS BIGINT) AS sample_rows,
    CAST(100000 AS BIGINT) AS threshold FROM lineitem""")
def _(spark, sf):
    return SA.sample_info(table(spark, sf, "lineitem"))


@query("content_hash")
def _(spark, sf):
    return SF.content_hash(table(spark, sf, "lineitem"))


# ── cleaning ──────────────────────────────────────────────────────────────────────────────────

@query("exclude_column", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders", "o_totalprice")
def _(spark, sf):
    df = table(spark, sf, "orders")
    for c in ("o_orderstatus", "o_orderdate", "o_orderpriority", "not_there"):
        df = C.exclude_column(df, c)
    return df


@query("drop_duplicate_rows",
       f"SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate,"
       f" o_orderpriority FROM {duck('orders_dup')}", "o_totalprice")
def _(spark, sf):
    return C.drop_duplicate_rows(table(spark, sf, "orders_dup"))


TOKENS = "'', 'na', 'n/a', 'null', 'none', 'nan', 'nd', 'n.d.', '-', '--', '?'"


@query("replace_values_exact", f"""SELECT c_custkey, CASE WHEN c_mktsegment IN ('--', 'BUILDING') THEN NULL
    ELSE c_mktsegment END AS c_mktsegment FROM {duck('customer_dirty')}""")
def _(spark, sf):
    df = table(spark, sf, "customer_dirty").select("c_custkey", "c_mktsegment")
    return C.replace_values_exact(df, "c_mktsegment", ["--", "BUILDING"])


@query("replace_values_normalized", f"""SELECT c_custkey, CASE WHEN lower(trim(c_mktsegment)) IN ({TOKENS}) THEN NULL
    ELSE c_mktsegment END AS c_mktsegment FROM {duck('customer_dirty')}""")
def _(spark, sf):
    df = table(spark, sf, "customer_dirty").select("c_custkey", "c_mktsegment")
    return C.replace_values_normalized(df, "c_mktsegment", ["", "NA", "N/A", "null", "none", "nan", "nd", "n.d.", "-", "--", "?"])


@query("trim_whitespace", f"SELECT c_custkey, trim(c_mktsegment) AS c_mktsegment FROM {duck('customer_dirty')}")
def _(spark, sf):
    return C.trim_whitespace(table(spark, sf, "customer_dirty").select("c_custkey", "c_mktsegment"), "c_mktsegment")


RECIPE = [
    CleaningAction("exclude_column", "c_name"), CleaningAction("exclude_column", "c_acctbal"),
    CleaningAction("replace_values", "c_mktsegment",
                   {"match_mode": "exact_case_insensitive_trimmed", "values": ["n/a", "--", ""]}),
    CleaningAction("trim_whitespace", "c_mktsegment"), CleaningAction("exclude_column", "c_custkey"),
    CleaningAction("drop_duplicate_rows"), CleaningAction("not_an_action", "c_mktsegment"),
]
RECIPE_SQL = f"""SELECT DISTINCT c_nationkey, CASE WHEN lower(trim(c_mktsegment)) IN ('n/a', '--', '') THEN NULL
    ELSE trim(c_mktsegment) END AS c_mktsegment FROM {duck('customer_dirty')}"""


@query("apply_cleaning", RECIPE_SQL)
def _(spark, sf):
    return C.apply_cleaning(table(spark, sf, "customer_dirty"), RECIPE)


@query("cleaning_report", f"""SELECT b AS rows_before, a AS rows_after, b - a AS rows_removed, 5 AS columns_before,
    2 AS columns_after, 3 AS columns_removed FROM (SELECT (SELECT count(*) FROM customer) AS b,
    (SELECT count(*) FROM ({RECIPE_SQL})) AS a)""")
def _(spark, sf):
    before = table(spark, sf, "customer_dirty")
    return C.cleaning_report(before, C.apply_cleaning(before, RECIPE))


# ── derived columns ───────────────────────────────────────────────────────────────────────────

@query("derive_revenue", "SELECT l_orderkey, l_quantity * l_extendedprice AS revenue FROM lineitem", "revenue")
def _(spark, sf):
    return FE.derive_revenue(table(spark, sf, "lineitem"), "revenue", "l_quantity", "l_extendedprice").select("l_orderkey", "revenue")


@query("derive_margin", f"SELECT p_partkey, retail_price - supplier_cost AS margin FROM {duck('sales')}", "margin")
def _(spark, sf):
    return FE.derive_margin(table(spark, sf, "sales"), "margin", "retail_price", "supplier_cost").select("p_partkey", "margin")


@query("derive_margin_pct", f"""SELECT p_partkey, (retail_price - supplier_cost) / nullif(retail_price, 0) * 100 AS margin_pct
    FROM {duck('sales')}""", "margin_pct")
def _(spark, sf):
    return FE.derive_margin_pct(table(spark, sf, "sales"), "margin_pct", "retail_price", "supplier_cost").select("p_partkey", "margin_pct")


@query("derive_ratio", "SELECT l_orderkey, l_extendedprice / nullif(l_discount, 0) AS ratio FROM lineitem", "ratio")
def _(spark, sf):
    return FE.derive_ratio(table(spark, sf, "lineitem"), "ratio", "l_extendedprice", "l_discount").select("l_orderkey", "ratio")


@query("derive_discount", """SELECT l_orderkey, l_extendedprice * (1 - CASE WHEN (SELECT max(l_discount) FROM lineitem) <= 1
    THEN l_discount ELSE l_discount / 100 END) AS net FROM lineitem""", "net")
def _(spark, sf):
    return FE.derive_discount(table(spark, sf, "lineitem"), "net", "l_extendedprice", "l_discount").select("l_orderkey", "net")


@query("derive_year", "SELECT l_orderkey, year(l_shipdate) AS y FROM lineitem")
def _(spark, sf):
    return FE.derive_year(table(spark, sf, "lineitem"), "y", "l_shipdate").select("l_orderkey", "y")


@query("derive_month", "SELECT l_orderkey, month(l_shipdate) AS m FROM lineitem")
def _(spark, sf):
    return FE.derive_month(table(spark, sf, "lineitem"), "m", "l_shipdate").select("l_orderkey", "m")


FEATURES = [
    AcceptedFeature("gross", "revenue", ("l_quantity", "l_extendedprice"), "l_quantity * l_extendedprice"),
    AcceptedFeature("net", "discount", ("gross", "l_discount"), "gross * (1 - l_discount)"),
    AcceptedFeature("ship_year", "derived_feature", ("l_shipdate",), " YEAR( l_shipdate ) "),
    AcceptedFeature("broken", "ratio", ("l_quantity", "nowhere"), "l_quantity / nowhere"),
    AcceptedFeature("", "ratio", ("l_quantity", "l_tax"), "l_quantity / l_tax"),
]


@query("apply_features", """SELECT l_orderkey, l_quantity * l_extendedprice AS gross,
    l_quantity * l_extendedprice * (1 - l_discount) AS net, year(l_shipdate) AS ship_year FROM lineitem""", "gross net")
def _(spark, sf):
    df, _warnings = FE.apply_features(table(spark, sf, "lineitem"), FEATURES)
    return df.select("l_orderkey", "gross", "net", "ship_year")


@query("derive_revenue_from_text", f"""SELECT p_partkey, CAST(size_text AS DOUBLE) * retail_price AS revenue
    FROM {duck('sales')}""", "revenue")
def _(spark, sf):
    return FE.derive_revenue(table(spark, sf, "sales"), "revenue", "size_text", "retail_price").select("p_partkey", "revenue")
