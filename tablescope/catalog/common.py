"""Registration of queries: each reads whole tables and, where SQL can say it, has a DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Derived views: the same SQL on Spark and DuckDB; {table} names a base table.
VIEWS = {
    "orders_missing": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
               CASE WHEN o_orderkey % 3 = 2 THEN o_orderdate END AS o_orderdate,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS o_orderpriority
        FROM {orders}""",
    "orders_dup": """
        SELECT * FROM {orders} UNION ALL SELECT * FROM {orders} WHERE o_orderkey % 20 = 0""",
    "orders_both": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice
        FROM {orders} UNION ALL
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice
        FROM {orders} WHERE o_orderkey % 20 = 0""",
    "customer_dirty": """
        SELECT c_custkey, c_name, c_nationkey, c_acctbal,
               CASE c_custkey % 10 WHEN 0 THEN ' N/A ' WHEN 1 THEN '--' WHEN 2 THEN ''
                    WHEN 3 THEN '  ' || c_mktsegment ELSE c_mktsegment END AS c_mktsegment
        FROM {customer}""",
    "documents_labelled": """
        SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "lineitem_const": """
        SELECT *, 'x' AS fixed, CASE WHEN l_orderkey % 500 = 0 THEN 'b' ELSE 'a' END AS quasi FROM {lineitem}""",
    "sales": """
        SELECT p_partkey, p_brand, p_retailprice AS retail_price, p_retailprice * 0.6 + p_size AS supplier_cost,
               p_size / 100.0 AS discount_share, p_size AS sold_units, p_size * 3 + 1 AS stock_units,
               CAST(p_size AS VARCHAR(10)) AS size_text
        FROM {part}""",
    "people": """
        SELECT c_custkey, 'user' || CAST(c_custkey AS VARCHAR(20)) || '@example.com' AS contact,
               '+39 055 ' || CAST(1000000 + c_custkey AS VARCHAR(20)) AS reachable,
               c_name, c_mktsegment AS home_region, CAST(c_custkey % 80 AS VARCHAR(10)) AS age,
               CASE WHEN c_custkey % 3 = 0 THEN 'yes' ELSE 'no' END AS churn,
               CASE WHEN c_custkey % 4 = 0 THEN 'churn late' ELSE 'churn none' END AS churn_note
        FROM {customer}""",
}
BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in BASE if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(name: str) -> str:
    """FROM item of a base table or derived view in DuckDB."""
    if name in BASE:
        return name
    return "(" + VIEWS[name].format(**{t: t for t in BASE}) + ")"


def stable(df: DataFrame) -> DataFrame:
    """Doubles to seven significant digits: the last bits depend on the order of summation."""
    out = []
    for f in df.schema.fields:
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = (F.round(c.cast("double"), 9).cast("float").cast("double") + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            c = c.cast("string").alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint").alias(f.name)
        out.append(c)
    return df.select(*out)


def stable_sql(sql: str, doubles: str) -> str:
    cols = doubles.split()
    if not cols:
        return sql
    rep = ", ".join(f'CAST(CAST(round(CAST("{c}" AS DOUBLE), 9) AS FLOAT) AS DOUBLE) + 0.0 AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS stable_rows"


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register ``fn(spark, sf_dir)``; ``sql`` is its twin, ``doubles`` its floating columns."""
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: stable(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = stable_sql(sql, doubles)
        return fn
    return register


def per_column(columns, template: str) -> str:
    """UNION ALL of one SELECT per column; ``{c}`` is the column, ``{i}`` its position."""
    return " UNION ALL ".join(template.format(c=c, i=i) for i, c in enumerate(columns))
