"""Readers, writers and table-level facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import expr as X
from tablescope.plans import blocks as B

# Bytes per value of the fixed-width types; strings and binaries count their octets.
WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
         T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16}

# Column of a CSV table that keeps lines of too many or too few cells.
RAGGED = "_ragged_line"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^NaN$|^[+-]?Inf(inity)?$"
DAY, CLOCK = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?"
# Kinds of cells, narrow before wide: (shape, type that must take the cell as well).
KINDS = {"flag": ("^(?i:true|false)$", "boolean"), "long": (r"^[+-]?\d{1,19}$", "bigint"), "whole": (r"^[+-]?\d{1,38}$", "decimal(38,0)"),
         "number": (NUMBER, "double"), "day": (f"^{DAY}$", "date"), "time": (f"^{DAY}[ T]{CLOCK}$", "timestamp_ntz"),
         "zoned": (f"^{DAY}[ T]{CLOCK} ?(Z|[+-]\\d{{2}}:?\\d{{2}})$", "timestamp")}
# Types of columns, narrow before wide, with the kinds of cells that each takes; text takes all.
TYPES = {"boolean": ("flag",), "bigint": ("long",), "decimal(38,0)": ("long", "whole"), "double": ("long", "whole", "number"),
         "date": ("day",), "timestamp_ntz": ("day", "time"), "timestamp": ("zoned",)}


def read_csv_strict(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A value that does not fit its type is an error."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def separator(spark: SparkSession, path: str) -> str:
    """``;`` where the first line holds one and no comma, else ``,``."""
    first = spark.read.text(path).limit(1).collect()
    return ";" if first and "," not in first[0][0] and ";" in first[0][0] else ","


def read_csv_cells(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Every cell as text under the names of the header, and the whole line in ``RAGGED`` where a line has too
    many or too few cells (the surplus is cut off, the missing ones are null)."""
    reader = spark.read.option("header", True).option("sep", sep)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, RAGGED]])
    return (reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAGGED)
            .option("enforceSchema", True).csv(path))


def _kind(value: Column) -> Column:
    """Narrowest kind of one cell as its position in ``KINDS``; null for an empty cell."""
    v = F.trim(value)
    out = F.when(v == "", F.lit(None).cast("int"))
    for i, (pattern, dtype) in enumerate(KINDS.values()):
        out = out.when(F.regexp_like(v, F.lit(pattern)) & v.try_cast(dtype).isNotNull(), i)
    return F.when(value.isNotNull(), out.otherwise(len(KINDS)))


def csv_types(cells: DataFrame, bad_share: float = 0.0) -> DataFrame:
    """The narrowest type of each column of text that takes all cells but a share of ``bad_share``:
    (position, column, dtype, n_filled, n_odd).

    Every cell of the table counts: a cell becomes its kind, kinds are counted per column (added up in the map
    tasks, so at most one row per column, kind and task is sent) and the types are compared on the counts. Ties go to
    the earlier type of ``TYPES``; a column without filled cells, or that nothing narrower takes, is text.
    """
    names = [c for c in cells.columns if c != RAGGED]
    positions = cells.sparkSession.createDataFrame(list(enumerate(names)), "position int, column string")
    if not names:
        return positions.selectExpr("position", "column", "'string' AS dtype", "0L AS n_filled", "0L AS n_odd")
    kinds = cells.select(F.posexplode(F.array(*[_kind(X.ref(c)) for c in names])).alias("position", "kind"))
    counts = kinds.where("kind IS NOT NULL").groupBy("position", "kind").agg(F.count(F.lit(1)).alias("n"))
    order = list(KINDS)
    fits = {t: F.coalesce(F.sum(F.when(F.col("kind").isin([order.index(k) for k in takes]), F.col("n"))), F.lit(0)) for t, takes in TYPES.items()}
    per = counts.groupBy("position").agg(F.sum("n").alias("n_filled"), *[c.alias(f"fit_{i}") for i, c in enumerate(fits.values())])
    chosen = F.coalesce(*[F.when(F.col("n_filled") - F.col(f"fit_{i}") <= F.col("n_filled") * bad_share, F.lit(i)) for i in range(len(fits))],
                        F.lit(len(fits)))
    dtype = F.element_at(F.array(*[F.lit(t) for t in [*fits, "string"]]), F.col("chosen") + 1)
    odd = F.element_at(F.array(*[F.col("n_filled") - F.col(f"fit_{i}") for i in range(len(fits))], F.lit(0)), F.col("chosen") + 1)
    per = per.withColumn("chosen", chosen).select("position", dtype.alias("dtype"), odd.cast("bigint").alias("n_odd"), "n_filled")
    return positions.join(F.broadcast(per), "position", "left").select(  # one row per column
        "position", "column", F.coalesce("dtype", F.lit("string")).alias("dtype"),
        F.coalesce("n_filled", F.lit(0)).cast("bigint").alias("n_filled"), F.coalesce("n_odd", F.lit(0)).cast("bigint").alias("n_odd"))


def _typed(cells: DataFrame, schema, bad_share: float) -> list[tuple[str, str, Column, Column]]:
    """(name, type, value, bad cell or null) of each wanted column."""
    names = [c for c in cells.columns if c != RAGGED]
    if schema is None:
        wanted = [(r["column"], r["dtype"]) for r in csv_types(cells, bad_share).orderBy("position").collect()]
    else:
        fields = (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields
        wanted = [(f.name, f.dataType.simpleString()) for f in fields]
    out = []
    for i, (name, dtype) in enumerate(wanted):
        text = X.ref(names[i]) if i < len(names) else F.lit(None).cast("string")
        if dtype == "string":
            value = text
        else:
            value = F.trim(text).try_cast(dtype)
            if dtype in ("float", "double"):  # the cast alone would take 1d and 1f
                value = F.when(F.regexp_like(F.trim(text), F.lit(NUMBER)), value)
        bad = F.when((F.trim(text) != "") & value.isNull(), text)
        out.append((name, dtype, value, bad))
    return out


def read_csv_lenient(spark: SparkSession, path: str, schema: str | T.StructType | None = None, bad_share: float = 0.0,
                     keep_bad: str | None = None) -> DataFrame:
    """Types from every cell of the file, or from ``schema`` by position; ``;`` is tried when ``,`` finds one column.

    Without a schema the file is read twice: once to count the kinds of cells (``csv_types``), once for the rows. With
    the default ``bad_share`` no cell is lost, as an odd cell widens its column. With a larger share, or a given schema, a
    cell that does not fit is null, and ``keep_bad`` names a column that holds it: an array of (column, value), with
    column null and the whole line for a line of too many or too few cells; null where the row is sound.
    Empty cells are null, blanks around numbers and dates do not count, an empty file has no columns.
    """
    cells = read_csv_cells(spark, path, separator(spark, path))
    typed = _typed(cells, schema, bad_share)
    columns = [value.alias(name) for name, _, value, _ in typed]
    if keep_bad is not None:
        found = [F.struct(F.lit(name).alias("column"), bad.alias("value")) for name, _, _, bad in typed]
        found.append(F.struct(F.lit(None).cast("string").alias("column"), X.ref(RAGGED).alias("value")))
        found = F.filter(F.array(*found), lambda x: x["value"].isNotNull())
        columns.append(F.when(F.size(found) > 0, found).alias(keep_bad))
    return cells.select(*columns)


def csv_report(spark: SparkSession, path: str, schema: str | T.StructType | None = None, bad_share: float = 0.0) -> DataFrame:
    """What ``read_csv_lenient`` makes of a file: (position, column, dtype, n_rows, n_filled, n_bad, example) per column, and one row
    with column null for lines of too many or too few cells. ``example`` is the smallest such cell, or line."""
    cells = read_csv_cells(spark, path, separator(spark, path))
    typed = _typed(cells, schema, bad_share)
    names = [c for c in cells.columns if c != RAGGED]
    rows = [F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(dtype).alias("dtype"),
                     (F.trim(X.ref(names[i])) != "" if i < len(names) else F.lit(False)).alias("filled"), bad.alias("bad"))
            for i, (name, dtype, _, bad) in enumerate(typed)]
    rows.append(F.struct(F.lit(len(typed)).alias("position"), F.lit(None).cast("string").alias("column"), F.lit("line").alias("dtype"),
                         F.lit(True).alias("filled"), X.ref(RAGGED).alias("bad")))
    return cells.select(X.rows(*rows)).groupBy("position", "column", "dtype").agg(
        F.count(F.lit(1)).alias("n_rows"), X.count_if(F.col("filled")).alias("n_filled"), F.count("bad").alias("n_bad"),
        F.min("bad").alias("example"))


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """S3: one JSON document (array of records), otherwise one record per line."""
    start = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    document = bool(start) and start[0][0].lstrip().startswith("[")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("multiLine", document).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S4"""
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Reader chosen by file extension."""
    if path.endswith(".json"):
        return read_json(spark, path, schema)
    if path.endswith((".csv", ".txt")):
        return read_csv_lenient(spark, path, schema)
    return read_parquet(spark, path)


def schema_summary(df: DataFrame) -> DataFrame:
    """One row per column with its type, and the size of the table."""
    kinds = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                      F.lit(f.dataType.simpleString()).alias("dtype")) for i, f in enumerate(df.schema.fields)]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(kinds)).cast("bigint").alias("n_columns"), X.rows(*kinds))


def preview(df: DataFrame, n: int = 20, order_by: list[str] | None = None) -> DataFrame:
    """First n rows in an explicit order (a top-n, never a full sort)."""
    return df.orderBy(*(order_by or df.columns)).limit(n)


def bytes_of(df: DataFrame, c: str):
    """S7 of one column as an aggregate: fixed width per value, octets for text, JSON size if nested."""
    kind, v = X.dtype(df, c), X.ref(c)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.sum(F.octet_length(v)), F.lit(0)).cast("bigint")
    if isinstance(kind, T.ArrayType) and type(kind.elementType) in WIDTH:
        width = F.greatest(F.coalesce(F.size(v), F.lit(0)), F.lit(0)) * WIDTH[type(kind.elementType)]
        return F.coalesce(F.sum(width), F.lit(0)).cast("bigint")
    if isinstance(kind, X.NESTED_TYPES):
        return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(v)))), F.lit(0)).cast("bigint")
    return (F.count(F.lit(1)) * WIDTH.get(type(kind), 8)).cast("bigint")


def estimated_size(df: DataFrame) -> DataFrame:
    """Bytes and MB per column."""
    return (B.wide(df, {c: {"n_bytes": bytes_of(df, c)} for c in df.columns})
            .withColumn("mb", F.col("n_bytes") / F.lit(1048576.0)))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """S10"""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def content_hash(df: DataFrame) -> DataFrame:
    """Fingerprint that does not depend on row order, file layout or partitioning.

    Column names, types and positions count, and a null is told from its neighbour's value.
    """
    h = X.row_hash(df, F.lit(df.schema.simpleString()))
    wide_sum = F.sum(h.cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), wide_sum.cast("string").alias("hash_sum"),
                  F.bit_xor(h).alias("hash_xor")).select(
        "n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), "hash_sum",
                                     F.col("hash_xor").cast("string")), 256).alias("content_hash"))
