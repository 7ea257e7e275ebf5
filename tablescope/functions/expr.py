"""Column helpers that never raise under ANSI mode."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
NUMERIC_TYPES = INTEGER_TYPES + FLOAT_TYPES + (T.DecimalType,)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)

# White space at either end, in the Unicode sense (tab, newline and no-break space included).
EDGE_SPACE = r"(?U)^\s+|\s+$"


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def ref(name: str) -> Column:
    """Column reference that is safe for names with dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(df: DataFrame, *more: Column) -> Column:
    """64-bit hash of a row that tells a null from a missing value and one column from another."""
    parts = list(more)
    for i, f in enumerate(df.schema.fields):
        v = ref(f.name)
        if not isinstance(f.dataType, (T.StringType, T.BinaryType, T.BooleanType, *NUMERIC_TYPES, *TEMPORAL_TYPES)):
            v = F.to_json(F.struct(v))  # maps cannot be hashed
        parts += [F.lit(i), ref(f.name).isNull(), v]
    return F.xxhash64(*parts)


def double(df: DataFrame, name: str) -> Column:
    """Value as double; text that is not a number, and NaN, become null."""
    kind = dtype(df, name)
    value = ref(name)
    if isinstance(kind, T.StringType):
        value = value.try_cast("double")
    elif not isinstance(kind, T.DoubleType):
        value = value.cast("double")
    if isinstance(kind, FLOAT_TYPES + (T.StringType,)):
        value = F.when(~F.isnan(value), value)
    return value


def loose_double(df: DataFrame, name: str) -> Column:
    """Value as double, NaN kept."""
    kind = dtype(df, name)
    return ref(name).try_cast("double") if isinstance(kind, T.StringType) else ref(name).cast("double")


def text(df: DataFrame, name: str) -> Column:
    """Value as string for frequency tables; -0.0 and 0.0 are one value."""
    kind = dtype(df, name)
    value = ref(name)
    if isinstance(kind, FLOAT_TYPES):
        value = value + F.lit(0.0).cast(kind)
    return value.cast("string")


def strip(value: Column) -> Column:
    return F.regexp_replace(value, EDGE_SPACE, "")


def timestamp(df: DataFrame, name: str) -> Column:
    kind = dtype(df, name)
    if isinstance(kind, T.TimestampNTZType):
        return ref(name)
    if isinstance(kind, T.StringType):
        return ref(name).try_cast("timestamp_ntz")
    return ref(name).cast("timestamp_ntz")


def div(a: Column, b: Column) -> Column:
    """a / b as double, null where b is zero or null."""
    b = b.cast("double")
    return a.cast("double") / F.when(b != 0, b)


def pct(part: Column, whole: Column) -> Column:
    return F.coalesce(div(part * F.lit(100.0), whole), F.lit(0.0))


def pct2(part: Column, whole: Column) -> Column:
    """Percent with two decimals, half up, decided on whole numbers (no binary rounding surprises)."""
    scaled = (part.cast("double") * 20000 + whole) / F.when(whole != 0, whole * F.lit(2.0))
    return F.coalesce(F.floor(scaled) / F.lit(100.0), F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.lit(1).cast("bigint"))), F.lit(0).cast("bigint"))


def rows(*structs: Column) -> Column:
    """One output row per struct (an unpivot that may mix types of different columns)."""
    return F.inline(F.array(*structs))


_ARROW = {T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}


def lit_rows(df: DataFrame, data: list[tuple], schema: str) -> DataFrame:
    """Small metadata table (a handful of rows per column of the input) as a DataFrame.

    Handed over as Arrow it is a part of the plan; as a list of tuples, reading it would start a Python worker on every core.
    """
    fields = T.StructType.fromDDL(schema)
    if any(f.dataType not in _ARROW for f in fields):
        return df.sparkSession.createDataFrame(data, schema)
    columns = zip(*data, strict=True) if data else [()] * len(fields)
    arrays = [pa.array(list(c), _ARROW[f.dataType]) for c, f in zip(columns, fields, strict=True)]
    return df.sparkSession.createDataFrame(pa.table(arrays, names=fields.names), fields)
