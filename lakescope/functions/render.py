"""One fixed text rendering of typed values, so min/max compare equal across engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the decimal scale of floating values that have no further digits; others keep their own text.
FLOAT_SCALE = 6
FLOAT_DECIMAL_BOUND = 1e31

NUMERIC_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC_FRACTIONAL = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def profile_class(dt: T.DataType) -> str:
    """'full' (nulls, distinct, min, max), 'distinct' (no min/max), or 'nulls' (null count only)."""
    if isinstance(dt, NUMERIC_INTEGRAL + NUMERIC_FRACTIONAL + TEMPORAL + (T.DecimalType, T.StringType)):
        return "full"
    if isinstance(dt, T.BooleanType):
        return "distinct"
    return "nulls"


def value_text(c: Column, dt: T.DataType) -> Column:
    """Render a typed value as text: integers plain, floating values at a fixed scale if that
    is exact and in their shortest exact text otherwise, timestamps ``yyyy-MM-dd HH:mm:ss.SSSSSS``, strings whole."""
    if isinstance(dt, NUMERIC_INTEGRAL + (T.DecimalType,)):
        return c.cast("string")
    if isinstance(dt, NUMERIC_FRACTIONAL):
        d = c.cast("double")
        return (
            F.when((F.abs(d) < F.lit(FLOAT_DECIMAL_BOUND)) & (d.cast(f"decimal(38,{FLOAT_SCALE})").cast("double") == d),
                   d.cast(f"decimal(38,{FLOAT_SCALE})").cast("string"))
            .otherwise(d.cast("string"))
        )
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(dt, T.StringType):
        return c
    return c.cast("string")


def value_text_sql(expr: str, dt: T.DataType) -> str:
    """The same rendering in ANSI/DuckDB SQL (used for oracle queries)."""
    if isinstance(dt, NUMERIC_INTEGRAL + (T.DecimalType,)):
        return f"CAST({expr} AS VARCHAR)"
    if isinstance(dt, NUMERIC_FRACTIONAL):
        return (f"CASE WHEN abs({expr}) < {FLOAT_DECIMAL_BOUND:.0e} AND "
                f"CAST(CAST({expr} AS DECIMAL(38,{FLOAT_SCALE})) AS DOUBLE) = {expr} THEN "
                f"CAST(CAST({expr} AS DECIMAL(38,{FLOAT_SCALE})) AS VARCHAR) ELSE CAST({expr} AS VARCHAR) END")
    if isinstance(dt, T.DateType):
        return f"strftime({expr}, '%Y-%m-%d')"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"
    if isinstance(dt, T.StringType):
        return expr
    return f"CAST({expr} AS VARCHAR)"


def value_text_spark_sql(expr: str, dt: T.DataType) -> str:
    """``value_text`` written as Spark SQL text (for plans built in one ``spark.sql`` call)."""
    if isinstance(dt, NUMERIC_INTEGRAL + (T.DecimalType,)):
        return f"CAST({expr} AS STRING)"
    if isinstance(dt, NUMERIC_FRACTIONAL):
        d = f"CAST({expr} AS DOUBLE)"
        return (f"CASE WHEN abs({d}) < {FLOAT_DECIMAL_BOUND:.0e} AND CAST(CAST({d} AS DECIMAL(38,{FLOAT_SCALE})) AS DOUBLE) = {d} "
                f"THEN CAST(CAST({d} AS DECIMAL(38,{FLOAT_SCALE})) "
                f"AS STRING) ELSE CAST({d} AS STRING) END")
    if isinstance(dt, T.DateType):
        return f"date_format({expr}, 'yyyy-MM-dd')"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return f"date_format({expr}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    if isinstance(dt, T.StringType):
        return expr
    return f"CAST({expr} AS STRING)"
