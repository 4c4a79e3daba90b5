"""Column-type helpers: family of a type name, compatibility of two types, display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakescope.functions.names import col_

# Type families that count as compatible for a key match.
INTEGER_TYPES = ["tinyint", "smallint", "int", "bigint"]
STRING_TYPES = ["char", "varchar", "nchar", "nvarchar"]
DECIMAL_TYPES = ["decimal", "numeric", "float", "real", "money", "smallmoney"]
# Spark's own names for the same families.
SPARK_INTEGER_TYPES = ["integer", "long", "short", "byte"]
SPARK_STRING_TYPES = ["string"]
SPARK_DECIMAL_TYPES = ["double"]


def base_type(c: Column | str) -> Column:
    """Lower-cased type name without its parameters: ``decimal(18,2)`` -> ``decimal``."""
    return F.lower(F.trim(F.regexp_replace(col_(c), r"\(.*$", "")))


def type_family(c: Column | str) -> Column:
    b = base_type(c)
    return (F.when(b.isin(INTEGER_TYPES + SPARK_INTEGER_TYPES), "integer")
            .when(b.isin(STRING_TYPES + SPARK_STRING_TYPES), "string")
            .when(b.isin(DECIMAL_TYPES + SPARK_DECIMAL_TYPES), "decimal"))


def type_match(a: Column | str, b: Column | str) -> Column:
    """'exact' (same base type), 'compatible' (same family) or 'mismatch'."""
    fa, fb = type_family(a), type_family(b)
    return (F.when(base_type(a) == base_type(b), "exact")
            .when(fa.isNotNull() & (fa == fb), "compatible")
            .otherwise("mismatch"))


def type_display(data_type: Column | str, max_length: Column | str, precision: Column | str,
                 scale: Column | str) -> Column:
    """``nvarchar(100)`` / ``nvarchar(MAX)`` for sized text, ``decimal(18,2)`` for decimals, else the name."""
    dt, ml, pr, sc = col_(data_type), col_(max_length), col_(precision), col_(scale)
    b = base_type(dt)
    return (F.when(b.isin("decimal", "numeric") & pr.isNotNull(),
                   F.format_string("%s(%d,%d)", dt, pr, F.coalesce(sc, F.lit(0))))
            .when(b.isin(STRING_TYPES + ["binary", "varbinary"]) & (ml == -1), F.format_string("%s(MAX)", dt))
            .when(b.isin(STRING_TYPES + ["binary", "varbinary"]) & ml.isNotNull(), F.format_string("%s(%d)", dt, ml))
            .otherwise(dt))
