"""Name helpers: qualified names, keys, brackets, quoting (all built-in column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key(c: Column | str) -> Column:
    """Case-insensitive join key for a name."""
    return F.lower(col_(c))


def full_name(*parts: Column | str) -> Column:
    """``schema.name`` (null parts skipped, like a qualified name without database)."""
    return F.concat_ws(".", *[col_(p) for p in parts])


def strip_brackets(c: Column | str) -> Column:
    return F.translate(col_(c), "[]", "")


def name_parts(c: Column | str) -> Column:
    return F.split(col_(c), r"\.")


def last_part(c: Column | str) -> Column:
    return F.element_at(name_parts(c), -1)


def dot_count(c: Column | str) -> Column:
    return F.size(name_parts(c)) - 1


def qualify(c: Column | str, database: Column | str) -> Column:
    """Prefix a name with its database unless it already has two dots (db.schema.name)."""
    c = col_(c)
    return F.when(c.isNull(), c).when(dot_count(c) < 2, F.concat_ws(".", col_(database), c)).otherwise(c)


def quote_ident(c: Column | str) -> Column:
    """Bracket-quote an identifier, doubling closing brackets."""
    return F.concat(F.lit("["), F.replace(col_(c), F.lit("]"), F.lit("]]")), F.lit("]"))
