"""Quality rules Q1-Q7 over catalog frames -> (database_name, category, severity, object_name, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescope.functions.names import full_name

# Column names flagged as SQL reserved words.
RESERVED_WORDS = [
    "SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE", "ORDER", "GROUP", "BY",
    "TABLE", "INDEX", "VIEW", "CREATE", "ALTER", "DROP", "KEY", "PRIMARY", "FOREIGN",
    "COLUMN", "DATABASE", "SCHEMA", "USER", "ROLE", "GRANT", "REVOKE", "TYPE",
    "NAME", "VALUE", "VALUES", "STATUS", "DATE", "TIME", "TIMESTAMP", "LEVEL",
    "COMMENT", "ACTION", "CONDITION", "RESULT", "FUNCTION", "PROCEDURE",
]

SEVERITY_RANK = {"Info": 0, "Warning": 1, "Error": 2}

ISSUE_COLUMNS = ["database_name", "category", "severity", "severity_rank", "object_name", "description",
                 "recommendation"]


def _issue(df: DataFrame, category: str, severity, obj, description, recommendation) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(
        "database_name", F.lit(category).alias("category"), sev.alias("severity"),
        F.element_at(F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))]), sev)
        .cast("int").alias("severity_rank"),
        obj.alias("object_name"), description.alias("description"), recommendation.alias("recommendation"))


def _base_tables(columns: DataFrame) -> DataFrame:
    return columns.filter(F.coalesce(F.col("table_type"), F.lit("BASE TABLE")) == "BASE TABLE")


def missing_primary_key(columns: DataFrame) -> DataFrame:
    """Q1: a table none of whose columns is a primary-key column."""
    t = _base_tables(columns).groupBy("database_name", "schema_name", "table_name").agg(
        F.bool_or(F.coalesce(F.col("is_primary_key"), F.lit(False))).alias("has_pk")).filter(~F.col("has_pk"))
    return _issue(t, "Design", "Error", full_name("schema_name", "table_name"),
                  F.lit("No column of this table is declared as its primary key."),
                  F.lit("Declare a key so that each row can be told apart."))


def unindexed_fk_columns(foreign_keys: DataFrame, indexes: DataFrame) -> DataFrame:
    """Q2: a foreign-key column that leads no index of its table."""
    leads = indexes.filter(F.size("columns") > 0).select(
        "database_name", F.lower("schema_name").alias("s"), F.lower("table_name").alias("t"),
        F.lower(F.col("columns")[0]).alias("c")).distinct()
    fk = foreign_keys.withColumn("s", F.lower("from_schema")).withColumn("t", F.lower("from_table")) \
        .withColumn("c", F.lower("from_column"))
    bad = fk.join(leads, ["database_name", "s", "t", "c"], "left_anti")
    return _issue(bad, "Performance", "Warning", full_name("from_schema", "from_table", "from_column"),
                  F.format_string("No index starts with the referencing column '%s'.", "from_column"),
                  F.lit("Create an index that leads with it; joins and deletes of parents look rows up by this column."))


def mixed_case_names(columns: DataFrame) -> DataFrame:
    """Q3: a table name that mixes PascalCase ([A-Z][a-z]) and snake_case (_)."""
    t = _base_tables(columns).select("database_name", "schema_name", "table_name").distinct().filter(
        F.col("table_name").rlike("[A-Z][a-z]") & F.col("table_name").contains("_"))
    return _issue(t, "Naming", "Info", full_name("schema_name", "table_name"),
                  F.lit("The table name joins two naming styles, capitals and underscores."), F.lit("Use one style for all table names."))


def reserved_column_names(columns: DataFrame) -> DataFrame:
    """Q4: a column named like a SQL reserved word."""
    c = _base_tables(columns).filter(F.upper("column_name").isin(RESERVED_WORDS))
    return _issue(c, "Naming", "Warning", full_name("schema_name", "table_name", "column_name"),
                  F.format_string("The column is named '%s', a word that SQL reserves.", "column_name"),
                  F.lit("Pick another name, else each query must quote it."))


def unbounded_text(columns: DataFrame) -> DataFrame:
    """Q5: an nvarchar column of unbounded length (max_length = -1)."""
    c = _base_tables(columns).filter((F.lower("data_type") == "nvarchar") & (F.col("max_length") == -1))
    return _issue(c, "Design", "Info", full_name("schema_name", "table_name", "column_name"),
                  F.lit("The column holds text without a length bound."),
                  F.lit("Give it the length that its values need."))


def orphaned_tables(columns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Q6: a table with no foreign key in or out, in a database of more than one table."""
    tables = _base_tables(columns).select("database_name", "schema_name", "table_name").distinct()
    sizes = tables.groupBy("database_name").agg(F.count(F.lit(1)).alias("n_tables"))
    tables = tables.join(sizes, "database_name")
    k = tables.withColumn("s", F.lower("schema_name")).withColumn("t", F.lower("table_name"))
    targets = foreign_keys.select("database_name", F.lower("to_schema").alias("s"), F.lower("to_table").alias("t"))
    sources = foreign_keys.select("database_name", F.lower("from_schema").alias("s"),
                                  F.lower("from_table").alias("t"))
    linked = targets.unionByName(sources).distinct()
    lone = k.join(linked, ["database_name", "s", "t"], "left_anti").filter(F.col("n_tables") > 1)
    return _issue(lone, "Design", "Info", full_name("schema_name", "table_name"),
                  F.lit("No foreign key leads to or from this table."),
                  F.lit("Check that it is meant to stand alone."))


def potential_missing_fks(implicit: DataFrame) -> DataFrame:
    """Q7: every suggested key; Warning from confidence 0.80, else Info; the declaring statement."""
    from lakescope.operators.relations import fk_statement
    rel = fk_statement(implicit)
    sev = F.when(F.col("confidence") >= F.lit(0.8).cast("decimal(4,2)"), "Warning").otherwise("Info")
    pct = (F.col("confidence") * 100).cast("int")
    return _issue(rel, "Referential Integrity", sev, full_name("from_schema", "from_table", "from_column"),
                  F.format_string("The values look like keys of %s.%s.%s (confidence %d%%).",
                                  F.col("to_schema"), F.col("to_table"), F.col("to_column"), pct),
                  F.col("statement"))


def quality_issues(columns: DataFrame, indexes: DataFrame, foreign_keys: DataFrame,
                   implicit: DataFrame | None = None) -> DataFrame:
    """All rules, one frame, stamped with database_name."""
    parts = [
        missing_primary_key(columns),
        unindexed_fk_columns(foreign_keys, indexes),
        mixed_case_names(columns),
        reserved_column_names(columns),
        unbounded_text(columns),
        orphaned_tables(columns, foreign_keys),
    ]
    if implicit is not None:
        parts.append(potential_missing_fks(implicit))
    return reduce(DataFrame.unionByName, parts)
