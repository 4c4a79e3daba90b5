"""Catalog snapshot of a live database over JDBC (ANSI ``information_schema``, pushed down).

Each catalog query is its own DataFrame (independent jobs, run in parallel by the scheduler); filters
such as the system-schema exclusion are part of the pushed query. Results conform to the catalog
contract of ``sources.catalog`` and carry ``database_name``. Needs the JDBC driver jar on the classpath.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescope.sources import catalog as C

# Schemas that hold the database's own catalog, never analysed.
SYSTEM_SCHEMAS = ["information_schema", "pg_catalog", "pg_toast", "sys"]
# Fixed value: time limit of one catalog command (seconds).
QUERY_TIMEOUT = 300


def read_query(spark: SparkSession, url: str, query: str, properties: dict | None = None,
               fetchsize: int = 10000) -> DataFrame:
    """Run a query on the source and read the rows (pushed down whole)."""
    r = (spark.read.format("jdbc").option("url", url).option("query", query)
         .option("queryTimeout", QUERY_TIMEOUT).option("fetchsize", fetchsize))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load()


def scalar(spark: SparkSession, url: str, query: str, properties: dict | None = None):
    """First value of the first row (None when there is no row or the value is null)."""
    row = read_query(spark, url, query, properties).first()
    return None if row is None else row[0]


def _not_system(col: str) -> str:
    return f"{col} NOT IN ({', '.join(repr(s) for s in SYSTEM_SCHEMAS)})"


COLUMNS_SQL = f"""
SELECT c.table_schema AS schema_name, c.table_name, t.table_type, c.column_name, c.data_type,
       c.character_maximum_length AS max_length, c.numeric_precision AS "precision",
       c.numeric_scale AS scale, CASE WHEN c.is_nullable = 'YES' THEN 1 ELSE 0 END AS is_nullable,
       c.column_default AS default_value, c.ordinal_position
FROM information_schema.columns c
JOIN information_schema.tables t ON t.table_schema = c.table_schema AND t.table_name = c.table_name
WHERE {_not_system('c.table_schema')}"""

PRIMARY_KEYS_SQL = f"""
SELECT k.table_schema AS schema_name, k.table_name, k.column_name
FROM information_schema.table_constraints tc
JOIN information_schema.key_column_usage k
  ON k.constraint_schema = tc.constraint_schema AND k.constraint_name = tc.constraint_name
WHERE tc.constraint_type = 'PRIMARY KEY' AND {_not_system('k.table_schema')}"""

FOREIGN_KEYS_SQL = f"""
SELECT rc.constraint_name AS fk_name, f.table_schema AS from_schema, f.table_name AS from_table,
       f.column_name AS from_column, p.table_schema AS to_schema, p.table_name AS to_table,
       p.column_name AS to_column, rc.delete_rule, rc.update_rule
FROM information_schema.referential_constraints rc
JOIN information_schema.key_column_usage f
  ON f.constraint_schema = rc.constraint_schema AND f.constraint_name = rc.constraint_name
JOIN information_schema.key_column_usage p
  ON p.constraint_schema = rc.unique_constraint_schema AND p.constraint_name = rc.unique_constraint_name
 AND p.ordinal_position = f.position_in_unique_constraint
WHERE {_not_system('f.table_schema')}"""

VIEWS_SQL = f"""
SELECT table_schema AS schema_name, table_name AS view_name, view_definition AS definition
FROM information_schema.views WHERE {_not_system('table_schema')}"""

ROUTINES_SQL = f"""
SELECT routine_schema AS schema_name, routine_name, routine_type, data_type AS return_type,
       routine_definition AS definition
FROM information_schema.routines WHERE {_not_system('routine_schema')}"""


def read_catalog(spark: SparkSession, url: str, database_name: str, properties: dict | None = None
                 ) -> dict[str, DataFrame]:
    """Columns (with primary-key flag), foreign keys, views, procedures and
    functions of one database, stamped with its name."""
    db = F.lit(database_name).alias("database_name")
    cols = read_query(spark, url, COLUMNS_SQL, properties)
    pks = read_query(spark, url, PRIMARY_KEYS_SQL, properties).withColumn("is_primary_key", F.lit(True))
    # a sequence-backed default marks an identity column
    cols = cols.join(pks, ["schema_name", "table_name", "column_name"], "left").select(
        db, "*", F.coalesce(F.col("default_value").startswith("nextval("), F.lit(False)).alias("is_identity"),
        F.lit(False).alias("is_computed"))
    cols = cols.withColumn("is_primary_key", F.coalesce(F.col("is_primary_key"), F.lit(False))) \
        .withColumn("is_nullable", F.col("is_nullable") == 1)
    fks = read_query(spark, url, FOREIGN_KEYS_SQL, properties).select(db, "*")
    views = read_query(spark, url, VIEWS_SQL, properties).select(db, "schema_name", "view_name",
                                                                F.coalesce("definition", F.lit("")).alias("definition"))
    routines = read_query(spark, url, ROUTINES_SQL, properties)
    procs = routines.filter(F.upper("routine_type") == "PROCEDURE").select(
        db, "schema_name", F.col("routine_name").alias("procedure_name"), "definition")
    funcs = routines.filter(F.upper("routine_type") == "FUNCTION").select(
        db, "schema_name", F.col("routine_name").alias("function_name"),
        F.when(F.upper("return_type") == "TABLE", "Table").otherwise("Scalar").alias("function_type"), "definition")
    return {
        "columns": C.conform(cols, "columns"),
        "foreign_keys": C.conform(fks, "foreign_keys"),
        "views": C.conform(views, "views"),
        "procedures": C.conform(procs, "procedures"),
        "functions": C.conform(funcs, "functions"),
    }


def list_databases(spark: SparkSession, url: str, properties: dict | None = None) -> DataFrame:
    """User databases of a server (ANSI ``information_schema.schemata`` catalogs)."""
    return read_query(spark, url, "SELECT DISTINCT catalog_name AS database_name FROM information_schema.schemata",
                      properties)
