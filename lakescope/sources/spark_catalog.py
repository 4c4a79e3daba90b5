"""Catalog frames of the Spark session catalog (lakehouse tables and views).

Only metadata is read on the driver (table and column lists); profiles and checks then run on the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescope.operators import refs as E
from lakescope.sources import catalog as C


def view_texts(spark: SparkSession, databases: list[str]) -> DataFrame:
    """(database_name, schema_name, view_name, definition) of all views, by one call for each database.

    The text is what stands between the two fields that the catalog's description gives for a view."""
    text = F.regexp_extract("information", r"(?s)\nView Text: (.*?)\nView Original Text: ", 1)
    parts = [spark.sql(f"SHOW TABLE EXTENDED IN `{db}` LIKE '*'").filter("not isTemporary").filter(F.col("information").contains("\nType: VIEW\n")).select(
        F.lit(db).alias("database_name"), F.lit(db).alias("schema_name"), F.col("tableName").alias("view_name"), text.alias("definition")) for db in databases]
    return reduce(DataFrame.unionByName, parts) if parts else C.empty(spark, "views")


def view_dependencies(spark: SparkSession, databases: list[str]) -> DataFrame:
    """Dependencies of the catalog's views, from their texts, on its tables and views."""
    cat = read_session_catalog(spark, databases)
    # a namespace is a schema here, so names of one call resolve across them
    one = lambda df: df.withColumn("database_name", F.lit("catalog"))
    known = E.known_objects(columns=one(cat["columns"]), views=one(cat["views"]))
    return E.object_dependencies(E.name_aliases(known), E.definitions(views=one(cat["views"])))


def read_session_catalog(spark: SparkSession, databases: list[str] | None = None,
                         include_temporary: bool = False) -> dict[str, DataFrame]:
    """Columns and views of the session catalog, keyed by ``database_name`` (the Spark namespace)."""
    cols, views = [], []
    dbs = databases or [d.name for d in spark.catalog.listDatabases()]
    for db in dbs:
        for t in spark.catalog.listTables(db):
            if t.isTemporary and not include_temporary:
                continue
            name = t.name if t.isTemporary else f"{db}.{t.name}"
            kind = "VIEW" if (t.tableType or "").upper() in ("VIEW", "TEMPORARY") else "BASE TABLE"
            for pos, c in enumerate(spark.catalog.listColumns(name), start=1):
                cols.append({"database_name": db, "schema_name": db, "table_name": t.name, "table_type": kind,
                             "column_name": c.name, "data_type": c.dataType, "is_nullable": bool(c.nullable),
                             "is_primary_key": False, "is_identity": False, "is_computed": False,
                             "ordinal_position": pos})
            if kind == "VIEW" and t.isTemporary:  # its text is not kept
                views.append({"database_name": db, "schema_name": db, "view_name": t.name, "definition": ""})
    return {"columns": C.frame(spark, "columns", cols), "views": C.frame(spark, "views", views).unionByName(C.conform(view_texts(spark, dbs), "views"))}


def table_exists(spark: SparkSession, name: str) -> bool:
    """Is a (query-log) table present."""
    return spark.catalog.tableExists(name)
