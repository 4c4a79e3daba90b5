"""Schema snapshot operators: nested tables, object inventory, overviews, DDL text, job inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescope.functions.names import full_name
from lakescope.functions.types import type_display
from lakescope.session import ranked

TABLE_KEY = ["database_name", "schema_name", "table_name"]


def assemble_tables(columns: DataFrame, indexes: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """One row per base table with its columns (by ordinal), indexes and foreign keys nested."""
    base = columns.filter(F.coalesce(F.col("table_type"), F.lit("BASE TABLE")) == "BASE TABLE")
    cols = base.groupBy(*TABLE_KEY).agg(F.array_sort(F.collect_list(F.struct(
        "ordinal_position", "column_name", "data_type", "max_length", "precision", "scale", "is_nullable",
        "is_primary_key", "is_identity", "is_computed", "default_value"))).alias("columns"))
    ix = indexes.groupBy(*TABLE_KEY).agg(F.array_sort(F.collect_list(F.struct(
        "index_name", "index_type", "is_unique", "is_clustered", F.col("columns").alias("key_columns")))).alias("indexes"))
    fk = foreign_keys.select(F.col("database_name"), F.col("from_schema").alias("schema_name"),
                             F.col("from_table").alias("table_name"), "fk_name", "from_column", "to_schema",
                             "to_table", "to_column", "delete_rule", "update_rule")
    fk = fk.groupBy(*TABLE_KEY).agg(F.array_sort(F.collect_list(F.struct(
        "fk_name", "from_column", "to_schema", "to_table", "to_column", "delete_rule", "update_rule"))).alias(
        "foreign_keys"))
    out = cols.join(ix, TABLE_KEY, "left").join(fk, TABLE_KEY, "left")
    return out.select(*TABLE_KEY, full_name("schema_name", "table_name").alias("full_name"), "columns",
                      F.coalesce("indexes", F.array()).alias("indexes"),
                      F.coalesce("foreign_keys", F.array()).alias("foreign_keys"))


def views_with_columns(columns: DataFrame, views: DataFrame) -> DataFrame:
    """Views with their columns (from the column catalog rows of type VIEW) and definition."""
    vc = columns.filter(F.col("table_type") == "VIEW").groupBy(*TABLE_KEY).agg(
        F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name", "data_type"))).alias("columns"))
    v = views.select("database_name", "schema_name", F.col("view_name").alias("table_name"), "definition")
    return v.join(vc, TABLE_KEY, "left").select(
        *TABLE_KEY, F.coalesce("columns", F.array()).alias("columns"), F.coalesce("definition", F.lit("")).alias(
            "definition"))


def object_inventory(columns: DataFrame | None = None, views=None, procedures=None, functions=None, triggers=None,
                     synonyms=None, sequences=None, user_types=None, jobs=None) -> DataFrame:
    """Every object with its kind and definition text: (database_name, schema_name, object_name,
    object_type, definition)."""
    parts = []
    none = F.lit(None).cast("string")
    if columns is not None:
        parts.append(columns.filter(F.coalesce(F.col("table_type"), F.lit("BASE TABLE")) == "BASE TABLE").select(
            "database_name", "schema_name", F.col("table_name").alias("object_name"),
            F.lit("Table").alias("object_type"), none.alias("definition")).distinct())
    spec = [(views, "view_name", "View", "definition"), (procedures, "procedure_name", "Procedure", "definition"),
            (functions, "function_name", "Function", "definition"), (triggers, "trigger_name", "Trigger", "definition"),
            (synonyms, "synonym_name", "Synonym", "base_object_name"), (sequences, "sequence_name", "Sequence", None),
            (user_types, "type_name", "Type", "base_type")]
    for df, name, kind, text in spec:
        if df is not None:
            parts.append(df.select("database_name", "schema_name", F.col(name).alias("object_name"),
                                   F.lit(kind).alias("object_type"),
                                   (F.col(text) if text else none).alias("definition")))
    if jobs is not None:
        parts.append(jobs.select("database_name", F.lit("job").alias("schema_name"), F.col("job_name").alias(
            "object_name"), F.lit("Job").alias("object_type"), F.col("description").alias("definition")))
    return reduce(DataFrame.unionByName, parts)


def table_overview(columns: DataFrame, indexes: DataFrame, foreign_keys: DataFrame,
                   row_counts: DataFrame | None = None) -> DataFrame:
    """Per table: columns, indexes, foreign keys, primary-key column list, rows."""
    base = columns.filter(F.coalesce(F.col("table_type"), F.lit("BASE TABLE")) == "BASE TABLE")
    c = base.groupBy(*TABLE_KEY).agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("is_primary_key"), F.struct("ordinal_position", "column_name")))), lambda s: s["column_name"]),
            ", ").alias("primary_key"))
    i = indexes.groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("n_indexes"))
    f = foreign_keys.groupBy("database_name", F.col("from_schema").alias("schema_name"),
                             F.col("from_table").alias("table_name")).agg(F.count(F.lit(1)).alias("n_foreign_keys"))
    out = c.join(i, TABLE_KEY, "left").join(f, TABLE_KEY, "left")
    if row_counts is not None:
        out = out.join(row_counts.select(*TABLE_KEY, "row_count"), TABLE_KEY, "left")
    else:
        out = out.withColumn("row_count", F.lit(None).cast("long"))
    return out.select(*TABLE_KEY, "n_columns", F.coalesce("n_indexes", F.lit(0)).cast("long").alias("n_indexes"),
                      F.coalesce("n_foreign_keys", F.lit(0)).cast("long").alias("n_foreign_keys"),
                      "primary_key", "row_count")


def view_overview(views: DataFrame, columns: DataFrame, edges: DataFrame) -> DataFrame:
    """Per view: column count and number of objects it depends on (edges: from_schema, from_name)."""
    vc = columns.filter(F.col("table_type") == "VIEW").groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("n_columns"))
    out = edges.groupBy("database_name", F.col("from_schema").alias("schema_name"),
                        F.col("from_name").alias("table_name")).agg(F.count(F.lit(1)).alias("n_depends_on"))
    v = views.select("database_name", "schema_name", F.col("view_name").alias("table_name"))
    return v.join(vc, TABLE_KEY, "left").join(out, TABLE_KEY, "left").fillna(0, ["n_columns", "n_depends_on"])


def ddl_text(columns: DataFrame) -> DataFrame:
    """CREATE TABLE text per table from the column catalog (columns in ordinal order, key clause)."""
    base = columns.filter(F.coalesce(F.col("table_type"), F.lit("BASE TABLE")) == "BASE TABLE")
    line = F.concat(F.lit("    ["), F.col("column_name"), F.lit("] "),
                    type_display("data_type", "max_length", "precision", "scale"),
                    F.when(F.col("is_nullable"), F.lit(" NULL")).otherwise(F.lit(" NOT NULL")))
    g = base.groupBy(*TABLE_KEY).agg(
        F.array_sort(F.collect_list(F.struct("ordinal_position", line.alias("l")))).alias("lines"),
        F.array_sort(F.collect_list(F.when(F.col("is_primary_key"),
                                           F.struct("ordinal_position", "column_name")))).alias("pk"))
    body = F.array_join(F.transform("lines", lambda s: s["l"]), ",\n")
    pk = F.when(F.size("pk") > 0, F.concat(F.lit(",\n    PRIMARY KEY (["), F.array_join(
        F.transform("pk", lambda s: s["column_name"]), "], ["), F.lit("])"))).otherwise(F.lit(""))
    return g.select(*TABLE_KEY, F.concat(F.lit("CREATE TABLE ["), F.col("schema_name"), F.lit("].["),
                                         F.col("table_name"), F.lit("] (\n"), body, pk, F.lit("\n);")).alias("ddl"))


def job_inventory(jobs: DataFrame, job_steps: DataFrame) -> DataFrame:
    """Jobs with their steps nested in step order."""
    st = job_steps.groupBy("database_name", "job_name").agg(F.array_sort(F.collect_list(F.struct(
        "step_id", "step_name", "subsystem_type", "step_database", "command"))).alias("steps"))
    return jobs.join(st, ["database_name", "job_name"], "left").withColumn(
        "steps", F.coalesce("steps", F.array()))


def jobs_touching(jobs: DataFrame, job_steps: DataFrame, database: str) -> DataFrame:
    """S13 filter: jobs with a step naming the database or whose command contains its name."""
    hit = job_steps.filter((F.lower("step_database") == database.lower())
                           | F.lower("command").contains(database.lower())).select("database_name", "job_name").distinct()
    return jobs.join(hit, ["database_name", "job_name"], "left_semi")


def assemble_indexes(index_columns: DataFrame) -> DataFrame:
    """One row per index with its key columns in key order (included columns left out).

    ``index_columns``: database_name, schema_name, table_name, index_name, index_type, is_unique,
    is_clustered, column_name, key_ordinal, is_included.
    """
    k = ["database_name", "schema_name", "table_name", "index_name"]
    keys = index_columns.filter(~F.coalesce(F.col("is_included"), F.lit(False)))
    return keys.groupBy(*k).agg(
        F.first("index_type").alias("index_type"), F.bool_or("is_unique").alias("is_unique"),
        F.bool_or("is_clustered").alias("is_clustered"),
        F.transform(F.array_sort(F.collect_list(F.struct("key_ordinal", "column_name"))),
                    lambda s: s["column_name"]).alias("columns"))


def indexes_from_positions(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """Indexes whose keys are an array of column positions (``key_positions``) joined to the column
    catalog (``ordinal_position``) keeping the array order: posexplode, then an equi-join."""
    k = ["database_name", "schema_name", "table_name"]
    ex = indexes.select(*k, "index_name", "index_type", "is_unique", "is_clustered",
                        F.posexplode("key_positions").alias("key_ordinal", "ordinal_position"))
    j = ex.join(columns.select(*k, "ordinal_position", "column_name"), k + ["ordinal_position"])
    return assemble_indexes(j.withColumn("is_included", F.lit(False)))


def assemble_triggers(trigger_events: DataFrame) -> DataFrame:
    """One row per trigger with its events joined by ', ' in a fixed order (INSERT, UPDATE, DELETE)."""
    order = F.when(F.upper("event") == "INSERT", 1).when(F.upper("event") == "UPDATE", 2) \
        .when(F.upper("event") == "DELETE", 3).otherwise(4)
    k = ["database_name", "schema_name", "trigger_name"]
    return trigger_events.groupBy(*k).agg(
        F.first("parent_table").alias("parent_table"), F.first("trigger_type").alias("trigger_type"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(order.alias("o"), F.upper("event").alias("e")))),
                                 lambda s: s["e"]), ", ").alias("trigger_events"),
        F.coalesce(F.bool_and("is_enabled"), F.lit(True)).alias("is_enabled"),
        F.first("definition").alias("definition"))


def standalone_types(user_types: DataFrame, relation_types: DataFrame) -> DataFrame:
    """User types that do not back a relation (NOT EXISTS as a left anti join on the type name)."""
    r = relation_types.select("database_name", "schema_name", F.col("type_name"))
    return user_types.join(r, ["database_name", "schema_name", "type_name"], "left_anti")


def job_last_run(job_history: DataFrame) -> DataFrame:
    """Latest run per job from history rows with integer ``run_date`` (yyyyMMdd)."""
    d = F.to_date(F.col("run_date").cast("string"), "yyyyMMdd")
    return job_history.groupBy("database_name", "job_name").agg(F.max(d).alias("last_run_date"))


# Schemas that hold a system's own objects.
SYSTEM_SCHEMAS = ["sys", "information_schema", "pg_catalog", "pg_toast"]


def user_objects(objects: DataFrame, flag: str = "is_shipped", schema_col: str = "schema_name") -> DataFrame:
    """objects without those shipped with the system: flagged so (where the catalog has the flag), or in a system schema."""
    own = ~F.coalesce(F.lower(schema_col).isin(SYSTEM_SCHEMAS), F.lit(False))
    if flag in objects.columns:
        own = own & ~F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    return objects.filter(own)


def ordered_objects(objects: DataFrame) -> DataFrame:
    """O1: objects in the order of database, schema, type and name, with their place (from 1)."""
    order = [F.col(c) for c in ("database_name", "schema_name", "object_type", "object_name")]
    return ranked(objects, order, "_rank0").withColumn("rank", F.col("_rank0") + 1).drop("_rank0")
