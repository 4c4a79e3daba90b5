"""Catalog and telemetry frames: the input contract of every operator.

Each frame carries a leading ``database_name`` so that a whole estate (many databases or
lakehouse schemas) is analysed in one job. Frames are plain DataFrames; they can come from
parquet snapshots, JDBC reads of a source catalog, or be derived from table schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, L, B, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampType()


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "columns": _schema(
        ("database_name", S), ("schema_name", S), ("table_name", S), ("table_type", S), ("column_name", S),
        ("data_type", S), ("max_length", I), ("precision", I), ("scale", I), ("is_nullable", B),
        ("is_primary_key", B), ("is_identity", B), ("is_computed", B), ("default_value", S),
        ("ordinal_position", I),
    ),
    "indexes": _schema(
        ("database_name", S), ("schema_name", S), ("table_name", S), ("index_name", S), ("index_type", S),
        ("is_unique", B), ("is_clustered", B), ("columns", T.ArrayType(S)),
    ),
    "foreign_keys": _schema(
        ("database_name", S), ("fk_name", S), ("from_schema", S), ("from_table", S), ("from_column", S),
        ("to_schema", S), ("to_table", S), ("to_column", S), ("delete_rule", S), ("update_rule", S),
    ),
    "views": _schema(("database_name", S), ("schema_name", S), ("view_name", S), ("definition", S)),
    "procedures": _schema(
        ("database_name", S), ("schema_name", S), ("procedure_name", S), ("definition", S), ("last_modified", TS),
    ),
    "functions": _schema(
        ("database_name", S), ("schema_name", S), ("function_name", S), ("function_type", S), ("definition", S),
        ("last_modified", TS),
    ),
    "triggers": _schema(
        ("database_name", S), ("schema_name", S), ("trigger_name", S), ("parent_table", S), ("trigger_type", S),
        ("trigger_events", S), ("is_enabled", B), ("definition", S),
    ),
    "synonyms": _schema(("database_name", S), ("schema_name", S), ("synonym_name", S), ("base_object_name", S)),
    "sequences": _schema(
        ("database_name", S), ("schema_name", S), ("sequence_name", S), ("data_type", S), ("current_value", L),
        ("increment", L), ("min_value", L), ("max_value", L), ("is_cycling", B),
    ),
    "user_types": _schema(
        ("database_name", S), ("schema_name", S), ("type_name", S), ("base_type", S), ("is_table_type", B),
        ("is_nullable", B), ("max_length", I),
    ),
    "jobs": _schema(
        ("database_name", S), ("job_name", S), ("description", S), ("is_enabled", B), ("last_run_date", TS),
        ("schedule_description", S),
    ),
    "job_steps": _schema(
        ("database_name", S), ("job_name", S), ("step_id", I), ("step_name", S), ("subsystem_type", S),
        ("step_database", S), ("command", S),
    ),
    "object_dependencies": _schema(
        ("database_name", S), ("from_schema", S), ("from_name", S), ("from_type", S), ("to_schema", S),
        ("to_name", S), ("to_type", S), ("to_database", S),
    ),
    "table_usage": _schema(
        ("database_name", S), ("schema_name", S), ("table_name", S), ("total_reads", L), ("total_writes", L),
        ("last_seek", TS), ("last_scan", TS), ("last_lookup", TS),
    ),
    "proc_usage": _schema(
        ("database_name", S), ("schema_name", S), ("name", S), ("execution_count", L), ("last_execution", TS),
    ),
    "func_usage": _schema(
        ("database_name", S), ("schema_name", S), ("name", S), ("execution_count", L), ("last_execution", TS),
    ),
    "log_objects": _schema(
        ("database_name", S), ("schema_name", S), ("object_name", S), ("object_type", S), ("total_executions", L),
        ("last_execution", TS), ("first_execution", TS),
    ),
    "log_texts": _schema(
        ("database_name", S), ("query_text", S), ("total_executions", L), ("last_execution", TS),
    ),
    "index_inventory": _schema(
        ("database_name", S), ("schema_name", S), ("table_name", S), ("index_name", S), ("index_type", S),
        ("is_unique", B), ("is_clustered", B), ("columns", T.ArrayType(S)), ("user_seeks", L), ("user_scans", L),
        ("user_lookups", L), ("user_updates", L), ("size_kb", L),
    ),
    "missing_index_stats": _schema(
        ("database_name", S), ("schema_name", S), ("table_name", S), ("impact_score", D),
        ("equality_columns", S), ("inequality_columns", S), ("include_columns", S), ("user_seeks", L),
        ("user_scans", L),
    ),
    "uptime": _schema(("database_name", S), ("start_time", TS), ("uptime_days", I)),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def frame(spark: SparkSession, name: str, rows: list[dict | tuple]) -> DataFrame:
    """Build a catalog frame from rows (dicts may omit nullable fields)."""
    schema = SCHEMAS[name]
    norm = []
    for r in rows:
        if isinstance(r, dict):
            norm.append(tuple(r.get(f.name) for f in schema.fields))
        else:
            norm.append(tuple(r))
    return spark.createDataFrame(norm, schema)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select and cast a frame to the contract schema; missing columns become null."""
    schema = SCHEMAS[name]
    have = set(df.columns)
    return df.select([
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def columns_from_dataframes(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    database_name: str,
    schema_name: str = "dbo",
    name_map=None,
) -> DataFrame:
    """Column catalog of existing DataFrames, read from their schemas (metadata only).

    ``name_map`` optionally maps (table, column) to the catalog name of the column.
    Keys are not known from a schema; derive them with ``profile.infer_keys``.
    """
    rows = []
    for table, df in tables.items():
        for pos, field in enumerate(df.schema.fields, start=1):
            col_name = name_map(table, field.name) if name_map else field.name
            dt = field.dataType
            precision = getattr(dt, "precision", None)
            scale = getattr(dt, "scale", None)
            rows.append({
                "database_name": database_name, "schema_name": schema_name, "table_name": table,
                "table_type": "BASE TABLE", "column_name": col_name, "data_type": dt.simpleString(),
                "max_length": -1 if isinstance(dt, T.StringType) else None,
                "precision": precision, "scale": scale, "is_nullable": bool(field.nullable),
                "is_primary_key": False, "is_identity": False, "is_computed": False,
                "default_value": None, "ordinal_position": pos,
            })
    return frame(spark, "columns", rows)
