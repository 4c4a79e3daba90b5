"""Estate, catalog, search and streaming bindings on the test snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescope.operators import catalog_ops as CO
from lakescope.operators import estate as ES
from lakescope.operators import profile as P
from lakescope.operators import search as H
from lakescope.operators import versions as V
from lakescope.plans.profiling import WIDE, estate_profile_sql
from lakescope.plans.relations import tpch_frames
from lakescope.session import scratch_path
from lakescope.sources import catalog as C
from lakescope.sources.tables import TEST_TABLES, TPCH_TABLES, read_table, read_tables
from lakescope.streaming.rollup import run_rollup

DB = "testdata"
NAME_TERM = "ring"
TEXT_TERM = "the"


def estate_inventory(spark, sf_dir):
    """B1 / B2 / H6: every table stamped with its database, qualified name, rows and columns."""
    tables = read_tables(spark, sf_dir)
    counts = P.row_counts(tables)
    cols = C.columns_from_dataframes(spark, tables, DB, "dbo").groupBy("database_name", "schema_name", "table_name") \
        .agg(F.count(F.lit(1)).alias("n_columns"))
    inv = ES.stamp(counts, DB).join(cols, ["database_name", "table_name"])
    inv = inv.withColumn("object_name", F.concat_ws(".", "schema_name", "table_name"))
    inv = ES.qualify_columns(inv, ["object_name"])
    return inv.select("database_name", "object_name", "row_count", F.col("n_columns").cast("long"))


def table_overview(spark, sf_dir):
    """TPC-H tables with columns, indexes, keys, inferred primary key and rows."""
    tables, cols, fks, idx = tpch_frames(spark, sf_dir)
    counts = ES.stamp(P.row_counts(tables), "tpch").withColumn("schema_name", F.lit("dbo"))
    return CO.table_overview(cols, idx, fks, counts).drop("database_name")


def ddl_text(spark, sf_dir):
    """CREATE TABLE text of the TPC-H tables with the primary key inferred from the data."""
    _, cols, _, _ = tpch_frames(spark, sf_dir)
    return CO.ddl_text(cols).drop("database_name")


def dashboard_counts(spark, sf_dir):
    """Estate totals: tables, columns, rows, key-like and constant columns."""
    prof = P.infer_keys(P.profile_tables(read_tables(spark, sf_dir), wide=WIDE))
    per_table = prof.groupBy("table_name").agg(
        F.max("total_count").alias("rows"), F.count(F.lit(1)).alias("cols"),
        F.count_if((F.col("distinct_count") == 1) & (F.col("null_count") == 0)).alias("constant"),
        F.count_if("is_key_candidate").alias("keys"))
    return per_table.agg(
        F.count(F.lit(1)).alias("n_tables"), F.sum("cols").alias("n_columns"),
        F.sum("constant").alias("n_constant_columns"), F.sum("rows").alias("total_rows"),
        F.sum("keys").alias("n_key_columns"))


def name_search(spark, sf_dir):
    """H1: the first 20 part names containing 'ring', by name then key."""
    p = read_table(spark, sf_dir, "part").select(F.col("p_name").alias("object_name"), F.col("p_partkey").alias("key"))
    return H.name_search(p, NAME_TERM, "object_name", ["key"], 20)


def text_search(spark, sf_dir):
    """H2 / X11: the first 30 documents containing 'the', with their first matching line and line count."""
    d = read_table(spark, sf_dir, "documents")
    return H.definition_search(d, TEXT_TERM, "text", ["doc_id"], 30)


def region_customers(spark, sf_dir):
    """Customers, each in the database of its nation's region."""
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("database_name"))
    return read_table(spark, sf_dir, "customer").join(n, "c_nationkey").select("database_name", "c_custkey", "c_name")


def partition_refresh(spark, sf_dir):
    """An estate stored by region, then region_1 renamed, region_2 emptied, and region_3 left as it was
    by a refresh that was never committed."""
    path = scratch_path(spark, "estate")
    all_ = region_customers(spark, sf_dir)
    V.refresh(all_, path, [f"region_{k}" for k in range(5)])
    V.refresh(all_.withColumn("c_name", F.upper(F.concat("c_name", F.lit("!")))), path, ["region_1"])
    V.refresh(all_.limit(0), path, ["region_2"])
    all_.limit(0).write.parquet(f"{path}/data/uncommitted")
    V.vacuum(spark, path)
    return V.read(spark, path)


def estate_merge(spark, sf_dir):
    """Every table profiled by a job of its own; one that can't be read is recorded, the others go on."""
    broken = scratch_path(spark, "broken")
    read_table(spark, sf_dir, "region").select("r_name").write.text(broken)
    jobs = {t: (lambda df=df, t=t: P.profile_tables({t: df}, wide=WIDE)) for t, df in read_tables(spark, sf_dir).items()}
    jobs["broken"] = lambda: P.profile_tables({"broken": spark.read.schema("r_name string").parquet(broken)})
    good, failed = ES.isolated(spark, jobs)
    rows = [df.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"), F.max("total_count").alias("n_rows")) for df in good.values()]
    out = reduce(DataFrame.unionByName, rows).select("table_name", F.lit("profiled").alias("status"), "n_columns", "n_rows")
    return out.unionByName(failed.select(F.col("name").alias("table_name"), F.lit("failed").alias("status"), F.lit(0).cast("long").alias("n_columns"), F.lit(0).cast("long").alias("n_rows")))


def stream_rollup(spark, sf_dir):
    """Events read as a stream, daily executions / first / last / value sum per event type."""
    ev = read_table(spark, sf_dir, "events")
    return run_rollup(spark, sf_dir, ev.schema, "ts", ["event_type"], window="1 day",
                      measure="value", glob="events.parquet")


# ---------------------------------------------------------------- oracle SQL

ESTATE_INVENTORY_SQL = " UNION ALL ".join(
    f"SELECT '{DB}' AS database_name, '{DB}.dbo.{t}' AS object_name, count(*) AS row_count, "
    f"CAST((SELECT count(*) FROM (DESCRIBE {t})) AS BIGINT) AS n_columns FROM {t}" for t in TEST_TABLES)


def _tpch_catalog_sql():
    from lakescope.plans.relations import _catalog_sql
    return _catalog_sql()


TABLE_OVERVIEW_SQL = f"""WITH {_tpch_catalog_sql()},
  counts AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TPCH_TABLES)})
SELECT 'dbo' AS schema_name, c.table_name, count(*) AS n_columns, CAST(0 AS BIGINT) AS n_indexes,
       CAST((SELECT count(*) FROM declared d WHERE d.from_table = c.table_name) AS BIGINT) AS n_foreign_keys,
       coalesce(string_agg(CASE WHEN c.column_name = pk.pk_column THEN c.column_name END, ', '
                           ORDER BY c.ordinal), '') AS primary_key,
       max(counts.row_count) AS row_count
FROM cat c LEFT JOIN pk ON pk.table_name = c.table_name JOIN counts ON counts.table_name = c.table_name
GROUP BY c.table_name"""

DDL_SQL = f"""WITH {_tpch_catalog_sql()}
SELECT 'dbo' AS schema_name, c.table_name,
       'CREATE TABLE [dbo].[' || c.table_name || '] (' || chr(10)
       || string_agg('    [' || c.column_name || '] '
                     || CASE WHEN c.data_type = 'string' THEN 'string' ELSE c.data_type END || ' NULL',
                     ',' || chr(10) ORDER BY c.ordinal)
       || coalesce(',' || chr(10) || '    PRIMARY KEY ([' || max(pk.pk_column) || '])', '')
       || chr(10) || ');' AS ddl
FROM cat c LEFT JOIN pk ON pk.table_name = c.table_name GROUP BY c.table_name"""

DASHBOARD_SQL = f"""WITH p AS ({estate_profile_sql()})
SELECT (SELECT count(DISTINCT table_name) FROM p) AS n_tables, (SELECT count(*) FROM p) AS n_columns,
       (SELECT count(*) FROM p WHERE distinct_count = 1 AND null_count = 0) AS n_constant_columns,
       (SELECT CAST(sum(r) AS BIGINT) FROM (SELECT max(total_count) AS r FROM p GROUP BY table_name)) AS total_rows,
       (SELECT count(*) FROM p WHERE null_count = 0 AND distinct_count = total_count AND total_count > 0)
         AS n_key_columns"""

NAME_SEARCH_SQL = f"""SELECT p_name AS object_name, p_partkey AS key FROM part
WHERE contains(lower(p_name), '{NAME_TERM}') ORDER BY p_name, p_partkey LIMIT 20"""

TEXT_SEARCH_SQL = f"""SELECT doc_id,
       list_filter(string_split(text, chr(10)), lambda l: contains(lower(l), '{TEXT_TERM}'))[1] AS matching_line,
       CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines
FROM documents WHERE contains(lower(text), '{TEXT_TERM}') ORDER BY doc_id LIMIT 30"""

STREAM_SQL = """SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS executions, min(ts) AS first_seen, max(ts) AS last_seen,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS measure_sum
FROM events GROUP BY 1, 2, 3"""

PARTITION_REFRESH_SQL = """SELECT 'region_' || n_regionkey AS database_name, c_custkey,
       CASE WHEN n_regionkey = 1 THEN upper(c_name || '!') ELSE c_name END AS c_name
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2"""

ESTATE_MERGE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, 'profiled' AS status, CAST((SELECT count(*) FROM (DESCRIBE {t})) AS BIGINT) AS n_columns, count(*) AS n_rows FROM {t}"
    for t in TEST_TABLES) + " UNION ALL SELECT 'broken', 'failed', 0, 0"

QUERIES = {
    "partition_refresh": partition_refresh,
    "estate_merge": estate_merge,
    "estate_inventory": estate_inventory,
    "table_overview": table_overview,
    "ddl_text": ddl_text,
    "dashboard_counts": dashboard_counts,
    "name_search": name_search,
    "text_search": text_search,
    "stream_rollup": stream_rollup,
}

ORACLE = {
    "partition_refresh": PARTITION_REFRESH_SQL,
    "estate_merge": ESTATE_MERGE_SQL,
    "estate_inventory": ESTATE_INVENTORY_SQL,
    "table_overview": TABLE_OVERVIEW_SQL,
    "ddl_text": DDL_SQL,
    "dashboard_counts": DASHBOARD_SQL,
    "name_search": NAME_SEARCH_SQL,
    "text_search": TEXT_SEARCH_SQL,
    "stream_rollup": STREAM_SQL,
}

