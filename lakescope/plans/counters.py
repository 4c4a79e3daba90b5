"""Bindings of the counter operators: executions, reads, access paths and missing paths, from ``events`` and ``lineitem``.

Customers are procedures that the events of the user with their key execute. Event types are tables, users modulo
``PATHS`` their access paths; an event is a seek if its value is below ``SEEK_BELOW``, else a scan, and an update if its type says so.
A part is a suggested path whose group holds its price and size, sought once for each line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakescope.operators import access as A
from lakescope.operators import diagram as V
from lakescope.operators import refs as E
from lakescope.operators import usage as U
from lakescope.plans.links import DB, SCHEMA, object_frames
from lakescope.sources.tables import read_table

PATHS, SEEK_BELOW, NOW = 20, 10.0, "2024-03-01 00:00:00"
KEYS = ["database_name", "schema_name"]


def _text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _named(df, name, alias):
    return df.select(F.lit(DB).alias("database_name"), F.lit(SCHEMA).alias("schema_name"), name.alias(alias), "*")


def execution_counts(spark, sf_dir):
    """Every customer's procedure with its executions (none: 0) and the last of them."""
    c = _named(read_table(spark, sf_dir, "customer"), F.col("c_name"), "name").select(*KEYS, "name", F.col("c_custkey").alias("key"))
    stats = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.lit(1).alias("execution_count"), F.col("ts").alias("last_execution"))
    return U.execution_counters(c, stats, ["key"]).select("name", "key", "execution_count", _text("last_execution").alias("last_execution"))


def path_events(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    seek = F.coalesce(F.col("value") < SEEK_BELOW, F.lit(False))
    one = lambda c: c.cast("int").cast("long")
    return _named(e, F.col("event_type"), "table_name").select(
        *KEYS, "table_name", F.concat(F.lit("path_"), (F.col("user_id") % PATHS).cast("string")).alias("index_name"), one(seek).alias("user_seeks"), one(~seek).alias("user_scans"),
        F.lit(0).cast("long").alias("user_lookups"), one(F.col("event_type") == "purchase").alias("user_updates"),
        F.when(seek, F.col("ts")).alias("last_seek"), F.when(~seek, F.col("ts")).alias("last_scan"), F.lit(None).cast("timestamp").alias("last_lookup"))


def table_reads(spark, sf_dir):
    """Reads, writes and last uses of each event type, and of the regions, which have none."""
    stats = path_events(spark, sf_dir)
    tables = stats.select(*KEYS, "table_name").unionByName(_named(read_table(spark, sf_dir, "region"), F.col("r_name"), "table_name").select(*KEYS, "table_name"))
    out = U.table_counters(tables, stats)
    return out.select("table_name", "total_reads", "total_writes", _text("last_seek").alias("last_seek"), _text("last_scan").alias("last_scan"))


def path_inventory(spark, sf_dir):
    """Access paths with their counters and sizes; a path for each nation has neither."""
    stats = path_events(spark, sf_dir)
    k = [*KEYS, "table_name", "index_name"]
    none = _named(read_table(spark, sf_dir, "nation"), F.lit("nations"), "table_name").select(*KEYS, "table_name", F.col("n_name").alias("index_name"))
    sizes = stats.select(*k, F.lit(1).cast("long").alias("pages"))
    out = A.usage_inventory(stats.select(*k).distinct().unionByName(none), stats, sizes)
    return out.select("table_name", "index_name", "user_seeks", "user_scans", "user_lookups", "user_updates", "size_kb")


def missing_facts(spark, sf_dir):
    """Suggested paths with their impact, from details, groups and statistics."""
    p, li = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "lineitem")
    details = p.select(F.lit(DB).alias("database_name"), F.lit(SCHEMA).alias("schema_name"), F.col("p_partkey").alias("index_handle"),
                       F.concat(F.lit("[testdata].[dbo].["), "p_brand", F.lit("]")).alias("statement"), F.col("p_type").alias("equality_columns"),
                       F.lit(None).cast("string").alias("inequality_columns"), F.col("p_name").alias("included_columns"))
    groups = p.select(F.col("p_partkey").alias("index_handle"), (F.col("p_partkey") + 1).alias("group_handle"))
    used = li.groupBy((F.col("l_partkey") + 1).alias("group_handle")).agg(F.count(F.lit(1)).alias("user_seeks"))
    stats = p.select((F.col("p_partkey") + 1).alias("group_handle"), F.col("p_retailprice").alias("avg_total_user_cost"), F.col("p_size").cast("double").alias("avg_user_impact")).join(
        used, "group_handle").withColumn("user_scans", F.lit(0).cast("long"))
    return A.missing_index_facts(details, groups, stats).select("table_name", "impact_score", "equality_columns", "include_columns", "user_seeks")


def counter_age(spark, sf_dir):
    """Whole days from each event type's first event to a fixed day."""
    e = read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("ts").cast("timestamp").alias("start"))
    return e.select("event_type", U.uptime_days(F.col("start"), F.lit(NOW).cast("timestamp")).alias("days"))


def node_list(spark, sf_dir):
    """D-1 / D-3: nodes of the objects of ``links``, with a placeholder for each external target."""
    known, bodies, recorded, synonyms = object_frames(spark, sf_dir)
    edges = E.object_dependencies(E.name_aliases(known), bodies, synonyms=synonyms, recorded=recorded)
    return V.graph_nodes(known, edges).select("node", "node_type", "external_database")


# ---------------------------------------------------------------- oracle SQL

EXECUTION_COUNTS_SQL = """SELECT c_name AS name, c_custkey AS key, count(event_id) AS execution_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_execution
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_name, c_custkey"""

_EVENTS = f"""SELECT event_type AS table_name, 'path_' || (user_id % {PATHS}) AS index_name, ts, coalesce(value < {SEEK_BELOW}, false) AS seek, event_type = 'purchase' AS upd FROM events"""

TABLE_READS_SQL = f"""SELECT table_name, count(*) AS total_reads, count(*) FILTER (WHERE upd) AS total_writes,
       strftime(max(ts) FILTER (WHERE seek), '%Y-%m-%d %H:%M:%S') AS last_seek, strftime(max(ts) FILTER (WHERE NOT seek), '%Y-%m-%d %H:%M:%S') AS last_scan
FROM ({_EVENTS}) GROUP BY table_name UNION ALL SELECT r_name, 0, 0, NULL, NULL FROM region"""

PATH_INVENTORY_SQL = f"""SELECT table_name, index_name, count(*) FILTER (WHERE seek) AS user_seeks, count(*) FILTER (WHERE NOT seek) AS user_scans,
       CAST(0 AS BIGINT) AS user_lookups, count(*) FILTER (WHERE upd) AS user_updates, count(*) * 8 AS size_kb
FROM ({_EVENTS}) GROUP BY table_name, index_name UNION ALL SELECT 'nations', n_name, 0, 0, 0, 0, 0 FROM nation"""

MISSING_FACTS_SQL = """SELECT p_brand AS table_name, p_retailprice * CAST(p_size AS DOUBLE) * n AS impact_score, p_type AS equality_columns, p_name AS include_columns, n AS user_seeks
FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey"""

COUNTER_AGE_SQL = f"""SELECT event_type, CAST(floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(min(ts)))) / 86400) AS INTEGER) AS days FROM events GROUP BY event_type"""

NODE_LIST_SQL = """SELECT 'dbo.' || n_name AS node, 'Table' AS node_type, CAST(NULL AS VARCHAR) AS external_database FROM nation
UNION ALL SELECT 'dbo.supplier_' || s_suppkey, 'View', NULL FROM supplier
UNION ALL SELECT 'dbo.customer_' || c_custkey, 'Procedure', NULL FROM customer
UNION ALL SELECT DISTINCT 'region_' || n_regionkey || '.dbo.totals', 'External', 'region_' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

QUERIES = {f.__name__: f for f in (execution_counts, table_reads, path_inventory, missing_facts, counter_age, node_list)}
ORACLE = {
    "execution_counts": EXECUTION_COUNTS_SQL,
    "table_reads": TABLE_READS_SQL,
    "path_inventory": PATH_INVENTORY_SQL,
    "missing_facts": MISSING_FACTS_SQL,
    "counter_age": COUNTER_AGE_SQL,
    "node_list": NODE_LIST_SQL,
}
