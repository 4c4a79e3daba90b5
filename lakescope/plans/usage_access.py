"""Usage-scoring and access-path bindings on the test snapshot.

* parts are the scored objects: lines read a part (reads), returned lines write it (writes), its line
  count is its row count, lines reference it (FK target), its name feeds the naming rule; customers
  are query-log objects executed once per order. Uptime = days between first and last ship date.
* each (user, day) of ``events`` is an access path on the user's "table": views are seeks, clicks
  scans, purchases lookups, errors updates; its key list is the day's event types in order of first
  occurrence.
* each (part, supplier) pair is a missing-path suggestion; impact = sum of price x discount.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakescope.operators import access as A
from lakescope.operators import usage as U
from lakescope.sources.tables import read_table

DB = "testdata"


def _uptime_days(spark, sf_dir) -> int:
    li = read_table(spark, sf_dir, "lineitem")
    return int(li.agg(F.datediff(F.max("l_shipdate"), F.min("l_shipdate"))).first()[0] or 0)


def usage_signals(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    p = read_table(spark, sf_dir, "part")
    per_part = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("total_reads"),
                                           F.count_if(F.col("l_returnflag") == "R").alias("total_writes"))
    parts = p.join(per_part, p.p_partkey == per_part.l_partkey, "left").select(
        F.lit("part").alias("schema_name"), F.col("p_partkey").cast("string").alias("table_name"),
        F.coalesce("total_reads", F.lit(0)).alias("total_reads"),
        F.coalesce("total_writes", F.lit(0)).alias("total_writes"), "p_name")
    uptime = _uptime_days(spark, sf_dir)
    objects = parts.select(F.concat_ws(".", "schema_name", "table_name").alias("object_name"),
                           F.lit("Table").alias("object_type"), F.col("p_name").alias("simple_name"))
    fk_edges = li.select(F.lit("part.lineitem").alias("src"),
                         F.concat(F.lit("part."), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    dep_edges = fk_edges.limit(0)
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    per_cust = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("f"),
                                          F.max("o_orderdate").alias("l"))
    log_objects = c.join(per_cust, c.c_custkey == per_cust.o_custkey, "left").select(
        F.lit("customer").alias("schema_name"), F.col("c_custkey").cast("string").alias("object_name"),
        F.lit("Customer").alias("object_type"), F.coalesce("n", F.lit(0)).alias("total_executions"),
        F.col("l").alias("last_execution"), F.col("f").alias("first_execution"))
    return [
        U.table_reads_signal(parts, uptime),
        U.row_count_signal(parts.select(F.concat_ws(".", "schema_name", "table_name").alias("object_name"),
                                        F.col("total_reads").alias("row_count"))),
        U.orphan_signal(objects, fk_edges, dep_edges),
        U.naming_signal(objects),
        U.log_object_signal(log_objects),
    ]


def usage_scores(spark, sf_dir):
    """N1, N3, N5, N6, N8 -> N9: score and level of every part and customer."""
    s = U.usage_scores(usage_signals(spark, sf_dir))
    return s.select("object_name", "object_type", "score", "usage_level", "level_rank", "n_signals",
                    F.array_join("evidence", " | ").alias("evidence"))


def supplier_usage(spark, sf_dir):
    """N2 / N7 / N9 on data: suppliers as executed objects (one execution per line supplied; uptime from
    the ship dates), never referenced by another object, scored and levelled."""
    li = read_table(spark, sf_dir, "lineitem")
    s = read_table(spark, sf_dir, "supplier")
    per = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("execution_count"))
    usage = s.join(per, s.s_suppkey == per.l_suppkey, "left").select(
        F.lit("supplier").alias("schema_name"), F.col("s_suppkey").cast("string").alias("name"),
        F.coalesce("execution_count", F.lit(0)).alias("execution_count"))
    objects = usage.select(F.concat_ws(".", "schema_name", "name").alias("object_name"),
                           F.lit("Procedure").alias("object_type"))
    none = objects.select(F.col("object_name").alias("src"), F.col("object_name").alias("dst")).limit(0)
    scores = U.usage_scores([U.execution_signal(usage, "Procedure", _uptime_days(spark, sf_dir)),
                             U.orphan_signal(objects, none, none)])
    return scores.select("object_name", "object_type", "score", "usage_level", "n_signals",
                         F.array_join("evidence", " | ").alias("evidence"))


def usage_summary(spark, sf_dir):
    """Objects per usage level."""
    return U.usage_summary(U.usage_scores(usage_signals(spark, sf_dir)))


def usage_rollup(spark, sf_dir):
    """Executions, first and last time per user and event type."""
    ev = read_table(spark, sf_dir, "events")
    return U.rollup_counters(ev, ["user_id", "event_type"], "ts")


def top_texts(spark, sf_dir):
    """Top 200 conversation openers by number of turns, cut at 4000 characters."""
    cv = read_table(spark, sf_dir, "conversations")
    per = cv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total_executions"),
                                    F.min_by("text", "turn").alias("query_text"))
    logs = per.select("query_text", "total_executions", F.lit(None).cast("timestamp").alias("last_execution"))
    return U.top_texts(logs, 200, 4000).drop("last_execution")


def path_inventory(spark, sf_dir):
    """Each (user, day) as an access path. Its key list is the day's event types in order of first
    occurrence: events are pre-aggregated to one row per (user, day, type) before the list is built,
    so a hot user-day never gathers its raw events in one task."""
    ev = read_table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    per_type = ev.groupBy("user_id", day.alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    g = per_type.groupBy("user_id", "day").agg(
        F.sum(F.when(F.col("event_type") == "view", F.col("n")).otherwise(0)).alias("user_seeks"),
        F.sum(F.when(F.col("event_type") == "click", F.col("n")).otherwise(0)).alias("user_scans"),
        F.sum(F.when(F.col("event_type") == "purchase", F.col("n")).otherwise(0)).alias("user_lookups"),
        F.sum(F.when(F.col("event_type") == "error", F.col("n")).otherwise(0)).alias("user_updates"),
        F.sum("n").alias("size_kb"),
        F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))),
                    lambda s: s["event_type"]).alias("columns"))
    return g.select(F.lit(DB).alias("database_name"), F.lit("user").alias("schema_name"),
                    F.col("user_id").cast("string").alias("table_name"), F.col("day").alias("index_name"),
                    F.lit("NONCLUSTERED").alias("index_type"), F.lit(False).alias("is_unique"),
                    F.lit(False).alias("is_clustered"), "columns", F.col("user_seeks").cast("long"),
                    F.col("user_scans").cast("long"), F.col("user_lookups").cast("long"),
                    F.col("user_updates").cast("long"), F.col("size_kb").cast("long"))


def unused_paths(spark, sf_dir):
    """User-days with no view, click or purchase but with errors."""
    return A.unused_paths(path_inventory(spark, sf_dir)).drop("database_name", "impact_score")


def access_inventory(spark, sf_dir):
    """Totals over all user-day paths."""
    return A.inventory_totals(path_inventory(spark, sf_dir)).drop("database_name")


def redundant_paths(spark, sf_dir):
    """I4: user-days whose event-type sequence is a prefix of (or equal to) another day's of the same user."""
    return A.redundant_paths(path_inventory(spark, sf_dir)).drop("database_name")


def missing_stats(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    amount = F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")
    g = li.groupBy("l_partkey", "l_suppkey").agg(
        F.sum(amount).alias("impact_score"), F.count(F.lit(1)).alias("user_seeks"),
        F.count_if(F.col("l_returnflag") == "R").alias("user_scans"))
    return g.select(F.lit(DB).alias("database_name"), F.concat(F.lit("p"), F.col("l_partkey")).alias("schema_name"),
                    F.concat(F.lit("s"), F.col("l_suppkey")).alias("table_name"), "impact_score",
                    F.lit("[l_orderkey]").alias("equality_columns"), F.lit("[l_shipdate]").alias("inequality_columns"),
                    F.lit("[l_quantity], [l_extendedprice]").alias("include_columns"), "user_seeks", "user_scans")


def impact_bands(spark, sf_dir):
    """Severity band and create statement of every (part, supplier) suggestion."""
    return A.missing_paths(missing_stats(spark, sf_dir)).drop("database_name")


def access_recommendations(spark, sf_dir):
    """Unused, missing and duplicate advice in one frame."""
    inv = path_inventory(spark, sf_dir)  # one plan for both consumers, so its exchange is reused
    return A.recommendations(inv, missing_stats(spark, sf_dir), inv).drop("database_name")


# ---------------------------------------------------------------- oracle SQL

_PREFIX_CASE = " ".join(f"WHEN starts_with(lower(p_name), '{p}') THEN 'name starts with ''{p}'''"
                        for p in U.SUSPICIOUS_PREFIXES)
_CONTAINS_CASE = " ".join(f"WHEN contains(lower(p_name), '{p}') THEN 'name contains ''{p}'''"
                          for p in U.SUSPICIOUS_CONTAINS)

SIGNALS_SQL = f"""
  up AS (SELECT date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) AS d FROM lineitem),
  pp AS (SELECT l_partkey, count(*) AS reads, count(*) FILTER (WHERE l_returnflag = 'R') AS writes
         FROM lineitem GROUP BY l_partkey),
  parts AS (SELECT 'part.' || p_partkey AS object_name, p_name, coalesce(reads, 0) AS reads,
                   coalesce(writes, 0) AS writes FROM part LEFT JOIN pp ON pp.l_partkey = p_partkey),
  fk AS (SELECT DISTINCT 'part.' || l_partkey AS dst FROM lineitem),
  pc AS (SELECT o_custkey, count(*) AS n, min(o_orderdate) AS f, max(o_orderdate) AS l FROM orders GROUP BY 1),
  cust AS (SELECT 'customer.' || c_custkey AS object_name, coalesce(n, 0) AS n, f, l
           FROM customer LEFT JOIN pc ON pc.o_custkey = c_custkey),
  signals AS (
    SELECT object_name, 'Table' AS object_type,
           CASE WHEN reads > 0 AND (SELECT d FROM up) >= 7 THEN 10
                WHEN reads = 0 AND writes = 0 AND (SELECT d FROM up) >= 30 THEN -8 END AS w10,
           CASE WHEN reads > 0 THEN printf('%d reads and %d writes since the counters started', reads, writes)
                ELSE printf('no reads or writes in %d days', (SELECT d FROM up)) END AS evidence
    FROM parts
    UNION ALL
    SELECT object_name, 'Table', CASE WHEN reads = 0 THEN -3 ELSE 2 END,
           CASE WHEN reads = 0 THEN 'table has 0 rows' ELSE printf('table has %d rows', reads) END FROM parts
    UNION ALL
    SELECT object_name, 'Table', -5, 'not referenced by any key or dependency'
    FROM parts WHERE object_name NOT IN (SELECT dst FROM fk)
    UNION ALL
    SELECT object_name, 'Table', -4, CASE {_PREFIX_CASE} {_CONTAINS_CASE} END FROM parts
    WHERE (CASE {_PREFIX_CASE} {_CONTAINS_CASE} END) IS NOT NULL
    UNION ALL
    SELECT object_name, 'Customer', CASE WHEN n > 0 THEN 10 ELSE -6 END,
           CASE WHEN n > 0 THEN printf('query log: %d executions', n)
                  || coalesce(printf(' over %d days', date_diff('day', CAST(f AS DATE), CAST(l AS DATE))), '')
                ELSE 'query log: no executions recorded' END
    FROM cust),
  g AS (
    SELECT min(object_name) AS object_name, min(object_type) AS object_type, sum(w10) AS s, count(*) AS n,
           string_agg(evidence, ' | ' ORDER BY evidence) AS evidence
    FROM signals WHERE w10 IS NOT NULL GROUP BY lower(object_name), lower(object_type)),
  sc AS (
    SELECT *, ((100 * s) % n + n) % n AS r, (100 * s - (((100 * s) % n + n) % n)) // n AS q FROM g),
  scores AS (
    SELECT object_name, object_type,
           CAST(CASE WHEN 2 * r > n THEN q + 1 WHEN 2 * r = n AND ((q % 2) + 2) % 2 = 1 THEN q + 1 ELSE q END
                AS DOUBLE) / 1000 AS score,
           CASE WHEN s >= 3 * n THEN 'Active' WHEN s >= -3 * n THEN 'Low' ELSE 'Unused' END AS usage_level,
           n AS n_signals, evidence
    FROM sc)"""

USAGE_SCORES_SQL = f"""WITH {SIGNALS_SQL}
SELECT object_name, object_type, score, usage_level,
       CAST(CASE usage_level WHEN 'Unused' THEN 0 WHEN 'Low' THEN 1 WHEN 'Unknown' THEN 2 ELSE 3 END AS INTEGER)
         AS level_rank, n_signals, evidence
FROM scores"""

USAGE_SUMMARY_SQL = f"""WITH {SIGNALS_SQL}
SELECT usage_level, count(*) AS n_objects FROM scores GROUP BY usage_level"""

USAGE_ROLLUP_SQL = """SELECT user_id, event_type, count(*) AS total_executions, min(ts) AS first_execution,
       max(ts) AS last_execution FROM events GROUP BY user_id, event_type"""

TOP_TEXTS_SQL = """WITH per AS (SELECT conv_id, count(*) AS n, arg_min(text, turn) AS t FROM conversations GROUP BY 1),
  g AS (SELECT t AS query_text, sum(n) AS total_executions FROM per GROUP BY t)
SELECT substring(query_text, 1, 4000) AS query_text, CAST(total_executions AS BIGINT) AS total_executions
FROM (SELECT * FROM g ORDER BY total_executions DESC, query_text LIMIT 200)"""

INVENTORY_SQL = """
  inv0 AS (
    SELECT 'user' AS schema_name, CAST(user_id AS VARCHAR) AS table_name, strftime(ts, '%Y-%m-%d') AS index_name,
           count(*) FILTER (WHERE event_type = 'view') AS user_seeks,
           count(*) FILTER (WHERE event_type = 'click') AS user_scans,
           count(*) FILTER (WHERE event_type = 'purchase') AS user_lookups,
           count(*) FILTER (WHERE event_type = 'error') AS user_updates,
           count(*) AS size_kb,
           list(event_type ORDER BY ts, event_id) AS _seq
    FROM events GROUP BY 1, 2, 3),
  inv AS (
    SELECT * EXCLUDE (_seq), list_filter(_seq, lambda x, i: list_position(_seq, x) = i) AS cols
    FROM inv0)"""

UNUSED_SQL = f"""WITH {INVENTORY_SQL}
SELECT 'Unused' AS category, 'warning' AS severity, 1 AS severity_rank, schema_name, table_name, index_name,
       printf('[%s] on [%s].[%s] was written %d times and never read.', index_name, schema_name,
              table_name, user_updates) AS description,
       printf('DROP INDEX [%s] ON [%s].[%s]', index_name, schema_name, table_name) AS recommendation
FROM inv WHERE user_seeks = 0 AND user_scans = 0 AND user_lookups = 0 AND user_updates > 0"""

ACCESS_INVENTORY_SQL = f"""WITH {INVENTORY_SQL}
SELECT 'NONCLUSTERED' AS index_type, count(*) AS n_paths, CAST(sum(user_seeks) AS BIGINT) AS seeks,
       CAST(sum(user_scans) AS BIGINT) AS scans, CAST(sum(user_lookups) AS BIGINT) AS lookups,
       CAST(sum(user_updates) AS BIGINT) AS updates, CAST(sum(size_kb) AS BIGINT) AS size_kb FROM inv"""

REDUNDANT_CORE_SQL = f"""{INVENTORY_SQL},
  cand AS (
    SELECT x.schema_name, x.table_name, x.index_name, x.cols, y.index_name AS y_name, y.cols AS y_cols,
           len(y.cols) > len(x.cols) AS proper
    FROM inv x JOIN inv y ON x.schema_name = y.schema_name AND x.table_name = y.table_name
    WHERE (len(y.cols) > len(x.cols) AND y.cols[1:len(x.cols)] = x.cols)
       OR (y.cols = x.cols AND y.index_name > x.index_name)),
  best AS (
    SELECT *, row_number() OVER (PARTITION BY schema_name, table_name, index_name
                                 ORDER BY proper DESC, CASE WHEN proper THEN len(y_cols) ELSE 0 END DESC,
                                          y_name DESC) AS rn
    FROM cand),
  red AS (
    SELECT schema_name, table_name, index_name, array_to_string(cols, ', ') AS columns, y_name AS covering_index,
           array_to_string(y_cols, ', ') AS covering_columns, CASE WHEN proper THEN 'prefix' ELSE 'equal' END AS kind
    FROM best WHERE rn = 1)"""

REDUNDANT_SQL = f"WITH {REDUNDANT_CORE_SQL}\nSELECT * FROM red"

MISSING_CORE_SQL = """
  st AS (
    SELECT 'p' || l_partkey AS schema_name, 's' || l_suppkey AS table_name,
           sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS impact,
           '[l_orderkey]' AS eq, '[l_shipdate]' AS ineq, '[l_quantity], [l_extendedprice]' AS inc
    FROM lineitem GROUP BY l_partkey, l_suppkey),
  miss AS (
    SELECT 'Missing' AS category,
           CASE WHEN impact > 10000 THEN 'error' WHEN impact > 1000 THEN 'warning' ELSE 'info' END AS severity,
           CASE WHEN impact > 10000 THEN 2 WHEN impact > 1000 THEN 1 ELSE 0 END AS severity_rank,
           schema_name, table_name,
           'IX_' || table_name || '_' || substring(md5(schema_name || '|' || table_name || '|' || eq || '|' || ineq
                                                       || '|' || inc), 1, 6) AS index_name,
           printf('Queries on [%s].[%s] lack a path for equality on [%s] and ranges on [%s]', schema_name, table_name, eq, ineq)
             AS description,
           eq, ineq, inc, CAST(round_even(impact, 2) AS DOUBLE) AS impact_score
    FROM st)"""

IMPACT_BANDS_SQL = f"""WITH {MISSING_CORE_SQL}
SELECT category, severity, CAST(severity_rank AS INTEGER) AS severity_rank, schema_name, table_name, index_name,
       description,
       printf('CREATE NONCLUSTERED INDEX [%s] ON [%s].[%s] (%s)', index_name, schema_name, table_name,
              eq || ', ' || ineq) || ' INCLUDE (' || inc || ')' AS recommendation,
       impact_score
FROM miss"""

ACCESS_RECOMMENDATIONS_SQL = f"""WITH {REDUNDANT_CORE_SQL}, {MISSING_CORE_SQL}
SELECT 'Unused' AS category, 'warning' AS severity, 1 AS severity_rank, schema_name, table_name, index_name,
       printf('[%s] on [%s].[%s] was written %d times and never read.', index_name, schema_name,
              table_name, user_updates) AS description,
       printf('DROP INDEX [%s] ON [%s].[%s]', index_name, schema_name, table_name) AS recommendation,
       CAST(NULL AS DOUBLE) AS impact_score
FROM inv WHERE user_seeks = 0 AND user_scans = 0 AND user_lookups = 0 AND user_updates > 0
UNION ALL
SELECT category, severity, severity_rank, schema_name, table_name, index_name, description,
       printf('CREATE NONCLUSTERED INDEX [%s] ON [%s].[%s] (%s)', index_name, schema_name, table_name,
              eq || ', ' || ineq) || ' INCLUDE (' || inc || ')', impact_score
FROM miss
UNION ALL
SELECT 'Duplicate', 'info', 0, schema_name, table_name, index_name,
       printf('[%s] with (%s) is covered by [%s] with (%s).', index_name, columns, covering_index,
              covering_columns),
       printf('[%s] can go where [%s] serves its queries.', index_name, covering_index), NULL
FROM red"""

SUPPLIER_USAGE_SQL = """WITH
  up AS (SELECT date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) AS d FROM lineitem),
  per AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1),
  sup AS (SELECT 'supplier.' || s_suppkey AS object_name, coalesce(n, 0) AS n FROM supplier
          LEFT JOIN per ON per.l_suppkey = s_suppkey),
  signals AS (
    SELECT object_name, CASE WHEN n > 0 THEN 10 WHEN (SELECT d FROM up) >= 30 THEN -8 END AS w10,
           CASE WHEN n > 0 THEN printf('%d executions', n) ELSE printf('no executions in %d days', (SELECT d FROM up))
           END AS evidence FROM sup
    UNION ALL
    SELECT object_name, -5, 'not referenced by any other object' FROM sup),
  g AS (SELECT object_name, sum(w10) AS s, count(*) AS n, string_agg(evidence, ' | ' ORDER BY evidence) AS evidence
        FROM signals WHERE w10 IS NOT NULL GROUP BY object_name),
  sc AS (SELECT *, ((100 * s) % n + n) % n AS r, (100 * s - (((100 * s) % n + n) % n)) // n AS q FROM g)
SELECT object_name, 'Procedure' AS object_type,
       CAST(CASE WHEN 2 * r > n THEN q + 1 WHEN 2 * r = n AND ((q % 2) + 2) % 2 = 1 THEN q + 1 ELSE q END
            AS DOUBLE) / 1000 AS score,
       CASE WHEN s >= 3 * n THEN 'Active' WHEN s >= -3 * n THEN 'Low' ELSE 'Unused' END AS usage_level,
       n AS n_signals, evidence
FROM sc"""

QUERIES = {
    "supplier_usage": supplier_usage,
    "usage_scores": usage_scores,
    "usage_summary": usage_summary,
    "usage_rollup": usage_rollup,
    "top_texts": top_texts,
    "unused_paths": unused_paths,
    "access_inventory": access_inventory,
    "redundant_paths": redundant_paths,
    "impact_bands": impact_bands,
    "access_recommendations": access_recommendations,
}

ORACLE = {
    "supplier_usage": SUPPLIER_USAGE_SQL,
    "usage_scores": USAGE_SCORES_SQL,
    "usage_summary": USAGE_SUMMARY_SQL,
    "usage_rollup": USAGE_ROLLUP_SQL,
    "top_texts": TOP_TEXTS_SQL,
    "unused_paths": UNUSED_SQL.replace("1 AS severity_rank", "CAST(1 AS INTEGER) AS severity_rank"),
    "access_inventory": ACCESS_INVENTORY_SQL,
    "redundant_paths": REDUNDANT_SQL,
    "impact_bands": IMPACT_BANDS_SQL,
    "access_recommendations": f"SELECT category, severity, CAST(severity_rank AS INTEGER) AS severity_rank, "
                              f"schema_name, table_name, index_name, description, recommendation, impact_score "
                              f"FROM ({ACCESS_RECOMMENDATIONS_SQL})",
}
