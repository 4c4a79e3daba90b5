"""Usage scoring: signals -> (object_name, object_type, weight, evidence) -> score and level per object.

Weights are decimal(3,1) and the average is taken in exact integer tenths, so the level limits
(+0.3 / -0.3) and the half-even rounding of the score to 3 places never depend on summation order.
A signal whose input frame is missing is simply not added (fault isolation).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescope.functions.names import full_name

# Name prefixes and fragments that mark an object as likely unused.
SUSPICIOUS_PREFIXES = ["tmp", "temp", "bak", "backup", "old", "test", "_", "zz"]
SUSPICIOUS_CONTAINS = ["deprecated", "archive"]

# Level order used for sorting (Unused first).
LEVEL_ORDER = {"Unused": 0, "Low": 1, "Unknown": 2, "Active": 3}

SIGNAL_COLUMNS = ["object_name", "object_type", "weight", "evidence", "signal"]


def _signal(df: DataFrame, name, otype, weight, evidence, signal: str) -> DataFrame:
    otype = F.lit(otype) if isinstance(otype, str) else otype
    return df.select(name.alias("object_name"), otype.alias("object_type"),
                     weight.cast("decimal(3,1)").alias("weight"), evidence.alias("evidence"),
                     F.lit(signal).alias("signal"))


def _w(x: float) -> F.Column:
    return F.lit(str(x)).cast("decimal(3,1)")


def table_reads_signal(table_usage: DataFrame, uptime_days) -> DataFrame:
    """+1.0 when read (uptime >= 7 days); -0.8 when neither read nor written (uptime >= 30 days)."""
    up = F.lit(uptime_days) if not isinstance(uptime_days, F.Column) else uptime_days
    t = table_usage.withColumn("_up", up)
    w = (F.when((F.col("total_reads") > 0) & (F.col("_up") >= 7), _w(1.0))
         .when((F.col("total_reads") == 0) & (F.col("total_writes") == 0) & (F.col("_up") >= 30), _w(-0.8)))
    ev = F.when(F.col("total_reads") > 0, F.format_string("%d reads and %d writes since the counters started",
                                                          F.col("total_reads"), F.col("total_writes"))) \
        .otherwise(F.format_string("no reads or writes in %d days", F.col("_up")))
    return _signal(t, full_name("schema_name", "table_name"), "Table", w, ev, "table_reads").filter(
        F.col("weight").isNotNull())


def execution_signal(usage: DataFrame, object_type: str, uptime_days) -> DataFrame:
    """Procedures / functions: +1.0 when executed; otherwise -0.8 once uptime reaches 30 days."""
    up = F.lit(uptime_days) if not isinstance(uptime_days, F.Column) else uptime_days
    t = usage.withColumn("_up", up)
    w = F.when(F.col("execution_count") > 0, _w(1.0)).when(F.col("_up") >= 30, _w(-0.8))
    ev = F.when(F.col("execution_count") > 0, F.format_string("%d executions", F.col("execution_count"))) \
        .otherwise(F.format_string("no executions in %d days", F.col("_up")))
    return _signal(t, full_name("schema_name", "name"), object_type, w, ev, "executions").filter(
        F.col("weight").isNotNull())


def log_object_signal(log_objects: DataFrame) -> DataFrame:
    """Objects in the query log: +1.0 when executed, else -0.6."""
    days = F.datediff(F.col("last_execution"), F.col("first_execution"))
    ev = F.when(F.col("total_executions") > 0,
                F.concat(F.format_string("query log: %d executions", F.col("total_executions")),
                         F.when(days.isNotNull(), F.format_string(" over %d days", days)).otherwise(F.lit(""))))\
        .otherwise(F.lit("query log: no executions recorded"))
    w = F.when(F.col("total_executions") > 0, _w(1.0)).otherwise(_w(-0.6))
    return _signal(log_objects, full_name("schema_name", "object_name"), F.col("object_type"), w, ev, "query_log")


def log_text_signal(mentions: DataFrame) -> DataFrame:
    """Tables mentioned in query-log texts whose executions add up to more than zero: +0.8."""
    m = mentions.filter(F.col("executions") > 0)
    return _signal(m, full_name("schema_name", "table_name"), "Table", _w(0.8),
                   F.format_string("mentioned in query-log texts with %d executions", F.col("executions")),
                   "query_texts")


def row_count_signal(counts: DataFrame) -> DataFrame:
    """Empty table -0.3, else +0.2. ``counts`` has object_name, row_count."""
    w = F.when(F.col("row_count") == 0, _w(-0.3)).otherwise(_w(0.2))
    ev = F.when(F.col("row_count") == 0, F.lit("table has 0 rows")).otherwise(
        F.format_string("table has %d rows", F.col("row_count")))
    return _signal(counts, F.col("object_name"), "Table", w, ev, "row_count")


def orphan_signal(objects: DataFrame, fk_edges: DataFrame, dep_edges: DataFrame) -> DataFrame:
    """Tables count their relation kinds (FK target, FK source, dependency target, source):
    none -0.5, two or more +0.3; views: unreferenced -0.5 else +0.3; procedures and functions:
    unreferenced -0.5. ``objects``: object_name, object_type; edges: src, dst (full names)."""
    k = lambda c: F.lower(F.col(c))
    sets = [
        fk_edges.select(k("dst").alias("_k")).distinct().withColumn("fk_target", F.lit(1)),
        fk_edges.select(k("src").alias("_k")).distinct().withColumn("fk_source", F.lit(1)),
        dep_edges.select(k("dst").alias("_k")).distinct().withColumn("dep_target", F.lit(1)),
        dep_edges.select(k("src").alias("_k")).distinct().withColumn("dep_source", F.lit(1)),
    ]
    o = objects.withColumn("_k", k("object_name"))
    for s in sets:
        o = o.join(s, "_k", "left")
    o = o.fillna(0, ["fk_target", "fk_source", "dep_target", "dep_source"])
    n = F.col("fk_target") + F.col("fk_source") + F.col("dep_target") + F.col("dep_source")
    is_t, is_v = F.col("object_type") == "Table", F.col("object_type") == "View"
    is_pf = F.col("object_type").isin("Procedure", "Function")
    w = (F.when(is_t & (n == 0), _w(-0.5)).when(is_t & (n >= 2), _w(0.3))
         .when(is_v & (F.col("dep_target") == 0), _w(-0.5)).when(is_v, _w(0.3))
         .when(is_pf & (F.col("dep_target") == 0), _w(-0.5)))
    ev = (F.when(is_t & (n == 0), F.lit("not referenced by any key or dependency"))
          .when(is_t, F.format_string("referenced by %d relation kinds", n))
          .when(F.col("dep_target") == 0, F.lit("not referenced by any other object"))
          .otherwise(F.lit("referenced by other objects")))
    return _signal(o, F.col("object_name"), F.col("object_type"), w, ev, "orphan").filter(
        F.col("weight").isNotNull())


def naming_signal(objects: DataFrame, simple_name_col: str = "simple_name") -> DataFrame:
    """-0.4 for the first suspicious prefix of the simple name, else for a suspicious fragment."""
    low = F.lower(F.col(simple_name_col))
    ev = None
    for p in SUSPICIOUS_PREFIXES:
        e = F.lit(f"name starts with '{p}'")
        ev = F.when(low.startswith(p), e) if ev is None else ev.when(low.startswith(p), e)
    for p in SUSPICIOUS_CONTAINS:
        ev = ev.when(low.contains(p), F.lit(f"name contains '{p}'"))
    o = objects.withColumn("_ev", ev).filter(F.col("_ev").isNotNull())
    return _signal(o, F.col("object_name"), F.col("object_type"), _w(-0.4), F.col("_ev"), "naming")


def usage_scores(signals: list[DataFrame]) -> DataFrame:
    """Per object (case-insensitive): score = average weight rounded half-even to 3 places,
    level from the unrounded average (>= 0.3 Active, >= -0.3 Low, else Unused), evidence list.
    Objects without any signal are absent; Unknown is never assigned."""
    u = reduce(DataFrame.unionByName, [s.select(*SIGNAL_COLUMNS) for s in signals if s is not None])
    g = u.groupBy(F.lower("object_name").alias("_n"), F.lower("object_type").alias("_t")).agg(
        F.min("object_name").alias("object_name"), F.min("object_type").alias("object_type"),
        F.sum((F.col("weight") * 10).cast("long")).alias("_s"), F.count(F.lit(1)).alias("n_signals"),
        F.array_sort(F.collect_list("evidence")).alias("evidence"))
    s, n = F.col("_s"), F.col("n_signals")
    num = s * 100  # average in thousandths = 100 * s / n, rounded half-even
    r = F.pmod(num, n)
    q = (num - r).cast("long") / n
    q = q.cast("long")
    q_rounded = (F.when(2 * r > n, q + 1).when((2 * r == n) & (F.pmod(q, F.lit(2)) == 1), q + 1).otherwise(q))
    level = F.when(s >= 3 * n, "Active").when(s >= -3 * n, "Low").otherwise("Unused")
    out = g.select("object_name", "object_type", (q_rounded.cast("double") / 1000).alias("score"),
                   level.alias("usage_level"), "n_signals", "evidence")
    rank = F.element_at(F.create_map(*[x for k, v in LEVEL_ORDER.items() for x in (F.lit(k), F.lit(v))]),
                        F.col("usage_level"))
    return out.withColumn("level_rank", rank.cast("int"))


def usage_summary(scores: DataFrame) -> DataFrame:
    """Objects per usage level."""
    return scores.groupBy("usage_level").agg(F.count(F.lit(1)).alias("n_objects"))


def top_texts(log_texts: DataFrame, n: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Ad-hoc texts by executions; the first ``n`` and a text's first ``max_chars`` if given."""
    g = log_texts.groupBy("query_text").agg(F.sum("total_executions").alias("total_executions"),
                                            F.max("last_execution").alias("last_execution"))
    top = g.orderBy(F.col("total_executions").desc(), F.col("query_text"))
    top = top if n is None else top.limit(n)
    text = F.col("query_text") if max_chars is None else F.substring("query_text", 1, max_chars).alias("query_text")
    return top.select(text, "total_executions", "last_execution")


def rollup_counters(log: DataFrame, keys: list[str], ts_col: str) -> DataFrame:
    """Executions, first and last time per object from an execution log."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_executions"),
                                  F.min(ts_col).alias("first_execution"), F.max(ts_col).alias("last_execution"))


def ordered_usage(scores: DataFrame) -> DataFrame:
    """O3: Unused first, then Low, Unknown, Active; lower score first inside a level; then name."""
    return scores.orderBy("level_rank", "score", "object_name")


def filter_level(scores: DataFrame, levels: list[str]) -> DataFrame:
    """objects of the given usage levels."""
    return scores.filter(F.col("usage_level").isin(levels))


def execution_counters(objects: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Every procedure or function with its execution counters (null -> 0), stats
    pre-aggregated per object before the join."""
    agg = stats.groupBy(*keys).agg(F.sum("execution_count").alias("execution_count"),
                                   F.max("last_execution").alias("last_execution"))
    return objects.join(agg, keys, "left").withColumn(
        "execution_count", F.coalesce(F.col("execution_count"), F.lit(0)).cast("long"))


def table_counters(tables: DataFrame, index_stats: DataFrame) -> DataFrame:
    """Reads (seeks + scans + lookups) and writes per table, summed over its access paths, and the
    latest seek / scan / lookup time; tables without statistics get zeros."""
    k = ["database_name", "schema_name", "table_name"]
    agg = index_stats.groupBy(*k).agg(
        F.sum(F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups")).alias("total_reads"),
        F.sum("user_updates").alias("total_writes"), F.max("last_seek").alias("last_seek"),
        F.max("last_scan").alias("last_scan"), F.max("last_lookup").alias("last_lookup"))
    return tables.select(*k).distinct().join(agg, k, "left").fillna(0, ["total_reads", "total_writes"])


def uptime_days(start_time, now=None) -> F.Column:
    """Whole days since the counters started (null when the start is unknown)."""
    now = now if now is not None else F.current_timestamp()
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(start_time)) / 86400).cast("int")


def log_is_enabled(spark, table_name: str) -> bool:
    """The query log counts as on when its table exists in the catalog."""
    return spark.catalog.tableExists(table_name)
