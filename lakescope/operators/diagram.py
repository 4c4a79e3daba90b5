"""Relationship-diagram tables and graph views: column flags, typed edge list, labels, filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescope.operators.refs import to_full_name

from lakescope.functions.names import full_name

# Edge label by the kind of the depending object.
EDGE_LABELS = {"view": "reads from", "procedure": "calls", "function": "calls", "trigger": "triggered by",
               "synonym": "alias for", "job": "executes"}
DEFAULT_LABEL = "depends on"
# Fixed value: suggested keys drawn on the diagram from this confidence.
MIN_DIAGRAM_CONFIDENCE = 0.7


def edge_label(from_type) -> F.Column:
    """L-4: 'reads from', 'calls', ... by the depending object's kind."""
    m = F.create_map(*[x for k, v in EDGE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.lower(from_type)), F.lit(DEFAULT_LABEL))


def column_flags(columns: DataFrame, foreign_keys: DataFrame, implicit: DataFrame | None = None) -> DataFrame:
    """V-1: every base-table column with pk, fk (declared) and sfk (suggested, neither pk nor fk) flags."""
    k = ["database_name", "_s", "_t", "_c"]
    cols = columns.filter(F.coalesce(F.col("table_type"), F.lit("BASE TABLE")) == "BASE TABLE").select(
        "*", F.lower("schema_name").alias("_s"), F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c"))
    fk = foreign_keys.select("database_name", F.lower("from_schema").alias("_s"), F.lower("from_table").alias("_t"),
                             F.lower("from_column").alias("_c")).distinct().withColumn("fk", F.lit(True))
    out = cols.join(fk, k, "left")
    if implicit is not None:
        sf = implicit.select("database_name", F.lower("from_schema").alias("_s"), F.lower("from_table").alias("_t"),
                             F.lower("from_column").alias("_c")).distinct().withColumn("_sugg", F.lit(True))
        out = out.join(sf, k, "left")
    else:
        out = out.withColumn("_sugg", F.lit(None).cast("boolean"))
    pk = F.coalesce(F.col("is_primary_key"), F.lit(False))
    fkc = F.coalesce(F.col("fk"), F.lit(False))
    return out.select("database_name", full_name("schema_name", "table_name").alias("table"), "column_name",
                      "ordinal_position", pk.alias("pk"), fkc.alias("fk"),
                      (~pk & ~fkc & F.coalesce(F.col("_sugg"), F.lit(False))).alias("sfk"), "is_nullable")


def diagram_edges(foreign_keys: DataFrame, object_edges: DataFrame | None = None,
                  implicit: DataFrame | None = None, nodes: DataFrame | None = None,
                  min_confidence: float = MIN_DIAGRAM_CONFIDENCE) -> DataFrame:
    """V-2 / U6: one edge per from -> to (case-insensitive), first kind wins in the order FK, object
    dependency, suggested key (from ``min_confidence``); with ``nodes`` (database_name, node) both ends
    must be drawn nodes. Output: database_name, src, dst, edge_type, label."""
    parts = [foreign_keys.select(
        "database_name", full_name("from_schema", "from_table").alias("src"),
        full_name("to_schema", "to_table").alias("dst"), F.lit("fk").alias("edge_type"),
        F.concat(F.lit("FK: "), F.col("fk_name")).alias("label"), F.lit(0).alias("_o"))]
    if object_edges is not None:
        to = F.when(F.col("to_database").isNotNull(), F.concat_ws(".", "to_database", "to_schema", "to_name")) \
            .otherwise(F.concat_ws(".", "to_schema", "to_name"))
        parts.append(object_edges.select(
            "database_name", full_name("from_schema", "from_name").alias("src"), to.alias("dst"),
            F.when(F.col("to_database").isNotNull(), F.lit("external")).otherwise(F.lower("from_type"))
            .alias("edge_type"), edge_label(F.col("from_type")).alias("label"), F.lit(1).alias("_o")))
    if implicit is not None:
        imp = implicit.filter(F.col("confidence") >= F.lit(min_confidence).cast("decimal(4,2)"))
        parts.append(imp.select(
            "database_name", full_name("from_schema", "from_table").alias("src"),
            full_name("to_schema", "to_table").alias("dst"), F.lit("implicit").alias("edge_type"),
            F.format_string("Suggested FK: %s.%s.%s -> %s.%s.%s (%d%%)", "from_schema", "from_table", "from_column",
                            "to_schema", "to_table", "to_column", (F.col("confidence") * 100).cast("int"))
            .alias("label"), F.lit(2).alias("_o")))
    u = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("database_name", F.lower("src"), F.lower("dst")).orderBy("_o")
    u = u.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_o")
    if nodes is not None:
        n = nodes.select("database_name", F.lower("node").alias("_k")).distinct()
        u = u.withColumn("_k", F.lower("src")).join(n, ["database_name", "_k"], "left_semi").drop("_k")
        u = u.withColumn("_k", F.lower("dst")).join(n, ["database_name", "_k"], "left_semi").drop("_k")
    return u


def filter_graph(nodes: DataFrame, edges: DataFrame, node_types: list[str] | None = None,
                 edge_types: list[str] | None = None, databases: list[str] | None = None):
    """Keep nodes of the given kinds / databases and the edges whose both ends are kept.

    ``nodes``: node, node_type, database_name; ``edges``: src, dst, edge_type.
    """
    n = nodes
    if node_types:
        n = n.filter(F.col("node_type").isin(node_types))
    if databases:
        n = n.filter(F.col("database_name").isin(databases))
    e = edges
    if edge_types:
        e = e.filter(F.col("edge_type").isin(edge_types))
    keep = n.select("node").distinct()
    e = e.join(keep.withColumnRenamed("node", "src"), "src", "left_semi")
    e = e.join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return n, e


def graph_nodes(objects: DataFrame, object_edges: DataFrame | None = None) -> DataFrame:
    """D-1 / D-3: node table of the seven object kinds, plus an External placeholder per cross-database
    target that is not a node already. ``objects``: database_name, schema_name, object_name, object_type."""
    n = objects.select("database_name", full_name("schema_name", "object_name").alias("node"),
                       F.col("object_type").alias("node_type"), F.lit(None).cast("string").alias("external_database"))
    if object_edges is None:
        return n
    ext = object_edges.filter(F.col("to_database").isNotNull()).select(
        "database_name", F.concat_ws(".", "to_database", "to_schema", "to_name").alias("node"),
        F.lit("External").alias("node_type"), F.col("to_database").alias("external_database")).distinct()
    ext = ext.withColumn("_k", F.lower("node")).join(
        n.select("database_name", F.lower("node").alias("_k")), ["database_name", "_k"], "left_anti").drop("_k")
    return n.unionByName(ext)


def edge_table(fks: DataFrame, refs: DataFrame, objects: DataFrame) -> DataFrame:
    """D-2: the dependency edges of foreign keys and object references: (database_name, src, dst, kind, src_known, dst_known).

    Names compare without case; of several edges between two objects the foreign key stands. ``objects`` has
    database_name, schema_name and object_name; the target of an external reference is a node of its own. An edge counts for
    each end that is known: its source depends on the target, its target is referenced by the source. Edges
    without a known end are left out.
    """
    full = lambda a, b: F.concat_ws(".", a, b)
    rows = fks.select("database_name", full("from_schema", "from_table").alias("src"), full("to_schema", "to_table").alias("dst"),
                      F.lit(0).alias("rank"), F.lit(False).alias("external"))
    rows = rows.unionByName(refs.select("database_name", full("from_schema", "from_name").alias("src"), to_full_name().alias("dst"),
                                        F.lit(1).alias("rank"), F.col("to_database").isNotNull().alias("external")))
    one = rows.groupBy("database_name", F.lower("src").alias("_src"), F.lower("dst").alias("_dst")).agg(
        F.min(F.struct("rank", "src", "dst")).alias("e"), F.bool_or("external").alias("external"))
    known = objects.select("database_name", F.lower(full("schema_name", "object_name")).alias("_name"), F.lit(True).alias("hit")).distinct()
    at = lambda side: known.withColumnRenamed("_name", f"_{side}").withColumnRenamed("hit", f"{side}_hit")
    out = one.join(at("src"), ["database_name", "_src"], "left").join(at("dst"), ["database_name", "_dst"], "left")
    out = out.select("database_name", "e.src", "e.dst", F.when(F.col("e.rank") == 0, "foreign key").otherwise("object").alias("kind"),
                     F.coalesce("src_hit", F.lit(False)).alias("src_known"), (F.coalesce("dst_hit", F.lit(False)) | F.col("external")).alias("dst_known"))
    return out.filter("src_known or dst_known")
