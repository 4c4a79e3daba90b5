"""Bindings for object references, edges across databases, orphan links and orderings.

* Object bodies are cut from the data: a supplier is a view that reads its nation's table, a table of its region's
  database and a table that does not exist; a customer is a procedure that calls a supplier's view and reads its
  nation in a text literal; a region is a synonym of a nation's table. Every second supplier's dependency is also recorded.
* Estate of regions: a region is a database, its nations are tables, its customers views that read a nation of
  their own database and one of another. The last region is not analysed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakescope.operators import diagram as V
from lakescope.operators import estate as ES
from lakescope.operators import profile as P
from lakescope.operators import refs as E
from lakescope.operators import relations as R
from lakescope.operators import search as H
from lakescope.plans.profiling import WIDE, estate_profile_sql
from lakescope.plans.relations import IMPLICIT_SQL, tpch_frames
from lakescope.session import cut_lineage
from lakescope.sources.tables import read_table, read_tables

DB, SCHEMA = "testdata", "dbo"
NOT_ANALYSED = "region_4"


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _bodies(df, name, kind, text):
    return df.select(F.lit(DB).alias("database_name"), F.lit(SCHEMA).alias("from_schema"), name.alias("from_name"), F.lit(kind).alias("from_type"),
                     text.alias("text"), F.lit(0).alias("step"))


def _objects(df, name, kind):
    return df.select(F.lit(DB).alias("database_name"), F.lit(SCHEMA).alias("schema_name"), name.alias("object_name"), F.lit(kind).alias("object_type"))


def object_frames(spark, sf_dir):
    """(known objects, bodies, recorded dependencies, synonyms)."""
    n, s, c, r = (read_table(spark, sf_dir, t) for t in ("nation", "supplier", "customer", "region"))
    col = F.col
    sn = s.join(n, s.s_nationkey == n.n_nationkey)
    cn = c.join(n, c.c_nationkey == n.n_nationkey)
    sup, cus = _text("supplier_", col("s_suppkey")), _text("customer_", col("c_custkey"))
    views = _bodies(sn, sup, "View", _text("SELECT * FROM dbo.", col("n_name"), " n JOIN region_", col("n_regionkey"), ".dbo.totals t JOIN missing_", col("s_suppkey"), " m"))
    calls = _bodies(cn, cus, "Procedure", _text("EXEC dbo.supplier_", col("c_nationkey"), "; EXEC('SELECT 1 AS one FROM [dbo].[", col("n_name"), "] WHERE 1 = 1'); SELECT 1 FROM dbo.customer_", col("c_custkey")))
    known = _objects(n, col("n_name"), "Table").unionByName(_objects(s, sup, "View")).unionByName(_objects(c, cus, "Procedure"))
    none = F.lit(None).cast("string")
    recorded = sn.filter("s_suppkey % 2 = 0").select(
        F.lit(DB).alias("database_name"), F.lit(SCHEMA).alias("from_schema"), sup.alias("from_name"), F.lit("View").alias("from_type"), F.lit(SCHEMA).alias("to_schema"),
        F.upper("n_name").alias("to_name"), F.lit("Table").alias("to_type"), none.alias("to_database"))
    synonyms = r.select(F.lit(DB).alias("database_name"), F.lit(SCHEMA).alias("schema_name"), _text("syn_", col("r_regionkey")).alias("synonym_name"),
                        _text("[dbo].[NATION_", col("r_regionkey"), "]").alias("base_object_name"))
    return known, views.unionByName(calls), recorded, synonyms


def link_refs(spark, sf_dir):
    """Merged dependencies: recorded ones first, then references in bodies (local, external, dropped), then synonyms."""
    known, bodies, recorded, synonyms = object_frames(spark, sf_dir)
    out = E.object_dependencies(E.name_aliases(known), bodies, synonyms=synonyms, recorded=recorded)
    return out.select("from_name", "from_type", "to_schema", "to_name", "to_type", "to_database", "detected_via")


def ref_edges(spark, sf_dir):
    """D-2 / D-3: dependency edges of the same objects and of the nations' keys to regions, each end known or not."""
    known, bodies, recorded, synonyms = object_frames(spark, sf_dir)
    refs = E.object_dependencies(E.name_aliases(known), bodies, synonyms=synonyms, recorded=recorded)
    n = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    fks = n.select(F.lit(DB).alias("database_name"), F.lit(SCHEMA).alias("from_schema"), F.col("n_name").alias("from_table"), F.lit(SCHEMA).alias("to_schema"), F.col("r_name").alias("to_table"))
    return V.edge_table(fks, refs, known).drop("database_name")


def region_objects(spark, sf_dir):
    """(known objects, bodies) of the estate of regions."""
    n = read_table(spark, sf_dir, "nation").withColumn("db", _text("region_", F.col("n_regionkey")))
    other = n.select((F.col("n_nationkey") - 1).alias("c_nationkey"), F.col("n_name").alias("o_name"), F.col("db").alias("o_db"))
    c = read_table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(other, "c_nationkey")
    name = _text("customer_", F.col("c_custkey"))
    known = n.select(F.col("db").alias("database_name"), F.lit(SCHEMA).alias("schema_name"), F.col("n_name").alias("object_name"), F.lit("Table").alias("object_type")).unionByName(
        c.select(F.col("db").alias("database_name"), F.lit(SCHEMA).alias("schema_name"), name.alias("object_name"), F.lit("View").alias("object_type")))
    bodies = c.select(F.col("db").alias("database_name"), F.lit(SCHEMA).alias("from_schema"), name.alias("from_name"), F.lit("View").alias("from_type"),
                      _text("SELECT * FROM dbo.", F.col("n_name"), " a JOIN ", F.col("o_db"), ".dbo.", F.col("o_name"), " b").alias("text"), F.lit(0).alias("step"))
    return known.filter(F.col("database_name") != NOT_ANALYSED), bodies.filter(F.col("database_name") != NOT_ANALYSED)


def cross_database(spark, sf_dir):
    """Edges of all databases of the estate; an external target in an analysed database is a table there."""
    known, bodies = region_objects(spark, sf_dir)
    edges = E.object_dependencies(E.name_aliases(known), bodies)
    edges = ES.resolve_external(edges, known.select("database_name").distinct())
    edges = edges.withColumn("src", F.concat_ws(".", "from_schema", "from_name")).withColumn(
        "dst", F.concat_ws(".", F.coalesce("to_database", "database_name"), "to_schema", "to_name"))
    return ES.qualify_columns(edges, ["src", "dst"]).select("src", "dst", "to_type", ES.is_cross_database(
        F.col("database_name"), F.col("to_database")).alias("is_cross_database"))


def database_objects(spark, sf_dir):
    """H6: objects of each database by type."""
    known, _ = region_objects(spark, sf_dir)
    return H.counts_by(known, "database_name", "object_type")


#: Keys between tables of the snapshot, some of them of different numeric types: child, column, parent, column.
LINKS = [
    ("documents", "doc_id", "labels", "doc_id"), ("labels", "doc_id", "documents", "doc_id"), ("embeddings", "vec_id", "documents", "doc_id"),
    ("pages", "page_id", "documents", "doc_id"), ("conversations", "conv_id", "pages", "page_id"), ("benchmark", "item_id", "nation", "n_nationkey"),
    ("events", "user_id", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_quantity", "part", "p_size"),
    ("events", "value", "part", "p_retailprice"), ("part", "p_retailprice", "orders", "o_orderkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("region", "r_name", "nation", "n_name"),
]


def link_orphans(spark, sf_dir):
    """Keys between all 14 tables checked on the data, with orphans, across numeric types."""
    cands = spark.createDataFrame(LINKS, "from_table string, from_column string, to_table string, to_column string")
    return R.orphan_check(cands, read_tables(spark, sf_dir))


def profile_order(spark, sf_dir):
    """Columns of all tables, the table with most rows first."""
    prof = cut_lineage(P.profile_tables(read_tables(spark, sf_dir), wide=WIDE).select("table_name", "column_name", "total_count"))
    return P.ordered_profiles(prof)


def suggestion_order(spark, sf_dir):
    """Suggested keys, the surest first."""
    _, cols, fks, idx = tpch_frames(spark, sf_dir)
    rel = R.implicit_fks(cols, idx, fks).select("from_table", "from_column", "to_table", F.col("confidence").cast("double").alias("confidence"))
    return R.ordered_suggestions(rel)


# ---------------------------------------------------------------- oracle SQL

_FOUND = """
  sup AS (SELECT s_suppkey, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  cus AS (SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
  refs AS (
    SELECT 'supplier_' || s_suppkey AS from_name, 'View' AS from_type, 'dbo' AS to_schema, n_name AS to_name, 'Table' AS to_type,
           CAST(NULL AS VARCHAR) AS to_database, CASE WHEN s_suppkey % 2 = 0 THEN 'recorded dependency' ELSE 'SQL: FROM/JOIN' END AS detected_via FROM sup
    UNION ALL SELECT 'supplier_' || s_suppkey, 'View', 'dbo', 'totals', 'External', 'region_' || n_regionkey, 'SQL: FROM/JOIN' FROM sup
    UNION ALL SELECT 'customer_' || c_custkey, 'Procedure', 'dbo', n_name, 'Table', NULL, 'SQL: FROM/JOIN' FROM cus
    UNION ALL SELECT 'customer_' || c_custkey, 'Procedure', 'dbo', 'supplier_' || c_nationkey, 'View', NULL, 'SQL: EXEC' FROM cus
              JOIN supplier ON s_suppkey = c_nationkey
    UNION ALL SELECT 'syn_' || r_regionkey, 'Synonym', 'dbo', 'NATION_' || r_regionkey, 'Table', NULL, 'Synonym base object' FROM region)"""

LINK_REFS_SQL = f"WITH {_FOUND} SELECT * FROM refs"

REF_EDGES_SQL = f"""WITH {_FOUND}
SELECT 'dbo.' || from_name AS src, coalesce(to_database || '.', '') || 'dbo.' || to_name AS dst, 'object' AS kind,
       from_type <> 'Synonym' AS src_known, true AS dst_known FROM refs
UNION ALL SELECT 'dbo.' || n_name, 'dbo.' || r_name, 'foreign key', true, false FROM nation JOIN region ON n_regionkey = r_regionkey"""

CROSS_DATABASE_SQL = f"""WITH
  n AS (SELECT n_nationkey, n_name, 'region_' || n_regionkey AS db FROM nation),
  c AS (SELECT c_custkey, a.db, a.n_name, o.db AS o_db, o.n_name AS o_name
        FROM customer JOIN n a ON c_nationkey = a.n_nationkey JOIN n o ON o.n_nationkey = c_nationkey + 1 WHERE a.db <> '{NOT_ANALYSED}')
SELECT db || '.dbo.customer_' || c_custkey AS src, db || '.dbo.' || n_name AS dst, 'Table' AS to_type, false AS is_cross_database FROM c
UNION ALL SELECT db || '.dbo.customer_' || c_custkey, o_db || '.dbo.' || o_name, CASE WHEN o_db = '{NOT_ANALYSED}' THEN 'External' ELSE 'Table' END, true FROM c"""

DATABASE_OBJECTS_SQL = f"""WITH
  n AS (SELECT n_nationkey, 'region_' || n_regionkey AS db FROM nation),
  o AS (SELECT db, 'Table' AS t FROM n
        UNION ALL SELECT a.db, 'View' FROM customer JOIN n a ON c_nationkey = a.n_nationkey JOIN n o ON o.n_nationkey = c_nationkey + 1)
SELECT db AS database_name, t AS object_type, count(*) AS n FROM o WHERE db <> '{NOT_ANALYSED}' GROUP BY ALL"""

LINK_ORPHANS_SQL = " UNION ALL ".join(f"""
SELECT '{ft}' AS from_table, '{fc}' AS from_column, '{tt}' AS to_table, '{tc}' AS to_column, count(*) AS child_rows,
       count(*) FILTER (WHERE x IS NULL) AS null_rows, count(*) FILTER (WHERE x IS NOT NULL AND y IS NULL) AS orphan_rows,
       count(DISTINCT x) FILTER (WHERE x IS NOT NULL AND y IS NULL) AS orphan_values,
       CASE WHEN count(x) > 0 THEN CAST(count(y) AS DOUBLE) / count(x) END AS match_rate
FROM (SELECT {fc} AS x FROM {ft}) LEFT JOIN (SELECT DISTINCT {tc} AS y FROM {tt}) ON x = y""" for ft, fc, tt, tc in LINKS)

PROFILE_ORDER_SQL = f"""SELECT table_name, column_name, total_count, row_number() OVER (ORDER BY total_count DESC, table_name, column_name) AS rank
FROM ({estate_profile_sql()})"""

SUGGESTION_ORDER_SQL = f"""SELECT from_table, from_column, to_table, confidence,
       row_number() OVER (ORDER BY confidence DESC, from_table, from_column, to_table) AS rank
FROM ({IMPLICIT_SQL})"""

QUERIES = {f.__name__: f for f in (link_refs, ref_edges, cross_database, database_objects, link_orphans, profile_order, suggestion_order)}
ORACLE = {
    "link_refs": LINK_REFS_SQL,
    "ref_edges": REF_EDGES_SQL,
    "cross_database": CROSS_DATABASE_SQL,
    "database_objects": DATABASE_OBJECTS_SQL,
    "link_orphans": LINK_ORPHANS_SQL,
    "profile_order": PROFILE_ORDER_SQL,
    "suggestion_order": SUGGESTION_ORDER_SQL,
}
