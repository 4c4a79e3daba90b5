"""Bindings for keys, implicit foreign keys, orphan checks and quality rules on the TPC-H tables.

Stand-in catalog: the seven TPC-H tables with the one-letter column prefix dropped (``l_orderkey`` ->
``orderkey``), primary keys inferred from the data by profiling, no indexes, and two declared keys
(the two that no naming rule can find). Everything else is derived by the library.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakescope.operators import profile as P
from lakescope.operators import quality as Q
from lakescope.operators import relations as R
from lakescope.plans.profiling import profile_sql
from lakescope.session import cut_lineage
from lakescope.sources import catalog as C
from lakescope.sources.tables import TPCH_TABLES, read_tables

DB = "tpch"
SCHEMA = "dbo"
# Stand-in declared constraints (catalog input): the keys naming rules cannot find.
DECLARED_FKS = [
    ("FK_orders_customer", "orders", "custkey", "customer", "custkey"),
    ("FK_lineitem_supplier", "lineitem", "suppkey", "supplier", "suppkey"),
]


def strip_prefix(name: str) -> str:
    return name.split("_", 1)[1] if "_" in name else name


def tpch_frames(spark, sf_dir):
    """Renamed TPC-H tables and their catalog frames (columns with inferred keys, FKs, indexes)."""
    raw = read_tables(spark, sf_dir, TPCH_TABLES)
    tables = {t: df.toDF(*[strip_prefix(c) for c in df.columns]) for t, df in raw.items()}
    cols = C.columns_from_dataframes(spark, tables, DB, SCHEMA)
    pk = P.primary_keys(P.profile_tables(tables, key_types_only=True)).withColumnRenamed("table_name", "_t")
    cols = cols.join(pk, cols.table_name == pk._t, "left").withColumn(
        "is_primary_key", F.coalesce(F.col("column_name") == F.col("pk_column"), F.lit(False))
    ).drop("_t", "pk_column")
    # the catalog is small metadata derived from a scan of every table: materialise it once
    cols = cut_lineage(C.conform(cols, "columns"))
    fks = C.frame(spark, "foreign_keys", [
        {"database_name": DB, "fk_name": n, "from_schema": SCHEMA, "from_table": ft, "from_column": fc,
         "to_schema": SCHEMA, "to_table": tt, "to_column": tc, "delete_rule": "NO_ACTION",
         "update_rule": "NO_ACTION"} for n, ft, fc, tt, tc in DECLARED_FKS])
    idx = C.empty(spark, "indexes")
    return tables, cols, fks, idx


def inferred_primary_keys(spark, sf_dir):
    """R2 on data: the inferred primary-key column of each TPC-H table."""
    _, cols, _, _ = tpch_frames(spark, sf_dir)
    return R.primary_key_lookup(cols).select("table_name", "pk_column", "pk_type")


def implicit_fk(spark, sf_dir):
    """Suggested foreign keys by naming, on the catalog with data-inferred keys."""
    _, cols, fks, idx = tpch_frames(spark, sf_dir)
    rel = R.implicit_fks(cols, idx, fks)
    return rel.select("from_table", "from_column", "to_table", "to_column", "pattern", "type_match",
                      "leads_index", F.col("confidence").cast("double").alias("confidence"))


def fk_orphans(spark, sf_dir):
    """Check every suggested and declared key on the data (orphans, nulls, match rate)."""
    tables, cols, fks, idx = tpch_frames(spark, sf_dir)
    rel = R.implicit_fks(cols, idx, fks).select("from_table", "from_column", "to_table", "to_column")
    cands = rel.unionByName(fks.select("from_table", "from_column", "to_table", "to_column"))
    return R.orphan_check(cands, tables)


def quality_issues(spark, sf_dir):
    """Q1-Q7 on the stand-in catalog."""
    _, cols, fks, idx = tpch_frames(spark, sf_dir)
    rel = R.implicit_fks(cols, idx, fks)
    return Q.quality_issues(cols, idx, fks, rel).drop("database_name")


def diagram_columns(spark, sf_dir):
    """V-1: every TPC-H column with its key flags: primary (inferred), declared FK, suggested FK."""
    from lakescope.operators import diagram as V
    _, cols, fks, idx = tpch_frames(spark, sf_dir)
    rel = R.implicit_fks(cols, idx, fks)
    return V.column_flags(cols, fks, rel).drop("database_name")


def missing_key_banner(spark, sf_dir):
    """H5: suggested keys with their confidence band (high from 0.8, medium from 0.7, else low)."""
    from lakescope.operators import search as H
    _, cols, fks, idx = tpch_frames(spark, sf_dir)
    rel = R.implicit_fks(cols, idx, fks)
    return H.missing_key_banner(rel).select("from_table", "from_column", "to_table",
                                            F.col("confidence").cast("double").alias("confidence"), "band")


def diagram_edges(spark, sf_dir):
    """V-2: diagram edges of the TPC-H catalog: declared keys, then suggested keys from 0.7."""
    from lakescope.operators import diagram as V
    _, cols, fks, idx = tpch_frames(spark, sf_dir)
    rel = R.implicit_fks(cols, idx, fks)
    return V.diagram_edges(fks, None, rel).drop("database_name")


# ---------------------------------------------------------------- oracle SQL

def _catalog_sql():
    prof = "\nUNION ALL\n".join(profile_sql(t) for t in TPCH_TABLES)
    return f"""
    prof AS MATERIALIZED ({prof}),
    cat AS MATERIALIZED (
      SELECT table_name, substr(column_name, 3) AS column_name, ordinal, data_type,
             (null_count = 0 AND distinct_count = total_count AND total_count > 0
              AND data_type IN ('tinyint','smallint','int','bigint','string')) AS key_like
      FROM prof),
    pk AS MATERIALIZED (
      SELECT table_name, arg_min(column_name, ordinal) AS pk_column, arg_min(data_type, ordinal) AS pk_type
      FROM cat WHERE key_like GROUP BY table_name),
    declared(from_table, from_column, to_table, to_column) AS (
      VALUES {", ".join(f"('{ft}', '{fc}', '{tt}', '{tc}')" for _, ft, fc, tt, tc in DECLARED_FKS)})"""


def _family(x):
    return (f"CASE WHEN {x} IN ('tinyint','smallint','int','bigint','integer','long','short','byte') THEN 'integer' "
            f"WHEN {x} IN ('char','varchar','nchar','nvarchar','string') THEN 'string' "
            f"WHEN {x} IN ('decimal','numeric','float','real','money','smallmoney','double') THEN 'decimal' END")


IMPLICIT_SQL_BODY = f"""
    cols AS (
      SELECT c.* FROM cat c LEFT JOIN pk ON c.table_name = pk.table_name AND c.column_name = pk.pk_column
      WHERE pk.pk_column IS NULL),
    pairs AS (
      SELECT c.table_name AS from_table, c.column_name AS from_column, c.data_type AS from_type,
             p.table_name AS to_table, p.pk_column AS to_column, p.pk_type AS to_type,
             lower(c.column_name) AS n, lower(p.table_name) AS t,
             CASE WHEN lower(p.table_name) LIKE '%s' THEN substr(lower(p.table_name), 1, length(p.table_name) - 1)
                  END AS s
      FROM cols c CROSS JOIN pk p),
    rules AS (
      SELECT *, CASE
        WHEN n IN (t || 'id', t || '_id') THEN 1
        WHEN s IS NOT NULL AND n IN (s || 'id', s || '_id') THEN 2
        WHEN n = 'fk_' || t THEN 3
        WHEN EXISTS (
          SELECT 1 FROM (VALUES ('ref'), ('fk'), ('source'), ('target'), ('parent'), ('child')) v(p)
          WHERE starts_with(n, v.p) AND length(n) > length(v.p) AND ends_with(substr(n, length(v.p) + 1), 'id')
            AND (CASE WHEN ends_with(substr(n, length(v.p) + 1), '_id')
                      THEN substr(n, length(v.p) + 1, length(n) - length(v.p) - 3)
                      ELSE substr(n, length(v.p) + 1, length(n) - length(v.p) - 2) END) IN (t, s)) THEN 5
        WHEN n IN (t || 'key', t || '_key') OR (s IS NOT NULL AND n IN (s || 'key', s || '_key')) THEN 6
        WHEN n IN (t || 'no', t || 'number', t || 'code', t || '_no', t || '_number', t || '_code')
          OR (s IS NOT NULL AND n IN (s || 'no', s || 'number', s || 'code', s || '_no', s || '_number',
                                      s || '_code')) THEN 7
        END AS pattern
      FROM pairs),
    firsts AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY from_table, from_column
                                     ORDER BY CASE WHEN pattern IN (1, 2) THEN 1 ELSE pattern END, t, pattern) AS rn
        FROM rules WHERE pattern IS NOT NULL) WHERE rn = 1),
    typed AS (
      SELECT *, CASE WHEN from_type = to_type THEN 'exact'
                     WHEN {_family('from_type')} = {_family('to_type')} THEN 'compatible'
                     ELSE 'mismatch' END AS type_match
      FROM firsts),
    implicit AS (
      SELECT from_table, from_column, to_table, to_column, CAST(pattern AS INTEGER) AS pattern, type_match,
             false AS leads_index,
             CAST(CAST(least(CASE pattern WHEN 1 THEN 90 WHEN 2 THEN 80 WHEN 3 THEN 70 WHEN 5 THEN 75
                                            WHEN 6 THEN 70 ELSE 65 END
                              - CASE WHEN type_match = 'compatible' THEN 10 ELSE 0 END - 5, 95) / 100.0
                  AS DECIMAL(4,2)) AS DOUBLE) AS confidence
      FROM typed t
      WHERE type_match <> 'mismatch'
        AND NOT (lower(from_table) = lower(to_table) AND lower(from_column) = lower(to_column))
        AND NOT EXISTS (SELECT 1 FROM declared d WHERE d.from_table = t.from_table AND d.from_column = t.from_column
                        AND d.to_table = t.to_table AND d.to_column = t.to_column))"""

IMPLICIT_SQL = f"WITH {_catalog_sql()},{IMPLICIT_SQL_BODY}\nSELECT * FROM implicit"

PK_SQL = f"WITH {_catalog_sql()}\nSELECT table_name, pk_column, pk_type FROM pk"

ORPHANS_SQL = f"""WITH {_catalog_sql()},{IMPLICIT_SQL_BODY},
    cands AS (SELECT from_table, from_column, to_table, to_column FROM implicit
              UNION SELECT * FROM declared)
    SELECT c.from_table, c.from_column, c.to_table, c.to_column, s.child_rows, s.null_rows, s.orphan_rows,
           s.orphan_values, s.match_rate
    FROM cands c JOIN (
      {" UNION ALL ".join(
        f"SELECT '{ft}' AS ft, '{fc}' AS fc, '{tt}' AS tt, '{tc}' AS tc, count(*) AS child_rows, "
        f"count(*) - count(x.{ft[0]}_{fc}) AS null_rows, "
        f"count(*) FILTER (WHERE x.{ft[0]}_{fc} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {tt} y WHERE y.{tt[0]}_{tc} = x.{ft[0]}_{fc})) AS orphan_rows, "
        f"count(DISTINCT x.{ft[0]}_{fc}) FILTER (WHERE NOT EXISTS "
        f"(SELECT 1 FROM {tt} y WHERE y.{tt[0]}_{tc} = x.{ft[0]}_{fc})) AS orphan_values, "
        f"CASE WHEN count(x.{ft[0]}_{fc}) = 0 THEN NULL ELSE CAST(count(x.{ft[0]}_{fc}) - count(*) FILTER "
        f"(WHERE x.{ft[0]}_{fc} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {tt} y WHERE y.{tt[0]}_{tc} = "
        f"x.{ft[0]}_{fc})) AS DOUBLE) / count(x.{ft[0]}_{fc}) END AS match_rate FROM {ft} x"
        for ft, fc, tt, tc in [
            ("lineitem", "orderkey", "orders", "orderkey"), ("lineitem", "partkey", "part", "partkey"),
            ("lineitem", "suppkey", "supplier", "suppkey"), ("orders", "custkey", "customer", "custkey"),
            ("customer", "nationkey", "nation", "nationkey"), ("supplier", "nationkey", "nation", "nationkey"),
            ("nation", "regionkey", "region", "regionkey")])}
    ) s ON s.ft = c.from_table AND s.fc = c.from_column AND s.tt = c.to_table AND s.tc = c.to_column"""


def _reserved_list():
    return ", ".join(f"'{w}'" for w in Q.RESERVED_WORDS)


QUALITY_SQL = f"""WITH {_catalog_sql()},{IMPLICIT_SQL_BODY},
    tabs AS (SELECT DISTINCT table_name FROM cat),
    issues AS (
      SELECT 'Design' AS category, 'Error' AS severity, 2 AS severity_rank, 'dbo.' || t.table_name AS object_name,
             'No column of this table is declared as its primary key.' AS description,
             'Declare a key so that each row can be told apart.' AS recommendation
      FROM tabs t WHERE t.table_name NOT IN (SELECT table_name FROM pk)
      UNION ALL
      SELECT 'Performance', 'Warning', 1, 'dbo.' || from_table || '.' || from_column,
             'No index starts with the referencing column ''' || from_column || '''.',
             'Create an index that leads with it; joins and deletes of parents look rows up by this column.'
      FROM declared
      UNION ALL
      SELECT 'Naming', 'Info', 0, 'dbo.' || table_name, 'The table name joins two naming styles, capitals and underscores.',
             'Use one style for all table names.'
      FROM tabs WHERE regexp_matches(table_name, '[A-Z][a-z]') AND contains(table_name, '_')
      UNION ALL
      SELECT 'Naming', 'Warning', 1, 'dbo.' || table_name || '.' || column_name,
             'The column is named ''' || column_name || ''', a word that SQL reserves.',
             'Pick another name, else each query must quote it.'
      FROM cat WHERE upper(column_name) IN ({_reserved_list()})
      UNION ALL
      SELECT 'Design', 'Info', 0, 'dbo.' || table_name, 'No foreign key leads to or from this table.',
             'Check that it is meant to stand alone.'
      FROM tabs WHERE (SELECT count(*) FROM tabs) > 1
        AND table_name NOT IN (SELECT from_table FROM declared UNION SELECT to_table FROM declared)
      UNION ALL
      SELECT 'Referential Integrity', CASE WHEN confidence >= 0.8 THEN 'Warning' ELSE 'Info' END,
             CASE WHEN confidence >= 0.8 THEN 1 ELSE 0 END,
             'dbo.' || from_table || '.' || from_column,
             'The values look like keys of dbo.' || to_table || '.' || to_column || ' (confidence '
               || CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '%).',
             'ALTER TABLE [dbo].[' || from_table || '] ADD CONSTRAINT [FK_' || from_table || '_' || to_table || '_'
               || from_column || '] FOREIGN KEY ([' || from_column || ']) REFERENCES [dbo].[' || to_table
               || '] ([' || to_column || ']);'
      FROM implicit)
    SELECT category, severity, CAST(severity_rank AS INTEGER) AS severity_rank, object_name, description,
           recommendation FROM issues"""

DIAGRAM_COLUMNS_SQL = f"""WITH {_catalog_sql()},{IMPLICIT_SQL_BODY}
SELECT 'dbo.' || c.table_name AS "table", c.column_name, c.ordinal AS ordinal_position,
       coalesce(c.column_name = pk.pk_column, false) AS pk,
       EXISTS (SELECT 1 FROM declared d WHERE d.from_table = c.table_name AND d.from_column = c.column_name) AS fk,
       coalesce(c.column_name = pk.pk_column, false) = false
         AND NOT EXISTS (SELECT 1 FROM declared d WHERE d.from_table = c.table_name AND d.from_column = c.column_name)
         AND EXISTS (SELECT 1 FROM implicit i WHERE i.from_table = c.table_name AND i.from_column = c.column_name)
         AS sfk,
       true AS is_nullable
FROM cat c LEFT JOIN pk ON pk.table_name = c.table_name"""

BANNER_SQL = f"""WITH {_catalog_sql()},{IMPLICIT_SQL_BODY}
SELECT from_table, from_column, to_table, confidence,
       CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band
FROM implicit"""

DIAGRAM_EDGES_SQL = f"""WITH {_catalog_sql()},{IMPLICIT_SQL_BODY},
  e AS (
    SELECT 'dbo.' || from_table AS src, 'dbo.' || to_table AS dst, 'fk' AS edge_type, 0 AS o,
           'FK: FK_' || from_table || '_' || to_table AS label FROM declared
    UNION ALL
    SELECT 'dbo.' || from_table, 'dbo.' || to_table, 'implicit', 2,
           printf('Suggested FK: dbo.%s.%s -> dbo.%s.%s (%d%%)', from_table, from_column, to_table, to_column,
                  CAST(round(confidence * 100) AS INTEGER))
    FROM implicit WHERE confidence >= 0.7)
SELECT src, dst, edge_type, label FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(src), lower(dst) ORDER BY o) AS rn FROM e) WHERE rn = 1"""

QUERIES = {
    "missing_key_banner": missing_key_banner,
    "diagram_edges": diagram_edges,
    "diagram_columns": diagram_columns,
    "inferred_primary_keys": inferred_primary_keys,
    "implicit_fk": implicit_fk,
    "fk_orphans": fk_orphans,
    "quality_issues": quality_issues,
}

ORACLE = {
    "missing_key_banner": BANNER_SQL,
    "diagram_edges": DIAGRAM_EDGES_SQL,
    "diagram_columns": DIAGRAM_COLUMNS_SQL,
    "inferred_primary_keys": PK_SQL,
    "implicit_fk": IMPLICIT_SQL,
    "fk_orphans": ORPHANS_SQL,
    "quality_issues": QUALITY_SQL,
}

