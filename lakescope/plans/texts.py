"""Text bindings: reference extraction (E2-E5) and resolution (E3) over the whole test texts.

Each text row of ``documents``, ``conversations``, ``pages`` and ``benchmark`` is treated as an
object body (like a view or procedure definition). Resolution uses the test snapshot's own catalog
(its fourteen table names in schema ``dbo`` of database ``testdata``) as the known objects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescope.operators import refs as E
from lakescope.sources import catalog as C
from lakescope.sources.tables import TEST_TABLES, read_table, read_tables

DB = "testdata"
TEXT_SOURCES = [("documents", "doc_id", "text"), ("conversations", "conv_id", "text"),
                ("pages", "page_id", "html"), ("benchmark", "item_id", "text")]


def text_definitions(spark, sf_dir):
    parts = []
    for t, k, c in TEXT_SOURCES:
        df = read_table(spark, sf_dir, t)
        oid = F.col(k).cast("string") if t != "conversations" else F.concat_ws(
            "/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        parts.append(df.select(F.lit(DB).alias("database_name"), F.lit(t).alias("source_table"),
                               oid.alias("object_id"), F.col(c).alias("text")))
    return reduce(DataFrame.unionByName, parts)


IDS = ["database_name", "source_table", "object_id"]


def text_refs(spark, sf_dir):
    """E2/E4/E5 + X4/X8: FROM/JOIN and EXEC references in every text and its literals, counted."""
    refs = E.extract_refs(text_definitions(spark, sf_dir), id_cols=IDS)
    return refs.groupBy("source_table", "kind", "via", F.lower("clean").alias("reference"), "n_parts").agg(
        F.countDistinct("object_id").alias("n_objects"), F.count(F.lit(1)).alias("mentions"))


def text_ref_edges(spark, sf_dir):
    """References resolved against the snapshot catalog (local, external by 3-4 parts, or dropped)."""
    tables = read_tables(spark, sf_dir)
    cols = C.columns_from_dataframes(spark, tables, DB, "dbo")
    aliases = E.name_aliases(E.known_objects(columns=cols))
    defs = text_definitions(spark, sf_dir).withColumn("from_schema", F.col("source_table")).withColumn(
        "from_name", F.col("object_id"))
    refs = E.extract_refs(defs, id_cols=IDS + ["from_schema", "from_name"])
    res = E.resolve_refs(refs, aliases, id_cols=IDS + ["from_schema", "from_name"])
    return res.select("source_table", "object_id", "to_schema", "to_name", "to_type", "to_database",
                      F.col("via").alias("detected_via")).distinct()


def _sql_str(s):
    return "'" + s.replace("'", "''") + "'"


DEFS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS source_table, "
    + ("CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)" if t == "conversations" else f"CAST({k} AS VARCHAR)")
    + f" AS object_id, {c} AS text FROM {t}" for t, k, c in TEXT_SOURCES)

REFS_SQL = f"""WITH defs AS ({DEFS_SQL}),
  srcs AS (
    SELECT source_table, object_id, text AS src, false AS is_dynamic FROM defs
    UNION ALL
    SELECT source_table, object_id, unnest(list_filter(list_transform(
             regexp_extract_all(text, {_sql_str(E.LITERAL_PATTERN)}, 1), lambda s: replace(s, '''''', '''')),
             lambda s: length(s) > {E.MIN_LITERAL_LENGTH})) AS src, true AS is_dynamic FROM defs),
  refs AS (
    SELECT source_table, object_id, is_dynamic, 'from_join' AS kind,
           unnest(regexp_extract_all(src, {_sql_str(E.FROM_JOIN_PATTERN)}, 1)) AS ref FROM srcs
    UNION ALL
    SELECT source_table, object_id, is_dynamic, 'exec' AS kind,
           unnest(regexp_extract_all(src, {_sql_str(E.EXEC_PATTERN)}, 1)) AS ref FROM srcs),
  cleaned AS (
    SELECT *, trim(replace(replace(trim(ref), '[', ''), ']', '')) AS clean,
           CASE WHEN kind = 'from_join' THEN 'SQL: FROM/JOIN' ELSE 'SQL: EXEC' END
             || CASE WHEN is_dynamic THEN ' (dynamic)' ELSE '' END AS via
    FROM refs)"""

TEXT_REFS_SQL = REFS_SQL + """
SELECT source_table, kind, via, lower(clean) AS reference, CAST(len(string_split(clean, '.')) AS INTEGER) AS n_parts,
       count(DISTINCT object_id) AS n_objects, count(*) AS mentions
FROM cleaned GROUP BY ALL"""

_KNOWN = ", ".join(f"('{t}')" for t in TEST_TABLES)
TEXT_REF_EDGES_SQL = REFS_SQL + f""",
  known(name) AS (VALUES {_KNOWN}),
  aliases AS (SELECT lower(name) AS k, name FROM known UNION ALL SELECT 'dbo.' || lower(name), name FROM known),
  parts AS (SELECT *, string_split(clean, '.') AS p, len(string_split(clean, '.')) AS n FROM cleaned),
  keyed AS (
    SELECT *, CASE WHEN kind = 'from_join' AND n = 3 AND lower(p[1]) = '{DB}' THEN lower(p[2] || '.' || p[3])
                   WHEN n <= 2 THEN lower(clean) END AS k FROM parts),
  res AS (
    SELECT source_table, object_id, via,
      CASE WHEN a.name IS NOT NULL THEN 'dbo' WHEN kind = 'from_join' AND n >= 4 THEN p[n - 1]
           WHEN kind = 'from_join' AND n = 3 THEN p[2] END AS to_schema,
      CASE WHEN a.name IS NOT NULL THEN a.name WHEN kind = 'from_join' AND n >= 4 THEN p[n]
           WHEN kind = 'from_join' AND n = 3 THEN p[3] END AS to_name,
      CASE WHEN a.name IS NOT NULL THEN 'Table' WHEN kind = 'from_join' AND n >= 3 THEN 'External' END AS to_type,
      CASE WHEN a.name IS NOT NULL THEN NULL WHEN kind = 'from_join' AND n >= 4 THEN p[n - 2]
           WHEN kind = 'from_join' AND n = 3 THEN p[1] END AS to_database
    FROM keyed LEFT JOIN aliases a ON a.k = keyed.k)
SELECT DISTINCT source_table, object_id, to_schema, to_name, to_type, to_database, via AS detected_via
FROM res WHERE to_name IS NOT NULL
  AND NOT (to_database IS NULL AND lower(to_name) = lower(object_id) AND lower(to_schema) = lower(source_table))"""

#: The first words of an item of ``benchmark``: a schema, and a table of one word or two.
TERM_NAMES_SQL = """
  terms AS (
    SELECT w[1] AS schema_name, CASE WHEN item_id % 2 = 0 THEN w[2] ELSE w[2] || ' ' || w[3] END AS table_name
    FROM (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark) WHERE len(w) >= 3)"""

TERM_USAGE_SQL = f"""WITH {TERM_NAMES_SQL},
  names AS (SELECT DISTINCT schema_name, table_name, table_name AS name FROM terms
            UNION SELECT DISTINCT schema_name, table_name, schema_name || '.' || table_name FROM terms),
  texts AS MATERIALIZED (
    SELECT row_number() OVER () AS id, t, n, list_distinct(regexp_extract_all(t, '[\\p{{L}}\\p{{Nd}}_]+')) AS words
    FROM (SELECT lower(text) AS t, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text)),
  longer AS MATERIALIZED (SELECT * FROM names WHERE NOT regexp_full_match(name, '[\\p{{L}}\\p{{Nd}}_]+')),
  may AS MATERIALIZED (SELECT schema_name, table_name, name, id, t FROM texts JOIN longer ON contains(t, name)),
  hits AS (
    SELECT schema_name, table_name, id FROM (SELECT id, unnest(words) AS w FROM texts) JOIN names ON w = name
    UNION SELECT schema_name, table_name, id FROM may
    WHERE regexp_matches(t, '(^|[^\\p{{L}}\\p{{Nd}}_])' || regexp_escape(name) || '([^\\p{{L}}\\p{{Nd}}_]|$)'))
SELECT schema_name, table_name, CAST(sum(n) AS BIGINT) AS executions, count(*) AS n_texts FROM hits JOIN texts USING (id) GROUP BY ALL"""


def term_usage(spark, sf_dir):
    """How many documents mention names of one word, of two words, and qualified ones, cut from ``benchmark``."""
    w = F.split(F.lower("text"), " ")
    items = read_table(spark, sf_dir, "benchmark").filter(F.size(w) >= 3)
    columns = items.select(F.lit(DB).alias("database_name"), w[0].alias("schema_name"), F.when(F.col("item_id") % 2 == 0, w[1]).otherwise(
        F.concat_ws(" ", w[1], w[2])).alias("table_name"), F.lit("BASE TABLE").alias("table_type"))
    logs = read_table(spark, sf_dir, "documents").filter("text is not null").select(
        F.lit(DB).alias("database_name"), F.col("text").alias("query_text"), F.lit(1).cast("long").alias("total_executions"), F.lit(None).cast("timestamp").alias("last_execution"))
    return E.table_mentions(logs, columns).select("schema_name", "table_name", "executions", "n_texts")


QUERIES = {"term_usage": term_usage, "text_refs": text_refs, "text_ref_edges": text_ref_edges}
ORACLE = {"term_usage": TERM_USAGE_SQL, "text_refs": TEXT_REFS_SQL, "text_ref_edges": TEXT_REF_EDGES_SQL}
