"""Bindings of the catalog operators on objects cut from the data.

Suppliers are views, customers procedures and regions synonyms, as in ``links``. A conversation is a job whose turns are
its steps, the days of ``events`` are the runs of the job of their type, and the types of parts are user types, of which those of
large parts back a relation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakescope.operators import catalog_ops as CO
from lakescope.operators import refs as E
from lakescope.plans.links import DB, SCHEMA, object_frames
from lakescope.sources.tables import read_table

#: Text that a job's step must hold.
JOB_TERM = "Eren"
LARGE_PART = 40


def _db():
    return F.lit(DB).alias("database_name")


def body_frames(spark, sf_dir):
    """(view columns, views, procedures, synonyms, dependencies)."""
    known, bodies, recorded, synonyms = object_frames(spark, sf_dir)
    views = bodies.filter("from_type = 'View'").select("database_name", F.col("from_schema").alias("schema_name"), F.col("from_name").alias("view_name"), F.col("text").alias("definition"))
    procedures = bodies.filter("from_type = 'Procedure'").select("database_name", F.col("from_schema").alias("schema_name"), F.col("from_name").alias("procedure_name"), F.col("text").alias("definition"))
    names = F.array(*[F.struct(F.lit(i).alias("ordinal_position"), F.lit(n).alias("column_name"), F.lit(t).alias("data_type")) for i, n, t in ((1, "nation", "string"), (2, "total", "double"))])
    columns = views.select("database_name", "schema_name", F.col("view_name").alias("table_name"), F.lit("VIEW").alias("table_type"), F.inline(names))
    edges = E.object_dependencies(E.name_aliases(known), bodies, synonyms=synonyms, recorded=recorded)
    return columns, views, procedures, synonyms, edges


def object_list(spark, sf_dir):
    """Views, procedures and synonyms with their texts."""
    _, views, procedures, synonyms, _ = body_frames(spark, sf_dir)
    return CO.object_inventory(views=views, procedures=procedures, synonyms=synonyms).drop("database_name")


def object_order(spark, sf_dir):
    """O1: the same objects in order."""
    _, views, procedures, synonyms, _ = body_frames(spark, sf_dir)
    out = CO.ordered_objects(CO.object_inventory(views=views, procedures=procedures, synonyms=synonyms).drop("definition"))
    return out.select("object_type", "object_name", "rank")


def view_list(spark, sf_dir):
    """Views with their columns, in order, and text."""
    columns, views, _, _, _ = body_frames(spark, sf_dir)
    out = CO.views_with_columns(columns, views)
    return out.select("table_name", F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["column_name"], c["data_type"])), ", ").alias("columns"), "definition")


def view_counts(spark, sf_dir):
    """Columns and dependencies of each view."""
    columns, views, _, _, edges = body_frames(spark, sf_dir)
    return CO.view_overview(views, columns, edges).select("table_name", "n_columns", "n_depends_on")


def job_frames(spark, sf_dir):
    """(jobs, steps)."""
    c = read_table(spark, sf_dir, "conversations").withColumn("job_name", F.concat(F.lit("job_"), F.col("conv_id").cast("string")))
    jobs = c.groupBy("job_name").agg(F.max(F.col("role") == "system").alias("is_enabled")).select(_db(), "job_name", "is_enabled")
    steps = c.select(_db(), "job_name", F.col("turn").cast("int").alias("step_id"), F.col("role").alias("step_name"), F.lit("TEXT").alias("subsystem_type"),
                     F.lit(None).cast("string").alias("step_database"), F.col("text").alias("command"))
    return jobs, steps


def job_list(spark, sf_dir):
    """Jobs with the number of their steps and the names of the steps in order."""
    out = CO.job_inventory(*job_frames(spark, sf_dir))
    return out.select("job_name", F.size("steps").cast("long").alias("n_steps"), F.array_join(F.transform("steps", lambda s: s["step_name"]), ">").alias("step_names"))


def jobs_naming(spark, sf_dir):
    """Jobs with a step whose text names a term, whatever its case."""
    return CO.jobs_touching(*job_frames(spark, sf_dir), JOB_TERM).select("job_name")


def job_runs(spark, sf_dir):
    """The last run of each job, from integer days."""
    h = read_table(spark, sf_dir, "events").select(_db(), F.col("event_type").alias("job_name"), F.date_format("ts", "yyyyMMdd").cast("int").alias("run_date"))
    return CO.job_last_run(h).select("job_name", F.date_format("last_run_date", "yyyy-MM-dd").alias("last_run"))


def own_types(spark, sf_dir):
    """Types of parts that back no relation."""
    p = read_table(spark, sf_dir, "part").select(_db(), F.lit(SCHEMA).alias("schema_name"), F.concat_ws(" ", "p_brand", "p_type").alias("type_name"), "p_size")
    return CO.standalone_types(p.select("database_name", "schema_name", "type_name").distinct(), p.filter(F.col("p_size") > LARGE_PART)).select("type_name")


# ---------------------------------------------------------------- oracle SQL

_VIEWS = """SELECT 'supplier_' || s_suppkey AS name, 'SELECT * FROM dbo.' || n_name || ' n JOIN region_' || n_regionkey || '.dbo.totals t JOIN missing_' || s_suppkey || ' m' AS text
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

OBJECT_LIST_SQL = f"""SELECT 'dbo' AS schema_name, name AS object_name, 'View' AS object_type, text AS definition FROM ({_VIEWS})
UNION ALL SELECT 'dbo', 'customer_' || c_custkey, 'Procedure', 'EXEC dbo.supplier_' || c_nationkey || '; EXEC(''SELECT 1 AS one FROM [dbo].[' || n_name
  || '] WHERE 1 = 1''); SELECT 1 FROM dbo.customer_' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'dbo', 'syn_' || r_regionkey, 'Synonym', '[dbo].[NATION_' || r_regionkey || ']' FROM region"""

OBJECT_ORDER_SQL = f"SELECT object_type, object_name, row_number() OVER (ORDER BY object_type, object_name) AS rank FROM ({OBJECT_LIST_SQL})"
VIEW_LIST_SQL = f"SELECT name AS table_name, 'nation string, total double' AS columns, text AS definition FROM ({_VIEWS})"
VIEW_COUNTS_SQL = f"SELECT name AS table_name, CAST(2 AS BIGINT) AS n_columns, CAST(2 AS BIGINT) AS n_depends_on FROM ({_VIEWS})"
JOB_LIST_SQL = "SELECT 'job_' || conv_id AS job_name, count(*) AS n_steps, string_agg(role, '>' ORDER BY turn) AS step_names FROM conversations GROUP BY conv_id"
JOBS_NAMING_SQL = f"SELECT DISTINCT 'job_' || conv_id AS job_name FROM conversations WHERE contains(lower(text), '{JOB_TERM.lower()}')"
JOB_RUNS_SQL = "SELECT event_type AS job_name, strftime(max(ts), '%Y-%m-%d') AS last_run FROM events GROUP BY event_type"
OWN_TYPES_SQL = f"SELECT p_brand || ' ' || p_type AS type_name FROM part GROUP BY 1 HAVING max(p_size) <= {LARGE_PART}"

QUERIES = {f.__name__: f for f in (object_list, object_order, view_list, view_counts, job_list, jobs_naming, job_runs, own_types)}
ORACLE = {
    "object_list": OBJECT_LIST_SQL,
    "object_order": OBJECT_ORDER_SQL,
    "view_list": VIEW_LIST_SQL,
    "view_counts": VIEW_COUNTS_SQL,
    "job_list": JOB_LIST_SQL,
    "jobs_naming": JOBS_NAMING_SQL,
    "job_runs": JOB_RUNS_SQL,
    "own_types": OWN_TYPES_SQL,
}
