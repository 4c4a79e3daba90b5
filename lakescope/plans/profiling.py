"""Driver query bindings for profiling (P1-P8) on the test snapshot, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakescope.functions.render import profile_class, value_text_sql
from lakescope.operators import profile as P
from lakescope.plans.schemas import TABLE_COLUMNS
from lakescope.sources.tables import TEST_TABLES, read_table, read_tables

#: Columns of the snapshot that hold long texts.
WIDE = ("text", "html")

PROFILED = ["lineitem", "orders", "events", "customer", "part", "documents"]


def _profile_query(table):
    def run(spark, sf_dir):
        return P.profile_columns(read_table(spark, sf_dir, table), table, wide=WIDE)
    run.__doc__ = f"Exact all-column profile of {table}: rows, nulls, distinct, min, max, null percentage."
    return run


def profile_estate(spark, sf_dir):
    """Exact profile of every column of all 14 tables in one plan."""
    return P.profile_tables(read_tables(spark, sf_dir), wide=WIDE)


def profile_row_counts(spark, sf_dir):
    """Row count of every table."""
    return P.row_counts(read_tables(spark, sf_dir))


def profile_approx(spark, sf_dir):
    """P5: one-scan approximate profile of lineitem (distinct counts are estimates)."""
    return P.profile_columns(read_table(spark, sf_dir, "lineitem"), "lineitem", exact=False)


def profile_approx_error(spark, sf_dir):
    """P5: each approximate distinct count of lineitem is within 15 per cent of the exact one (three standard errors); rows and nulls are exact."""
    df = read_table(spark, sf_dir, "lineitem")
    a = P.profile_columns(df, "lineitem", exact=False).select("column_name", F.col("distinct_count").alias("a"), F.col("total_count").alias("at"), F.col("null_count").alias("an"))
    e = P.profile_columns(df, "lineitem").join(a, "column_name")
    near = F.abs(F.col("a") - F.col("distinct_count")) <= F.col("distinct_count") * 0.15
    return e.select("column_name", "distinct_count", (near & (F.col("at") == F.col("total_count")) & (F.col("an") == F.col("null_count"))).alias("within"))


def largest_tables(spark, sf_dir):
    """Ten largest tables with their ratio to the largest."""
    return P.largest_tables(P.row_counts(read_tables(spark, sf_dir)), 10)


def key_inference(spark, sf_dir):
    """Key-like columns (no nulls, distinct = rows) over every column of every table."""
    prof = P.profile_tables(read_tables(spark, sf_dir), wide=WIDE)
    return P.infer_keys(prof).select("table_name", "column_name", "total_count", "distinct_count", "null_count",
                                     "is_key_candidate")


def null_bands(spark, sf_dir):
    """Null percentage band of each column of every table."""
    prof = P.profile_tables(read_tables(spark, sf_dir), wide=WIDE)
    return prof.select("table_name", "column_name", "null_percentage",
                       P.null_band(F.col("null_percentage")).alias("null_band"))


# ---------------------------------------------------------------- oracle SQL

def _column_sql(table, i, name, dt):
    cls = profile_class(dt)
    total = "count(*)"
    nulls = f"(count(*) - count({name}))"
    if cls == "nulls":
        distinct, mn, mx = "0", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"
    else:
        distinct = f"count(DISTINCT {name})"
        if cls == "full":
            mn, mx = value_text_sql(f"min({name})", dt), value_text_sql(f"max({name})", dt)
        else:
            mn, mx = "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT '{table}' AS table_name, '{name}' AS column_name, CAST({i} AS INTEGER) AS ordinal, "
        f"'{dt.simpleString()}' AS data_type, {total} AS total_count, {nulls} AS null_count, "
        f"CAST({distinct} AS BIGINT) AS distinct_count, {mn} AS min_value, {mx} AS max_value, "
        f"CASE WHEN {total} = 0 THEN 0.0 ELSE CAST({nulls} AS DOUBLE) / {total} * 100.0 END AS null_percentage "
        f"FROM {table}"
    )


def profile_sql(table):
    return "\nUNION ALL\n".join(_column_sql(table, i, n, dt) for i, (n, dt) in enumerate(TABLE_COLUMNS[table], 1))


def estate_profile_sql():
    return "\nUNION ALL\n".join(profile_sql(t) for t in TEST_TABLES)


ROW_COUNTS_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TEST_TABLES)

QUERIES = {f"profile_{t}": _profile_query(t) for t in PROFILED}
QUERIES.update({
    "profile_estate": profile_estate,
    "profile_row_counts": profile_row_counts,
    "profile_approx": profile_approx,
    "profile_approx_error": profile_approx_error,
    "largest_tables": largest_tables,
    "key_inference": key_inference,
    "null_bands": null_bands,
})

ORACLE = {f"profile_{t}": profile_sql(t) for t in PROFILED}
ORACLE.update({
    "profile_estate": estate_profile_sql(),
    "profile_row_counts": ROW_COUNTS_SQL,
    "profile_approx_error": f"SELECT column_name, distinct_count, true AS within FROM ({profile_sql('lineitem')})",
    "largest_tables": f"""
        WITH c AS ({ROW_COUNTS_SQL}), top AS (
          SELECT * FROM c ORDER BY row_count DESC, table_name LIMIT 10)
        SELECT table_name, row_count,
               CASE WHEN max(row_count) OVER () = 0 THEN 0.0
                    ELSE CAST(row_count AS DOUBLE) / max(row_count) OVER () END AS ratio_to_largest,
               CAST(row_number() OVER (ORDER BY row_count DESC, table_name) AS INTEGER) AS rank
        FROM top""",
    "key_inference": f"""
        WITH p AS ({estate_profile_sql()})
        SELECT table_name, column_name, total_count, distinct_count, null_count,
               (null_count = 0 AND distinct_count = total_count AND total_count > 0) AS is_key_candidate
        FROM p""",
    "null_bands": f"""
        WITH p AS ({estate_profile_sql()})
        SELECT table_name, column_name, null_percentage,
               CASE WHEN null_percentage >= 80.0 THEN 'critical' WHEN null_percentage >= 50.0 THEN 'high'
                    WHEN null_percentage >= 20.0 THEN 'medium' ELSE 'low' END AS null_band
        FROM p""",
})
