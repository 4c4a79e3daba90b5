"""Column profiling: rows, nulls, distinct, min, max for every column of a table in one job.

Exact mode (default ``branches``) builds one branch per column: ``groupBy(value).count()`` (partial
aggregation on the map side, so a hot value costs one row per task, not a third of the shuffle).
The per-value rows of all columns are put in typed slots (one slot per type family, so min and max
stay typed), unioned, and reduced once per column: rows, nulls, distinct, min and max. On columnar
sources each branch reads only its own column. ``stacked`` reads the table once instead (best for
row sources), ``branches`` keeps a separate global aggregate per column. Approximate mode is one
scan with ``approx_count_distinct`` for very wide or very high-cardinality tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescope.session import ranked
from lakescope.functions.render import (NUMERIC_FRACTIONAL, NUMERIC_INTEGRAL, profile_class, value_text,
                                        value_text_spark_sql)

PROFILE_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("total_count", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("distinct_count", T.LongType()),
    T.StructField("min_value", T.StringType()),
    T.StructField("max_value", T.StringType()),
    T.StructField("null_percentage", T.DoubleType()),
])


#: Texts of up to so many bytes are grouped as they are; longer ones by a digest.
KEY_BYTES = 64


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def null_percentage(nulls, total):
    """Percent of nulls with a zero guard (unrounded, as the reference model does)."""
    return F.when(total == 0, F.lit(0.0)).otherwise(nulls.cast("double") / total * F.lit(100.0))


def _finish(df: DataFrame, table_name: str, column: str, ordinal: int, dtype: T.DataType) -> DataFrame:
    return df.select(
        F.lit(table_name).alias("table_name"),
        F.lit(column).alias("column_name"),
        F.lit(ordinal).cast("int").alias("ordinal"),
        F.lit(dtype.simpleString()).alias("data_type"),
        F.coalesce(F.col("total_count"), F.lit(0)).cast("long").alias("total_count"),
        F.coalesce(F.col("null_count"), F.lit(0)).cast("long").alias("null_count"),
        F.coalesce(F.col("distinct_count"), F.lit(0)).cast("long").alias("distinct_count"),
        F.col("min_value"),
        F.col("max_value"),
    ).withColumn("null_percentage", null_percentage(F.col("null_count"), F.col("total_count")))


def _exact_branch(df: DataFrame, table_name: str, field: T.StructField, ordinal: int) -> DataFrame:
    cls = profile_class(field.dataType)
    v = F.col(_q(field.name))
    if cls == "nulls":
        agg = df.agg(
            F.count(F.lit(1)).alias("total_count"),
            F.count_if(v.isNull()).alias("null_count"),
        ).select("*", F.lit(0).alias("distinct_count"), F.lit(None).cast("string").alias("min_value"),
                 F.lit(None).cast("string").alias("max_value"))
        return _finish(agg, table_name, field.name, ordinal, field.dataType)
    grouped = df.groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    minmax = cls == "full"
    agg = grouped.agg(
        F.sum("n").alias("total_count"),
        F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("null_count"),
        F.count("v").alias("distinct_count"),
        (value_text(F.min("v"), field.dataType) if minmax else F.lit(None).cast("string")).alias("min_value"),
        (value_text(F.max("v"), field.dataType) if minmax else F.lit(None).cast("string")).alias("max_value"),
    )
    return _finish(agg, table_name, field.name, ordinal, field.dataType)


def profile_columns(df: DataFrame, table_name: str, exact: bool = True, columns: list[str] | None = None,
                    method: str = "sql", wide: tuple[str, ...] = ()) -> DataFrame:
    """Profile every column (or the named ones) of ``df``.

    Output: table_name, column_name, ordinal, data_type, total_count, null_count, distinct_count,
    min_value, max_value, null_percentage. Numeric, string, date and timestamp columns get min/max;
    booleans get distinct but no min/max; binary and complex columns get the null count only.

    ``wide``: text columns that hold long values; these are counted by digest and never shuffled.

    ``method='sql'`` (default): the branches plan written as one Spark SQL statement (fast to plan).
    ``method='branches'``: per-column ``groupBy(value)`` then a global aggregate per column.
    ``method='hybrid'``: the same branches feeding one shared reduce over typed value slots.
    ``method='stacked'`` reads the table once: every row is turned into one record per
    column holding the value in a slot of its type family, pre-aggregated per (column, value) on the
    map side, shuffled once, then reduced per column. ``method='branches'`` builds one
    ``groupBy(value)`` branch per column (each branch reads the table; persist non-columnar inputs).
    """
    fields = [(i, f) for i, f in enumerate(df.schema.fields, start=1) if columns is None or f.name in columns]
    if not exact:
        return _approx_profile(df, table_name, fields)
    if method == "sql":
        sub = df.select(*[F.col(_q(f.name)) for _, f in fields]) if columns is not None else df
        out = profile_tables_sql({table_name: sub}, wide=wide)
        if columns is not None:  # keep the ordinals of the full schema
            pos = {f.name: i for i, f in fields}
            out = out.withColumn("ordinal", F.element_at(F.create_map(*[x for k, v in pos.items()
                                                                       for x in (F.lit(k), F.lit(v))]),
                                                         F.col("column_name")))
        return out
    if method == "stacked":
        return _stacked_profile(df, table_name, fields)
    if method == "hybrid":
        return _hybrid_profile(df, table_name, fields)
    branches = [_exact_branch(df, table_name, f, i) for i, f in fields]
    return reduce(DataFrame.unionByName, branches)


_SLOTS = [
    ("s_long", NUMERIC_INTEGRAL, "bigint"),
    ("s_double", NUMERIC_FRACTIONAL, "double"),
    ("s_string", (T.StringType,), "string"),
    ("s_ts", (T.TimestampType,), "timestamp"),
    ("s_tsntz", (T.TimestampNTZType,), "timestamp_ntz"),
    ("s_date", (T.DateType,), "date"),
    ("s_bool", (T.BooleanType,), "boolean"),
]


def _slot_of(dt: T.DataType):
    for name, types, cast in _SLOTS:
        if isinstance(dt, types):
            return name, cast
    if isinstance(dt, T.DecimalType):
        return f"s_dec_{dt.precision}_{dt.scale}", dt.simpleString()
    return None, None


def _slot_layout(fields):
    slot_cols: dict[str, str] = {}
    by_idx = {}
    for i, f in fields:
        slot, cast = _slot_of(f.dataType) if profile_class(f.dataType) != "nulls" else (None, None)
        if slot:
            slot_cols[slot] = cast
        by_idx[i] = slot
    return sorted(slot_cols), slot_cols, by_idx


def _slot_record(i, f, slot, slot_names, slot_cols, v):
    members = [F.lit(i).alias("ci")]
    for s in slot_names:
        members.append((v.cast(slot_cols[s]) if s == slot else F.lit(None).cast(slot_cols[s])).alias(s))
    # columns without a slot (binary, complex) only carry their null flag
    members.append((v.isNull() if slot is None else F.lit(None).cast("boolean")).alias("is_null_other"))
    return members


def _sentinels(spark, fields, slot_names, slot_cols, by_idx) -> DataFrame:
    """One zero-weight record per column, generated on the JVM side, so every column (also of an
    empty table) reaches the reduce; it adds nothing to rows, nulls or distinct."""
    recs = []
    for i, f in fields:
        members = [F.lit(i).alias("ci")] + [F.lit(None).cast(slot_cols[s]).alias(s) for s in slot_names]
        members += [F.lit(True).alias("is_null_other"), F.lit(0).cast("long").alias("n")]
        recs.append(F.struct(*members))
    return spark.range(1).select(F.inline(F.array(*recs)))


def _case_on_ci(fields, value_of):
    expr = None
    for i, f in fields:
        v = value_of(i, f)
        expr = F.when(F.col("ci") == i, v) if expr is None else expr.when(F.col("ci") == i, v)
    return expr


def _reduce_per_column(per_value: DataFrame, table_name: str, fields, slot_names, by_idx, slot_cols=None) -> DataFrame:
    """(ci, value slots, n) -> one profile row per column."""
    if slot_cols is not None:
        per_value = per_value.unionByName(_sentinels(per_value.sparkSession, fields, slot_names, slot_cols, by_idx))

    def null_cond(i, f):
        slot = by_idx[i]
        return F.col(slot).isNull() if slot else F.col("is_null_other")

    per_value = per_value.withColumn("_null", F.coalesce(F.col("is_null_other"), _case_on_ci(fields, null_cond)))
    aggs = [F.sum("n").alias("total_count"),
            F.sum(F.when(F.col("_null"), F.col("n"))).alias("null_count"),
            # columns without a slot (is_null_other set) get no distinct count
            F.count_if(~F.col("_null") & F.col("is_null_other").isNull()).alias("distinct_count")]
    for s in slot_names:
        aggs += [F.min(s).alias(f"min_{s}"), F.max(s).alias(f"max_{s}")]
    out = per_value.groupBy("ci").agg(*aggs)

    def render(which):
        def value_of(i, f):
            slot = by_idx[i]
            if slot and profile_class(f.dataType) == "full":
                return value_text(F.col(f"{which}_{slot}"), f.dataType)
            return F.lit(None).cast("string")
        return value_of

    return out.select(
        F.lit(table_name).alias("table_name"),
        _case_on_ci(fields, lambda i, f: F.lit(f.name)).alias("column_name"),
        F.col("ci").cast("int").alias("ordinal"),
        _case_on_ci(fields, lambda i, f: F.lit(f.dataType.simpleString())).alias("data_type"),
        F.coalesce(F.col("total_count"), F.lit(0)).cast("long").alias("total_count"),
        F.coalesce(F.col("null_count"), F.lit(0)).cast("long").alias("null_count"),
        F.coalesce(F.col("distinct_count"), F.lit(0)).cast("long").alias("distinct_count"),
        _case_on_ci(fields, render("min")).alias("min_value"),
        _case_on_ci(fields, render("max")).alias("max_value"),
    ).withColumn("null_percentage", null_percentage(F.col("null_count"), F.col("total_count")))


def _stacked_profile(df: DataFrame, table_name: str, fields) -> DataFrame:
    """One scan, one shuffle of distinct (column, value) pairs, one small reduce per column."""
    slot_names, slot_cols, by_idx = _slot_layout(fields)
    structs = [F.struct(*_slot_record(i, f, by_idx[i], slot_names, slot_cols, F.col(_q(f.name)))) for i, f in fields]
    stacked = df.select(F.inline(F.array(*structs)))
    per_value = stacked.groupBy("ci", *slot_names, "is_null_other").agg(F.count(F.lit(1)).alias("n"))
    return _reduce_per_column(per_value, table_name, fields, slot_names, by_idx, slot_cols)


def _hybrid_profile(df: DataFrame, table_name: str, fields) -> DataFrame:
    """Per column ``groupBy(value).count()`` (parallel, each reads one column), then one shared reduce."""
    slot_names, slot_cols, by_idx = _slot_layout(fields)
    parts = []
    for i, f in fields:
        slot = by_idx[i]
        v = F.col(_q(f.name))
        if slot is None:
            g = df.groupBy(v.isNull().alias("_isnull")).agg(F.count(F.lit(1)).alias("n"))
            rec = _slot_record(i, f, None, slot_names, slot_cols, F.lit(None))
            rec[-1] = F.col("_isnull").alias("is_null_other")
            parts.append(g.select(*rec, "n"))
        else:
            g = df.groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("n"))
            parts.append(g.select(*_slot_record(i, f, slot, slot_names, slot_cols, F.col("_v")), "n"))
    per_value = reduce(DataFrame.unionByName, parts)
    return _reduce_per_column(per_value, table_name, fields, slot_names, by_idx, slot_cols)


def _approx_profile(df: DataFrame, table_name: str, fields) -> DataFrame:
    """One scan: count, non-null count, approximate distinct, min and max for all columns."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in fields:
        v = F.col(_q(f.name))
        cls = profile_class(f.dataType)
        aggs.append(F.count(v).alias(f"nn_{i}"))
        if cls != "nulls":
            aggs.append(F.approx_count_distinct(v).alias(f"d_{i}"))
        if cls == "full":
            aggs.append(value_text(F.min(v), f.dataType).alias(f"mn_{i}"))
            aggs.append(value_text(F.max(v), f.dataType).alias(f"mx_{i}"))
    wide = df.agg(*aggs)
    structs = []
    for i, f in fields:
        cls = profile_class(f.dataType)
        structs.append(F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(i).alias("ordinal"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            (F.col("__rows") - F.col(f"nn_{i}")).alias("null_count"),
            (F.col(f"d_{i}") if cls != "nulls" else F.lit(0)).cast("long").alias("distinct_count"),
            (F.col(f"mn_{i}") if cls == "full" else F.lit(None).cast("string")).alias("min_value"),
            (F.col(f"mx_{i}") if cls == "full" else F.lit(None).cast("string")).alias("max_value"),
        ))
    rows = wide.select(F.col("__rows").alias("total_count"), F.inline(F.array(*structs)))
    return rows.select(
        F.lit(table_name).alias("table_name"), "column_name", F.col("ordinal").cast("int"), "data_type",
        F.col("total_count").cast("long"), F.col("null_count").cast("long"), "distinct_count",
        "min_value", "max_value",
    ).withColumn("null_percentage", null_percentage(F.col("null_count"), F.col("total_count")))


def _sql_lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _branch_sql(view: str, table_name: str, i: int, f: T.StructField, wide: tuple[str, ...] = ()) -> str:
    cls = profile_class(f.dataType)
    head = (f"SELECT {_sql_lit(table_name)} AS table_name, {_sql_lit(f.name)} AS column_name, CAST({i} AS INT) AS "
            f"ordinal, {_sql_lit(f.dataType.simpleString())} AS data_type")
    if cls == "nulls":
        return (f"{head}, count(1) AS total_count, count_if({_q(f.name)} IS NULL) AS null_count, "
                f"CAST(0 AS BIGINT) AS distinct_count, CAST(NULL AS STRING) AS min_value, "
                f"CAST(NULL AS STRING) AS max_value FROM {{{view}}}")
    mn = value_text_spark_sql("min(v)", f.dataType) if cls == "full" else "CAST(NULL AS STRING)"
    mx = value_text_spark_sql("max(v)", f.dataType) if cls == "full" else "CAST(NULL AS STRING)"
    if isinstance(f.dataType, T.StringType) and f.name in wide:
        return _text_branch_sql(view, head, f)
    return (f"{head}, coalesce(sum(n), 0) AS total_count, coalesce(sum(CASE WHEN v IS NULL THEN n END), 0) "
            f"AS null_count, count(v) AS distinct_count, {mn} AS min_value, {mx} AS max_value "
            f"FROM (SELECT {_q(f.name)} AS v, count(1) AS n FROM {{{view}}} GROUP BY {_q(f.name)})")


def _text_branch_sql(view: str, head: str, f: T.StructField) -> str:
    """A column of long texts, read twice: values of up to ``KEY_BYTES`` bytes are grouped as they are, longer ones by their SHA-256, so no long
    text is shuffled; rows, nulls, least and greatest value are partial aggregates, a row for each task."""
    v = _q(f.name)
    # the first byte tells values from digests
    key = f"CASE WHEN octet_length({v}) <= {KEY_BYTES} THEN concat('=', {v}) ELSE concat('#', sha2({v}, 256)) END"
    return (f"{head}, a.total_count, a.null_count, d.distinct_count, {value_text_spark_sql('a.mn', f.dataType)} AS min_value, "
            f"{value_text_spark_sql('a.mx', f.dataType)} AS max_value "
            f"FROM (SELECT count(1) AS total_count, count_if({v} IS NULL) AS null_count, min({v}) AS mn, max({v}) AS mx FROM {{{view}}}) a "
            f"CROSS JOIN (SELECT count(k) AS distinct_count FROM (SELECT {key} AS k FROM {{{view}}} GROUP BY 1)) d")


def profile_tables_sql(tables: dict[str, DataFrame], key_types_only: bool = False, wide: tuple[str, ...] = ()) -> DataFrame:
    """Exact estate profile as one Spark SQL statement: a UNION ALL of per-column ``GROUP BY`` branches
    (the same plan as ``method='branches'``), parsed and analysed once instead of once per operator.
    """
    spark = next(iter(tables.values())).sparkSession
    branches = []
    views = {f"t{k}": df for k, df in enumerate(tables.values())}
    for k, (name, df) in enumerate(tables.items()):
        for i, f in enumerate(df.schema.fields, start=1):
            if key_types_only and f.dataType.simpleString() not in KEY_TYPES:
                continue
            branches.append((f"t{k}", _branch_sql(f"t{k}", name, i, f, wide)))

    def run(chunk):
        used = sorted({v for v, _ in chunk})
        body = "\nUNION ALL\n".join(b for _, b in chunk)
        sql = (f"SELECT *, CASE WHEN total_count = 0 THEN 0.0D ELSE CAST(null_count AS DOUBLE) / total_count "
               f"* 100.0D END AS null_percentage FROM (\n{body}\n)")
        out = spark.sql(sql, **{v: views[v] for v in used})
        return out.select(*[F.col(c).cast(PROFILE_SCHEMA[c].dataType) for c in PROFILE_SCHEMA.fieldNames()])

    if not branches:
        return spark.createDataFrame([], PROFILE_SCHEMA)
    return run(branches)


def profile_tables(tables: dict[str, DataFrame], exact: bool = True, key_types_only: bool = False,
                   method: str = "sql", wide: tuple[str, ...] = ()) -> DataFrame:
    """Estate profile: every column of every table, one plan (``key_types_only``: integer and text columns;
    ``wide``: names of the columns that hold long texts).

    The default exact plan is built as one SQL statement (``profile_tables_sql``); other methods build
    it operator by operator.
    """
    if exact and method == "sql":
        return profile_tables_sql(tables, key_types_only, wide)
    parts = []
    for name, df in tables.items():
        cols = None
        if key_types_only:
            cols = [f.name for f in df.schema.fields if f.dataType.simpleString() in KEY_TYPES]
            if not cols:
                continue
        parts.append(profile_columns(df, name, exact, columns=cols, method=method if method != "sql" else "branches"))
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def null_band(pct_col, bands=(20.0, 50.0, 80.0)):
    """Label a null percentage by the UI bands (low / medium / high / critical)."""
    low, mid, high = bands
    return (F.when(pct_col >= high, "critical").when(pct_col >= mid, "high")
            .when(pct_col >= low, "medium").otherwise("low"))


def largest_tables(counts: DataFrame, n: int | None = None) -> DataFrame:
    """Tables by rows with the ratio to the largest; the first ``n`` if given."""
    top = counts.orderBy(F.col("row_count").desc(), F.col("table_name"))
    top = top if n is None else top.limit(n)
    w = Window.partitionBy()
    return top.select(
        "table_name", "row_count",
        F.when(F.max("row_count").over(w) == 0, F.lit(0.0))
        .otherwise(F.col("row_count").cast("double") / F.max("row_count").over(w)).alias("ratio_to_largest"),
        F.row_number().over(Window.orderBy(F.col("row_count").desc(), F.col("table_name"))).alias("rank"),
    )


def infer_keys(profile: DataFrame) -> DataFrame:
    """Key-like columns: no nulls and as many distinct values as rows (on a non-empty table)."""
    return profile.select(
        "table_name", "column_name", "ordinal", "data_type", "total_count", "distinct_count", "null_count",
        ((F.col("null_count") == 0) & (F.col("distinct_count") == F.col("total_count"))
         & (F.col("total_count") > 0)).alias("is_key_candidate"),
    )


KEY_TYPES = ["tinyint", "smallint", "int", "bigint", "string"]


def primary_keys(profile: DataFrame) -> DataFrame:
    """Inferred primary key per table: the first key-like column (by ordinal) of an integer or text type."""
    cand = infer_keys(profile).filter(F.col("is_key_candidate") & F.col("data_type").isin(KEY_TYPES))
    return cand.groupBy("table_name").agg(
        F.min_by("column_name", "ordinal").alias("pk_column"))


def ordered_profiles(profile: DataFrame) -> DataFrame:
    """Profiles from the table with most rows to that with fewest, then by name, with their place (from 1)."""
    order = [F.col("total_count").desc(), F.col("table_name"), F.col("column_name")]
    return ranked(profile, order, "_rank0").withColumn("rank", F.col("_rank0") + 1).drop("_rank0")
