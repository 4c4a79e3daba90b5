"""Estate operators: stamp and qualify per-database results, cross-database resolution, failure table,
refresh of one database, and the result sink / reader (JSON or parquet, versioned)."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescope.functions.names import qualify
from lakescope.session import cut_lineage, delete_path

RESULT_VERSION = 1


def stamp(df: DataFrame, database_name: str) -> DataFrame:
    """B1 / U4: add (or overwrite) the database column."""
    return df.withColumn("database_name", F.lit(database_name))


def qualify_columns(df: DataFrame, cols: list[str], database_col: str = "database_name") -> DataFrame:
    """B2: prefix names with fewer than two dots by the row's database (array columns element-wise)."""
    for c in cols:
        dt = df.schema[c].dataType.simpleString()
        if dt.startswith("array"):
            df = df.withColumn(c, F.transform(c, lambda x: qualify(x, F.col(database_col))))
        else:
            df = df.withColumn(c, qualify(c, database_col))
    return df


def resolve_external(edges: DataFrame, analysed: DataFrame) -> DataFrame:
    """An External target whose database was analysed becomes a local node of that database.

    ``edges`` has to_database and to_type; ``analysed`` has database_name. The target keeps its own
    database (not the referencing one) so impact can cross databases.
    """
    a = analysed.select(F.lower("database_name").alias("_adb")).distinct().withColumn("_hit", F.lit(True))
    e = edges.join(a, F.lower(edges.to_database) == a._adb, "left")
    internal = F.col("_hit") & (F.col("to_type") == "External")
    return e.withColumn("to_type", F.when(internal, F.lit("Table")).otherwise(F.col("to_type"))) \
        .withColumn("is_cross_database", F.col("to_database").isNotNull()) \
        .drop("_adb", "_hit")


def is_cross_database(from_db, to_db):
    """null-safe cross-database test (a set target with an unset source counts as cross)."""
    return F.when(to_db.isNull(), F.lit(False)).when(from_db.isNull(), F.lit(True)).otherwise(
        F.lower(from_db) != F.lower(to_db))


def failures(spark: SparkSession, errors: list[tuple[str, str]]) -> DataFrame:
    """The failure table: one row per database whose analysis failed."""
    return spark.createDataFrame(errors, "database_name string, error string")


def read_estate(spark: SparkSession, loaders: dict, sections: list[str] | None = None):
    """Read the catalog of every database and union them; a database whose reader fails is
    recorded in the failure table and the others go on. ``loaders`` maps database name to a callable
    returning a dict of catalog frames (for example ``sources.jdbc.read_catalog``); the frames are
    resolved eagerly (schemas, connection) so failures surface here, not later in a shared plan."""
    from functools import reduce as _reduce
    good: dict[str, list[DataFrame]] = {}
    errors: list[tuple[str, str]] = []
    for name, loader in loaders.items():
        try:
            frames = {k: df for k, df in loader().items() if sections is None or k in sections}
            for df in frames.values():
                df.schema  # resolve now, so a failure keeps none of this database's frames
        except Exception as e:  # fault isolation: record and go on
            errors.append((name, f"{type(e).__name__}: {e}"))
            continue
        for k, df in frames.items():
            good.setdefault(k, []).append(df)
    merged = {k: _reduce(DataFrame.unionByName, v) for k, v in good.items()}
    return merged, failures(spark, errors)


def write_partitioned(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a result table partitioned by database (dynamic partition overwrite replaces only the
    databases present in ``df``)."""
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("database_name").parquet(path))


def refresh_partition(df: DataFrame, path: str, database_name: str) -> None:
    """Replace one database's rows of a stored result table, leaving the others; without new rows it has none.

    Readers may see the change halfway; ``versions.refresh`` commits it at once.
    """
    mine = df.filter(F.col("database_name") == database_name)
    if mine.isEmpty():
        held = df.sparkSession.read.parquet(path).filter(F.col("database_name") == database_name).select(F.input_file_name().alias("f")).distinct()
        for folder in {r.f.rsplit("/", 1)[0] for r in held.collect()}:  # one folder for a database
            delete_path(df.sparkSession, folder)
    else:
        write_partitioned(mine, path)


def isolated(spark: SparkSession, jobs: dict, workers: int = 4) -> tuple[dict[str, DataFrame], DataFrame]:
    """Run each job by itself, a few at a time: (its rows by name, failures).

    ``jobs`` maps a name to a callable that returns a DataFrame. Each is run and written under a job group of its own,
    so one that fails while it runs (a corrupt file, a lost connection) is recorded and the others go on.
    """
    def one(name):
        spark.sparkContext.setJobGroup(f"lakescope-{name}", name)
        try:
            return name, cut_lineage(jobs[name]()), None
        except Exception as e:  # fault isolation: record and go on
            return name, None, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(max_workers=workers) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(one), sorted(jobs)))
    return {n: df for n, df, e in done if e is None}, spark.createDataFrame([(n, e) for n, _, e in done if e is not None], "name string, error string")


def coalesce_results(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A newer run's sections replace the old ones; sections it lacks are kept."""
    out = dict(old)
    out.update({k: v for k, v in new.items() if v is not None})
    return out


def save_result(spark: SparkSession, sections: dict[str, DataFrame], path: str, fmt: str = "parquet",
                metadata: dict | None = None) -> None:
    """Write each section as its own table plus a version row. JSON drops null fields."""
    for name, df in sections.items():
        w = df.write.mode("overwrite")
        if fmt == "json":
            w.option("ignoreNullFields", "true").json(f"{path}/{name}")
        else:
            w.parquet(f"{path}/{name}")
    meta = {"version": RESULT_VERSION, "sections": sorted(sections), **(metadata or {})}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
        f"{path}/_meta")


def open_result(spark: SparkSession, path: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Read a saved result, checking its version."""
    meta = json.loads(spark.read.text(f"{path}/_meta").first()[0])
    if meta.get("version") != RESULT_VERSION:
        raise ValueError(f"unsupported result version {meta.get('version')}")
    reader = spark.read.json if fmt == "json" else spark.read.parquet
    return {name: reader(f"{path}/{name}") for name in meta["sections"]}


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row (null fields dropped)."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("json"))
