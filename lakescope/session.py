"""Session helpers: build a local session for tests, find the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lakescope") -> SparkSession:
    """A local session for tests and the bench; on a cluster, use the cluster's own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("LAKESCOPE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be shared storage and be configured there: without it this raises an
    error. A local session, as in tests, gets a folder of its own, which goes when Python ends.
    """
    sc = spark.sparkContext
    current = (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
               or sc.getConf().get("spark.checkpoint.dir", None))
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="lakescope-ckpt-", dir="/tmp")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    import uuid

    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


#: Paths of the tables that ``cut_lineage`` has written in this process, in order.
WRITTEN: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder as Parquet and read back: the plan is cut at a reliable copy, which
    survives lost executors and is fast to scan again."""
    spark = df.sparkSession
    path = scratch_path(spark, "round")
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    WRITTEN.append(path)
    return out


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind tables from ``cut_lineage`` that nothing reads any more."""
    for df in tables:
        if getattr(df, "_scratch", None):
            delete_path(df.sparkSession, df._scratch)


def release(spark: SparkSession, paths: list[str], read_by: DataFrame | None = None) -> None:
    """Delete tables that ``cut_lineage`` has written, all but those that ``read_by`` reads."""
    used = read_by.inputFiles() if read_by is not None and paths else []
    for path in paths:
        name = path.rsplit("/", 1)[-1]  # a unique name
        if not any(f"/{name}/" in f for f in used):
            delete_path(spark, path)


def ranked(df: DataFrame, order: list[Column], rank: str, partitions: int | None = None) -> DataFrame:
    """Rank rows from 0 over a global order without a one-task window.

    Rows are range-sorted and written; a row's rank is its place in its range plus the sizes of the
    ranges before it. The offsets table has one row for each range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    laid = cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                  .withColumn("_place", place))
    laid = laid.withColumn("_range", F.shiftright("_place", 33)).withColumn(
        "_seq", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = laid.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    return laid.join(before, "_range").withColumn(rank, F.col("_before") + F.col("_seq")).drop(
        "_place", "_range", "_seq", "_before")
