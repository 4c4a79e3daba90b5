"""Continuous usage roll-up with Structured Streaming.

An append-only execution log is read as a stream. Each micro-batch is aggregated by (time window, keys) and
its counts, first and last times and sums are written to ``<out>/batch_id=<n>`` under the shared checkpoint
folder (a retried batch overwrites its own folder). All four merge, so the reader's sums over the batches
equal one aggregation of the whole log, whatever the order and number of files: no row is late, and no state
is kept between batches. ``compact_rollup`` folds written batches into one when there are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescope.session import path_exists, scratch_path


def utc_instant(c) -> F.Column:
    """A time-zone-less timestamp read as UTC wall-clock time, as an instant (independent of the
    session time zone); event-time watermarks need instants."""
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                            F.date_part(F.lit("SECOND"), c), F.lit("UTC"))


def utc_wall_clock(c) -> F.Column:
    """An instant as time-zone-less UTC wall-clock time, by epoch arithmetic (no session zone)."""
    secs = (F.unix_micros(c) / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def rollup_rows(rows: DataFrame, ts_col: str, keys: list[str], window: str, measure: str | None = None,
                measure_type: str = "decimal(38,6)") -> DataFrame:
    """Per (window, keys): count, first, last and an exact sum in ``measure_type``."""
    dt = rows.schema[ts_col].dataType
    ts = utc_instant(F.col(ts_col)) if isinstance(dt, T.TimestampNTZType) else F.col(ts_col).cast("timestamp")
    aggs = [F.count(F.lit(1)).alias("executions"), F.min("_ts").alias("first_seen"), F.max("_ts").alias("last_seen")]
    if measure:
        aggs.append(F.sum(F.col(measure).cast(measure_type)).alias("measure_sum"))
    return rows.withColumn("_ts", ts).groupBy(F.window("_ts", window).alias("w"), *keys).agg(*aggs)


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial roll-ups of any split of the log, merged."""
    aggs = [F.sum("executions").alias("executions"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    if "measure_sum" in parts.columns:
        aggs.append(F.sum("measure_sum").alias("measure_sum"))
    return parts.groupBy("w", *keys).agg(*aggs)


def run_rollup(spark: SparkSession, source_dir: str, schema: T.StructType, ts_col: str, keys: list[str],
               window: str = "1 day", measure: str | None = None, glob: str | None = None,
               files_per_trigger: int | None = None, out_dir: str | None = None,
               measure_type: str = "decimal(38,6)") -> DataFrame:
    """Run the roll-up to completion (``availableNow``) and return the final rows."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    out = out_dir or scratch_path(spark, "stream-rollup")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rollup_rows(batch, ts_col, keys, window, measure, measure_type).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (reader.parquet(source_dir).writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if not path_exists(spark, out):  # no file has come yet
        rollup_rows(spark.createDataFrame([], schema), ts_col, keys, window, measure, measure_type).write.parquet(f"{out}/batch_id=-1")
    return read_rollup(spark, out, keys, measure is not None, wall_clock=isinstance(schema[ts_col].dataType, T.TimestampNTZType))


def compact_rollup(spark: SparkSession, out: str, into: str, keys: list[str]) -> None:
    """Fold the written batches into one, in another folder that the reader takes in their place."""
    merged(spark.read.parquet(out).drop("batch_id"), keys).write.mode("errorifexists").parquet(f"{into}/batch_id=0")


def read_rollup(spark: SparkSession, out: str, keys: list[str], has_measure: bool,
                wall_clock: bool = True) -> DataFrame:
    """The roll-up of all written micro-batches; times come back as UTC wall-clock (time-zone-less) when the
    input was time-zone-less."""
    rows = merged(spark.read.parquet(out).drop("batch_id"), keys)
    t = utc_wall_clock if wall_clock else (lambda c: c)
    cols = [t(F.col("w.start")).alias("window_start"), t(F.col("w.end")).alias("window_end"), *keys, "executions",
            t(F.col("first_seen")).alias("first_seen"), t(F.col("last_seen")).alias("last_seen")]
    if has_measure:
        cols.append(F.col("measure_sum").cast("double").alias("measure_sum"))
    return rows.select(*cols)
