"""Result sinks, partition refresh, streaming roll-up, and the driver entry points."""

import os
import tempfile

from pyspark.sql import functions as F

from lakescope.operators import estate as ES
from lakescope.streaming.rollup import run_rollup
from tests.conftest import SF_SMALL, rows


def test_save_and_open_result(spark):
    path = tempfile.mkdtemp(prefix="lakescope-result-", dir="/tmp")
    a = spark.createDataFrame([("Sales", "dbo.Orders", None)], "database_name string, name string, note string")
    ES.save_result(spark, {"tables": a}, path + "/r", fmt="json")
    back = ES.open_result(spark, path + "/r", fmt="json")
    assert rows(back["tables"], "database_name", "name") == [("Sales", "dbo.Orders")]
    assert "note" not in back["tables"].columns  # null fields dropped


def test_refresh_one_database(spark):
    path = tempfile.mkdtemp(prefix="lakescope-refresh-", dir="/tmp") + "/t"
    old = spark.createDataFrame([("Sales", 1), ("HR", 2)], "database_name string, v int")
    ES.write_partitioned(old, path)
    ES.refresh_partition(spark.createDataFrame([("Sales", 10), ("HR", 99)], "database_name string, v int"), path,
                         "Sales")
    assert rows(spark.read.parquet(path), "database_name", "v") == [("HR", 2), ("Sales", 10)]


def test_refresh_to_no_rows(spark, tmp_path):
    old = spark.createDataFrame([("Sales", 1), ("HR", 2)], "database_name string, v int")
    ES.write_partitioned(old, f"{tmp_path}/t")
    ES.refresh_partition(old.filter("v = 2"), f"{tmp_path}/t", "Sales")
    assert rows(spark.read.parquet(f"{tmp_path}/t"), "database_name", "v") == [("HR", 2)]


def test_versions(spark, tmp_path, monkeypatch):
    """Refresh, empty, a writer that dies before its commit, two writers of one version, old versions, vacuum."""
    import pytest

    from lakescope.operators import versions as V
    path, schema = f"{tmp_path}/t", "database_name string, v int"
    frame = lambda *r: spark.createDataFrame(list(r), schema)
    now = lambda *a: rows(V.read(spark, path, *a), "database_name", "v")
    with pytest.raises(ValueError):
        V.read(spark, path)
    assert V.refresh(frame(("a", 1), ("a", 2), ("b", 3), ("a/é", 4)), path, ["a", "b", "a/é"]) == 1
    V.refresh(frame(("a", 9), ("b", 99)), path, ["a"])
    assert now() == [("a", 9), ("a/é", 4), ("b", 3)] and now(1) == [("a", 1), ("a", 2), ("a/é", 4), ("b", 3)]
    commit = V._commit
    with monkeypatch.context() as m:
        m.setattr(V, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            V.refresh(frame(("b", 100)), path, ["b"])
    assert now() == [("a", 9), ("a/é", 4), ("b", 3)]
    V.refresh(frame(), path, ["a"])
    assert now() == [("a/é", 4), ("b", 3)]
    with pytest.raises(RuntimeError):  # the version is taken
        commit(spark, path, {"version": 3})
    assert V.vacuum(spark, path) == 2 and now() == [("a/é", 4), ("b", 3)]
    V.refresh(frame(), path, ["b", "a/é"])
    assert now() == [] and V.read(spark, path).columns == ["database_name", "v"]


def test_isolated_jobs(spark, tmp_path):
    """A job that fails while it runs, and one that fails before, are recorded; the others' rows are there."""
    spark.range(3).selectExpr("cast(id as string) AS v").write.text(f"{tmp_path}/text")
    jobs = {"good": lambda: spark.range(5), "corrupt": lambda: spark.read.schema("v string").parquet(f"{tmp_path}/text"),
            "missing": lambda: spark.read.parquet(f"{tmp_path}/none"), "late": lambda: spark.range(3).selectExpr("raise_error('late') AS x")}
    good, failed = ES.isolated(spark, jobs, workers=2)
    assert {k: v.count() for k, v in good.items()} == {"good": 5}
    errors = {r.name: r.error for r in failed.collect()}
    assert set(errors) == {"corrupt", "missing", "late"} and "late" in errors["late"]


def test_stream_rollup_of_an_empty_log(spark, tmp_path):
    """No file: an empty result; files that come later are taken up by the next run."""
    import shutil
    os.makedirs(f"{tmp_path}/in")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    run = lambda: run_rollup(spark, f"{tmp_path}/in", ev.schema, "ts", ["event_type"], measure="value", out_dir=f"{tmp_path}/out")
    empty = run()
    assert empty.count() == 0 and "measure_sum" in empty.columns
    shutil.copy(f"{SF_SMALL}/events.parquet", f"{tmp_path}/in/events.parquet")
    assert run().agg(F.sum("executions")).first()[0] == ev.count()
    assert run().agg(F.sum("executions")).first()[0] == ev.count()


def test_stream_rollup_matches_batch(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    out = run_rollup(spark, SF_SMALL, ev.schema, "ts", ["event_type"], window="1 day",
                     measure="value", glob="events.parquet")
    batch = ev.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"))
    assert out.count() == batch.count()
    assert out.agg(F.sum("executions")).first()[0] == ev.count()


def test_entry_and_queries_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    qs, oracle = E.queries(), E.oracle_sql()
    assert set(oracle) <= set(qs)
    for name in ["profile_row_counts", "implicit_fk", "trade_cycles", "usage_scores", "text_refs"]:
        assert qs[name](spark, SF_SMALL).count() >= 0


def test_oracle_matches_on_small_data(spark):
    """A choice of registered queries equals its DuckDB oracle on sf0.001 (rows and values); tools/oracle_check.py runs all."""
    import duckdb

    import __spark_entry__ as E
    from lakescope.sources.tables import TEST_TABLES
    from tools.oracle_check import rows_of
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    qs, oracle = E.queries(), E.oracle_sql()
    fast = ["profile_lineitem", "implicit_fk", "fk_orphans", "quality_issues", "record_impact", "trade_cycles",
            "membership_components", "text_refs", "usage_scores", "redundant_paths", "impact_bands", "ddl_text",
            "stream_rollup", "link_refs", "ref_edges", "cross_database", "link_orphans", "partition_refresh", "estate_merge", "term_usage",
            "object_list", "view_counts", "job_list", "path_inventory", "missing_facts", "table_reads", "execution_counts"]
    for name in fast:
        s = rows_of(qs[name](spark, SF_SMALL).toPandas(), 9)
        o = rows_of(con.execute(oracle[name]).fetchdf(), 9)
        assert s == o, name
    assert os.path.exists(SF_SMALL)


def test_stream_rollup_many_batches(spark):
    """Events split over several files arrive in several micro-batches; the merged result equals the batch
    aggregation exactly ."""
    src = tempfile.mkdtemp(prefix="lakescope-stream-src-", dir="/tmp")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    bounds = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-02-01"]
    for i in range(4):
        ev.filter((F.col("ts") >= bounds[i]) & (F.col("ts") < bounds[i + 1])).coalesce(1).write.parquet(
            f"{src}/part{i}")
    import glob
    import shutil
    flat = tempfile.mkdtemp(prefix="lakescope-stream-in-", dir="/tmp")
    for i, f in enumerate(sorted(glob.glob(f"{src}/part*/*.parquet"))):
        shutil.copy(f, f"{flat}/events_{i}.parquet")  # one file per week: one micro-batch each
    out = run_rollup(spark, flat, ev.schema, "ts", ["event_type"], window="1 day",
                     measure="value", glob="events_*.parquet", files_per_trigger=1)
    exp = ev.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("executions")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "executions")
    assert rows(out.select("window_start", "event_type", "executions")) == rows(exp)


def test_stream_rollup_does_not_depend_on_file_order(spark, tmp_path):
    """Three files, the newest first, one for each micro-batch, with default settings: no row is late."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    bounds = ["2024-01-01", "2024-01-11", "2024-01-21", "2030-01-01"]
    import glob
    import shutil
    os.makedirs(f"{tmp_path}/in")
    for k, i in enumerate((2, 1, 0)):
        ev.filter((F.col("ts") >= bounds[i]) & (F.col("ts") < bounds[i + 1])).coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        for f in glob.glob(f"{tmp_path}/part{k}/*.parquet"):
            shutil.copy(f, f"{tmp_path}/in/events_{k}.parquet")
            os.utime(f"{tmp_path}/in/events_{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    out = run_rollup(spark, f"{tmp_path}/in", ev.schema, "ts", ["event_type"], files_per_trigger=1, measure="value")
    exp = ev.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("executions"), F.sum(F.col("value").cast("decimal(38,6)")).cast("double").alias("measure_sum")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "executions", "measure_sum")
    assert rows(out.select("window_start", "event_type", "executions", "measure_sum")) == rows(exp)
    assert sum(r.executions for r in out.collect()) == ev.count()
