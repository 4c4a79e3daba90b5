"""Profiling invariants and usage-score vectors."""

import datetime as dt

from pyspark.sql import functions as F

from lakescope.operators import profile as P
from lakescope.operators import usage as U
from tests.conftest import SF_SMALL, rows


def _sample(spark):
    return spark.createDataFrame(
        [(1, "a", 1.5, True, [1.0], dt.datetime(2024, 1, 1, 12, 0, 0)),
         (2, None, 2.25, False, None, None),
         (2, "b", None, None, [2.0], dt.datetime(2024, 1, 2, 0, 0, 0, 5))],
        "k int, s string, d double, b boolean, arr array<float>, ts timestamp_ntz")


def test_profile_methods_agree(spark):
    df = _sample(spark)
    base = rows(P.profile_columns(df, "t", method="branches"))
    assert rows(P.profile_columns(df, "t", method="hybrid")) == base
    assert rows(P.profile_columns(df, "t", method="stacked")) == base
    by = {r.column_name: r for r in P.profile_columns(df, "t").collect()}
    assert (by["k"].distinct_count, by["k"].min_value, by["k"].max_value) == (2, "1", "2")
    assert (by["s"].null_count, by["s"].distinct_count) == (1, 2)
    assert by["d"].min_value == "1.500000" and by["d"].max_value == "2.250000"
    assert (by["b"].distinct_count, by["b"].min_value) == (2, None)
    assert (by["arr"].null_count, by["arr"].distinct_count) == (1, 0)
    assert by["ts"].max_value == "2024-01-02 00:00:00.000005"
    assert abs(by["s"].null_percentage - 100 / 3) < 1e-9


def test_empty_table_profile(spark):
    df = _sample(spark).limit(0)
    for r in P.profile_columns(df, "t").collect():
        assert (r.total_count, r.null_count, r.distinct_count, r.null_percentage) == (0, 0, 0, 0.0)


def test_profile_invariants_on_test_data(spark):
    from lakescope.sources.tables import read_tables
    prof = P.profile_tables(read_tables(spark, SF_SMALL))
    bad = prof.filter((F.col("distinct_count") > F.col("total_count") - F.col("null_count"))
                      | (F.col("null_count") > F.col("total_count")))
    assert bad.count() == 0
    approx = {r.column_name: r for r in P.profile_columns(read_tables(spark, SF_SMALL, ["lineitem"])["lineitem"],
                                                          "lineitem", exact=False).collect()}
    exact = {r.column_name: r for r in prof.filter("table_name = 'lineitem'").collect()}
    for c, r in exact.items():
        assert approx[c].total_count == r.total_count and approx[c].min_value == r.min_value
        assert abs(approx[c].distinct_count - r.distinct_count) <= max(3, 0.1 * r.distinct_count)


def _sig(spark, rows_):
    return spark.createDataFrame(rows_, "object_name string, object_type string, weight string, evidence string, "
                                        "signal string").withColumn("weight", F.col("weight").cast("decimal(3,1)"))


def test_usage_vectors(spark):
    cases = {
        "t1": (["1.0", "0.2", "0.3"], 0.5, "Active"),
        "t2": (["-0.8", "-0.3", "-0.5"], -0.533, "Unused"),
        "t3": (["0.2", "-0.5"], -0.15, "Low"),
        "t4": (["0.2", "-0.4", "-0.5"], -0.233, "Low"),
        "t5": (["-0.5", "-0.4"], -0.45, "Unused"),
        "t6": (["0.3"], 0.3, "Active"),
        "t7": (["-0.3"], -0.3, "Low"),
        "t8": (["0.1", "0.0", "0.0", "0.0", "0.0", "0.0", "0.0", "0.0"], 0.012, "Low"),
    }
    data = [(k, "Table", w, f"e{i}", "s") for k, (ws, _, _) in cases.items() for i, w in enumerate(ws)]
    got = {r.object_name: (r.score, r.usage_level) for r in U.usage_scores([_sig(spark, data)]).collect()}
    assert got == {k: (s, lvl) for k, (_, s, lvl) in cases.items()}


def test_naming_signal_first_prefix(spark):
    objs = spark.createDataFrame([("dbo.tmp_x", "Table", "tmp_x"), ("dbo.Orders_Archive", "Table", "Orders_Archive"),
                                  ("dbo.Orders", "Table", "Orders")], "object_name string, object_type string, "
                                                                      "simple_name string")
    got = rows(U.naming_signal(objs), "object_name", "evidence")
    assert got == [("dbo.Orders_Archive", "name contains 'archive'"), ("dbo.tmp_x", "name starts with 'tmp'")]


def test_execution_log_and_orphan_signals(spark):
    procs = spark.createDataFrame([("dbo", "usp_a", 3, None), ("dbo", "usp_b", 0, None)],
                                  "schema_name string, name string, execution_count long, last_execution timestamp")
    got = rows(U.execution_signal(procs, "Procedure", 45), "object_name", "weight")
    assert [(n, str(w)) for n, w in got] == [("dbo.usp_a", "1.0"), ("dbo.usp_b", "-0.8")]
    assert U.execution_signal(procs, "Procedure", 10).count() == 1  # no negative evidence before 30 days
    mentions = spark.createDataFrame([("dbo", "Orders", 12), ("dbo", "Lines", 0)],
                                     "schema_name string, table_name string, executions long")
    assert rows(U.log_text_signal(mentions), "object_name") == [("dbo.Orders",)]
    objs = spark.createDataFrame([("dbo.v1", "View"), ("dbo.v2", "View"), ("dbo.p1", "Procedure"),
                                  ("dbo.T", "Table"), ("dbo.U", "Table")], "object_name string, object_type string")
    fk = spark.createDataFrame([("dbo.U", "dbo.T")], "src string, dst string")
    dep = spark.createDataFrame([("dbo.v2", "dbo.v1"), ("dbo.v1", "dbo.T")], "src string, dst string")
    got = {r.object_name: str(r.weight) for r in U.orphan_signal(objs, fk, dep).collect()}
    # T: FK target + dependency target = 2 kinds -> +0.3; U: FK source only -> no row
    assert got == {"dbo.v1": "0.3", "dbo.v2": "-0.5", "dbo.p1": "-0.5", "dbo.T": "0.3"}


def test_wide_profile_in_one_statement(spark):
    """Many tables (one statement of many branches) give the rows that each table gives alone."""
    from lakescope.sources.tables import read_tables
    tabs = read_tables(spark, SF_SMALL, ["lineitem", "orders", "customer"])
    one = rows(P.profile_tables_sql(tabs))
    alone = sorted(r for name, df in tabs.items() for r in rows(P.profile_tables_sql({name: df})))
    assert sorted(one) == alone and len(one) == 22


def test_long_and_short_texts_are_counted_exactly(spark):
    """Texts around the width from which digests stand for values; digests and values that look like them; null, empty and non-ASCII text."""
    import hashlib
    w = P.KEY_BYTES
    values = ["", None, "a", "a", "é" * (w // 2), "é" * (w // 2) + "x", "b" * w, "b" * (w + 1), "b" * (w + 1), "c" * 5000, "c" * 5000, "c" * 4999 + "d"]
    values += [hashlib.sha256(b"b" * (w + 1)).hexdigest(), "=a", "#a"]
    df = spark.createDataFrame([(v,) for v in values], "x string").repartition(3)
    r = P.profile_tables_sql({"t": df}, wide=("x",)).first()
    known = [v for v in values if v is not None]
    assert (r.total_count, r.null_count, r.distinct_count) == (len(values), 1, len(set(known)))
    assert (r.min_value, r.max_value) == (min(known, key=str.encode), max(known, key=str.encode))
    empty = P.profile_tables_sql({"t": df.limit(0)}, wide=("x",)).first()
    assert (empty.total_count, empty.distinct_count, empty.min_value) == (0, 0, None)
