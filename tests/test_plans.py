"""Physical-plan properties: column pruning in profiling, one scan per table in orphan checks."""

import re

from lakescope.operators import profile as P
from lakescope.sources.tables import read_table
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_branches_read_one_column_each(spark):
    df = read_table(spark, SF_SMALL, "lineitem")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", _plan(P.profile_columns(df, "lineitem")))
    assert len(schemas) == len(df.columns)
    assert all("," not in s for s in schemas)


def test_profile_selected_columns_keep_schema_ordinals(spark):
    df = read_table(spark, SF_SMALL, "orders")
    got = {r.column_name: r.ordinal for r in P.profile_columns(df, "orders", columns=["o_custkey", "o_orderdate"]).collect()}
    assert got == {"o_custkey": 2, "o_orderdate": 5}


def test_orphan_check_scans_each_table_once(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["fk_orphans"](spark, SF_SMALL))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    lineitem_scans = [s for s in scans if "l_orderkey" in s or "l_partkey" in s or "l_suppkey" in s]
    assert len(lineitem_scans) == 1
    assert sorted(c.split("#")[0] for c in lineitem_scans[0].split(",")) == ["l_orderkey", "l_partkey", "l_suppkey"]
