"""The record graph by numbers: names, odd keys, and how often a graph loop writes its edges."""

import pytest
from pyspark.sql import functions as F

from lakescope.operators import graph as G
from lakescope.plans import graphs as P
from tests.conftest import rows


@pytest.fixture
def snapshot(spark, tmp_path):
    """Keys that repeat, are null, negative, large, or without a row of their own."""
    tables = {
        "orders": ("o_orderkey long, o_custkey long", [(1, 1), (1, 2), (2, None), (None, 1), (-3, 1), (1 << 59, 2)]),
        "customer": ("c_custkey long, c_nationkey long", [(1, 0), (1, 0), (2, 1), (None, 1)]),
        "supplier": ("s_suppkey long, s_nationkey long", [(1, 1), (2, None)]),
        "nation": ("n_nationkey long, n_regionkey long", [(0, 0), (1, 0)]),
        "region": ("r_regionkey long", [(0,), (1,)]),
        "part": ("p_partkey long", [(1,), (7,)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(1, 1, 1), (1, 1, 2), (1, 1, 1), (2, 9, 1), (None, 1, 1), (-3, None, 2)]),
    }
    for name, (ddl, data) in tables.items():
        spark.createDataFrame(data, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_numbers_stand_for_the_same_edges_and_nodes(spark, snapshot):
    e = P.numbered_record_edges(spark, snapshot).select(P._name(F.col("src")).alias("src"), P._name(F.col("dst")).alias("dst"))
    assert rows(e) == rows(P.record_edges(spark, snapshot), "src", "dst")
    assert rows(P.numbered_record_nodes(spark, snapshot).select(P._name(F.col("node")))) == rows(P.record_nodes(spark, snapshot))


def test_record_queries_give_what_the_named_graph_gives(spark, snapshot):
    e, nodes = G.cut_lineage(P.record_edges(spark, snapshot)), P.record_nodes(spark, snapshot)
    assert rows(P.record_impact(spark, snapshot)) == rows(G.importance(e, nodes=nodes))
    assert rows(P.record_cycles(spark, snapshot)) == rows(G.strongly_connected(e, nodes))
    assert rows(P.record_impact_approx(spark, snapshot)) == rows(G.approx_impact(e))


def test_a_key_too_large_for_a_number_is_an_error(spark):
    with pytest.raises(Exception, match="key too large"):
        spark.createDataFrame([(1 << 61,)], "k long").select(P._number("o:", "k")).collect()


LEAVES = 2000


@pytest.fixture
def written(monkeypatch):
    """The tables that a graph loop writes: columns and rows."""
    out, plain = [], G.cut_lineage

    def cut(df):
        got = plain(df)
        out.append((got.columns, got.count()))
        return got

    monkeypatch.setattr(G, "cut_lineage", cut)
    return out


def _layered(spark):
    ids = spark.range(LEAVES)
    low = ids.select(F.format_string("leaf%d", "id").alias("src"), F.format_string("mid%d", F.col("id") % 7).alias("dst"))
    low = low.unionByName(ids.select(F.format_string("leaf%d", "id").alias("src"), F.format_string("own%d", "id").alias("dst")))
    return low.unionByName(spark.range(7).select(F.format_string("mid%d", "id").alias("src"), F.lit("top").alias("dst")))


def test_importance_writes_all_edges_once(spark, written):
    got = {r.node: (r.referenced_by, r.impact) for r in G.importance(_layered(spark)).collect()}
    assert got["top"] == (7, LEAVES + 7) and got["own5"] == (1, 1) and got["leaf5"] == (0, 0)
    assert sum("dst" in c and n >= LEAVES for c, n in written) == 1


def test_sketches_that_do_not_change_are_written_once(spark, written):
    got = {r.node: r.approx_impact for r in G.approx_impact(_layered(spark)).collect()}
    assert got["own5"] == 1 and abs(got["top"] - LEAVES - 7) < 0.05 * LEAVES
    assert sum("sk" in c and n >= LEAVES for c, n in written) == 1


def test_cycle_search_writes_all_edges_once(spark, written):
    assert G.cycles(G.strongly_connected(_layered(spark))).count() == 0
    assert sum(n >= LEAVES for _, n in written) == 1
