"""Graph bindings on the test snapshot.

* record graph: every order, customer, supplier, part, nation and region is a node; a row depends on
  the rows its keys point at (order -> customer, order -> part and supplier through its lines,
  customer/supplier -> nation, nation -> region). A DAG with depth, over whole tables.
* trade graph: nation of the buyer depends on nation of the supplier, over all lines (cyclic).
* membership graph: customers and suppliers linked to their nation, undirected (components).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescope.operators import graph as G
from lakescope.session import cut_lineage
from lakescope.sources.tables import read_table

START_NODE = "n:0"


def _k(prefix, c):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def record_edges(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    li = read_table(spark, sf_dir, "lineitem")
    parts = [
        o.select(_k("o:", "o_orderkey").alias("src"), _k("c:", "o_custkey").alias("dst"), F.lit("order_customer").alias("kind")),
        c.select(_k("c:", "c_custkey"), _k("n:", "c_nationkey"), F.lit("customer_nation")),
        s.select(_k("s:", "s_suppkey"), _k("n:", "s_nationkey"), F.lit("supplier_nation")),
        n.select(_k("n:", "n_nationkey"), _k("r:", "n_regionkey"), F.lit("nation_region")),
        li.select(_k("o:", "l_orderkey"), _k("p:", "l_partkey"), F.lit("order_part")),
        li.select(_k("o:", "l_orderkey"), _k("s:", "l_suppkey"), F.lit("order_supplier")),
    ]
    e = parts[0]
    for p in parts[1:]:
        e = e.union(p.toDF("src", "dst", "kind"))
    return e.distinct()


RECORD_NODES = [("orders", "o:", "o_orderkey"), ("customer", "c:", "c_custkey"), ("supplier", "s:", "s_suppkey"),
                ("part", "p:", "p_partkey"), ("nation", "n:", "n_nationkey"), ("region", "r:", "r_regionkey")]


def record_nodes(spark, sf_dir):
    out = None
    for t, p, k in RECORD_NODES:
        df = read_table(spark, sf_dir, t).select(_k(p, k).alias("node"))
        out = df if out is None else out.unionByName(df)
    return out


#: Prefixes of the record graph's names; a prefix's place is the last three bits of a node's number.
PREFIXES = ("c:", "n:", "o:", "p:", "r:", "s:")


def _number(prefix, c):
    """A record node as one number, for graph loops that move every edge: its key, then three bits for the prefix."""
    key = F.col(c).cast("long")
    wide = F.raise_error(F.concat(F.lit(f"key too large for the record graph: {c} "), key.cast("string"))).cast("long")
    return F.when((key >= 1 << 60) | (key < -(1 << 60)), wide).otherwise(key * 8 + PREFIXES.index(prefix))


def _name(number):
    """The name that ``_k`` gives a node, from its number."""
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (number.bitwiseAND(F.lit(7)) + 1).cast("int"))
    return F.concat(prefix, F.shiftright(number, 3).cast("string"))


def numbered_record_edges(spark, sf_dir):
    """The pairs of ``record_edges`` as numbers, those of one source together (a source has few)."""
    spec = [("orders", "o:", "o_orderkey", {"c:": "o_custkey"}), ("customer", "c:", "c_custkey", {"n:": "c_nationkey"}),
            ("supplier", "s:", "s_suppkey", {"n:": "s_nationkey"}), ("nation", "n:", "n_nationkey", {"r:": "n_regionkey"}),
            ("lineitem", "o:", "l_orderkey", {"p:": "l_partkey", "s:": "l_suppkey"})]
    # a row's edges move as one
    parts = [read_table(spark, sf_dir, t).select(_number(a, x).alias("src"), F.array(*(_number(b, y) for b, y in to.items())).alias("to"))
             for t, a, x, to in spec]
    return reduce(DataFrame.unionByName, parts).repartition("src").select("src", F.explode("to").alias("dst")).distinct()


def numbered_record_nodes(spark, sf_dir):
    parts = [read_table(spark, sf_dir, t).select(_number(p, k).alias("node")) for t, p, k in RECORD_NODES]
    return reduce(DataFrame.unionByName, parts)


def trade_edges(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # pre-aggregate to distinct (order, supplier nation) before the wider joins
    j = li.join(s, li.l_suppkey == s.s_suppkey).select("l_orderkey", "s_nationkey").distinct()
    j = j.join(o, j.l_orderkey == o.o_orderkey).select("o_custkey", "s_nationkey").distinct()
    j = j.join(c, j.o_custkey == c.c_custkey).select("c_nationkey", "s_nationkey").distinct()
    j = j.join(n.withColumnRenamed("n_name", "src"), j.c_nationkey == n.n_nationkey).drop("n_nationkey")
    j = j.join(n.withColumnRenamed("n_name", "dst"), j.s_nationkey == n.n_nationkey)
    return j.select("src", "dst", F.lit("trade").alias("kind")).distinct()


def membership_edges(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(_k("c:", "c_custkey").alias("src"), _k("n:", "c_nationkey").alias("dst"))
    s = read_table(spark, sf_dir, "supplier").select(_k("s:", "s_suppkey").alias("src"), _k("n:", "s_nationkey").alias("dst"))
    return c.unionByName(s)


def record_impact(spark, sf_dir):
    """D-4 / D-5 / U3: exact impact size and importance of every record node."""
    scores = G.importance(numbered_record_edges(spark, sf_dir), nodes=numbered_record_nodes(spark, sf_dir))
    return scores.withColumn("node", _name(F.col("node")))


def record_impact_approx(spark, sf_dir):
    """D-4 at scale: approximate impact size of every record node (HLL sketches, no closure table)."""
    return G.approx_impact(numbered_record_edges(spark, sf_dir), named=_name).withColumn("node", _name(F.col("node")))


def core_records(spark, sf_dir):
    """D-6 / O6 / W1: the ten most important record nodes with their rank."""
    return G.core_objects(record_impact(spark, sf_dir), 10)


def lineage_layers(spark, sf_dir):
    """L-1: upstream and downstream layers around nation 0 in the record graph."""
    return G.lineage(record_edges(spark, sf_dir), START_NODE)


def trade_lineage_report(spark, sf_dir):
    """L-2: lineage of every nation in the region trade graph, nodes placed upstream not placed again downstream."""
    e = cut_lineage(region_trade_edges(spark, sf_dir))
    return G.lineage(e, G.node_table(e), shared_visited=True)


def impact_approx_error(spark, sf_dir):
    """D-4 at scale: each node's approximate impact size is within five per cent of the exact one (three standard errors), or one off."""
    e = numbered_record_edges(spark, sf_dir)
    both = G.impact_sizes(e).join(G.approx_impact(e, named=_name), "node")
    off = F.abs(F.col("impact") - F.col("approx_impact"))
    return both.select(_name(F.col("node")).alias("node"), "impact", ((off <= 1) | (off <= F.col("impact") * 0.05)).alias("within"))


def lineage_subgraph(spark, sf_dir):
    """L-3: edges among the nodes of the lineage of nation 0."""
    e = cut_lineage(record_edges(spark, sf_dir))
    return G.induced_edges(e, G.lineage(e, START_NODE).select("node"))


def trade_impact(spark, sf_dir):
    """D-4 / D-5 on a cyclic graph: nodes on a cycle are in their own impact."""
    e = cut_lineage(trade_edges(spark, sf_dir))
    return G.importance(e)


def trade_cycles(spark, sf_dir):
    """K-1: strongly connected components of the trade graph."""
    return G.strongly_connected(trade_edges(spark, sf_dir))


def region_trade_edges(spark, sf_dir):
    """Trade between nations of one region, and from each region's nations to those of the next region in key order."""
    n = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    e = trade_edges(spark, sf_dir).select("src", "dst")
    e = e.join(n.toDF("src", "a"), "src").join(n.toDF("dst", "b"), "dst")
    return e.filter("b = a or b = a + 1").select("src", "dst")


def region_trade_cycles(spark, sf_dir):
    """K-1: strongly connected components of the trade inside regions and up to the next region (one for each region)."""
    return G.strongly_connected(region_trade_edges(spark, sf_dir))


def region_trade_impact(spark, sf_dir):
    """D-4 / D-5 on a graph of several cycles, one above the other."""
    return G.importance(cut_lineage(region_trade_edges(spark, sf_dir)))


def record_cycles(spark, sf_dir):
    """K-1 on the record graph: every node with its strongly connected component (acyclic: all singletons)."""
    # the graph has no cycle between tables, so that no component's least name is chosen by number
    scc = G.strongly_connected(numbered_record_edges(spark, sf_dir), numbered_record_nodes(spark, sf_dir))
    return scc.select(_name(F.col("node")).alias("node"), _name(F.col("scc_id")).alias("scc_id"), "scc_size")


def trade_cycle_edges(spark, sf_dir):
    """K-2: trade edges inside a cycle."""
    e = cut_lineage(trade_edges(spark, sf_dir))
    return G.cycle_edges(e, G.strongly_connected(e)).select("src", "dst", "scc_id")


def membership_components(spark, sf_dir):
    """K-3: connected components of customers and suppliers joined through their nation."""
    return G.connected_components(membership_edges(spark, sf_dir))


def record_subgraph(spark, sf_dir):
    """Customers, nations and regions of the record graph, with the edges among them."""
    from lakescope.operators import diagram as V
    e = cut_lineage(record_edges(spark, sf_dir))
    nodes = G.node_table(e, record_nodes(spark, sf_dir)).select(
        "node", F.split(F.col("node"), ":")[0].alias("node_type"), F.lit("testdata").alias("database_name"))
    _, sub = V.filter_graph(nodes, e.withColumnRenamed("kind", "edge_type"), node_types=["c", "n", "r"])
    return sub


def graph_counts(spark, sf_dir):
    """V-3 / G10: record-graph nodes by type and edges by kind."""
    e = record_edges(spark, sf_dir)
    nodes = G.node_table(e, record_nodes(spark, sf_dir)).select(
        F.lit("node").alias("what"), F.split(F.col("node"), ":")[0].alias("kind"))
    edges = e.select(F.lit("edge").alias("what"), "kind")
    return nodes.unionByName(edges).groupBy("what", "kind").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- oracle SQL

RECORD_EDGES_SQL = """
  edges AS (
    SELECT DISTINCT src, dst, kind FROM (
      SELECT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst, 'order_customer' AS kind FROM orders
      UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'customer_nation' FROM customer
      UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'supplier_nation' FROM supplier
      UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'nation_region' FROM nation
      UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'order_part' FROM lineitem
      UNION ALL SELECT 'o:' || l_orderkey, 's:' || l_suppkey, 'order_supplier' FROM lineitem)),
  e AS (SELECT DISTINCT src, dst FROM edges),
  nodes AS (
    SELECT 'o:' || o_orderkey AS node FROM orders UNION SELECT 'c:' || c_custkey FROM customer
    UNION SELECT 's:' || s_suppkey FROM supplier UNION SELECT 'p:' || p_partkey FROM part
    UNION SELECT 'n:' || n_nationkey FROM nation UNION SELECT 'r:' || r_regionkey FROM region
    UNION SELECT src FROM e UNION SELECT dst FROM e)"""

TRADE_EDGES_SQL = """
  edges AS (
    SELECT DISTINCT cn.n_name AS src, sn.n_name AS dst, 'trade' AS kind
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation cn ON cn.n_nationkey = c.c_nationkey
    JOIN nation sn ON sn.n_nationkey = s.s_nationkey),
  e AS (SELECT DISTINCT src, dst FROM edges),
  nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""


def _importance_sql(edges_sql, closure_sql):
    return f"""WITH RECURSIVE {edges_sql},
  {closure_sql},
  cl AS (SELECT node, affected, min(depth) AS depth FROM closure GROUP BY node, affected),
  rb AS (SELECT dst AS node, count(*) AS referenced_by FROM e GROUP BY dst),
  dn AS (SELECT src AS node, count(*) AS depends_on FROM e GROUP BY src),
  im AS (SELECT node, count(*) AS impact, count(*) FILTER (WHERE depth > 1) AS indirect_impact FROM cl GROUP BY node),
  scores AS (
    SELECT n.node, coalesce(referenced_by, 0) AS referenced_by, coalesce(depends_on, 0) AS depends_on,
           coalesce(impact, 0) AS impact, coalesce(indirect_impact, 0) AS indirect_impact,
           3 * coalesce(referenced_by, 0) + coalesce(depends_on, 0) + coalesce(impact, 0) AS importance,
           coalesce(referenced_by, 0) + coalesce(depends_on, 0) = 0 AS is_standalone
    FROM nodes n LEFT JOIN rb USING (node) LEFT JOIN dn USING (node) LEFT JOIN im USING (node))"""


DAG_CLOSURE = """closure(node, affected, depth) AS (
    SELECT dst, src, 1 FROM e
    UNION SELECT c.node, e.src, c.depth + 1 FROM closure c JOIN e ON e.dst = c.affected)"""

CYCLIC_CLOSURE = """closure(node, affected, depth) AS (
    SELECT dst, src, 1 FROM e
    UNION SELECT c.node, e.src, c.depth + 1 FROM closure c JOIN e ON e.dst = c.affected
    WHERE c.depth < (SELECT count(*) FROM nodes))"""

RECORD_IMPACT_SQL = _importance_sql(RECORD_EDGES_SQL, DAG_CLOSURE) + "\nSELECT * FROM scores"
CORE_RECORDS_SQL = _importance_sql(RECORD_EDGES_SQL, DAG_CLOSURE) + """
SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, node) AS INTEGER) AS rank
FROM (SELECT * FROM scores ORDER BY importance DESC, node LIMIT 10)"""
TRADE_IMPACT_SQL = _importance_sql(TRADE_EDGES_SQL, CYCLIC_CLOSURE) + "\nSELECT * FROM scores"

LINEAGE_SQL = f"""WITH RECURSIVE {RECORD_EDGES_SQL},
  up(node, depth) AS (SELECT '{START_NODE}', 0 UNION SELECT e.dst, u.depth + 1 FROM up u JOIN e ON e.src = u.node),
  down(node, depth) AS (SELECT '{START_NODE}', 0 UNION SELECT e.src, d.depth + 1 FROM down d JOIN e ON e.dst = d.node),
  u AS (SELECT node, min(depth) AS depth FROM up GROUP BY node),
  d AS (SELECT node, min(depth) AS depth FROM down GROUP BY node),
  layers AS (
    SELECT '{START_NODE}' AS start, '{START_NODE}' AS node, 'start' AS direction, 0 AS layer
    UNION ALL SELECT '{START_NODE}', node, 'upstream', -depth FROM u WHERE node <> '{START_NODE}'
    UNION ALL SELECT '{START_NODE}', node, 'downstream', depth FROM d WHERE node <> '{START_NODE}')"""

LINEAGE_LAYERS_SQL = LINEAGE_SQL + "\nSELECT start, node, direction, CAST(layer AS INTEGER) AS layer FROM layers"
LINEAGE_SUBGRAPH_SQL = LINEAGE_SQL + """
SELECT ed.dst, ed.src, ed.kind FROM edges ed
WHERE ed.src IN (SELECT node FROM layers) AND ed.dst IN (SELECT node FROM layers)"""

SCC_SQL = f"""WITH RECURSIVE {TRADE_EDGES_SQL},
  reach(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b),
  mutual AS (SELECT r1.a AS node, r1.b AS other FROM reach r1 JOIN reach r2 ON r1.a = r2.b AND r1.b = r2.a),
  ids AS (SELECT n.node, least(n.node, coalesce(min(m.other), n.node)) AS scc_id
          FROM nodes n LEFT JOIN mutual m ON m.node = n.node GROUP BY n.node),
  scc AS (SELECT node, scc_id, count(*) OVER (PARTITION BY scc_id) AS scc_size FROM ids)"""

TRADE_CYCLES_SQL = SCC_SQL + "\nSELECT node, scc_id, scc_size FROM scc"
TRADE_CYCLE_EDGES_SQL = SCC_SQL + """
SELECT e.src, e.dst, a.scc_id FROM e JOIN scc a ON a.node = e.src JOIN scc b ON b.node = e.dst
WHERE a.scc_id = b.scc_id AND a.scc_size > 1"""

REGION_TRADE_EDGES_SQL = TRADE_EDGES_SQL.replace("  e AS (SELECT DISTINCT src, dst FROM edges)", """  e AS (
    SELECT DISTINCT src, dst FROM edges JOIN nation a ON a.n_name = src JOIN nation b ON b.n_name = dst
    WHERE b.n_regionkey IN (a.n_regionkey, a.n_regionkey + 1))""")
TRADE_LINEAGE_SQL = f"""WITH RECURSIVE {REGION_TRADE_EDGES_SQL},
  up(start, node, depth) AS (SELECT node, node, 0 FROM nodes
    UNION SELECT u.start, e.dst, u.depth + 1 FROM up u JOIN e ON e.src = u.node WHERE u.depth < 25),
  down(start, node, depth) AS (SELECT node, node, 0 FROM nodes
    UNION SELECT d.start, e.src, d.depth + 1 FROM down d JOIN e ON e.dst = d.node WHERE d.depth < 25),
  u AS (SELECT start, node, min(depth) AS depth FROM up WHERE node <> start GROUP BY ALL),
  d AS (SELECT start, node, min(depth) AS depth FROM down WHERE node <> start GROUP BY ALL)
SELECT node AS start, node, 'start' AS direction, CAST(0 AS INTEGER) AS layer FROM nodes
UNION ALL SELECT start, node, 'upstream', CAST(-depth AS INTEGER) FROM u
UNION ALL SELECT d.start, d.node, 'downstream', CAST(d.depth AS INTEGER) FROM d ANTI JOIN u ON u.start = d.start AND u.node = d.node"""

IMPACT_WITHIN_SQL = _importance_sql(RECORD_EDGES_SQL, DAG_CLOSURE) + "\nSELECT node, impact, true AS within FROM scores WHERE impact > 0"

REGION_TRADE_CYCLES_SQL = SCC_SQL.replace(TRADE_EDGES_SQL, REGION_TRADE_EDGES_SQL) + "\nSELECT node, scc_id, scc_size FROM scc"
REGION_TRADE_IMPACT_SQL = _importance_sql(REGION_TRADE_EDGES_SQL, CYCLIC_CLOSURE) + "\nSELECT * FROM scores"

COMPONENTS_SQL = """WITH RECURSIVE
  e AS (SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst FROM customer
        UNION SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier),
  u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
  nodes AS (SELECT a AS node FROM u),
  reach(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON u.a = r.b),
  ids AS (SELECT n.node, least(n.node, coalesce(min(r.b), n.node)) AS component_id
          FROM nodes n LEFT JOIN reach r ON r.a = n.node GROUP BY n.node)
SELECT node, component_id, count(*) OVER (PARTITION BY component_id) AS component_size FROM ids"""

GRAPH_COUNTS_SQL = f"""WITH {RECORD_EDGES_SQL}
SELECT 'node' AS what, split_part(node, ':', 1) AS kind, count(*) AS n FROM nodes GROUP BY 2
UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY 2"""

RECORD_SUBGRAPH_SQL = f"""WITH {RECORD_EDGES_SQL}
SELECT dst, src, kind AS edge_type FROM edges
WHERE split_part(src, ':', 1) IN ('c', 'n', 'r') AND split_part(dst, ':', 1) IN ('c', 'n', 'r')"""

RECORD_SCC_SQL = f"""WITH RECURSIVE {RECORD_EDGES_SQL},
  reach(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b),
  mutual AS (SELECT r1.a AS node, r1.b AS other FROM reach r1 JOIN reach r2 ON r1.a = r2.b AND r1.b = r2.a),
  ids AS (SELECT n.node, least(n.node, coalesce(min(m.other), n.node)) AS scc_id
          FROM nodes n LEFT JOIN mutual m ON m.node = n.node GROUP BY n.node)
SELECT node, scc_id, count(*) OVER (PARTITION BY scc_id) AS scc_size FROM ids"""

QUERIES = {
    "record_cycles": record_cycles,
    "record_subgraph": record_subgraph,
    "record_impact": record_impact,
    "record_impact_approx": record_impact_approx,
    "core_records": core_records,
    "lineage_layers": lineage_layers,
    "lineage_subgraph": lineage_subgraph,
    "trade_lineage_report": trade_lineage_report,
    "impact_approx_error": impact_approx_error,
    "trade_impact": trade_impact,
    "trade_cycles": trade_cycles,
    "region_trade_cycles": region_trade_cycles,
    "region_trade_impact": region_trade_impact,
    "trade_cycle_edges": trade_cycle_edges,
    "membership_components": membership_components,
    "graph_counts": graph_counts,
}

ORACLE = {
    "record_cycles": RECORD_SCC_SQL,
    "record_subgraph": RECORD_SUBGRAPH_SQL,
    "record_impact": RECORD_IMPACT_SQL,
    "core_records": CORE_RECORDS_SQL,
    "lineage_layers": LINEAGE_LAYERS_SQL,
    "lineage_subgraph": LINEAGE_SUBGRAPH_SQL,
    "trade_lineage_report": TRADE_LINEAGE_SQL,
    "impact_approx_error": IMPACT_WITHIN_SQL,
    "trade_impact": TRADE_IMPACT_SQL,
    "trade_cycles": TRADE_CYCLES_SQL,
    "region_trade_cycles": REGION_TRADE_CYCLES_SQL,
    "region_trade_impact": REGION_TRADE_IMPACT_SQL,
    "trade_cycle_edges": TRADE_CYCLE_EDGES_SQL,
    "membership_components": COMPONENTS_SQL,
    "graph_counts": GRAPH_COUNTS_SQL,
}
