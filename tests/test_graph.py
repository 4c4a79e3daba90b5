"""Graph vectors (small, hand-made) and random graphs against a brute-force answer."""

import random

from pyspark.sql import functions as F

from lakescope.operators import graph as G
from tests.conftest import rows


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def _impact(spark, pairs):
    out = {}
    for r in G.reachable(_edges(spark, pairs)).collect():
        out.setdefault(r.node, set()).add(r.affected)
    return out


def test_chain(spark):
    imp = _impact(spark, [("a", "b"), ("b", "c")])
    assert imp["c"] == {"a", "b"} and imp["b"] == {"a"}
    scc = G.strongly_connected(_edges(spark, [("a", "b"), ("b", "c")]))
    assert G.cycles(scc).count() == 0
    lin = rows(G.lineage(_edges(spark, [("a", "b"), ("b", "c")]), "a"), "node", "direction", "layer")
    assert lin == [("a", "start", 0), ("b", "upstream", -1), ("c", "upstream", -2)]


def test_two_cycle(spark):
    e = [("a", "b"), ("b", "a")]
    assert _impact(spark, e)["a"] == {"a", "b"}
    scc = rows(G.strongly_connected(_edges(spark, e)), "node", "scc_id", "scc_size")
    assert scc == [("a", "a", 2), ("b", "a", 2)]


def test_self_edge(spark):
    e = [("a", "a")]
    assert _impact(spark, e)["a"] == {"a"}
    assert G.cycles(G.strongly_connected(_edges(spark, e))).count() == 0


def test_components(spark):
    cc = rows(G.connected_components(_edges(spark, [("a", "b"), ("c", "d")])), "node", "component_id",
              "component_size")
    assert cc == [("a", "a", 2), ("b", "a", 2), ("c", "c", 2), ("d", "c", 2)]


def test_cycle_with_tail(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]
    imp = _impact(spark, e)
    assert "d" not in imp
    assert imp["a"] == {"a", "b", "c", "d"}
    scc = {r.node: r.scc_id for r in G.cycles(G.strongly_connected(_edges(spark, e))).collect()}
    assert scc == {"a": "a", "b": "a", "c": "a"}
    ce = rows(G.cycle_edges(_edges(spark, e), G.strongly_connected(_edges(spark, e))), "src", "dst")
    assert ce == [("a", "b"), ("b", "c"), ("c", "a")]


def _closure(pairs):
    succ = {}
    for s, d in pairs:
        succ.setdefault(s, set()).add(d)
    reach = {}
    for n in {x for p in pairs for x in p}:
        seen, stack = set(), [n]
        while stack:
            for m in succ.get(stack.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    stack.append(m)
        reach[n] = seen
    return reach


def test_random_graphs_against_brute_force(spark):
    rnd = random.Random(11)
    for trial in range(3):
        nodes = [f"n{i:02d}" for i in range(14)]
        pairs = list({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(20)})
        reach = _closure(pairs)
        # impact(x) = nodes that reach x
        exp_imp = {}
        for a, rs in reach.items():
            for b in rs:
                exp_imp.setdefault(b, set()).add(a)
        assert _impact(spark, pairs) == exp_imp
        exp_scc = {}
        for a in reach:
            members = {a} | {b for b in reach[a] if a in reach.get(b, set())}
            exp_scc[a] = (min(members), len(members))
        got = {r.node: (r.scc_id, r.scc_size) for r in G.strongly_connected(_edges(spark, pairs)).collect()}
        assert got == exp_scc
        und = pairs + [(d, s) for s, d in pairs]
        ur = _closure(und)
        exp_cc = {a: min({a} | ur[a]) for a in ur}
        got_cc = {r.node: r.component_id for r in G.connected_components(_edges(spark, pairs)).collect()}
        assert got_cc == exp_cc


def test_lineage_layers_and_shared_visited(spark):
    e = _edges(spark, [("v", "t"), ("p", "v"), ("t", "x"), ("x", "v")])
    both = rows(G.lineage(e, "v"), "node", "direction", "layer")
    assert ("t", "upstream", -1) in both and ("p", "downstream", 1) in both and ("x", "downstream", 1) in both
    shared = rows(G.lineage(e, "v", shared_visited=True), "node", "direction", "layer")
    assert ("x", "downstream", 1) not in shared  # x is already upstream
    sub = rows(G.induced_edges(e, spark.createDataFrame([("v",), ("t",)], "node string")), "src", "dst")
    assert sub == [("v", "t")]


def test_approx_impact_matches_exact_on_small_graphs(spark):
    rnd = random.Random(3)
    nodes = [f"n{i:02d}" for i in range(30)]
    pairs = list({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(45)})
    exact = {k: len(v) for k, v in _impact(spark, pairs).items()}
    approx = {r.node: r.approx_impact for r in G.approx_impact(_edges(spark, pairs)).collect()}
    assert set(approx) == set(exact)
    for k, v in exact.items():
        assert abs(approx[k] - v) <= max(1, 0.05 * v)


def test_core_objects_without_a_limit(spark, capsys):
    scores = spark.range(500).selectExpr("concat('n', lpad(id, 4, '0')) AS node", "id % 7 AS importance").repartition(4)
    out = G.core_objects(scores)
    assert out.columns == ["node", "importance", "rank"]
    out.explain()
    assert "row_number" not in capsys.readouterr().out  # no window over all nodes
    want = sorted(((f"n{i:04}", i % 7) for i in range(500)), key=lambda x: (-x[1], x[0]))
    assert [tuple(r) for r in out.orderBy("rank").collect()] == [(*x, k + 1) for k, x in enumerate(want)]
    assert [tuple(r) for r in G.core_objects(scores, 5).orderBy("rank").collect()] == [(*x, k + 1) for k, x in enumerate(want[:5])]


def _random_graph(rng, n, m):
    return list({(f"n{rng.randrange(n):03d}", f"n{rng.randrange(n):03d}") for _ in range(m)})


def _brute_sizes(pairs):
    out = {}
    for node in {d for _, d in pairs}:
        seen, todo = set(), [node]
        while todo:
            x = todo.pop()
            for s, d in pairs:
                if d == x and s not in seen:
                    seen.add(s)
                    todo.append(s)
        out[node] = (len(seen), len(seen) - len({s for s, d in pairs if d == node}))
    return out


def test_impact_sizes_of_random_graphs(spark):
    """Acyclic and cyclic graphs, self edges, repeated edges; also with few numbers at a time."""
    rng = random.Random(5)
    dag = [(max(p), min(p)) for p in _random_graph(rng, 150, 260) if p[0] != p[1]]
    for pairs, block in ((dag, 64), (_random_graph(rng, 90, 120), None)):
        got = {r.node: (r.impact, r.indirect_impact) for r in G.impact_sizes(_edges(spark, pairs + pairs[:3]), block).collect()}
        assert got == _brute_sizes(pairs)


def test_impact_sizes_count_hubs_and_nothing(spark):
    assert G.impact_sizes(_edges(spark, []).limit(0)).count() == 0
    pairs = [(f"leaf{i}", f"mid{i % 7}") for i in range(3000)] + [(f"mid{i}", "top") for i in range(7)]
    got = {r.node: r.impact for r in G.impact_sizes(_edges(spark, pairs)).collect()}
    assert got["top"] == 3007 and got["mid0"] == 429


def _brute_scc(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            x = todo.pop()
            for s, d in pairs:
                if s == x and d not in seen:
                    seen.add(d)
                    todo.append(d)
        reach[n] = seen
    out = []
    for n in nodes:
        comp = {m for m in reach[n] if n in reach[m]}
        out.append((n, min(comp), len(comp)))
    return sorted(out)


def test_cycles_of_random_graphs(spark):
    rng = random.Random(8)
    ring = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    chain = [("n001", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "n001"), ("n002", "d1"), ("d1", "d2")]
    pairs = _random_graph(rng, 40, 60) + ring + chain + [("s", "s")]
    assert rows(G.strongly_connected(_edges(spark, pairs)), "node", "scc_id", "scc_size") == _brute_scc(pairs)


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    """A ring and a path of 10,000 nodes each: rounds grow with the logarithm of the length."""
    n, written = 10_000, []
    plain = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: written.append(1) or plain(df))
    node = lambda c: F.format_string("n%05d", c)
    ids = spark.range(n)
    ring = ids.select(node(F.col("id")).alias("src"), node((F.col("id") + 1) % n).alias("dst"))
    path = ids.select(F.concat(F.lit("p"), node(F.col("id"))).alias("src"), F.concat(F.lit("p"), node(F.col("id") + 1)).alias("dst"))
    scc = G.strongly_connected(ring.unionByName(path))
    got = scc.groupBy("scc_size").agg(F.count(F.lit(1)).alias("n"), F.min("scc_id").alias("least")).collect()
    assert {(r.scc_size, r.n) for r in got} == {(n, n), (1, n + 1)} and {r.least for r in got if r.scc_size == n} == {"n00000"}
    assert len(written) < 40
