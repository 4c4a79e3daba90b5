"""Dependency graph: impact closure, importance, lineage layers, cycles (SCC), components.

Edges are a DataFrame ``(src, dst)``: *src depends on dst* (a view reads a table, an FK child points
to its parent). Every algorithm is an iterative DataFrame loop: frontier ⋈ edges, ``left_anti``
against what is already known, and a table written to the shared checkpoint folder each round, so plans
stay short and a lost executor only recomputes one round. The only driver work is the per-round
emptiness test. Impact sizes of all nodes come from bit vectors over the dependents (``impact_sizes``),
not from a table of (node, dependent) pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescope.operators.components import star_components
from lakescope.session import cut_lineage, discard, ranked

#: Nodes whose dependents' bits are propagated at once.
BLOCK_NODES = 1 << 26


def node_table(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All nodes: the given node list plus every edge end."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("node"))
    return ends.distinct()


def _pairs(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst), written once. Sorted, as a source's edges then take less room here and in shuffles."""
    return cut_lineage(edges.select("src", "dst").distinct().sortWithinPartitions("src", "dst"))


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (frm, to) in the walking direction: 'dependents' walks dst -> src, 'dependencies' src -> dst.
    Duplicate edges are harmless: every BFS step is deduplicated."""
    e = edges.select("src", "dst")
    if direction == "dependents":
        return e.select(F.col("dst").alias("frm"), F.col("src").alias("to"))
    if direction == "dependencies":
        return e.select(F.col("src").alias("frm"), F.col("dst").alias("to"))
    raise ValueError(direction)


def bfs(edges: DataFrame, seeds: DataFrame, direction: str = "dependents", max_depth: int | None = None,
        include_seed_level: bool = False) -> DataFrame:
    """Multi-source BFS: (root, node) -> (root, node, depth) with the least depth per pair.

    ``seeds`` has (root, node). The root is not pre-marked as visited, so a root on a cycle (or with
    a self edge) reaches itself, as the impact rule requires. With ``include_seed_level`` the seeds
    themselves are returned at depth 0 and are never revisited (lineage rule). Each round's new pairs
    are written once to the shared folder and never rewritten; the visited set is their union.
    """
    return _bfs(cut_lineage(_directed(edges, direction)), seeds, max_depth, include_seed_level)


def _bfs(e: DataFrame, seeds: DataFrame, max_depth: int | None, include_seed_level: bool) -> DataFrame:
    """BFS over materialised (frm, to) edges."""
    frontier = cut_lineage(seeds.select("root", "node").distinct().withColumn("depth", F.lit(0)))
    parts = [frontier] if include_seed_level else []
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(e, frontier.node == e.frm).select("root", F.col("to").alias("node")).distinct()
        if parts:
            seen = reduce(DataFrame.unionByName, [p.select("root", "node") for p in parts])
            step = step.join(seen, ["root", "node"], "left_anti")
        step = cut_lineage(step.withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            break
        parts.append(step)
        frontier = step
    if not parts:
        return frontier.limit(0)
    return reduce(DataFrame.unionByName, parts)


def reachable(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """D-4: transitive impact — (node, affected, depth) for every node that depends on ``node``.

    ``seeds`` (column ``node``) restricts the roots; by default every node with a dependent is a root.
    """
    roots = seeds.select("node") if seeds is not None else edges.select(F.col("dst").alias("node"))
    s = roots.distinct().select(F.col("node").alias("root"), F.col("node"))
    out = bfs(edges, s, "dependents", max_depth)
    return out.select(F.col("root").alias("node"), F.col("node").alias("affected"), "depth")


def approx_impact(edges: DataFrame, lg_k: int = 12, max_rounds: int | None = None, named: Callable[[Column], Column] | None = None) -> DataFrame:
    """D-4 at scale: approximate impact size per node without materialising the closure.

    Every node keeps a HyperLogLog sketch of the nodes that depend on it; sketches flow backwards along
    the edges (a dependent's impact is part of its target's impact) and are unioned until no node's
    estimate changes (estimates only grow, so the loop ends; a path is never longer than the number of nodes
    whose dependents have dependents, which also bounds the rounds). All other nodes have their sketch from
    the start: it is sent on once and not written again. Memory per node is bounded by ``lg_k``; a cycle
    converges because union is idempotent. ``named`` gives what a sketch holds of a node (the node itself).
    Output: node, approx_impact.
    """
    e = _pairs(edges)
    of = named(F.col("src")) if named else F.col("src")
    sk = cut_lineage(e.groupBy(F.col("dst").alias("node")).agg(F.hll_sketch_agg(of, lg_k).alias("sk")).withColumn("est", F.hll_sketch_estimate("sk")))
    passing = cut_lineage(e.join(sk.select(F.col("node").alias("src")), "src", "left_semi"))  # edges whose source has dependents
    moving = cut_lineage(passing.select(F.col("dst").alias("node")).filter("node IS NOT NULL").distinct())
    now = cut_lineage(sk.join(moving, "node", "left_semi"))
    still = sk.join(moving, "node", "left_anti")
    senders, along = sk, passing
    for k in range(max_rounds if max_rounds is not None else moving.count() + 1):
        contrib = along.join(senders.select(F.col("node").alias("src"), "sk"), "src").select(F.col("dst").alias("node"), "sk").filter("node IS NOT NULL")
        new = now.select("node", "sk").unionByName(contrib).groupBy("node").agg(F.hll_union_agg("sk").alias("sk"))
        new = cut_lineage(new.withColumn("est", F.hll_sketch_estimate("sk")))
        changed = new.join(now.select("node", F.col("est").alias("old")), "node", "left").filter(
            F.col("old").isNull() | (F.col("est") != F.col("old")))
        if k == 0:  # from here on only sketches that move are sent
            along = cut_lineage(passing.join(moving.withColumnRenamed("node", "src"), "src", "left_semi"))
        now = senders = new
        if changed.isEmpty():
            break
    return still.unionByName(now).select("node", F.col("est").alias("approx_impact"))


def heights(edges: DataFrame, targets: DataFrame | None = None) -> tuple[list[DataFrame], bool]:
    """Layers of (src, dst): layer k holds the edges whose source has k steps or more of dependents behind it.

    ``edges`` is materialised, without self edges; ``targets`` are its distinct ``dst`` as ``node``, if known. A node's
    height is the last layer, counted from 1, that has it as ``dst``. The flag tells that a cycle keeps the last
    layer from shrinking.
    """
    layers, n = [edges], edges.count()
    while n:
        last = layers[-1]
        ends = last.select(F.col("dst").alias("src")).distinct() if targets is None else targets.select(F.col("node").alias("src"))
        up = cut_lineage(last.join(ends, "src", "left_semi").select("src", "dst"))
        m, targets = up.count(), None
        if m == n:
            return layers, True
        layers.append(up)
        n = m
    return layers, False


def condensed(edges: DataFrame, core: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between components (each named by its least node), and (node, comp, size) of the components with a cycle."""
    on = cut_lineage(cycles(strongly_connected(core)).select("node", F.col("scc_id").alias("comp"), F.col("scc_size").alias("size")))
    at = on.select("node", "comp")
    e = edges.join(at.toDF("src", "a"), "src", "left").join(at.toDF("dst", "b"), "dst", "left").select(
        F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    return cut_lineage(e.filter("src <> dst").distinct()), on


def _unite(bits: DataFrame) -> DataFrame:
    return cut_lineage(bits.groupBy("node", "block").agg(F.bit_or("word").alias("word")))


def impact_sizes(edges: DataFrame, block_nodes: int | None = None) -> DataFrame:
    """D-4: exact impact size of every node with a dependent, without (node, dependent) pairs:
    (node, impact, indirect_impact). A node on a cycle is in its own impact.

    Cycles are condensed first. Nodes are numbered so that dependents of one node lie together; a node's
    dependents are then 64-bit words, 64 of them in a row, united by ``bit_or`` from layer to layer, and
    counted. Nodes whose dependents have no dependents themselves need no bits: their dependents are counted.
    Words of a node are spread over rows, so hubs are partial sums like any other. ``block_nodes`` numbers
    are propagated at a time; a block's words are deleted when they are counted.
    """
    return _impact_sizes(_pairs(edges), block_nodes or BLOCK_NODES).drop("direct")


def _impact_sizes(e: DataFrame, block_nodes: int) -> DataFrame:
    """``impact_sizes`` of edges from ``_pairs``, and ``direct``, the number of direct dependents."""
    plain = e.filter("src <> dst")
    direct = cut_lineage(e.groupBy(F.col("dst").alias("node")).agg(
        F.count(F.lit(1)).alias("direct"), F.count_if(F.col("src") != F.col("dst")).alias("others"), F.count_if(F.col("src") == F.col("dst")).alias("self")))
    first = direct.filter("others > 0").select("node")
    layers, cyclic = heights(plain, first)
    dag, on = plain, None
    if cyclic:
        dag, on = condensed(plain, layers[-1])
        layers, _ = heights(dag)
    if on is None:
        beside = direct.filter("others > 0").select("node", F.col("others").alias("n"))
    else:
        sizes = on.select(F.col("comp").alias("src"), "size").distinct()
        beside = dag.join(sizes, "src", "left").groupBy(F.col("dst").alias("node")).agg(F.sum(F.coalesce("size", F.lit(1))).alias("n"))
    targets = [x.select(F.col("dst").alias("node")).distinct() for x in layers]  # of height k + 1 or more
    if len(layers) > 2:
        high = cut_lineage(targets[1])  # nodes whose dependents have dependents
        beside = beside.join(high, "node", "left_anti").unionByName(_counted_bits(dag, on, layers, targets, block_nodes))
    if on is None:
        out = direct.join(beside, "node", "left").withColumn("own", F.col("self"))
    else:
        out = direct.join(on, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(beside.withColumnRenamed("node", "comp"), "comp", "left")
        out = out.withColumn("own", F.coalesce("size", "self"))
    impact = F.coalesce("n", F.lit(0)) + F.col("own")
    return out.select("node", impact.cast("long").alias("impact"), (impact - F.col("direct")).cast("long").alias("indirect_impact"), "direct")


def _counted_bits(dag: DataFrame, on: DataFrame | None, layers: list[DataFrame], targets: list[DataFrame], block_nodes: int) -> DataFrame:
    """(node, n): how many nodes reach each node of height 2 or more."""
    senders = dag.groupBy(F.col("src").alias("comp")).agg(F.min("dst").alias("first"))
    if on is None:
        senders = senders.withColumn("node", F.col("comp"))
    else:
        senders = senders.join(on.select("comp", F.col("node").alias("member")), "comp", "left").withColumn("node", F.coalesce("member", "comp"))
    numbered = ranked(senders.select("comp", "node", "first"), [F.col("first"), F.col("comp"), F.col("node")], "rank")
    own = numbered.groupBy("comp", F.shiftright("rank", 6).alias("block")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(rank % 64 as int))")).alias("word"))
    own = cut_lineage(own.withColumnRenamed("comp", "src"))
    words = (own.agg(F.max("block")).first()[0] or 0) + 1
    step = max(1, block_nodes // 64)
    # the edges that end at each height; at height 1 only where the node itself has dependencies above it
    into = []
    for k in range(1, len(layers)):
        # sources of the second layer are targets of the first
        ends = layers[1].select(F.col("src").alias("node")).distinct() if k == 1 else targets[k - 1]
        if k < len(layers) - 1:
            ends = ends.join(targets[k], "node", "left_anti")
        ends = dag.join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
        into.append(ends if k == 1 and words <= step else cut_lineage(ends))  # read once: not written
    counts = []
    for low in range(0, words, step):
        mine = own if words <= step else own.filter((F.col("block") >= low) & (F.col("block") < low + step))
        held = []
        for k, e in enumerate(into, 1):
            bits = e.join(mine, "src").select(F.col("dst").alias("node"), "block", "word")
            if held:
                below = reduce(DataFrame.unionByName, held).withColumnRenamed("node", "src")
                bits = bits.unionByName(e.join(below, "src").select(F.col("dst").alias("node"), "block", "word"))
            held.append(_unite(bits))
        counts.append(cut_lineage(reduce(DataFrame.unionByName, held[1:]).groupBy("node").agg(F.sum(F.bit_count("word")).alias("n"))))
        discard(*held)
    return reduce(DataFrame.unionByName, counts).groupBy("node").agg(F.sum("n").alias("n"))


def importance(edges: DataFrame, impact: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """D-5: referenced_by, depends_on, impact size, importance = 3*referenced_by + depends_on + impact.

    ``impact`` is from ``impact_sizes`` (the default) or ``reachable``. Also the part of the impact that is
    indirect (U3): transitive minus direct dependents.
    """
    e = _pairs(edges)
    one = lambda n, into, out, impact, indirect: (
        F.col(n).alias("node"), F.lit(into).alias("into"), F.lit(out).alias("out"), F.lit(impact).alias("impact"), F.lit(indirect).alias("indirect"))
    # both ends of an edge, and the nodes given, counted in one grouping
    ends = e.select(*one("src", 0, 1, 0, 0))
    if impact is None:
        known = F.col("node").isNotNull()
        ends = ends.unionByName(_impact_sizes(e, BLOCK_NODES).select(
            *one("node", F.col("direct"), 0, F.when(known, F.col("impact")).otherwise(0), F.when(known, F.col("indirect_impact")).otherwise(0))))
    else:
        ends = ends.unionByName(e.select(*one("dst", 1, 0, 0, 0)))
    if nodes is not None:
        ends = ends.unionByName(nodes.select(*one("node", 0, 0, 0, 0)))
    out = ends.groupBy("node").agg(F.sum("into").alias("referenced_by"), F.sum("out").alias("depends_on"),
                                   F.sum("impact").alias("impact"), F.sum("indirect").alias("indirect_impact"))
    if impact is not None:
        if "affected" in impact.columns:
            impact = impact.groupBy("node").agg(F.count(F.lit(1)).alias("impact"), F.count_if(F.col("depth") > 1).alias("indirect_impact"))
        out = out.drop("impact", "indirect_impact").join(
            impact.select("node", "impact", "indirect_impact"), "node", "left").fillna(0, ["impact", "indirect_impact"])
    return out.select(
        "node", F.col("referenced_by").cast("long"), F.col("depends_on").cast("long"), F.col("impact").cast("long"),
        F.col("indirect_impact").cast("long"),
        (3 * F.col("referenced_by") + F.col("depends_on") + F.col("impact")).cast("long").alias("importance"),
        ((F.col("referenced_by") + F.col("depends_on")) == 0).alias("is_standalone"),
    )


def core_objects(scores: DataFrame, n: int | None = None) -> DataFrame:
    """D-6 / W1 / O6: nodes by importance with their rank; the first ``n`` if given."""
    order = [F.col("importance").desc(), F.col("node")]
    if n is None:
        return ranked(scores, order, "_rank0").withColumn("rank", (F.col("_rank0") + 1).cast("int")).drop("_rank0")
    # n rows
    from pyspark.sql import Window
    return scores.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def lineage(edges: DataFrame, start: DataFrame | str, shared_visited: bool = False,
            max_depth: int | None = None) -> DataFrame:
    """L-1 / L-2: lineage layers around start node(s): (start, node, direction, layer).

    Upstream (what the start depends on) gets negative layers, downstream positive, the start 0.
    Each direction keeps its own visited set; with ``shared_visited`` nodes already placed upstream
    are not placed again downstream (report variant).
    """
    if isinstance(start, str):
        start = edges.sparkSession.createDataFrame([(start,)], "node string")
    up_e = cut_lineage(_directed(edges, "dependencies"))
    down_e = up_e.select(F.col("to").alias("frm"), F.col("frm").alias("to"))
    seeds = start.select(F.col("node").alias("root"), F.col("node"))
    up = _bfs(up_e, seeds, max_depth, include_seed_level=True)
    down = _bfs(down_e, seeds, max_depth, include_seed_level=True)
    up = up.filter(F.col("depth") > 0).select("root", "node", F.lit("upstream").alias("direction"),
                                             (-F.col("depth")).alias("layer"))
    down = down.filter(F.col("depth") > 0)
    if shared_visited:
        down = down.join(up.select("root", "node"), ["root", "node"], "left_anti")
    down = down.select("root", "node", F.lit("downstream").alias("direction"), F.col("depth").alias("layer"))
    origin = seeds.select("root", "node", F.lit("start").alias("direction"), F.lit(0).alias("layer"))
    return origin.unionByName(up).unionByName(down).withColumnRenamed("root", "start").withColumn(
        "layer", F.col("layer").cast("int"))


def induced_edges(edges: DataFrame, node_set: DataFrame) -> DataFrame:
    """L-3 / J12: edges whose both ends are in the node set."""
    ns = node_set.select("node").distinct()
    e = edges.join(ns.withColumnRenamed("node", "src"), "src", "left_semi")
    return e.join(ns.withColumnRenamed("node", "dst"), "dst", "left_semi")


def _propagate_min(edges_ft: DataFrame, labels: DataFrame) -> DataFrame:
    """Min-label propagation along (frm, to) to a fixpoint: label(to) = min(label(to), label(frm)).

    Delta propagation: only nodes whose label changed in the last round send their label on, so late
    rounds touch a small frontier instead of every edge.
    """
    labels = cut_lineage(labels)
    changed = labels
    while True:
        cand = changed.join(edges_ft, changed.node == edges_ft.frm).groupBy(F.col("to").alias("node")).agg(
            F.min("label").alias("cand"))
        new = labels.join(cand, "node", "left").select(
            "node", F.least(F.col("label"), F.coalesce(F.col("cand"), F.col("label"))).alias("label"),
            F.coalesce(F.col("cand") < F.col("label"), F.lit(False)).alias("_changed"))
        new = cut_lineage(new)
        changed = new.filter(F.col("_changed")).select("node", "label")
        labels = new.drop("_changed")
        if changed.isEmpty():
            return labels


def _chains(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Contract nodes with one edge in and one out: (edges left, chain members, rings); None if there is no such node.

    Pointers double from round to round, so that a chain of n nodes takes log2(n) rounds. Members: node, and the
    ends (a, b) of the edge that stands for the chain. Rings, closed chains without another node: node, label (the least).
    """
    one_in = e.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("before"), F.count(F.lit(1)).alias("i")).filter("i = 1")
    one_out = e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("after"), F.count(F.lit(1)).alias("o")).filter("o = 1")
    mid = cut_lineage(one_in.join(one_out, "node").select("node", "before", "after"))
    n = mid.count()
    if not n:
        return None
    inner = mid.select("node")
    at = mid.join(inner.withColumnRenamed("node", "after").withColumn("more", F.lit(True)), "after", "left").select(
        "node", F.col("node").alias("last"), F.col("after").alias("to"), F.col("node").alias("least"), F.coalesce("more", F.lit(False)).alias("more"))
    at = cut_lineage(at)
    for _ in range(max(1, n.bit_length())):
        if at.filter("more").isEmpty():
            break
        hop = at.select(F.col("node").alias("to"), F.col("last").alias("last2"), F.col("to").alias("to2"), F.col("least").alias("least2"), F.col("more").alias("more2"))
        walks = F.col("more")
        at = cut_lineage(at.join(hop, "to", "left").select(
            "node", F.when(walks, F.col("last2")).otherwise(F.col("last")).alias("last"), F.when(walks, F.col("to2")).otherwise(F.col("to")).alias("to"),
            F.when(walks, F.least("least", "least2")).otherwise(F.col("least")).alias("least"), F.when(walks, F.col("more2")).otherwise(F.lit(False)).alias("more")))
    rings = at.filter("more").select("node", F.col("least").alias("label"))
    open_ = at.filter("not more").select("node", "last", "to")
    heads = mid.join(inner.withColumnRenamed("node", "before"), "before", "left_anti").select("node", F.col("before").alias("a"))
    ends = heads.join(open_, "node").select("last", "a", F.col("to").alias("b"))
    members = cut_lineage(open_.join(ends, "last").select("node", "a", "b"))
    rest = e.join(inner.withColumnRenamed("node", "src"), "src", "left_anti").join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti")
    left = rest.select("src", "dst").unionByName(ends.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return cut_lineage(left.filter("src <> dst").distinct()), members, cut_lineage(rings)


def _trimmed(e: DataFrame) -> DataFrame | None:
    """Edges without those whose source has no edge in, or whose target has none out; None if all stay."""
    keep = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    keep = cut_lineage(keep.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
    return None if keep.count() == e.count() else keep


def _coloured(e: DataFrame) -> DataFrame:
    """One round of forward-backward colouring: (node, label) of the components found, one at least.

    The least name is propagated along the edges; a node with its own name as colour roots a component, whose
    other nodes are found by walking backwards inside the colour."""
    ft = e.select(F.col("src").alias("frm"), F.col("dst").alias("to"))
    colour = _propagate_min(ft, node_table(e).select("node", F.col("node").alias("label")))
    back = e.select(F.col("dst").alias("frm"), F.col("src").alias("to"))
    back = cut_lineage(back.join(colour.select(F.col("node").alias("to"), F.col("label").alias("to_label")), "to"))
    found = cut_lineage(colour.filter(F.col("node") == F.col("label")))
    frontier, parts = found, [found]
    while True:
        step = frontier.join(back, (frontier.node == back.frm) & (frontier.label == back.to_label)).select(F.col("to").alias("node"), "label").distinct()
        step = cut_lineage(step.join(reduce(DataFrame.unionByName, parts).select("node"), "node", "left_anti"))
        if step.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(step)
        frontier = step


def strongly_connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """K-1: strongly connected components - (node, scc_id, scc_size); scc_id is the least node name.

    Rounds of: trimming (edges from nodes that nothing reaches, or into nodes that reach nothing, go, which
    dissolves acyclic parts), contraction of chains and rings by pointer doubling, so that their length costs
    its logarithm in rounds, and forward-backward colouring of what neither shrinks. Chains come back at the end:
    a chain's nodes belong to the component of its ends if both ends lie in one, and else to none. A node with
    only a self edge is a component of size 1 (no cycle).
    """
    e0 = _pairs(edges)
    e = e0.filter("src <> dst")
    found, chains = [], []
    while not e.isEmpty():
        # in turns: a path would lose one node at each end by trimming alone
        smaller = _trimmed(e)
        if smaller is not None:
            e = smaller
        contracted = _chains(e)
        if contracted is not None:
            e, members, rings = contracted
            chains.append(members)
            found.append(rings)
        if smaller is not None or contracted is not None:
            continue
        some = cut_lineage(_coloured(e))
        found.append(some)
        gone = some.select("node")
        e = cut_lineage(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    labels = reduce(DataFrame.unionByName, found) if found else e0.select(F.col("src").alias("node"), F.col("src").alias("label")).limit(0)
    for members in reversed(chains):
        x, y = labels.toDF("a", "la"), labels.toDF("b", "lb")
        # ends without a component of their own are components by themselves
        on = members.join(x, "a", "left").join(y, "b", "left").select(
            "node", "a", F.coalesce("la", "a").alias("p"), F.coalesce("lb", "b").alias("q")).filter("p = q")
        back = on.select("node", F.col("p").alias("label")).unionByName(on.select(F.col("a").alias("node"), F.col("p").alias("label")))
        labels = cut_lineage(labels.unionByName(back).distinct())
    names = labels.groupBy("label").agg(F.min("node").alias("scc_id"), F.count(F.lit(1)).cast("long").alias("scc_size"))
    labels = labels.join(names, "label").select("node", "scc_id", "scc_size")
    return node_table(e0, nodes).join(labels, "node", "left").select(
        "node", F.coalesce("scc_id", "node").alias("scc_id"), F.coalesce("scc_size", F.lit(1)).cast("long").alias("scc_size"))


def cycles(scc: DataFrame) -> DataFrame:
    """K-1: nodes on a cycle (component of more than one node)."""
    return scc.filter(F.col("scc_size") > 1)


def cycle_edges(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """K-2: edges whose both ends lie in the same cycle."""
    c = cycles(scc)
    e = edges.join(c.select(F.col("node").alias("src"), F.col("scc_id").alias("a")), "src")
    e = e.join(c.select(F.col("node").alias("dst"), F.col("scc_id").alias("b")), "dst")
    return e.filter(F.col("a") == F.col("b")).drop("b").withColumnRenamed("a", "scc_id")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """K-3: weakly connected components — (node, component_id, component_size), least name as id."""
    e = cut_lineage(edges.select("src", "dst").distinct())
    lab = node_table(e, nodes).select("node").join(star_components(e), "node", "left").select(
        "node", F.coalesce("component", "node").alias("label"))
    lab = cut_lineage(lab)
    sizes = lab.groupBy("label").agg(F.count(F.lit(1)).alias("component_size"))
    return lab.join(sizes, "label").select("node", F.col("label").alias("component_id"),
                                           F.col("component_size").cast("long"))


def counts_by(df: DataFrame, col: str) -> DataFrame:
    """G10 / V-3: rows per value of a column."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
