"""Operator 5: exact top-k search by inner product, with a KD-tree for each shard.

Components x become the integers floor(1024 * x). Rows are dealt to shards of ``SHARD_CELLS`` components by a
hash of their id; a task builds its shard's KD-tree by median splits of the widest side, each node with the
tight box of its rows. A query walks a tree best first, by the largest inner product that a node's box allows,
and stops when that is below its k-th score so far. That k-th score is propagated: a query first searches
one shard, its home, and enters all others with the k-th score found there.

Scale: queries come in blocks of ``BLOCK_QUERIES``; a task holds one shard and one block, whatever the tables'
sizes. Each query keeps k rows of each shard at most, and these alone are merged. Equal vectors share a leaf,
of which k rows at most go on.

Exact: inner products are computed in floating point while all sums stay below 2**53, else with Python's
integers (scores beyond a long are held at its ends), and all nodes are visited then.

Defined cases: null vectors, those with null or non-finite components, and rows without id take no part; a
row's own id is never its candidate, also where rows repeat; of rows with one query id the least vector asks;
vectors meet those of their own length only; a query with fewer candidates gets all of them. Other columns
are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakescope.llm.shared import frozen

SCALE, SHARD_CELLS, BLOCK_QUERIES, LEAF_ROWS = 1024, 1 << 19, 2048, 64
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of whole numbers in double precision."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(a.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.floor(flat * SCALE).reshape(len(a), -1) if len(a) else np.zeros((0, 0))


class KdTree:
    """Nodes in arrays: box (low, high), children (or -1) and the rows order[start:stop]."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.x, self.order = x, np.arange(len(x))
        self.low, self.high, self.child, self.span = [], [], [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = self.x[self.order[a:b]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            me = len(self.span)
            self.low.append(low)
            self.high.append(high)
            self.child.append([-1, -1])
            self.span.append((a, b))
            if parent >= 0:
                self.child[parent][side] = me
            wide = high - low
            if b - a > leaf_rows and wide.size and wide.max() > 0:
                axis, mid = int(wide.argmax()), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query (row) and node, the largest inner product that the node's box allows."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T


def search(tree: KdTree, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, k: int):
    """Yields (query place, ids, scores) of each query's best rows; rows below ``floor`` (the propagated k-th
    score) are not needed."""
    bounds = tree.bounds(q)
    for i in range(len(q)):
        best_s, best_i, kth = np.zeros(0), np.zeros(0, np.int64), floor[i]
        heap = [(-bounds[i, 0], 0)]
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            left, right = tree.child[node]
            if left >= 0:
                for c in (left, right):
                    if bounds[i, c] >= kth:
                        heapq.heappush(heap, (-bounds[i, c], c))
                continue
            a, b = tree.span[node]
            rows = tree.order[a:b]
            s, r = tree.x[rows] @ q[i], ids[rows]
            stay = (s >= kth) & (r != q_ids[i])
            if stay.any():
                s, r = np.concatenate([best_s, s[stay]]), np.concatenate([best_i, r[stay]])
                top = np.lexsort((r, -s))[:k]
                best_s, best_i = s[top], r[top]
                if len(top) == k:
                    kth = max(kth, best_s[-1])
        yield i, best_i, best_s


def search_all(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int):
    """The same by Python's integers, for numbers whose sums floating point can't hold."""
    rows = [[int(v) for v in r] for r in x]
    for i, own in enumerate(q):
        v = [int(c) for c in own]
        held = ((max(-LONG, min(LONG, sum(a * b for a, b in zip(v, r, strict=True)))), int(j)) for r, j in zip(rows, ids, strict=True) if j != q_ids[i])
        best = heapq.nsmallest(k, ((-s, j) for s, j in held))
        yield i, np.array([j for _, j in best], np.int64), [-s for s, _ in best]


def _task(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, ids = matrix(rows["vector"]), rows["vec_id"].to_numpy()
        q, q_ids = matrix(queries["q_vector"]), queries["query_id"].to_numpy()
        floor = np.array([-np.inf if v is None else float(v) for v in queries["kth"].to_pylist()])
        most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1])
        found = search(KdTree(x), ids, q, q_ids, floor, k) if most < EXACT else search_all(x, ids, q, q_ids, k)
        out = [(int(q_ids[i]), int(j), int(s)) for i, js, ss in found for j, s in zip(js, ss, strict=True)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    return run


def _deal(by: Column, count: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(by, F.lit(salt)), count).cast("int")


def top_k(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_cells: int = SHARD_CELLS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product for each query, ties to the
    smaller id. ``is_query`` is a condition on the table's columns."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    rows = frozen(rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(
        F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))).withColumn("dim", F.size("vector")))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("int")).alias("nq")).select(
        "dim", F.ceil(F.col("n") / F.greatest(F.lit(1), F.floor(F.lit(shard_cells) / F.greatest("dim", F.lit(1))))).alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.col("nq") / block_queries)).alias("blocks"))
    shards = rows.join(sizes, "dim").withColumn("shard", _deal(F.col("vec_id"), F.col("shards"), 1)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).select("dim", "shard", "block", "vec_id", "vector")
    asked = rows.filter("asks").groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("v")).select(
        F.col("vec_id").alias("query_id"), "v.dim", F.col("v.vector").alias("q_vector"))
    asked = frozen(asked.join(sizes, "dim").withColumn("home", _deal(F.col("query_id"), F.col("shards"), 2)).withColumn(
        "block", _deal(F.col("query_id"), F.col("blocks"), 3)))
    at, run = ["dim", "shard", "block"], _task(k)
    ddl = "query_id long, vec_id long, score long"
    first = asked.select("dim", F.col("home").alias("shard"), "block", "query_id", "q_vector", F.lit(None).cast("long").alias("kth"))
    found = frozen(shards.groupBy(*at).cogroup(first.groupBy(*at)).applyInArrow(run, ddl))
    kth = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    rest = asked.join(kth, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1)))
    rest = rest.filter(F.col("shard") != F.col("home")).select("dim", "shard", "block", "query_id", "q_vector", "kth")
    more = shards.groupBy(*at).cogroup(rest.groupBy(*at)).applyInArrow(run, ddl)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.unionByName(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
