"""Operator 11: ranked lexical search over FP-trees of documents.

A set of items asks for its best documents by term weights. Only the items' own terms matter, so a document
becomes its restricted term vector: the asked terms it holds, the most frequent first, each with its
occurrences tf, and the document's length factor m. Vectors in that order share paths from a trie's
root: an FP-tree, kept as a sorted array of vectors whose common prefixes give the nodes. A node holds the
largest tf of each term and the smallest m below it. As a term's part of the score grows with tf and falls with m,
these bound every document below, for any item. An item walks a tree depth first, the best child first,
and leaves what is bounded below its k-th score so far. Vectors of small subtrees are scored together.

Scale: the texts are read once for each block of items, in which each task also counts documents, terms and
document frequencies; only these counts are gathered, one row for each asked term. Items come in blocks of
``BLOCK_ITEMS`` and ``BLOCK_TERMS`` on average, so what is broadcast has a bound whatever the table of items holds.
Vectors are searched where they lie, without a shuffle: a task builds trees of ``SHARD_DOCS`` documents one
after the other and keeps k rows for each item, with which it enters its next tree. The k-th scores of a
part of the documents (one in ``SEED_PART``) are found first; they are lower bounds for all, so that every tree is
entered with one. Results are exact.

Defined cases: null, empty and blank texts have no terms and are no documents; a row without id takes no part;
rows that repeat are separate documents; of rows with one item id the least text asks, and items without terms get
no rows; long texts are whole; empty tables give no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakescope.llm.shared import frozen

TOP = 10
BLOCK_ITEMS, BLOCK_TERMS = 256, 16_384
SHARD_DOCS, LEAF_DOCS, SEED_PART = 4096, 16, 32

#: Bytes of terms (digits, letters lower-cased, all beyond ASCII) stay, the others separate terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_TABLE).split()


def length_factor(n: np.ndarray, docs: int, length: int) -> np.ndarray:
    return 25 + (75 * n * docs) // length


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of the score, before its weight; grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Restricted term vectors (docs = 0: doc_id, n, terms, tfs) and each task's counts (docs: its documents, n: their
    terms; terms and tfs: document frequencies)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        get, df = sent.value.get, np.zeros(len(sent.value), np.int64)
        n_docs = n_all = 0
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(t.as_py()) if t.is_valid and i is not None else ()
                if found:
                    n_docs, n_all = n_docs + 1, n_all + len(found)
                    held = Counter(map(get, found))
                    held.pop(None, None)
                    if held:
                        own = list(held)
                        df[own] += 1
                        rows.append((i, len(found), own, list(held.values())))
            if rows:
                yield _batch(0, rows)
        own = np.flatnonzero(df)
        yield _batch(n_docs, [(None, n_all, own.tolist(), df[own].tolist())])

    d = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    return frozen(d.mapInArrow(run, "docs long, doc_id long, n long, terms array<int>, tfs array<int>"))


def _batch(n_docs: int, rows: list[tuple]) -> pa.RecordBatch:
    i, n, own, tfs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([
        pa.array([n_docs] * len(rows), pa.int64()), pa.array(i, pa.int64()), pa.array(n, pa.int64()),
        pa.array(own, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["docs", "doc_id", "n", "terms", "tfs"])


class FpTree:
    """Vectors sorted by their terms (places in the order of frequency), and the nodes over them."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, counts: np.ndarray, places: np.ndarray, tfs: np.ndarray, width: int, leaf_docs: int = LEAF_DOCS):
        owner = np.repeat(np.arange(len(ids)), counts)
        by = np.argsort(owner * width + places)
        places, tfs = places[by], tfs[by]
        ends = np.cumsum(counts)
        paths = [places[b - c:b].astype(">u4").tobytes() for b, c in zip(ends, counts, strict=True)]
        order = np.array(sorted(range(len(ids)), key=paths.__getitem__), np.int64)
        self.ids, self.m, counts = ids[order], m[order], counts[order]
        self.start = np.concatenate([[0], np.cumsum(counts)])
        take = np.repeat((ends - np.diff(np.concatenate([[0], ends])))[order] - self.start[:-1], counts) + np.arange(self.start[-1])
        self.places, self.tfs = places[take], tfs[take]
        self.parts = part(self.tfs, np.repeat(self.m, counts))
        self._nodes(leaf_docs)
        self._maxima(width)

    def _shared(self) -> np.ndarray:
        """For each vector the number of terms of the path it shares with the one before."""
        out = np.zeros(len(self.ids), np.int64)
        for i in range(1, len(out)):
            a, b = self.places[self.start[i - 1]:self.start[i]], self.places[self.start[i]:self.start[i + 1]]
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            out[i] = differ.argmax() if differ.any() else n
        return out

    def _nodes(self, leaf_docs: int) -> None:
        """span: vectors of each node; child: its children (none: a leaf). Neighbouring subtrees with few vectors make one leaf."""
        shared, self.span, self.child = self._shared(), [(0, len(self.ids))], [[]]
        todo = [0]
        while todo:
            me = todo.pop()
            a, b = self.span[me]
            if b - a <= leaf_docs:
                continue
            depth = shared[a + 1:b].min()
            cuts = [a, *(np.flatnonzero(shared[a + 1:b] == depth) + a + 1).tolist(), b]
            at = a
            for x, y in zip(cuts[1:], [*cuts[2:], None], strict=True):
                if y is None or y - at > leaf_docs:  # what follows does not fit into this child
                    self.child[me].append(len(self.span))
                    todo.append(len(self.span))
                    self.span.append((at, x))
                    self.child.append([])
                    at = x

    def _maxima(self, width: int) -> None:
        most, least = np.zeros((len(self.span), width), np.int64), np.zeros(len(self.span), np.int64)
        for me in range(len(self.span) - 1, -1, -1):  # children come after their parents
            a, b = self.span[me]
            least[me] = self.m[a:b].min()
            if self.child[me]:
                most[me] = most[self.child[me]].max(axis=0)
            else:
                np.maximum.at(most[me], self.places[self.start[a]:self.start[b]], self.tfs[self.start[a]:self.start[b]])
        self.most = part(most, least[:, None])

    def bounds(self, weights: np.ndarray) -> np.ndarray:
        """For each node (row) and item the largest score that the node allows."""
        return (self.most.astype(np.float64) @ weights.T.astype(np.float64)) * (1 + 1e-9)

    def score(self, node: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.span[node]
        first, last = self.start[a], self.start[b]
        return np.add.reduceat(weights[self.places[first:last]] * self.parts[first:last], self.start[a:b] - first), self.ids[a:b]


class Best:
    """The best rows so far of one item, and the least score that a row needs."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.score, self.ids = k, max(1, floor), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        stay = score >= self.floor
        if stay.any():
            score, ids = np.concatenate([self.score, score[stay]]), np.concatenate([self.ids, ids[stay]])
            top = np.lexsort((ids, -score))[:self.k]
            self.score, self.ids = score[top], ids[top]
            if len(top) == self.k:
                self.floor = max(self.floor, int(self.score[-1]))


def search(tree: FpTree, weights: np.ndarray, best: list[Best]) -> None:
    """Every item walks the tree depth first, the best child first."""
    bounds = tree.bounds(weights)
    for q, mine in enumerate(best):
        bound, todo = bounds[:, q], [0]
        while todo:
            node = todo.pop()
            if bound[node] < mine.floor:
                continue
            if tree.child[node]:
                todo += sorted((c for c in tree.child[node] if bound[c] >= mine.floor), key=bound.__getitem__)
            else:
                mine.add(*tree.score(node, weights[q]))


def best_rows(rows: DataFrame, asked: dict, k: int = TOP, floors: list[int] | None = None) -> DataFrame:
    """(item, doc_id, score): for each task the k best rows of each item. ``asked``: place (of each term in the order of
    frequency), weights (items by places), docs, length."""
    sent = rows.sparkSession.sparkContext.broadcast((asked, floors))

    def run(batches):
        of, low = sent.value
        weights, place = of["weights"], of["place"]
        best = [Best(k, low[q] if low else 0) for q in range(len(weights))]

        def build(some):
            ids, n = (np.concatenate([b.column(c).to_numpy() for b in some]) for c in (0, 1))
            counts = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in some])
            own, tfs = (np.concatenate([b.column(c).flatten().to_numpy() for b in some]).astype(np.int64) for c in (2, 3))
            search(FpTree(ids, length_factor(n, of["docs"], of["length"]), counts, place[own], tfs, weights.shape[1]), weights, best)

        some, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_DOCS):
                piece = batch.slice(at, SHARD_DOCS)
                if held + piece.num_rows > SHARD_DOCS and some:
                    build(some)
                    some, held = [], 0
                some.append(piece)
                held += piece.num_rows
        if held:
            build(some)
        out = [(q, i, s) for q, b in enumerate(best) for i, s in zip(b.ids.tolist(), b.score.tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["item", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item int, doc_id long, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """(item_id, text) of the items that ask, in blocks."""
    one = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text")).filter("item_id is not null and text is not null")
    one = frozen(one.groupBy("item_id").agg(F.min("text").alias("text")))
    n, size = one.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-size // (6 * BLOCK_TERMS)))  # a term and what parts it from the next: about 6 bytes
    return [one.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks)]


def top_documents(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, ties to the smaller id."""
    spark: SparkSession = docs.sparkSession
    out = None
    for block in item_blocks(items, item_col, item_text_col):
        asking = [(r.item_id, Counter(terms(bytes(r.text)))) for r in block.orderBy("item_id").collect()]
        asking = [(i, t) for i, t in asking if t]
        names = sorted({t for _, own in asking for t in own})
        number = {t: j for j, t in enumerate(names)}
        if not names:
            continue
        held = vectors(docs, number, id_col, text_col)
        counts = held.filter("doc_id is null")
        n_docs, length = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(names), np.int64)
        for r in counts.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.tfs").alias("df")).collect():
            df[r.terms] = r.df
        place = np.empty(len(names), np.int64)
        place[np.lexsort((np.arange(len(names)), -df))] = np.arange(len(names))
        weights = np.zeros((len(asking), len(names)), np.int64)
        for q, (_, own) in enumerate(asking):
            for t, times in own.items():
                if df[number[t]]:
                    weights[q, place[number[t]]] = times * weight(int(df[number[t]]), n_docs)
        asked = {"place": place, "weights": weights, "docs": n_docs, "length": max(1, length)}
        rows = held.filter("doc_id is not null")
        seed = _ranked(best_rows(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SEED_PART)) == 0), asked, k), k).filter(F.col("rank") == k).collect()
        floors = [0] * len(asking)
        for r in seed:
            floors[r.item] = r.score
        found = _ranked(best_rows(rows, asked, k, floors), k)
        ids = F.array(*[F.lit(i).cast("long") for i, _ in asking])
        found = found.select(F.get(ids, F.col("item")).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
