"""Operator 2: MinHash near-dedup by a multi-index Hamming join.

A document's set is its distinct five-word shingles (64-bit hashes). Documents with one set form a class; a
class has a signature of ``SYMBOLS`` b-bit minimum hashes (b = 16). Two signatures at most ``DISTANCE`` = 31
symbols apart agree, by the pigeonhole principle, in one of the 16 chunks of four symbols with one error at
most. Each chunk is therefore indexed four times, each time without one symbol: classes within the distance
share a key, always. Sets at the similarity threshold of 0.75 are farther apart than that with a
probability of about 1 in 100,000; every link found is confirmed on the full sets.

First each bucket's members meet its leader alone (the member that
shares most keys over all, as the origin of near copies does), and components of the confirmed links form.
Then buckets that still hold several components are joined with themselves under conditions checked inside
the join, so that only pairs leave it that lie in different components, whose sizes, parity bitmaps (each
differing shingle changes one bit at most) and signatures allow a link, and for which the key is the first
they share. What the join compares still grows with the square of such a bucket's components. In large buckets a pair must also have enough
shingles that occur in more than one set there: shingles of one's own can't be common.

Scale: texts are read once for sketches (compact rows), and once more for the members of candidate pairs;
their ids are broadcast below ``BROADCAST_ROWS`` rows of 32 bytes and joined otherwise. Copies cost one
class. Signatures and keys spread by hash; skewed buckets are split by the adaptive join.

Defined cases: null or blank text has an empty set and links with nothing; a text of fewer than five words
is one shingle; a document without id takes no part and is kept; rows with one id are one document's,
whichever their texts; an empty table gives no rows. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescope.llm.ngram_join import PARITY, parity
from lakescope.llm.shared import frozen, let
from lakescope.operators.components import star_components

SHINGLE, SIMILARITY = 5, 75
SYMBOLS, CHUNK, DISTANCE = 64, 4, 31
CHUNKS = SYMBOLS // CHUNK
#: Members from which a bucket counts as large; ids that may be broadcast.
LARGE, BROADCAST_ROWS = 64, 2_000_000

_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_P = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a whole text."""
    w = (text or "").encode().lower().split()  # lower-cases A-Z and splits at ASCII white space only
    if len(w) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w))] if w else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - SHINGLE + 1
    s = h[:n] * _P[0]
    for k in range(1, SHINGLE):
        s += h[k : n + k] * _P[k]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x9E3779B97F4A7C15)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """The low 16 bits of 64 minimum hashes, four to a 64-bit integer."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, ((s[i : i + 2048, None] * _A + _B) >> np.uint64(32)).min(axis=0))
    return low.astype("<u2").view("<i8")


def _name(s: np.ndarray) -> tuple[int, int]:
    raw = s.tobytes()
    return tuple(int(np.array(x, np.uint64).view(np.int64)) for x in (xxhash.xxh3_64_intdigest(raw), xxhash.xxh64_intdigest(raw, 7)))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=at[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ha, hb, sig, par): size of the set, its 128-bit name, its signature and parity bitmap."""
    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1):
                s = shingles(t.as_py())
                rows.append((len(s), *_name(s), signature(s), parity(s)))
            if rows:
                n, ha, hb, sig, par = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ha, pa.int64()), pa.array(hb, pa.int64()), _lists(sig), _lists(par)],
                                                 names=["doc_id", "n", "ha", "hb", "sig", "par"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return frozen(d.mapInArrow(run, "doc_id long, n long, ha long, hb long, sig array<long>, par array<long>"))


def classes(sketched: DataFrame) -> DataFrame:
    """(node, doc_id, n, ha, hb, sig, par): one row for each distinct set that a document with an id has."""
    one = sketched.filter("n > 0 and doc_id is not null").groupBy("ha", "hb").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first(F.struct("sig", "par")).alias("s"))
    return frozen(one.select("ha", "hb", "doc_id", "n", "s.sig", "s.par").withColumn("node", F.monotonically_increasing_id()))


def index_keys(sig: Column) -> Column:
    """Keys of a signature: for each chunk and each of its symbols, a hash of the chunk without it."""
    out = []
    for c in range(CHUNKS):
        for m in range(CHUNK):
            mask = ~(0xFFFF << (16 * m)) & ((1 << 64) - 1)
            mask -= (mask >> 63) << 64
            out.append(F.struct(F.lit(c * CHUNK + m).cast("short").alias("slot"), F.xxhash64(
                F.lit(c * CHUNK + m), F.get(sig, F.lit(c)).bitwiseAND(F.lit(mask))).alias("key")))
    return F.array(*out)


def gaps(x: Column, y: Column) -> Column:
    """For each chunk, how many of its four symbols differ."""
    def differ(p, q):
        v = p.bitwiseXOR(q)
        return reduce(lambda a, b: a + b, [F.when(v.bitwiseAND(F.lit(0xFFFF)) != 0, 1).otherwise(0) if m == 0 else
                                           F.when(F.shiftrightunsigned(v, 16 * m).bitwiseAND(F.lit(0xFFFF)) != 0, 1).otherwise(0) for m in range(CHUNK)])
    return F.zip_with(x, y, differ)


def _sum(g: Column) -> Column:
    return F.aggregate(g, F.lit(0), lambda a, v: a + v)


def distance(x: Column, y: Column) -> Column:
    """How many symbols of two signatures differ."""
    return _sum(gaps(x, y))


def near_at(x: Column, y: Column, slot: Column) -> Column:
    """True if the signatures are within the distance and the key of ``slot`` is the first they share.

    A chunk with one error shares the key without that symbol; a chunk without error shares all four."""
    first = lambda g: F.array_position(F.transform(g, lambda v: v <= 1), True) - 1
    here = lambda g: (first(g) == F.floor(slot / CHUNK)) & ((F.get(g, F.floor(slot / CHUNK).cast("int")) == 1) | (slot % CHUNK == 0))
    return let(gaps(x, y), lambda g: (_sum(g) <= DISTANCE) & here(g))


def _needs(na: Column, nb: Column, similarity: int) -> Column:
    """The least overlap of linked sets, times 100 + similarity."""
    return (na + nb) * similarity


def _sizes_allow(na: Column, nb: Column, similarity: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * similarity


def set_rows(docs: DataFrame, known: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, n, set): the full sets of the given nodes, from the texts of their first documents."""
    want = frozen(known.join(nodes.select("node").distinct(), "node").select("node", F.col("doc_id").alias("_doc"), "ha", "hb"))
    few = want.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def run(batches):
        for batch in batches:
            rows = []
            for node, ha, hb, t in zip(*(batch.column(k) for k in range(4)), strict=True):
                s = shingles(t.as_py())
                if _name(s) == (ha.as_py(), hb.as_py()):
                    rows.append((node.as_py(), s))
            for i in range(0, len(rows), 512):
                nodes_, sets = zip(*rows[i : i + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(nodes_, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(list(sets))],
                                                 names=["node", "n", "set"])

    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    got = d.join(F.broadcast(want) if few else want, F.col("_id") == F.col("_doc")).select("node", "ha", "hb", "_text").mapInArrow(
        run, "node long, n long, set array<long>")
    return frozen(got.groupBy("node").agg(F.first("n").alias("n"), F.first("set").alias("set")))


def confirmed(docs: DataFrame, known: DataFrame, pairs: DataFrame, similarity: int, **cols) -> DataFrame:
    """(a, b): the pairs whose full sets are similar enough."""
    both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    sets = set_rows(docs, known, both, **cols)
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("set").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("set").alias("y"))
    j = pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return frozen(j.filter(F.col("common") * (100 + similarity) >= _needs(F.col("na"), F.col("nb"), similarity)).select("a", "b"))


def shared_counts(sets: DataFrame) -> DataFrame:
    """(node, shared): how many of a set's shingles occur in another of the sets too."""
    each = sets.select("node", F.explode("set").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).filter("k = 1")
    own = alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    return sets.select("node", "n").join(own, "node", "left").select("node", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))


def links(docs: DataFrame, known: DataFrame, similarity: int = SIMILARITY, **cols) -> DataFrame:
    """(a, b): confirmed links whose components are those of all links between classes."""
    keys = known.select("node", F.explode(index_keys(F.col("sig"))).alias("k")).select("node", "k.slot", "k.key")
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    buckets = frozen(keys.join(met, "key"))
    # first the leader of each bucket
    rank = buckets.groupBy("node").agg(F.sum("members").alias("rank"))
    leaders = buckets.join(rank, "node").groupBy("key").agg(F.max_by("node", F.struct("rank", -F.col("node"))).alias("a"))
    star = buckets.join(leaders, "key").filter(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    x = known.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("x"))
    y = known.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("y"))
    likely = _sizes_allow(F.col("na"), F.col("nb"), similarity) & (distance(F.col("x"), F.col("y")) <= DISTANCE)
    tried = frozen(star.join(x, "a").join(y, "b").filter(likely).select("a", "b"))
    first = confirmed(docs, known, tried, similarity, **cols)
    # then what lies in different components of one bucket
    parts = star_components(first, "a", "b")
    part = F.coalesce("component", "node").alias("part")
    marked = buckets.join(parts, "node", "left").select("key", "slot", "members", "node", part)
    mixed = marked.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("key")
    open_ = frozen(marked.join(mixed, "key"))
    large = open_.filter(F.col("members") >= LARGE).select("node").distinct()
    shared = shared_counts(set_rows(docs, known, large, **cols))
    u = open_.join(known.select("node", "n", "sig", "par"), "node").join(shared, "node", "left")
    a, b = (u.select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("slot", "members", "node", "part", "n", "sig", "par", "shared")]) for k in "ab")
    c = F.col
    enough = lambda k: c(f"shared_{k}") * (100 + similarity) >= _needs(c("n_a"), c("n_b"), similarity)
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.get(c("par_a"), k).bitwiseXOR(F.get(c("par_b"), k))) for k in range(PARITY)])
    may = ((c("node_a") < c("node_b")) & (c("part_a") != c("part_b")) & _sizes_allow(c("n_a"), c("n_b"), similarity)
           & (apart * (100 + similarity) <= (c("n_a") + c("n_b")) * (100 - similarity))
           & ((c("members_a") < LARGE) | (enough("a") & enough("b")))
           & near_at(c("sig_a"), c("sig_b"), c("slot_a")))
    pairs = a.join(b, (a["key"] == b["key"]) & may).select(c("node_a").alias("a"), c("node_b").alias("b"))
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = confirmed(docs, known, frozen(pairs.distinct().join(done, ["a", "b"], "left_anti")), similarity, **cols)
    return first.unionByName(second)


def components(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    cols = {"id_col": id_col, "text_col": text_col}
    sketched = sketches(docs, id_col, text_col)
    known = classes(sketched)
    parts = frozen(star_components(links(docs, known, similarity, **cols), "a", "b"))
    joined = frozen(known.join(parts, "node", "left").select("ha", "hb", "doc_id", F.coalesce("component", "node").alias("part")))
    least = joined.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    named = joined.join(least, "part").select("ha", "hb", "component_id")
    out = sketched.select("doc_id", "n", "ha", "hb").join(named, ["ha", "hb"], "left")
    of = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    of = F.when(F.col("doc_id").isNotNull(), of)
    return out.select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id"),
                      F.coalesce(F.col("doc_id") == of, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The documents kept, one of each component, with their columns; a row that repeats another's id
    and text goes too."""
    found = frozen(components(docs.select("doc_id", "text"), similarity))
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    again = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    few = lambda t: F.broadcast(t) if t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else t
    stay = docs.join(few(frozen(gone)), "doc_id", "left_anti")
    again = frozen(again)
    return stay.join(few(again), "doc_id", "left_anti").unionByName(
        stay.join(few(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)
