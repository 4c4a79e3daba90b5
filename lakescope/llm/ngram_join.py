"""Operator 12: n-gram Jaccard join with a token-group matrix.

A document's set is its distinct three-word shingles (64-bit hashes); documents with one set are one class.
Similar classes are partitioned into groups; a group's row of the matrix is the union of its classes' shingles,
as a bitmap over hashed shingles. A class whose shingles outside a group's union are too many can link with no
class of it, so only groups whose bound allows a link are opened, and their classes compared.

Which class meets which group: sizes lie in bands such that linked sets are in one band or in neighbours.
For the pairs of a band (``schemes``) at most ``k`` shingles differ; shingles are dealt to more than k segments by hash,
so linked sets agree in a whole segment that is not empty (sets with many empty segments use these too).
The content of each segment is a key. Sets that merely share passages or frequent shingles differ
in every segment and share no key.

Groups are the components of confirmed links to one class of each key, the leader (the class that shares most
keys over all, as the origin of copies does). Then in keys that hold several groups, a class meets groups
of one class by a parity bitmap (each differing shingle changes one bit at most) and larger groups by their
unions, inside the join, so that only what the bounds allow leaves it. All links are confirmed on the full sets.
A link inside a group is not looked for: its ends are one component already.

Scale: texts are read once for sketches, and once more for each of the two rounds of confirmation. Copies cost one class. No set
of a document that shares no key is shuffled; keys spread by hash, large ones are split by the adaptive join,
and unions are partial sums of bits. Ids are broadcast below ``BROADCAST_ROWS`` rows of 40 bytes and joined otherwise.

Defined cases: null or blank text has an empty set and links with nothing; a text of fewer than three words is
one shingle; a document without id takes no part; rows with one id are judged each by its own text; an empty
table gives no rows. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescope.llm.shared import frozen
from lakescope.operators.components import star_components

SHINGLE, SIMILARITY = 3, 90
#: Longs of the parity bitmap; bits of the union bitmap for each shingle, and the least and most bits.
PARITY, UNION_BITS, LEAST_BITS, MOST_BITS = 8, 8, 512, 1 << 17
BROADCAST_ROWS = 1_500_000


def _spread(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    w = (text or "").encode().lower().split()  # lower-cases A-Z and splits at ASCII white space only
    if len(w) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w))] if w else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    out = h[:len(w) - size + 1].copy()
    for k in range(1, size):
        out = _spread(out, k) + h[k:len(w) - size + 1 + k]
    return np.unique(_spread(out, size))


def name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    raw = s.tobytes()
    return tuple(int(np.array(x, np.uint64).view(np.int64)) for x in (xxhash.xxh3_64_intdigest(raw), xxhash.xxh64_intdigest(raw, 7)))


@lru_cache(None)
def bands(similarity: int, upto: int) -> tuple[int, ...]:
    """Least size of each band; a set and the largest it can link with lie in one band or in neighbours."""
    low = [1]
    while low[-1] <= upto:
        low.append(low[-1] * 100 // similarity + 1)
    return tuple(low)


@lru_cache(None)
def scheme(band: int, similarity: int, upto: int) -> tuple[int, int]:
    """(k, segments) for pairs whose smaller set lies in the band: k shingles differ at most. (0, 0): equal sets alone link."""
    low = bands(similarity, upto)
    small = low[band + 1] - 1
    k = (small + small * 100 // similarity) * (100 - similarity) // (100 + similarity)
    if not k:
        return 0, 0
    # so that few sets have segments - k empty ones; where no number does it, such sets use their empty segments too
    few = (m for m in range(k + 2, 2 * k + 3) if m - k - 1 >= 4 * m * math.exp(-low[band] / m))
    segments = next(few, k + 2)
    return k, segments


def segment_keys(s: np.ndarray, band: int, similarity: int, upto: int) -> np.ndarray:
    """Keys of a set for the pairs of a band: a hash of each segment's content."""
    k, segments = scheme(band, similarity, upto)
    if not segments:
        return np.zeros(0, np.uint64)
    at = ((_spread(s, 2 * band + 1) >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    at = at.astype(np.int64)
    content = np.zeros(segments, np.uint64)
    np.add.at(content, at, _spread(s, 3))
    empty = np.bincount(at, minlength=segments) == 0
    keys = _spread(content + _spread(np.arange(segments, dtype=np.uint64), band), 5)
    return keys if empty.sum() >= segments - k else keys[~empty]


def parity(s: np.ndarray) -> np.ndarray:
    """Bits that are set where an odd number of shingles falls; two sets differ in as many shingles as in bits, or more."""
    odd = np.bincount((_spread(s, 11) >> np.uint64(32)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def union_bits(s: np.ndarray) -> np.ndarray:
    """Bits of a set's shingles; folded by halves, wide bitmaps compare with narrow ones."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (UNION_BITS * len(s) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(_spread(s, 13) >> np.uint64(32)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=at[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


#: Sizes up to which bands are made; above any text's number of words.
_UPTO = 1 << 40


def sketches(docs: DataFrame, similarity: int = SIMILARITY, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n, ha, hb, parity, bits, lower, upper): a set's size, name and bitmaps, and its keys as the smaller
    and as the larger set of a pair's bands."""
    low = np.array(bands(similarity, _UPTO))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = []
                for t in part.column(2):
                    s = shingles(t.as_py(), size)
                    band = int(np.searchsorted(low, max(1, len(s)), "right")) - 1
                    rows.append((len(s), *name(s), parity(s), union_bits(s), segment_keys(s, band, similarity, _UPTO),
                                 segment_keys(s, band - 1, similarity, _UPTO) if band else np.zeros(0, np.uint64)))
                n, ha, hb, *lists = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(x, pa.int64()) for x in (n, ha, hb)], *[_lists(list(x)) for x in lists]],
                                                 names=["row", "doc_id", "n", "ha", "hb", "parity", "bits", "lower", "upper"])

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return frozen(d.mapInArrow(run, "row long, doc_id long, n long, ha long, hb long, parity array<long>, bits array<long>, lower array<long>, upper array<long>"))


def narrow(df: DataFrame) -> DataFrame:
    """Broadcast rows of a few numbers if they are not too many; joined otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def classes(sketched: DataFrame) -> DataFrame:
    """(node, doc_id, n, ha, hb, parity, bits, lower, upper): the first document of each distinct set."""
    d = sketched.filter("n > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "row")).alias("first")
    copies = frozen(d.groupBy("ha", "hb").agg(first, F.count(F.lit(1)).alias("k")).filter("k > 1").select("ha", "hb", F.col("first.row").alias("stays")))
    return d.join(narrow(copies), ["ha", "hb"], "left").filter("stays is null or stays = row").drop("stays").withColumnRenamed("row", "node")


def _differ(similarity: int, na: Column, nb: Column) -> Column:
    """How many shingles of linked sets of these sizes can differ, at most."""
    return F.floor((na + nb) * (100 - similarity) / F.lit(100 + similarity))


def _sizes_allow(similarity: int, na: Column, nb: Column) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * similarity


def _parity_allows(similarity: int, a: str, b: str) -> Column:
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.get(F.col(f"parity_{a}"), k).bitwiseXOR(F.get(F.col(f"parity_{b}"), k))) for k in range(PARITY)])
    return apart <= _differ(similarity, F.col(f"n_{a}"), F.col(f"n_{b}"))


def _folded(bits: Column, size: Column) -> Column:
    """A bitmap at a smaller width: its parts of that width united."""
    fold = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(
        F.sequence(i, F.size(bits) - 1, size), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseOR(F.get(bits, j))))
    return F.when(F.size(bits) == size, bits).otherwise(fold)


def outside(bits: Column, union: Column) -> Column:
    """How many shingles of a set are not in a union, at least."""
    width = F.least(F.size(bits), F.size(union))
    missing = F.zip_with(_folded(bits, width), _folded(union, width), lambda x, u: F.bit_count(x.bitwiseAND(F.bitwise_not(u))))
    return F.aggregate(missing, F.lit(0), lambda acc, v: acc + v)


def set_rows(docs: DataFrame, known: DataFrame, nodes: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(node, n, set): the full sets of the given nodes, from the texts of their first documents."""
    want = frozen(known.select("node", "doc_id", "ha", "hb").join(nodes.select("node").distinct(), "node").withColumnRenamed("doc_id", "_doc"))

    def run(batches):
        for batch in batches:
            rows = []
            for node, ha, hb, t in zip(*(batch.column(k) for k in range(4)), strict=True):
                s = shingles(t.as_py(), size)
                if name(s) == (ha.as_py(), hb.as_py()):
                    rows.append((node.as_py(), s))
            for i in range(0, len(rows), 256):
                n, sets = zip(*rows[i:i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(list(sets))], names=["node", "n", "set"])

    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    got = d.join(narrow(want), F.col("_id") == F.col("_doc")).select("node", "ha", "hb", "_text").mapInArrow(run, "node long, n long, set array<long>")
    return frozen(got.dropDuplicates(["node"]))


def confirmed(docs: DataFrame, known: DataFrame, pairs: DataFrame, similarity: int, **of) -> DataFrame:
    """(a, b): the pairs whose full sets link."""
    sets = set_rows(docs, known, pairs.select(F.explode(F.array("a", "b")).alias("node")), **of)
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("set").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("set").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    j = pairs.join(x, "a").join(y, "b").withColumn("common", common)
    return frozen(j.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * similarity).select("a", "b"))


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in df.columns])


def keys_met(known: DataFrame) -> DataFrame:
    """(key, node, larger, members): keys that two classes or more share, not all of them as the larger set."""
    rows = lambda c, larger: F.transform(c, lambda k: F.struct(k.alias("key"), F.lit(larger).alias("larger")))
    keys = known.select("node", F.explode(F.concat(rows(F.col("lower"), False), rows(F.col("upper"), True))).alias("k")).select("k.key", "node", "k.larger")
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.bool_and("larger").alias("all_larger")).filter("members > 1 and not all_larger")
    return frozen(keys.join(met.select("key", "members"), "key"))


def leader_pairs(met: DataFrame, known: DataFrame, similarity: int) -> DataFrame:
    """(a, b): each key's leader with the other classes of the key, where sizes and parity allow a link."""
    rank = met.groupBy("node").agg(F.sum("members").alias("rank"))
    leaders = met.join(rank, "node").groupBy("key").agg(F.max_by("node", F.struct("rank", -F.col("node"))).alias("a"))
    star = met.join(leaders, "key").filter(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    at = known.select("node", "n", "parity")
    j = star.join(_sided(at, "a").withColumnRenamed("node_a", "a"), "a").join(_sided(at, "b").withColumnRenamed("node_b", "b"), "b")
    return frozen(j.filter(_sizes_allow(similarity, F.col("n_a"), F.col("n_b")) & _parity_allows(similarity, "a", "b")).select("a", "b"))


def matrix(members: DataFrame) -> DataFrame:
    """(group, least, most, bits): sizes and the union of the classes of each group. ``members``: group, n, bits."""
    sizes = members.groupBy("group").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min(F.size("bits")).alias("width"))
    # first at each class's own width, so that a large group is partial sums by word, and then at the group's
    words = members.select("group", F.size("bits").alias("of"), F.posexplode("bits").alias("at", "w")).filter("w <> 0").groupBy("group", "of", "at").agg(F.bit_or("w").alias("w"))
    words = words.join(sizes, "group").groupBy("group", (F.col("at") % F.col("width")).alias("at")).agg(F.bit_or("w").alias("w"))
    cells = words.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("cells"))  # MOST_BITS bits at most
    full = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.element_at("cells", i), F.lit(0).cast("long")))
    return cells.join(sizes, "group").select("group", "least", "most", full.alias("bits"))


def qualifying(docs: DataFrame, met: DataFrame, known: DataFrame, first: DataFrame, similarity: int) -> DataFrame:
    """(a, b): pairs of classes in different groups, which the groups' bounds and their own allow to link."""
    c = F.col
    parts = star_components(first, "a", "b").withColumnRenamed("component", "part")
    grouped = frozen(met.join(parts, "node", "left").select("key", "node", "larger", F.coalesce("part", "node").alias("group"), c("part").isNotNull().alias("many")))
    mixed = grouped.groupBy("key").agg(F.min("group").alias("p"), F.max("group").alias("q"), F.bool_and("larger").alias("all_larger")).filter("p < q and not all_larger")
    open_ = frozen(grouped.join(mixed.select("key"), "key"))
    at = known.select("node", "n", "parity", "bits").join(open_.select("node").distinct(), "node")
    at = frozen(at)
    # groups of one class, by parity
    one = open_.filter("not many").join(at.drop("bits"), "node").select("key", "node", "larger", "n", "parity")
    a, b = _sided(one, "a"), _sided(one, "b")
    ones = a.join(b, (c("key_a") == c("key_b")) & (c("node_a") < c("node_b")) & ~(c("larger_a") & c("larger_b"))
                  & _sizes_allow(similarity, c("n_a"), c("n_b")) & _parity_allows(similarity, "a", "b")).select(c("node_a").alias("a"), c("node_b").alias("b"))
    # larger groups, by their unions; of two larger groups the classes of the first ask
    wanted = open_.filter("many").select("group").distinct()
    members = parts.select("node", c("part").alias("group")).join(narrow(frozen(wanted)), "group", "left_semi").join(known.select("node", "n", "parity", "bits"), "node")
    members = frozen(members)
    rows = frozen(matrix(members))
    there = open_.filter("many").select(c("key").alias("key_g"), "group").distinct().join(rows, "group").withColumnRenamed("bits", "union").withColumnRenamed("group", "group_g")
    asks = open_.select("key", "node", "group", "many").join(at.select("node", "n", "bits"), "node")
    may = ((c("key") == c("key_g")) & (c("group") != c("group_g")) & (~c("many") | (c("group") < c("group_g")))
           & (c("n") * 100 >= c("least") * similarity) & (c("most") * 100 >= c("n") * similarity)
           & (outside(c("bits"), c("union")) * 100 <= c("n") * (100 - similarity)))
    opened = frozen(asks.join(there, may).select(c("node").alias("node_a"), c("group_g").alias("group")).distinct())
    inside = opened.join(_sided(at.select("node", "n", "parity"), "a"), "node_a").join(
        members.select("group", c("node").alias("node_b"), c("n").alias("n_b"), c("parity").alias("parity_b")),
        (opened["group"] == members["group"]) & _sizes_allow(similarity, c("n_a"), c("n_b")) & _parity_allows(similarity, "a", "b"))
    return frozen(ones.unionByName(inside.select(c("node_a").alias("a"), c("node_b").alias("b"))).distinct())


def components(docs: DataFrame, similarity: int = SIMILARITY, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    of = {"size": size, "id_col": id_col, "text_col": text_col}
    sketched = sketches(docs, similarity, size, id_col, text_col)
    known = classes(sketched)
    met = keys_met(known)
    first = confirmed(docs, known, leader_pairs(met, known, similarity), similarity, **of)
    second = confirmed(docs, known, qualifying(docs, met, known, first, similarity), similarity, **of)
    parts = star_components(first.unionByName(second), "a", "b")
    named = frozen(known.select("node", "doc_id", "ha", "hb").join(parts, "node", "left").select("ha", "hb", "doc_id", F.coalesce("component", "node").alias("part")))
    least = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "part").select("ha", "hb", "component_id")
    out = sketched.select("doc_id", "n", "ha", "hb").join(named, ["ha", "hb"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
