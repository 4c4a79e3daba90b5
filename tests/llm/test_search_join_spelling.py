"""Operators 11 to 13 against brute force."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from lakescope.llm import ngram_join as J, ranking as R, spelling as S

from .data import DOCS, WORD, awkward_docs, documents, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- ranked search

def brute_ranked(docs, items, k=10):
    held = [(i, TERM.findall(t.translate(LOWER))) for i, t in docs if i is not None and t]
    held = [(i, Counter(w), len(w)) for i, w in held if w]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, w, _ in held for t in w)
    out = []
    for item, text in items:
        scores = []
        for i, w, n in held:
            m = 25 + (75 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w[t]) // (1000 * w[t] + 8 * m))
                    for t in TERM.findall((text or "").translate(LOWER)) if w[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def ranked(docs, items):
    return sorted(tuple(r) for r in R.top_documents(docs, items).select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("shard,leaf,items_in_block", [(4096, 16, 256), (7, 2, 3)])
def test_ranked_search(spark, monkeypatch, shard, leaf, items_in_block):
    monkeypatch.setattr(R, "SHARD_DOCS", shard)
    monkeypatch.setattr(R, "BLOCK_ITEMS", items_in_block)
    monkeypatch.setattr(R.FpTree.__init__, "__defaults__", (leaf,))
    rows = awkward_docs()
    rng = random.Random(3)
    rows += [(100 + i, sentence(rng, rng.randint(1, 60)), "en", "a", 1) for i in range(150)]
    rows += [(400 + i, rows[3][1], "en", "a", 1) for i in range(15)]  # ties
    items = [(1, sentence(rng, 12)), (2, None), (3, ""), (4, rows[3][1]), (5, "unseen words only"), (6, "Alpha1 alpha1 ALPHA1 tau3"), (7, "漢字 Zoë it's"), (8, sentence(rng, 40)), (9, rows[3][1])]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS score", "2 AS rank", "3 AS doc_id")
    assert ranked(documents(spark, rows), asked) == brute_ranked([(i, t) for i, t, *_ in rows], items)


def test_ranked_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert ranked(documents(spark, []), items) == []
    assert ranked(documents(spark, [(1, None, "en", "a", 0), (2, " ", "en", "a", 0)]), items) == []
    assert ranked(documents(spark), items.limit(0)) == []


def test_rows_without_id_and_repeated_items(spark):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha"), (2, "gamma")]
    items = [(1, "beta"), (1, "alpha"), (None, "alpha")]
    got = ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute_ranked(docs, [(1, "alpha")]) and [r[:3] for r in got] == [(1, 1, 1), (1, 2, 1)]


def test_fp_tree_shares_paths_and_bounds_hold():
    import numpy as np
    rng = np.random.default_rng(1)
    vectors = [np.unique(rng.integers(0, 30, rng.integers(1, 12))) for _ in range(200)]
    tfs = [rng.integers(1, 5, len(v)) for v in vectors]
    m = rng.integers(25, 300, 200)
    tree = R.FpTree(np.arange(200), m, np.array([len(v) for v in vectors]), np.concatenate(vectors), np.concatenate(tfs), 30, 4)
    weights = rng.integers(0, 9000, (5, 30))
    bounds = tree.bounds(weights)
    for node, (a, b) in enumerate(tree.span):
        if not tree.child[node]:
            for q in range(5):
                assert tree.score(node, weights[q])[0].max() <= bounds[node, q] <= bounds[0, q]
    assert sorted(tree.ids) == list(range(200)) and sum(b - a for me, (a, b) in enumerate(tree.span) if not tree.child[me]) == 200


# ---------------------------------------------------------------- n-gram join

def brute_components(rows, similarity=90, size=3):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, s) in enumerate(sets):
        for y in range(x):
            j, u = sets[y]
            if i is not None and j is not None and s and u and 100 * len(s & u) >= similarity * len(s | u):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return sorted(((i, len(s), least[root(x)] if i is not None else None) for x, (i, s) in enumerate(sets)), key=repr)


def joined(docs, **of):
    return sorted((tuple(r) for r in J.components(docs, **of).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def family(rng, first, n, words, copies, edits):
    """Copies of one text with random edits, and copies of copies."""
    base = sentence(rng, words).split()
    out = []
    for k in range(copies):
        w = list(rng.choice(out)[1].split()) if out and rng.random() < 0.3 else list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(w))
            w[at:at + 1] = rng.choice([[], ["new" + str(rng.random())], [w[at], "more"]])
        out.append((first + k, " ".join(w)))
    return out


def test_ngram_join(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)  # nothing is broadcast; the next test broadcasts
    rows = awkward_docs()
    rng = random.Random(5)
    more = [(i, t) for i, t, *_ in rows]
    for k, (words, copies, edits) in enumerate([(9, 12, 1), (11, 12, 1), (15, 12, 1), (25, 20, 3), (60, 60, 8), (120, 40, 12), (400, 15, 30), (1500, 6, 60)]):
        more += family(rng, 1000 * (k + 1), copies, words, copies, edits)
    rng.shuffle(more)
    docs = spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "'x' AS node", "1 AS key", "2 AS n", "3 AS row")
    assert joined(docs) == brute_components(more)


def test_ngram_join_at_another_threshold(spark):
    rng = random.Random(6)
    rows = [r for k in range(5) for r in family(rng, 100 * k, 25, rng.randint(8, 80), 25, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs, similarity=80, size=2) == brute_components(rows, 80, 2)


def test_ngram_join_of_empty_tables(spark):
    assert joined(documents(spark, [])) == []
    assert joined(documents(spark, [(1, None, "en", "a", 0), (2, "", "en", "a", 0)])) == [(1, 0, 1), (2, 0, 2)]


def test_linked_sets_share_a_key_and_pass_every_bound():
    import numpy as np
    rng = np.random.default_rng(2)
    for _ in range(3000):
        n = int(rng.integers(3, 150))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.05], rng.integers(0, 1 << 60, int(rng.integers(0, 1 + n // 15))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < 90 * (len(a) + len(b) - common):
            continue
        low = np.array(J.bands(90, J._UPTO))
        keys = []
        for s in (a, b):
            band = int(np.searchsorted(low, len(s), "right")) - 1
            keys.append((set(J.segment_keys(s, band, 90, J._UPTO).tolist()), set(J.segment_keys(s, band - 1, 90, J._UPTO).tolist()) if band else set()))
        (la, ua), (lb, ub) = keys
        assert np.array_equal(a, b) or la & lb or la & ub or ua & lb
        apart = sum(int(x).bit_count() for x in (J.parity(a) ^ J.parity(b)).view(np.uint64))
        assert apart <= len(a) + len(b) - 2 * common


def test_union_bounds(spark):
    import numpy as np
    from pyspark.sql import functions as F
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 60, int(n)).astype(np.uint64)) for n in rng.integers(280, 310, 30)]
    rows = [(k // 3, len(s), J.union_bits(s).tolist()) for k, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "group long, n long, bits array<long>")
    unions = {r.group: r for r in J.matrix(members).collect()}
    asks = members.withColumn("set", F.monotonically_increasing_id()).crossJoin(J.matrix(members).select(F.col("group").alias("g"), F.col("bits").alias("union")))
    for r in asks.select("group", "n", "g", J.outside(F.col("bits"), F.col("union")).alias("out")).collect():
        assert r.out == 0 if r.group == r.g else r.out <= r.n
    assert all(unions[k // 3].least <= len(s) <= unions[k // 3].most for k, s in enumerate(sets))
    far = asks.filter("group <> g").agg(F.min(J.outside(F.col("bits"), F.col("union")) / F.col("n")).alias("x")).first().x
    assert far > 0.1


# ---------------------------------------------------------------- spelling variants

def brute_words(rows, least=7):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(rows):
    n = brute_words(rows)
    form, count = {}, {}
    for w in n:
        others = sorted((-n[v], v) for v in n if v != w and near(v, w))
        count[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


def spelled(docs):
    return sorted(tuple(r) for r in S.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())


def misspelled(rng, w, letters):
    at = rng.randrange(len(w))
    return w[:at] + rng.choice(["", rng.choice(letters), w[at] + rng.choice(letters)]) + w[at + 1:]


@pytest.mark.parametrize("blocks,table", [(4 << 20, 200_000), (60, 3)])
def test_variants(spark, monkeypatch, blocks, table):
    monkeypatch.setattr(S, "FILTER_BLOCKS", blocks)
    monkeypatch.setattr(S, "TABLE_WORDS", table)
    rng = random.Random(9)
    words = ["zoëforms", "Éclairée", "committee", "occurrence", "aaaaaaaaa", "needlessly", "international", "zzzzzzz"]
    rows = [(i, t) for i, t, *_ in awkward_docs()]
    for k in range(40):
        text = []
        for w in words:
            text += [w] * rng.randint(0, 12)
            for _ in range(2):
                x = misspelled(rng, w, "aeiszéÿ")
                text += [x, x.upper(), misspelled(rng, x, "aeisÉ")]
        rng.shuffle(text)
        rows.append((100 + k, rng.choice([" ", ", ", "\n", "1"]).join(text)))
    rows.append((900, " ".join(["chainedword"] * 600 + ["chainedwird"] * 40 + ["chaimedwird"] * 3)))  # a form of a form
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS root").repartition(4)
    got = spelled(docs)
    assert got == brute_variants(rows)
    assert any(f for _, f, *_ in got) and any(f and r != f for _, f, r, *_ in got)
    assert len({len(w) for w, *_ in got}) > 5


def test_variants_of_empty_tables_and_nulls(spark):
    assert spelled(spark.createDataFrame([], "doc_id long, text string")) == []
    rows = [(1, None), (2, ""), (None, "abcdefgh abcdefgh abcdefgi abcdefgi"), (3, "abcdefgh " * 40)]
    assert spelled(spark.createDataFrame(rows, "doc_id long, text string")) == brute_variants(rows)


def test_passes_cover_every_block_once():
    blocks = {7: 3, 8: 11, 9: 1, 12: 6}
    for most in (1, 4, 5, 100):
        got = S.passes(blocks, most)
        assert all(sum(b - a for _, a, b in p) <= most for p in got)
        assert sorted((k, x) for p in got for k, a, b in p for x in range(a, b)) == sorted((k, x) for k, n in blocks.items() for x in range(n))


def test_queries_equal_their_sql(spark):
    """The registered queries of operators 5, 11 and 12 on whole tables against DuckDB."""
    import duckdb

    from lakescope.llm import queries as Q
    from tools.oracle_check import rows_of

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in Q.ORACLE.items():
        assert rows_of(Q.QUERIES[name](spark, sf).toPandas(), 9) == rows_of(con.execute(sql).fetchdf(), 9), name
