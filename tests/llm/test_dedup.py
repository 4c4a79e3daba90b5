import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lakescope.llm import line_dedup as D, near_dup as N

from .data import DOCS, WORD, awkward_docs, documents, sentence

PIECE = re.compile(r"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){1,128}")


def pieces(text):
    out = []
    for k, line in enumerate(text.split("\n")):
        out += [(k, x) for x in PIECE.findall(line)] if len(WORD.findall(line)) > D.PIECE_WORDS else [(k, line)]
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows):
    """Kept texts by comparing every line with every earlier distinct line."""
    first = {}
    for i, t, *_ in rows:
        for no, (_, x) in enumerate(pieces(t) if t is not None else []):
            w = tuple(WORD.findall(x))
            place = (i is None, i or 0, no)
            if len(w) >= D.EXACT_WORDS and (w not in first or place < first[w]):
                first[w] = place
    long = [w for w in first if len(w) >= D.NEAR_WORDS]
    near = {w for w in long if any(first[v] < first[w] and abs(len(v) - len(w)) <= 1 and edits(v, w) <= 1 for v in long)}
    out = []
    for i, t, *_ in rows:
        if t is None:
            out.append((i, None, 0, 0, 0))
            continue
        stay, exact, gone = [], 0, 0
        for no, (k, x) in enumerate(pieces(t)):
            w = tuple(WORD.findall(x))
            if w in near:
                gone += 1
            elif w in first and first[w] != (i is None, i or 0, no):
                exact += 1
            else:
                stay.append((k, x))
        text = "".join(("\n" if j and stay[j - 1][0] != k else "") + x for j, (k, x) in enumerate(stay))
        out.append((i, text, t.count("\n") + 1, exact, gone))
    return sorted(out, key=repr)


def cleaned(docs):
    return sorted(((r.doc_id, r.text, *r._lines) for r in D.deduplicated(docs).collect()), key=repr)


def test_lines_of_awkward_documents(spark):
    rows = awkward_docs()
    docs = documents(spark, rows)
    assert D.deduplicated(docs).columns == [*docs.columns, "_lines"]
    assert cleaned(docs) == brute_lines(rows)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_random_edits_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(D, "BROADCAST_DOCS", limit)
    rng = random.Random(11)
    lines = [sentence(rng, n).split() for n in (3, 4, 7, 8, 9, 9, 12, 20, 130)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"], [w[at]]])
                if not w:
                    w = ["x"]
            text.append("  ".join(w))
        rows.append((i, "\n".join(text), "en", "a", 1))
    # a template in which one word differs: all lines are one edit apart
    rows += [(100 + i, f"page {i} of the long report that all of these pages make", "en", "a", 1) for i in range(60)]
    got = cleaned(documents(spark, rows, extra=False))
    assert got == brute_lines(rows)
    assert sum(bool(r[1]) for r in got if r[0] >= 100) == 1


def test_short_lines(spark):
    lines = ["x", "a b", "a b c", "a b c d", "v w x y z"]
    near = ["a b c e", "v w x z"]  # one word replaced, one removed
    rows = [(1, "\n".join(lines), "en", "a", 1), (2, "\n".join([*lines, "", "a", "b a", *near, "new line here"]), "en", "a", 1)]
    assert cleaned(documents(spark, rows, extra=False)) == [(1, rows[0][1], 5, 0, 0), (2, "\na\nb a\nnew line here", 11, 5, 2)]


def test_long_lines_are_judged_whole(spark):
    rng = random.Random(4)
    w = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    two = [*w[:10], "x", *w[11:700], "y", *w[701:]]  # two edits
    lines = [w[:300], ["new", *w[:300]], w[:200] + w[201:300], w, [*w[:500], "z", *w[500:]], two, w[:129]]
    rows = [(i, " ".join(x), "en", "a", 1) for i, x in enumerate(lines)]
    drop = {1, 2, 4}
    assert cleaned(documents(spark, rows, extra=False)) == [(i, "" if i in drop else t, 1, 0, int(i in drop)) for i, t, *_ in rows]


def test_one_edit(spark):
    rng = random.Random(2)
    rows = [([rng.randint(0, 2) for _ in range(rng.randint(0, 6))], [rng.randint(0, 2) for _ in range(rng.randint(0, 6))]) for _ in range(300)]
    got = spark.createDataFrame(rows, "x array<long>, y array<long>").select("x", "y", D.one_edit(F.col("x"), F.col("y")).alias("same")).collect()
    assert all(r.same == (edits(r.x, r.y) <= 1) for r in got)


def test_no_lines(spark):
    assert D.deduplicated(spark.createDataFrame([], DOCS)).count() == 0
    assert cleaned(documents(spark, [(1, None, None, None, None), (2, "", "en", "a", 0)])) == [(1, None, 0, 0, 0), (2, "", 1, 0, 0)]


def shingle_set(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))


def brute_components(rows):
    sets = defaultdict(list)
    for i, t, *_ in rows:
        if i is not None and shingle_set(t):
            sets[shingle_set(t)].append(i)
    alike = list(sets)
    up = {s: s for s in alike}

    def top(s):
        while up[s] is not s:
            s = up[s]
        return s

    for k, x in enumerate(alike):
        for y in alike[:k]:
            if 100 * len(x & y) >= 75 * len(x | y):
                up[top(x)] = top(y)
    least = {}
    for s in alike:
        least[top(s)] = min(least.get(top(s), 1 << 60), *sets[s])
    out = []
    for i, t, *_ in rows:
        s = shingle_set(t)
        c = None if i is None else least[top(s)] if s else i
        out.append((i, len(s), c, i is None or i == c))
    return sorted(out, key=repr)


def found(docs):
    return sorted((tuple(r) for r in N.components(docs).collect()), key=repr)


def test_components_of_awkward_documents(spark):
    rows = awkward_docs()
    assert found(documents(spark, rows)) == brute_components(rows)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_near_copies_around_an_origin(spark, monkeypatch, limit):
    monkeypatch.setattr(N, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(N, "LARGE", 8)
    rng = random.Random(5)
    rows = []
    for g in range(3):
        origin = sentence(rng, 150).split()
        for k in range(50):
            w = list(origin)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((1000 * g + k, " ".join(w[: rng.choice([150, 150, 130, 112])]), "en", "a", 1))
    assert found(documents(spark, rows, extra=False)) == brute_components(rows)


def test_index_keys_are_shared_within_the_distance(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        a = [rng.randrange(1 << 16) for _ in range(N.SYMBOLS)]
        b = list(a)
        for k in rng.sample(range(N.SYMBOLS), N.DISTANCE):
            b[k] = (b[k] + rng.randrange(1, 1 << 16)) % (1 << 16)
        pack = lambda s: [int.from_bytes(b"".join(x.to_bytes(2, "little") for x in s[i : i + 4]), "little", signed=True) for i in range(0, N.SYMBOLS, 4)]
        rows.append((pack(a), pack(b)))
    keys = lambda c: F.transform(N.index_keys(F.col(c)), lambda k: k["key"])
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").withColumn("slots", N.index_keys(F.col("a")))
    got = df.select(N.distance(F.col("a"), F.col("b")).alias("d"), F.arrays_overlap(keys("a"), keys("b")).alias("met")).collect()
    assert all(r.d == N.DISTANCE and r.met for r in got)
    # of the keys that two signatures share, one is the first
    each = df.select("a", "b", F.explode("slots").alias("k")).filter(F.array_contains(keys("b"), F.col("k.key"))).withColumn("first", N.near_at(F.col("a"), F.col("b"), F.col("k.slot")))
    assert set(Counter((tuple(r.a), tuple(r.b)) for r in each.filter("first").collect()).values()) == {1}
    assert each.filter("first").count() == len(rows)


def test_one_of_each(spark):
    rows = awkward_docs()
    docs = documents(spark, rows)
    out = N.one_of_each(docs)
    assert out.columns == docs.columns
    keep = [r[0] for r in brute_components(rows) if r[3]]
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([i for i in keep if i != 17], key=repr)  # 17 repeats 5
    assert N.one_of_each(spark.createDataFrame([], DOCS)).count() == 0
    twice = documents(spark, [(1, "a b c d e f", "en", "a", 1)] * 3)
    assert N.one_of_each(twice).count() == 1
