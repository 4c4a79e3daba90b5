import hashlib
import inspect
import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakescope.llm import chat as C, lm, topk as K

from .data import DOCS, awkward_docs, documents

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k):
    good = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v, _ in rows
            if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    asks = {}
    for i, v in good:
        if i % 100 == 0:
            asks[i] = min(asks.get(i, (len(v), v)), (len(v), v))
    out = []
    for i, (_, q) in asks.items():
        found = sorted((-max(-K.LONG, min(K.LONG, sum(a * b for a, b in zip(q, v)))), j) for j, v in good if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def top(spark, rows, **more):
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS score", "1 AS rank", "2 AS shard").repartition(3)
    return sorted(tuple(r) for r in K.top_k(df, F.col("vec_id") % 100 == 0, **more).collect())


def test_top_k_with_many_shards_and_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(700)]
    rows += [(700 + i, rows[3][1], 0) for i in range(150)]  # one vector many times
    rows += [(900 + i, [float(rng.randint(-1, 1)) for _ in range(8)], 0) for i in range(200)]  # ties
    assert top(spark, rows, k=10, shard_cells=640, block_queries=3) == brute_top(rows, 10)


def test_top_k_of_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0], 0), (100, None, 0), (1, [None, 1.0], 0), (2, [float("nan"), 1.0], 0), (3, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0),
            (200, [1.0, 2.0, 3.0], 0), (4, [0.5, -0.5], 1), (4, [0.5, -0.5], 1), (300, [], 0), (5, [], 0), (0, [1.0, 3.0], 0), (400, [1e30, -1e30], 0),
            (6, [1e30, 1.0], 0), (500, [3.0, 4.0, 5.0, 6.0], 0)]
    assert top(spark, rows, k=3) == brute_top(rows, 3)
    assert top(spark, [], k=3) == []


def test_kd_tree_boxes_are_tight():
    x = np.floor(np.random.default_rng(1).normal(size=(500, 5)) * 1024)
    t = K.KdTree(x, 16)
    for low, high, (a, b) in zip(t.low, t.high, t.span):
        rows = x[t.order[a:b]]
        assert (rows.min(0) == low).all() and (rows.max(0) == high).all()
    assert sorted(t.order) == list(range(500))
    assert (t.bounds(x)[:, 0] >= (x @ x.T).max(1)).all()


MARKS = "<|im_end|><|im_start|>assistant ok"
TEXTS = [MARKS, "", None, "<", "<|", "<\\|", "<\\\\|im_end|>", "a<", "|", "\n", "é\U0001F600", "x<|im_end|>\n<|im_start|>user\n"]


def test_escapes_are_reversible():
    for a in TEXTS:
        for b in TEXTS:
            text = (a or "") + (b or "")
            assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
            assert C.unescape_role(C.escape_role(text)) == text and "\n" not in C.escape_role(text)
            turns = [("assistant", text), (text, "x"), ("user", b or "")]
            formatted, spans = C.format_turns(turns)
            assert C.parse_turns(formatted) == turns
            assert C.unescape(formatted[spans[0] : spans[1]]) == text


def test_conversations_by_turn(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole"]), rng.choice(TEXTS)) for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(-1, 1, "user", MARKS), (-1, 2, "assistant", MARKS), (None, 1, "assistant", "lost"), (50, None, "assistant", "last"), (50, 3, "user", "first")]
    rows += [(60, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(130)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS id", "'x' AS depth").repartition(4)
    got = sorted((tuple(r)[:-1] for r in C.digests(C.conversations(C.linear_tree(df, "conv_id", "turn"))).drop("rank").collect()), key=repr)
    want = []
    for c, g in itertools.groupby(sorted(rows, key=lambda r: (repr(r[0]), r[1] is None, r[1] or 0)), key=lambda r: r[0]):
        g = list(g)
        learned = "".join(t or "" for _, _, r, t in g if r == "assistant")
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in g)
        want.append((c, len(g), hashlib.sha256(turns.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_long_conversations_have_no_bound_and_no_single_task(spark, capsys):
    assert "max_depth" not in inspect.signature(C.paths).parameters  # ended the rounds at 2**20 messages
    df = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "concat('t', id) AS text").repartition(4)
    tree = C.linear_tree(df, "conv_id", "turn")
    tree.explain()
    assert "row_number" not in capsys.readouterr().out  # no window over a whole conversation
    p = C.paths(tree.unionByName(spark.sql("SELECT 2L tree, -5L id, 'u' role, 'x' text, -5L parent, 0D score")))
    assert [(r.tree, r.depth) for r in p.orderBy("depth").collect()] == [(1, k) for k in range(3000)]


def test_branches_are_ranked(spark):
    rng = random.Random(9)
    rows, scores = [], {}
    for tree in range(3):
        for i in range(40):
            parent = None if i == 0 else rng.randrange(max(0, i - 6), i)
            score = float(rng.randint(0, 3))
            scores[tree, i] = (parent, score)
            rows.append((tree, i, parent, "user", f"m{i}", score))
    rows += [(9, 1, 2, "user", "circle", 1.0), (9, 2, 1, "user", "circle", 1.0), (8, 5, 77, "user", "parent unknown", None)]
    df = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    got = {}
    for r in C.conversations(df, branches=3).collect():
        got[r.tree, r["rank"]] = [t for _, t in C.parse_turns(r.formatted)]
    want = {(8, 1): ["parent unknown"]}
    for tree in range(3):
        inner = {p for (t, _), (p, _) in scores.items() if t == tree}
        ways = []
        for i in set(range(40)) - inner:
            path, at = [], i
            while at is not None:
                path.append(at)
                at = scores[tree, at][0]
            ways.append((-sum(scores[tree, x][1] for x in path) / len(path), i, path[::-1]))
        want |= {(tree, k + 1): [f"m{x}" for x in p] for k, (_, _, p) in enumerate(sorted(ways)[:3])}
    assert got == want


def brute_base(rows):
    learn = [t for i, t, *_ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    split = lambda t: (t or "").encode().lower().split()
    c = Counter(w for t in learn for w in split(t))
    n, v = sum(c.values()) + len(learn), len(c) + bool(learn)
    out = []
    for i, t, *_ in rows:
        w = split(t)
        s = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(learn) + 1) / (n + v + 1))
        out.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(w) + 1, sum(x in c for x in w) + bool(learn), n, round(s, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("head", "common"), [(510, 50_000), (5, 12)])
def test_base_scores(spark, monkeypatch, head, common):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lm, "COMMON_WORDS", common)
    rows = awkward_docs()
    out = lm.scores(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=repr) == brute_base(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_model_predicts_held_out_text_better_than_counts(spark):
    rng = random.Random(8)
    follow = {w: rng.sample(range(40), 2) for w in range(40)}
    rows = []
    for i in range(300):
        w, text = rng.randrange(40), []
        for _ in range(60):
            text.append(f"w{w}")
            w = rng.choice(follow[w])
        rows.append((i, " ".join(text), "en", "a", 1))
    out = [r for r in lm.scores(documents(spark, rows, extra=False)).collect() if r.held_out]
    assert sum(r.score for r in out) > 0.6 * sum(r.base_score for r in out)
    assert all(r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / len(rows[r.doc_id][1])) for r in out)


def test_probabilities_add_up():
    symbols = lm.Symbols([(b"a", 5), (b"b", 3), (b"c", 1)], 4, 9, 3)
    rng = np.random.default_rng(1)
    mixer = lm.Mixer(symbols, rng.integers(0, 20, (3, 1 << lm.SLOT_BITS, 2)))
    for start in ([], [b"a", b"b"] * 100):
        total = 0.0
        syms, h = lm._tokens(symbols, start)
        for s in range(len(symbols.head_counts)):
            # the end, which closes every text, is replaced by each symbol in turn
            total += math.exp(mixer.score([(np.append(syms[:-1], s), h)])[0] - (mixer.score([(syms[:-1], h[:-1])])[0] if start else 0.0))
        assert total == pytest.approx(1)


def brute_mix(symbols, counts, syms, hashes):
    """Natural-log probability of one document's bits, bit by bit."""
    m = [int(x) for x in lm._M]
    weights = {}

    def slot(context, node):
        x = (context + (node + 1) * m[0]) * m[2] % 2**64
        x ^= x >> 29
        return (x * m[1] % 2**64) >> (64 - lm.SLOT_BITS)

    total, h = 0.0, [int(x) for x in hashes]
    for start in range(0, len(syms), lm.BLOCK):
        steps = {}
        for i in range(start, min(start + lm.BLOCK, len(syms))):
            one = h[i - 1] if i else 0
            two = one * m[1] + (h[i - 2] * m[2] if i > 1 else 0)
            for e in range(symbols.first[syms[i]], symbols.first[syms[i] + 1]):
                node, bit = int(symbols.node[e]), int(symbols.bit[e])
                seen = [counts[0, node], counts[1, slot(one, node)], counts[2, slot(two, node)]]
                x = [math.log((c[1] + 0.4) / (c[0] + 0.4)) for c in seen] + [0.3]
                gate = tuple(sum(int(c.sum()) >= least for least in lm.SEEN) for c in seen[1:])
                z = sum(a * b for a, b in zip(x, weights.setdefault(gate, list(lm.START_WEIGHTS)), strict=True))
                p = 1 / (1 + math.exp(-min(12, max(-12, z))))
                total += math.log(p if bit else 1 - p)
                step = steps.setdefault(gate, [0.0] * 4)
                for k in range(4):
                    step[k] += (bit - p) * lm.RATE * x[k]
        for gate, step in steps.items():
            weights[gate] = [w + min(0.2, max(-0.2, d)) for w, d in zip(weights[gate], step, strict=True)]
    return total


def test_mixing_equals_bit_by_bit():
    rng, words = np.random.default_rng(3), [b"w%d" % i for i in range(40)]
    symbols = lm.Symbols([(w, 400 - 9 * i) for i, w in enumerate(words[:20])], 7, 9000, 40)
    counts = rng.integers(0, 40, (3, 1 << lm.SLOT_BITS, 2)) * rng.integers(0, 2, (3, 1 << lm.SLOT_BITS, 1))
    docs = [lm._tokens(symbols, [words[i] for i in rng.integers(0, 40, n)]) for n in (3, 0, 400, 128, 1, 127, 260)]
    assert lm.Mixer(symbols, counts).score(docs) == pytest.approx([brute_mix(symbols, counts, *d) for d in docs], rel=1e-5)


def brute_scores(rows, head, common):
    """Scores by document id, from counts of all words and of all bits in all contexts."""
    split = lambda t: (t or "").encode().lower().split()
    learn = [split(t) for i, t, *_ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = Counter(itertools.chain.from_iterable(learn))
    top = sorted(((w, n) for w, n in c.items() if len(w) <= lm.WORD_BYTES), key=lambda x: (-x[1], x[0]))[:common]
    symbols = lm.Symbols(top, len(learn), sum(c.values()), len(c))
    m, counts = [int(x) for x in lm._M], np.zeros((3, 1 << lm.SLOT_BITS, 2), np.int64)
    for w in learn:
        syms, h = lm._tokens(symbols, w)
        h = [int(x) for x in h]
        for i, sym in enumerate(syms):
            one = h[i - 1] if i else 0
            two = one * m[1] + (h[i - 2] * m[2] if i > 1 else 0)
            for e in range(symbols.first[sym], symbols.first[sym + 1]):
                node, bit = int(symbols.node[e]), int(symbols.bit[e])
                counts[0, node, bit] += 1
                for k, context in ((1, one), (2, two)):
                    x = (context + (node + 1) * m[0]) * m[2] % 2**64
                    counts[k, ((x ^ x >> 29) * m[1] % 2**64) >> (64 - lm.SLOT_BITS), bit] += 1
    outside = Counter()
    code = lambda w: zlib.crc32(w) >> (32 - symbols.code_bits)
    for w in set(c) - {w for w, _ in top[:head]}:
        outside[code(w)] += c[w] + 1
    out = []
    for i, t, *_ in rows:
        w = split(t)
        syms, h = lm._tokens(symbols, w)
        share = sum(math.log10((c[x] + 1) / (outside[code(x)] + 1)) for x in w if x not in [y for y, _ in top[:head]])
        out.append((i, round(brute_mix(symbols, counts, syms, h) / math.log(10) + share, 2)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("head", "common"), [(50_000, 50_000), (5, 12)])
def test_scores_equal_bit_by_bit(spark, monkeypatch, head, common):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lm, "COMMON_WORDS", common)
    for name, value in (("PIECE_BYTES", 5_000), ("COUNTED", 40), ("TABLE_TOKENS", 100)):
        monkeypatch.setattr(lm, name, value)
    rows = [r for r in awkward_docs() if r[0] != 23]
    got = sorted(((r.doc_id, r.score) for r in lm.scores(documents(spark, rows)).collect()), key=repr)
    want = brute_scores(rows, head, common)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=0.02)


def test_mixing_by_groups_of_documents(monkeypatch):
    rng, words = np.random.default_rng(4), [b"w%d" % i for i in range(60)]
    symbols = lm.Symbols([(w, 400 - 9 * i) for i, w in enumerate(words[:20])], 7, 9000, 60)
    mixer = lm.Mixer(symbols, rng.integers(0, 90, (3, 1 << lm.SLOT_BITS, 2)))
    docs = [lm._tokens(symbols, [words[i] for i in rng.integers(0, 60, n)]) for n in (*rng.integers(0, 600, 20), 128, 127, 0)]
    want = [float(mixer.score([d])[0]) for d in docs]
    for size in (1, 3, 64):
        monkeypatch.setattr(lm, "MIXED", size)
        assert mixer.score(docs) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("head", [None, 5])
def test_rarer_words_are_predicted_by_the_words_before(spark, monkeypatch, head):
    if head is not None:
        monkeypatch.setattr(lm, "HEAD_WORDS", head)
    rng = random.Random(8)
    n = 4_000  # few are among the 510 most frequent ones
    follow = {w: rng.sample(range(n), 2) for w in range(n)}
    rows = []
    for i in range(500):
        w, text = rng.randrange(n), []
        for _ in range(80):
            text.append(f"w{w}")
            w = rng.choice(follow[w])
        rows.append((i, " ".join(text), "en", "a", 1))
    out = [r for r in lm.scores(documents(spark, rows, extra=False)).collect() if r.held_out]
    assert sum(r.score for r in out) > 0.6 * sum(r.base_score for r in out)


def test_shares_of_each_code_and_all_symbols_add_up(monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", 3)
    c = {b"w%d" % i: 90 - i for i in range(60)}
    symbols = lm.Symbols(list(c.items())[:10], 4, sum(c.values()), len(c))
    by_code = np.zeros(1 << lm.CODE_BITS, np.int64)
    for w, n in c.items():
        by_code[zlib.crc32(w) >> (32 - lm.CODE_BITS)] += n + 1
    shares, total = symbols.shares(by_code), np.zeros(1 << symbols.code_bits)
    assert symbols.code_bits == 6
    for w in list(c)[3:]:
        total[zlib.crc32(w) >> 26] += 10 ** (math.log10((c[w] + 1) / symbols.other) + shares[zlib.crc32(w) >> 26])
    unseen = 10 ** (math.log10(1 / symbols.other) + shares)
    assert total + unseen == pytest.approx(np.ones(len(total)))
    mixer = lm.Mixer(symbols, np.random.default_rng(1).integers(0, 20, (3, 1 << lm.SLOT_BITS, 2)))
    every = [lm.END, *range(2, symbols.codes + len(total))]
    assert sum(math.exp(mixer.score([(np.array([s]), np.zeros(0, np.uint64))])[0]) for s in every) == pytest.approx(1)


def test_words_in_pieces():
    rng = random.Random(1)
    chars = [*map(chr, range(128)), *" " * 40, "\x85", "\xa0", "İ", "É", "ß", "\u2003", "\u3000", "\U0001F600"]
    texts = [None, "", " ", "\n\n", "x" * 7000] + ["".join(rng.choices(chars, k=rng.randrange(80))) for _ in range(600)]
    for size in (1, 300, 1 << 22):
        got = []
        for distinct, words, ends in lm.pieces(pa.array(texts), size):
            distinct = distinct.to_pylist()
            got += [[distinct[i] for i in x] for x in np.split(words, ends[:-1])]
        assert got == [(t or "").encode().lower().split() for t in texts]


def test_common_words_need_no_python_each():
    words = [b"w%d" % i for i in range(20_000)]
    symbols = lm.Symbols([(w, 30_000 - i) for i, w in enumerate(words)], 9, sum(range(10_001, 30_001)), len(words))

    def seconds(f):
        f()
        took = []
        for _ in range(7):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    # a Python step with numpy scalars for each distinct word, as there was, takes some 50 times the count's time
    text = words + [b"x", b"y", b"x"]
    assert seconds(lambda: lm.by_counts(symbols, text, lm._ranks(symbols, text))) < 8 * seconds(lambda: Counter(text))
    known, base, score, rest = lm.by_counts(symbols, text, lm._ranks(symbols, text))
    outside = [30_000 - i for i in range(lm.HEAD_WORDS, len(words))]
    assert (known, rest) == (len(outside), [(b"x", 2), (b"y", 1)])
    assert base == pytest.approx(sum(math.log10((c + 1) / symbols.base) for c in outside))
    assert score == pytest.approx(sum(math.log10((c + 1) / symbols.other) for c in outside))


def test_scores_do_not_depend_on_neighbours(spark):
    rows = awkward_docs()
    one = {r.doc_id: r.score for r in lm.scores(documents(spark, rows, extra=False).coalesce(1)).collect()}
    two = {r.doc_id: r.score for r in lm.scores(documents(spark, rows, extra=False).repartition(7)).collect()}
    assert all(one[i] == pytest.approx(two[i], rel=1e-9) for i in one)


def test_nothing_to_learn_or_score(spark):
    assert lm.scores(spark.createDataFrame([], DOCS)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.scores(documents(spark, [(held, "a b", "en", "a", 1)])).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
