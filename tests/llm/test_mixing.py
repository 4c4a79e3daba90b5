from collections import defaultdict

from lakescope.llm import mixing as M

from .data import CLASHING, DOCS, WORD, awkward_docs, documents


def fill(sizes, weights, repeats, budget):
    """Targets by sharing the rest again and again."""
    target = dict.fromkeys(sizes, 0.0)
    open_ = {s for s in sizes if sizes[s]}
    while open_:
        left = budget - sum(target[s] for s in sizes if s not in open_)
        share = left / sum(weights[s] for s in open_)
        above = {s for s in open_ if share * weights[s] >= repeats * sizes[s]}
        if not above:
            for s in open_:
                target[s] = share * weights[s]
            break
        for s in above:
            target[s] = repeats * sizes[s]
        open_ -= above
    return target


def mixed(spark, docs):
    d = M.sized(docs)
    sources = M.frozen(M.by_source(d))
    targets = M.frozen(M.source_targets(sources, M.cycling_weights(sources)))
    return d, targets, M.mix(d, targets)


def test_targets_and_shares(spark):
    rows = awkward_docs()
    d, targets, stream = mixed(spark, documents(spark, rows))
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, 3, sum(sizes.values()))
    key = {s: "" if s is None else f"={s}" for s in sizes}
    got = {r.source_key: r.target for r in targets.collect()}
    assert all(abs(got[key[s]] - want[s]) < 1e-6 for s in sizes)
    taken = defaultdict(int)
    for r in stream.collect():
        assert 0 < r.taken <= r.size and 0 <= r.epoch < 3
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())


def test_positions_run_through_and_reruns_agree(spark):
    one = sorted(mixed(spark, documents(spark))[2].drop("row").collect(), key=lambda r: r.position)
    at = 0
    for r in one:
        assert r.position == at
        at += r.taken
    assert [r.virtual_finish for r in one] == sorted(r.virtual_finish for r in one)
    two = sorted(mixed(spark, documents(spark).repartition(5))[2].drop("row").collect(), key=lambda r: r.position)
    assert one == two


def test_budget_truncates(spark):
    d, targets, _ = mixed(spark, documents(spark))
    assert sum(r.taken for r in M.mix(d, targets, budget=500).collect()) == 500


def test_whole_documents_keep_columns_and_repeated_rows(spark):
    rows = [(i, "a b c d", "en", "x", 7) for i in range(20)] + [(99, "a b", "en", "y", 3)] * 4
    docs = documents(spark, rows)
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    times = defaultdict(int)
    for r in out.collect():
        times[r.doc_id] += 1
        assert r["size"] == "clash"
    # y can send at most three times its 8 words, which is less than its share of two thirds
    assert times[99] == 12 and sum(v for k, v in times.items() if k != 99) == 16


def test_empty_and_blank_tables(spark):
    assert mixed(spark, documents(spark, []))[2].count() == 0
    assert mixed(spark, documents(spark, [(1, None, None, None, None), (2, " ", "en", "a", 1)]))[2].count() == 0
    assert M.mixed_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert CLASHING
