import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline as P
from lakescope.llm import bpe, queries

from .data import DOCS, WORD, documents
from .test_dedup import brute_components, brute_lines
from .test_mixing import fill
from .test_quality_licenses import base

LABELS = "doc_id long, quality int, toxic int"


def folder(spark, tmp_path, rows):
    documents(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def brute(rows):
    """All stages but the shuffled choice of the mix: the documents before it, and each source's target."""
    rows = [r for r in rows if not (base(r[1])[0] < 10 or 100 * base(r[1])[4] > 20 * base(r[1])[0])]
    lines = {}
    for i, text, _, exact, near in brute_lines(rows):
        if not exact + near or WORD.findall(text or ""):
            lines[i] = text
    rows = [(r[0], lines[r[0]], *r[2:]) for r in rows if r[0] in lines]
    kept = {r[0] for r in brute_components(rows) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    return rows, fill(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, 3, sum(sizes.values()))


def test_stages_and_rows_against_brute_force(spark, tmp_path):
    from .data import awkward_docs

    rows = [r for r in awkward_docs() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    sf = folder(spark, tmp_path, rows)
    want, targets = brute(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        if k < len(P.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    assert sorted((r.doc_id, r.text) for r in seen["near_dedup"]) == sorted((r[0], r[1]) for r in want)
    by_id = {r[0]: r for r in want}
    mixed = Counter(r.doc_id for r in seen["mix_sources"])
    for s, target in targets.items():
        docs_of = [r for r in want if r[3] == s]
        got = sum(mixed[r[0]] * len(WORD.findall(r[1])) for r in docs_of)
        assert abs(got - target) <= max(len(WORD.findall(r[1])) for r in docs_of)
    c = bpe.coder(bpe.default_tokenizer())
    sha = lambda i: hashlib.sha256(np.array(c.tokenizer.encode(by_id[i][1], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    final = Counter((r.doc_id, r.ids_sha256) for r in P.run(spark, sf).collect())
    assert final == Counter({(i, sha(i)): n for i, n in mixed.items()})
    assert Counter((r.doc_id, r.ids_sha256) for r in seen["bpe"]) == final


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
