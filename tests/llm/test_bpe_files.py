import hashlib
import random
import zlib

import numpy as np
import pytest

from lakescope.llm import bpe, token_files as T

from .data import DOCS, awkward_docs, documents


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(bpe.default_tokenizer())


def library(coder, text):
    return coder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_cuts_and_joins_equal_the_library(coder):
    rng = random.Random(3)
    alphabets = [list("ab cde'stmlr 12 \n\t!?.é"), list("aaaab"), list(" \n"), list("!'s"), ["<|endoftext|>", " ", "x", "<|endof", "text|>"],
                 ["é", "ü", "漢", "😀", " ", "a"], [" ", " ", "a", "᠎", "　", "1"], list("é a\n ö, 1're "), list("012345 ")]
    for _ in range(1500):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 250)))
        want = np.array(library(coder, text), "<u4").tobytes()
        assert coder.encode(text) == want
        assert coder.tree([coder.encode(p) for p in bpe.halves(text, rng.choice([1, 3, 7, 40]))]) == want
        assert coder.decode(want) == text


def test_long_unsplit_text(coder):
    rng = random.Random(4)
    for unit in ("ab", "é", " ", "!", "\n"):
        text = "".join(rng.choice([unit, unit + "x"[: rng.random() < 0.01]]) for _ in range(6000))
        want = np.array(library(coder, text), "<u4").tobytes()
        assert coder.tree([coder.encode(p) for p in bpe.halves(text, 500)]) == want


def test_tables_are_bounded(coder, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_UNITS", 20)
    for k in range(30):
        text = " ".join(f"w{k}x{i}" for i in range(50))
        assert coder.encode(text) == np.array(library(coder, text), "<u4").tobytes()
    assert len(coder.table) <= 200


def test_round_trip_of_whole_texts(spark, coder):
    rows = awkward_docs()
    got = sorted(map(tuple, bpe.digests(documents(spark, rows)).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        ids = library(coder, t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_long_texts_are_joined_from_rows(spark, coder):
    rows = awkward_docs()
    got = sorted(((r.doc_id, bytes(r.ids)) for r in bpe.encode(documents(spark, rows), leaf_chars=64).collect()), key=repr)
    assert got == sorted(((i, np.array(library(coder, t), "<u4").tobytes()) for i, t, *_ in rows), key=repr)


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 20, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64)
        raw = T.pack(ids, bits)
        assert len(raw) == -(-n // 64) * bits * 8
        assert (T.unpack(raw, bits, n) == ids).all()


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    w = T.Writer(f"{tmp_path}/x.tokens", 17, block_ids=128)
    docs = [rng.integers(0, 1 << 17, n).astype(np.uint32) for n in (0, 5, 128, 1000, 1, 0, 300)]
    for i, d in enumerate(docs):
        w.add(None if i == 2 else i, d)
    w.close()
    r, every = T.Reader(f"file:{tmp_path}/x.tokens"), np.concatenate(docs)
    for a, b in ((0, 0), (0, len(every)), (3, 4), (127, 130), (1400, len(every))):
        assert (r.tokens(a, b) == every[a:b]).all()
    assert [(i, n) for i, _, n in ((i, s, len(x)) for i, s, x in r.documents())] == [(None if i == 2 else i, len(d)) for i, d in enumerate(docs)]


def test_files_of_awkward_documents(spark, coder):
    rows = awkward_docs()
    manifest = T.write(documents(spark, rows), files=4, block_ids=128)
    assert {r.bits for r in manifest.collect()} == {16}
    got = sorted((tuple(r) for r in T.read_files(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    want = sorted(((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in ((r[0], library(coder, r[1]) + [0]) for r in rows)), key=repr)
    assert sorted(((i, n, c) for i, _, n, c in got), key=repr) == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert bpe.digests(empty).count() == 0
    assert T.read_files(T.write(empty, files=2)).count() == 0
