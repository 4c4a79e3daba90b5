"""Operator 6: byte-level BPE encoding and decoding, long texts by tree concatenation.

The ids equal those of the tokenizers library for the whole text. A text longer than ``leaf_chars`` is
halved until its pieces fit; the pieces are rows of their own, which Spark spreads over tasks and encodes
in parallel. Neighbouring pieces are then joined level by level: a window of tokens around the join is
encoded anew and grows until its first and last token equal the tokens that stood there before. All pairs
of adjacent tokens then occur in an encoding made by the library, which determines the whole.

Why that is exact: inside a pre-token a sequence of BPE tokens is the encoding of its bytes if each
adjacent pair is the encoding of the pair's bytes; and the pre-token pattern looks back at nothing, so
equal tokens at a window's end mean equal pre-token ends from there on. A special token's string that a cut
divides lies inside the first window, which spans ``GUARD`` bytes on both sides.

Inside a piece, text is cut where the pattern always starts a pre-token: before a blank that follows a
visible character, and in texts of Latin-1 also where a run of letters ends. The library encodes the cuts;
two bounded tables, the current one and the one before, keep their ids.

Defined cases: null text encodes as empty; an empty text has no ids; ids come as little-endian unsigned
32-bit integers in a binary column; repeated rows come back as often; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece; longer texts are halved. Units kept in a task's table of encoded cuts.
LEAF_CHARS, TABLE_UNITS = 32_768, 350_000
#: Bytes on both sides of a join that the first window spans; above any special token's length.
GUARD = 64
#: Bytes of output that a task hands over at once.
BATCH_BYTES = 8 << 20

#: The letters of Latin-1; in a text of Latin-1 alone, words with their blank and what stands between them.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_PIECE = re.compile(f" ?[{_LETTERS}]+|(?:[^{_LETTERS} ]| (?![{_LETTERS}]))+[{_LETTERS}]*")
_WIDE = re.compile("[^\\x00-\\xff]")
_CUT = re.compile("(?<=[^\\s᠎])(?= )")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 characters for
    themselves, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Encodes and decodes with one tokenizer file; made once in each Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            special = {t["id"]: t["content"] for t in json.load(f).get("added_tokens", [])}
        of = byte_alphabet()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [special.get(i) or self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [n.encode() if i in special else bytes(of[c] for c in n) for i, n in enumerate(names)]
        self.size, self.special, self.table, self.older = size, list(special.values()), {}, {}

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """Ids of a text of any length, as bytes; every distinct cut is encoded by the library."""
        if not text:
            return b""
        units = _CUT.split(text) if _WIDE.search(text) or any(x in text for x in self.special) else _PIECE.findall(text)
        got = list(map(self.table.get, units))
        if None in got:
            self._learn({u for u, g in zip(units, got, strict=True) if g is None})
            got = [self.table[u] for u in units]
            if len(self.table) > TABLE_UNITS:
                self.table, self.older = {}, self.table
        return b"".join(got)

    def _learn(self, units: set[str]) -> None:
        """Brings units into the table: from the table before it, or encoded by the library."""
        known = {u: g for u in units if (g := self.older.get(u)) is not None}
        new = list(units - known.keys())
        self.table.update(known)
        for i in range(0, len(new), TABLE_UNITS):
            some = new[i : i + TABLE_UNITS]
            coded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.table.update(zip(some, (np.array(e.ids, "<u4").tobytes() for e in coded), strict=True))

    def decode(self, ids: bytes) -> str:
        size, of = self.size, self.bytes
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist() if i < size]).decode("utf-8", "replace")

    def join(self, left: bytes, right: bytes) -> bytes:
        """The encoding of two neighbouring texts from theirs: windows around the join grow until both
        sides agree."""
        a, b = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
        if not len(a) or not len(b):
            return left + right
        i, j = self._reach(a[::-1], 4), self._reach(b, 4)
        while True:
            i, j = self._whole(a, len(a) - i, -1), self._whole(b, j, 1)
            head, tail = a[i:].tolist(), b[:j].tolist()
            new = self._plain(b"".join(self.bytes[x] for x in head + tail).decode("utf-8"))
            agree = (i == 0 or new[:1] == head[:1], j == len(b) or new[-1:] == tail[-1:])
            if all(agree) or (i == 0 and j == len(b)):
                return a[:i].tobytes() + np.array(new, "<u4").tobytes() + b[j:].tobytes()
            i, j = len(head) * (1 if agree[0] else 2), len(tail) * (1 if agree[1] else 2)
            i, j = min(i, len(a)), min(j, len(b))

    def _reach(self, ids, least: int) -> int:
        """How many ids from the start span GUARD bytes, ``least`` at least."""
        n, k = 0, 0
        while k < len(ids) and (n < GUARD or k < least):
            n, k = n + len(self.bytes[ids[k]]), k + 1
        return k

    def _whole(self, ids, at: int, step: int) -> int:
        """The next place from ``at`` where no character is divided."""
        while 0 < at < len(ids) and 0x80 <= self.bytes[ids[at]][0] < 0xC0:
            at += step
        return at

    def tree(self, pieces: list[bytes]) -> bytes:
        """Joins the encodings of a text's pieces, pair by pair, level by level."""
        while len(pieces) > 1:
            pieces = [self.join(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0] if pieces else b""


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def halves(text: str, leaf_chars: int) -> list[str]:
    """The pieces that halving a text gives until each has at most ``leaf_chars`` characters."""
    n = 1
    while len(text) > n * leaf_chars:
        n *= 2
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def in_batches(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size from rows."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weigh(r)
        if size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _encode_rows(path: str, schema: pa.Schema, text_at: int):
    def run(batches):
        c = coder(path)

        def rows():
            for batch in batches:
                cols = [batch.column(k) for k in range(batch.num_columns)]
                for i in range(batch.num_rows):
                    r = [x[i].as_py() for x in cols]
                    r[text_at] = c.encode(r[text_at] or "")
                    yield tuple(r)

        yield from in_batches(rows(), schema, lambda r: len(r[text_at]) + 64)
    return run


def _cut_rows(leaf_chars: int, schema: pa.Schema):
    def run(batches):
        def rows():
            for batch in batches:
                for i, t, h in zip(*(batch.column(k) for k in range(3)), strict=True):
                    pieces = halves(t.as_py(), leaf_chars)
                    for k, p in enumerate(pieces):
                        yield i.as_py(), h.as_py(), len(pieces), k, p

        yield from in_batches(rows(), schema, lambda r: 4 * len(r[4]) + 64)
    return run


def _join_rows(path: str, schema: pa.Schema):
    def run(batches):
        c = coder(path)

        def rows():
            for batch in batches:
                for i, parts, times in zip(*(batch.column(k) for k in range(3)), strict=True):
                    ids = c.tree([p["ids"] for p in sorted(parts.as_py(), key=lambda p: p["no"])])
                    for _ in range(times.as_py()):
                        yield i.as_py(), ids

        yield from in_batches(rows(), schema, lambda r: len(r[1]) + 64)
    return run


def encode(docs: DataFrame, tokenizer: str | None = None, leaf_chars: int = LEAF_CHARS,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): every whole text's ids. ``tokenizer`` is a path that executors can read."""
    path = tokenizer or default_tokenizer()
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    ddl = "doc_id long, ids binary"
    whole = d.filter(F.length("text") <= leaf_chars).mapInArrow(_encode_rows(path, out, 1), ddl)
    # a text is named by its id, hash and number of pieces; rows that are alike in all are one, counted
    cut = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int32()), ("no", pa.int32()), ("ids", pa.string())])
    pieces = d.filter(F.length("text") > leaf_chars).select("doc_id", "text", F.xxhash64("text", F.length("text")).alias("hash")).mapInArrow(
        _cut_rows(leaf_chars, cut), "doc_id long, hash long, n int, no int, piece string")
    alike = pieces.groupBy("doc_id", "hash", "n", "no").agg(F.first("piece").alias("piece"), F.count(F.lit(1)).alias("times"))
    coded = cut.set(4, pa.field("ids", pa.binary())).append(pa.field("times", pa.int64()))
    parts = alike.select("doc_id", "hash", "n", "no", "piece", "times").mapInArrow(
        _encode_rows(path, coded, 4), "doc_id long, hash long, n int, no int, ids binary, times long")
    joined = parts.groupBy("doc_id", "hash", "n").agg(F.collect_list(F.struct("no", "ids")).alias("parts"), F.max("times").alias("times"))
    long = joined.select("doc_id", "parts", "times").mapInArrow(_join_rows(path, out), ddl)
    return whole.unionByName(long)


def decode(coded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Adds ``text``, decoded from the binary column ``ids``, to (doc_id, ids)."""
    path = tokenizer or default_tokenizer()
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches):
        c = coder(path)

        def rows():
            for batch in batches:
                for i, ids in zip(batch.column(0), batch.column(1), strict=True):
                    raw = ids.as_py() or b""
                    yield i.as_py(), raw, c.decode(raw)

        yield from in_batches(rows(), out, lambda r: 2 * len(r[1]) + 64)

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, after encoding and decoding it."""
    back = decode(encode(docs, tokenizer), tokenizer)
    return back.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
