"""Operator 13: spelling variants by Bloom-guided neighbourhoods.

Words are runs of letters, some with one letter deleted (``runs_of``). Each task counts its words and hands on
one row for each, so that a frequent word costs a row for each task. The vocabulary is what is left above
the least length and count.

Two words are near if they differ by one inserted, deleted or replaced code point. Each word's edits are made
as hashes, without strings: all deletions, and all replacements by a greater letter (the other direction of
each is the same pair). They are probed against blocked Bloom filters, one for each word length; a key's bits lie
in one block of 64. Only the edits found there become strings and are joined to the vocabulary, which
removes the false positives. A pair comes out once.

Scale: the filters take ``BITS`` = 16 bits a word. They are broadcast in passes of ``FILTER_BLOCKS`` blocks (32 MB)
at most; a vocabulary of over 16 million words takes several passes, each with its own lengths or range of
blocks, so that memory is bounded at any size and no edit is left out. A pass probes only words whose edits can fall
into it. Forms are followed by pointer doubling; a form has at least ``ratio`` times the word's count, so chains
are short and without circles.

Defined cases: null and empty texts have no words; a null id reads as an empty string; rows that repeat count
again; words of any length take part; an empty table gives no rows. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescope.llm.shared import frozen

LEAST_LENGTH, LEAST_COUNT, RATIO, DELETE_EVERY = 7, 2, 10, 31
#: The letters, after A-Z are lower-cased.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
_RUN = "[A-Za-zÀ-ÿ]"

#: Bits of filter for each word, bits set by a word, blocks of 64 bits broadcast at once.
BITS, PROBES, FILTER_BLOCKS = 16, 5, 4 << 20
#: Words that a task counts before it hands them on; edits that it hashes at once.
TABLE_WORDS, CHUNK_EDITS = 200_000, 1 << 20


def runs_of(doc_id: str, text: bytes, least: int = LEAST_LENGTH, pattern: re.Pattern | None = None) -> Counter:
    """Words of one text with their counts: its runs of letters, less one letter where the run's number says so."""
    found = (pattern or re.compile(f"{_RUN}{{{least},}}")).findall(text.lower().decode("utf-8", "replace"))  # lowers A-Z only
    out, start = Counter(), crc32(f"{doc_id}:".encode())
    for run, n in Counter(found).items():
        h = crc32(run.encode(), start)
        if h % DELETE_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < least:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): all words of the least length and count."""
    def run(batches):
        pattern, seen = re.compile(f"{_RUN}{{{least_length},}}"), Counter()

        def handed():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                if t.is_valid:
                    seen.update(runs_of(i.as_py() or "", t.as_py(), least_length, pattern))
                if len(seen) > TABLE_WORDS:
                    yield handed()
                    seen.clear()
        yield handed()

    d = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
    return frozen(d.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _places(length: int) -> np.ndarray:
    """An odd factor for each place of a word."""
    return _mixed(np.arange(1, length + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.uint64)


def _block(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits of each hash in a filter of so many blocks."""
    h = _mixed(h)
    mask = np.zeros(h.shape, np.uint64)
    for k in range(PROBES):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), mask


def _by_length(words) -> dict[int, list]:
    out: dict[int, list] = {}
    for w in words:
        out.setdefault(len(w[0]), []).append(w)
    return out


def blocks_of(words: int) -> int:
    return max(1, -(-words * BITS // 64))


def filters(vocab: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """(length, block, bits): the blocks of all filters that have a bit."""
    def run(batches):
        for batch in batches:
            for length, words in _by_length((w,) for w in batch.column(0).to_pylist()).items():
                at, mask = _block((_codes([w for w, in words], length) * _places(length)).sum(axis=1, dtype=np.uint64), blocks[length])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), length), pa.int32()), pa.array(at.view(np.int64)), pa.array(mask.view(np.int64))],
                                                 names=["length", "block", "bits"])

    got = vocab.select("word").mapInArrow(run, "length int, block long, bits long")
    return frozen(got.groupBy("length", "block").agg(F.bit_or("bits").alias("bits")))


def passes(blocks: dict[int, int], most: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Slices (length, first block, end) of the filters, in passes of ``most`` blocks together."""
    most, out, room = most or FILTER_BLOCKS, [], 0
    for length, n in sorted(blocks.items()):
        at = 0
        while at < n:
            if not room:
                out.append([])
                room = most
            take = min(room, n - at)
            out[-1].append((length, at, at + take))
            at, room = at + take, room - take
    return out


def _gathered(made: DataFrame, slices: list[tuple[int, int, int]]) -> dict[int, tuple[int, np.ndarray]]:
    """Length: (first block, blocks) of one pass, whose lengths follow one another."""
    (low, first, _), (high, _, end) = slices[0], slices[-1]
    rows = made.filter(f"length between {low} and {high} and not (length = {low} and block < {first}) and not (length = {high} and block >= {end})").toArrow()
    rows = rows.sort_by("length")
    where, at, bits = (rows[c].to_numpy() for c in ("length", "block", "bits"))
    out = {}
    for k, a, b in slices:
        mine, one = slice(*np.searchsorted(where, [k, k + 1])), np.zeros(b - a, np.uint64)
        one[at[mine] - a] = bits[mine].view(np.uint64)
        out[k] = (a, one)
    return out


class Probe:
    """The slices of one pass, and the edits of words that may be in them."""

    def __init__(self, blocks: dict[int, int], slices: dict[int, tuple[int, np.ndarray]], letters: np.ndarray):
        self.blocks, self.slices, self.letters = blocks, slices, letters.astype(np.uint64)

    def _found(self, h: np.ndarray, length: int) -> np.ndarray:
        first, held = self.slices[length]
        at, mask = _block(h, self.blocks[length])
        at = at.view(np.int64) - first
        inside = (at >= 0) & (at < len(held))
        return inside & ((held[np.where(inside, at, 0)] & mask) == mask)

    def edits(self, words: list[str], length: int):
        """Yields (place of the word in the list, edit) for each deletion and greater replacement found."""
        factor = _places(length)
        step = max(1, CHUNK_EDITS // (length * (len(self.letters) if length in self.slices else 1)))
        for start in range(0, len(words), step):
            some = words[start:start + step]
            c = _codes(some, length)
            own = (c * factor).sum(axis=1, dtype=np.uint64)
            if length in self.slices:
                h = own[:, None, None] + (self.letters[None, None, :] - c[:, :, None]) * factor[None, :, None]
                hit = self._found(h, length) & (self.letters[None, None, :] > c[:, :, None])
                for w, i, a in zip(*np.nonzero(hit), strict=True):
                    yield start + int(w), some[w][:i] + chr(int(self.letters[a])) + some[w][i + 1:]
            if length - 1 in self.slices:
                before = np.cumsum(c * factor, axis=1, dtype=np.uint64) - c * factor
                moved = np.zeros_like(c)
                moved[:, 1:] = c[:, 1:] * factor[:-1]
                after = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
                hit = self._found(before + after, length - 1)
                hit[:, :-1] &= c[:, :-1] != c[:, 1:]  # of equal neighbours, the last goes: each result once
                for w, i in zip(*np.nonzero(hit), strict=True):
                    yield start + int(w), some[w][:i] + some[w][i + 1:]


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n, other, other_n): all pairs of near words, in both directions."""
    spark = vocab.sparkSession
    lengths = {r.length: r.n for r in vocab.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {k: blocks_of(n) for k, n in lengths.items()}
    used = vocab.select(F.explode(F.split("word", "")).alias("c")).filter("c != ''").distinct().collect()  # letters: 90 at most
    letters = np.array(sorted(ord(r.c) for r in used), np.uint64)
    made = filters(vocab, blocks)
    found, tasks = None, int(spark.conf.get("spark.sql.shuffle.partitions"))
    for slices in passes(blocks):
        held = _gathered(made, slices)
        sent = spark.sparkContext.broadcast((blocks, held, letters))

        def run(batches, sent=sent):
            probe = Probe(*sent.value)
            for batch in batches:
                word, n, edit = [], [], []
                for length, words in _by_length(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)).items():
                    for w, e in probe.edits([x for x, _ in words], length):
                        word.append(words[w][0])
                        n.append(words[w][1])
                        edit.append(e)
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(edit, pa.string())], names=["word", "n", "other"])

        lengths_here = sorted({k + d for k, *_ in slices for d in (0, 1)} & set(blocks))
        mine = vocab.filter(F.length("word").isin(lengths_here)) if len(lengths_here) < len(blocks) else vocab
        got = mine.select("word", "n").repartition(tasks, "word").mapInArrow(run, "word string, n long, other string")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return vocab.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    pairs = frozen(frozen(found).join(vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n"))
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word with a form to the last one, by pointer doubling."""
    at = frozen(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = frozen(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO,
             least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Per word: word, form (the most frequent near word of ``ratio`` times its count, ties to the smaller; else
    null), root (the last form), n, n_near, form_n."""
    vocab = vocabulary(docs, id_col, text_col, least_length, least_count)
    near = frozen(near_words(vocab).groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), F.min(
        F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")))
    has = near.filter(-F.col("best.less") >= F.col("n") * ratio).select("word", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    has = frozen(has)
    out = vocab.join(near.select("word", "n_near"), "word", "left").join(has.join(roots(has), "word"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"),
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
