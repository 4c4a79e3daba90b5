"""Operator 9: language-model scores by online logistic context mixing.

A token is a binary path: the ``HEAD_WORDS`` most frequent training words, the end of a text and an escape for all
other words are the leaves of a Huffman tree. Behind the escape comes a code of the word, up to ``CODE_BITS`` bits of
its checksum (fewer where training has fewer words outside the head, none where it has none). Each bit on the path, the
code's too, is predicted by hashed contexts: the tree node alone, with the word before, with the two words before. Each
context hashes to a slot with the counts of zeros and ones that followed it in training; the predictions' logits are
mixed by weights that a gate selects (how much the slots have seen), and the weights are refined as the text goes on,
block by block of ``BLOCK`` tokens: a block is coded with the weights learned from the blocks before it in its document.
Among the words with the same code, a word has the share of its count plus 1, as one unseen word has. All bits and
shares together give the text's log10 probability and its bits per byte.

Scale: texts are split and their distinct words looked up by pieces of ``PIECE_BYTES``; word counts and slot counts are
summed in each piece or task before the shuffle, over all training texts. The slot tables have a fixed size
(2**SLOT_BITS slots for each context), so model and broadcast have one. Counts of the ``COMMON_WORDS`` most frequent
words, at most ``WORD_BYTES`` long each, travel with the model; all other words of a document meet their counts in a
join, one row for each distinct word of a document. The whole vocabulary is never gathered.

Defined cases: null text is empty and has the end as its only token; documents without id learn; an empty
training set gives each token probability 1 in the base score; scores don't depend on how rows are split into
tasks, as nothing is carried from one document to the next. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescope.llm.bpe import in_batches
from lakescope.llm.shared import frozen

HEAD_WORDS, COMMON_WORDS, WORD_BYTES = 50_000, 50_000, 64
#: Bits of the code of a word outside the head, at most.
CODE_BITS = 16
SLOT_BITS, BLOCK = 20, 128
#: Neighbouring slots whose counts travel in one row.
PART = 256
#: Bytes of texts that are split together; tokens after which a task hands its slot counts on (32 bits hold them); tokens
#: of documents that are scored together.
PIECE_BYTES, TABLE_TOKENS, TOGETHER = 1 << 22, 1 << 25, 100_000
#: Tokens that are counted, and documents that are mixed, in one go, which bounds their bits' arrays.
COUNTED, MIXED = 4_000, 64
#: Weights at the start (node, one word, two words, bias) and the rate at which they are refined.
START_WEIGHTS, RATE = (0.4, 0.3, 0.3, 0.0), 0.002
#: Counts from which a slot counts as little, well and much seen; 4 levels (two bits) for each of two contexts.
SEEN, LEVELS = (2, 8, 64), 3
GATES = (LEVELS + 1) ** 2
END, ESCAPE = 0, 1
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def pieces(texts: pa.Array, size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For pieces of the texts of about that many bytes: the distinct words, each word's place among them, and for each
    text the number of words up to its end. Only A-Z are lower-cased, and only ASCII white space separates."""
    texts = pc.fill_null(texts, "")
    piece = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // size
    starts = np.flatnonzero(np.diff(piece, prepend=-1, append=-1))
    for a, b in zip(starts, starts[1:], strict=False):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(a, b - a)))
        words, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        kept = pc.greater(pc.binary_length(words), 0)  # white space at the edges leaves empty ones
        n = np.bincount(np.repeat(np.arange(len(n), dtype=np.int32), n)[kept.to_numpy(zero_copy_only=False)], minlength=len(n))
        coded = words.filter(kept).dictionary_encode()
        yield coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(zero_copy_only=False), np.cumsum(n)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def code_of(words: list[bytes], bits: int) -> np.ndarray:
    """Codes of words outside the head: the first bits of their checksum."""
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) >> (32 - bits)


def build_tree(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman codes of the symbols: (first, node, bit); symbol s has entries first[s] to first[s + 1]."""
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    n = len(counts)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (n, 0), (n, 1)
        heapq.heappush(heap, (a + b, n))
        n += 1
    first, node, bit = [0], [], []
    for s in range(len(counts)):
        path = []
        while s in up:
            s, b = up[s]
            path.append((s - len(counts), b))
        node += [p for p, _ in reversed(path)]
        bit += [b for _, b in reversed(path)]
        first.append(len(node))
    return np.array(first, np.int64), np.array(node, np.int64), np.array(bit, np.int64)


def with_codes(first: np.ndarray, node: np.ndarray, bit: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree with all codes of so many bits as symbols after the others: the path of the escape, then the code's bits."""
    code, down, escape = np.arange(1 << bits)[:, None], np.arange(bits), slice(first[ESCAPE], first[ESCAPE + 1])
    further = len(first) - 2 + (1 << down) - 1 + (code >> (bits - down))
    nodes = np.hstack([np.tile(node[escape], (len(code), 1)), further])
    all_bits = np.hstack([np.tile(bit[escape], (len(code), 1)), code >> (bits - 1 - down) & 1])
    return (np.append(first, first[-1] + nodes.shape[1] * (code[:, 0] + 1)),
            np.append(node, nodes).astype(np.int32), np.append(bit, all_bits).astype(np.int8))


class Symbols:
    """Head words and codes as symbols, common words' counts, and the tree; small and of bounded size."""

    def __init__(self, common: list[tuple[bytes, int]], n_docs: int, n_words: int, n_distinct: int):
        head = common[:HEAD_WORDS]
        self.rank = {w: i for i, (w, _) in enumerate(common)}
        self.n_head, self.n_common = len(head), len(common)
        self.counts = np.array([c for _, c in common], np.float64)
        rest = n_words - sum(c for _, c in head)
        self.code_bits = min(CODE_BITS, (n_distinct - len(head)).bit_length())
        self.first, self.node, self.bit = with_codes(*build_tree([n_docs, rest] + [c for _, c in head]), self.code_bits)
        self.codes, self.n_nodes = len(head) + 2, len(head) + (1 << self.code_bits)  # the first code's symbol
        self.head_counts = np.array([n_docs, 0] + [c for _, c in head], np.float64)
        self.total, self.kinds = n_words + n_docs, n_distinct + (n_docs > 0)
        self.base = float(self.total + self.kinds + 1)  # the base score's denominator
        self.other = float(rest + (n_distinct - len(head)) + 1)  # an escaped word's

    def shares(self, by_code: np.ndarray) -> np.ndarray:
        """For each code, what is added to an escaped word's log10 probability when the code is known. ``by_code``:
        counts + 1 of all words, head words too, by codes of `CODE_BITS` bits."""
        n = by_code.reshape(1 << self.code_bits, -1).sum(axis=1)
        np.subtract.at(n, code_of(list(self.rank)[: self.n_head], self.code_bits), self.counts[: self.n_head].astype(np.int64) + 1)
        return np.log10(self.other) - np.log10(n + 1)

    # made where they are used, once for each Python worker, and not sent

    @cached_property
    def hashes(self) -> np.ndarray:
        """The common words' hashes by rank, and a place for all others."""
        return np.fromiter(chain(map(xxhash.xxh3_64_intdigest, self.rank), [0]), np.uint64, self.n_common + 1)

    @cached_property
    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        """The common words' log10 probabilities by rank: by the base, and as an escaped word."""
        log = np.log10(self.counts + 1)
        return log - np.log10(self.base), log - np.log10(self.other)

    @cached_property
    def turn(self) -> np.ndarray:
        """What each node adds to a context in `slots`."""
        return np.arange(1, self.n_nodes + 1, dtype=np.uint64) * _M[0] * _M[2]

    @cached_property
    def way(self) -> np.ndarray:
        """Node and bit of each entry of the tree in one number: the bit is the last one."""
        return self.node * 2 + self.bit

    def entries(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of bits of each symbol's code, and for all these bits the entry of the tree."""
        first = self.first[symbols]
        n = self.first[symbols + 1] - first
        end = np.cumsum(n)
        entry = np.repeat(first - end + n, n)
        entry += np.arange(len(entry))
        return n, entry


def context_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of one document (its words' hashes; the end is last): the hash of the word before and
    of the two words before."""
    one, two = np.zeros(len(h) + 1, np.uint64), np.zeros(len(h) + 1, np.uint64)
    one[1:] = h * _M[2]
    two[1:] = one[1:] * _M[1]
    two[2:] += one[1:-1] * _M[2]
    return one, two


def slots(context: np.ndarray, n: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Slots of all bits: each symbol's context for its n bits, turned by their nodes."""
    x = np.repeat(context, n)
    x += turn
    x ^= x >> np.uint64(29)
    x *= _M[1]
    x >>= np.uint64(64 - SLOT_BITS)
    return x.view(np.int64)


def _ranks(symbols: Symbols, w: list[bytes]) -> np.ndarray:
    """Ranks of the common words; any other word has the next one."""
    return np.fromiter(map(symbols.rank.get, w, repeat(symbols.n_common)), np.int64, len(w))


def _tokens(symbols: Symbols, w: list[bytes], ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    r = _ranks(symbols, w) if ranks is None else ranks
    s = np.full(len(w) + 1, END, np.int64)
    s[:-1] = r + 2
    outside = (r >= symbols.n_head).nonzero()[0]
    words = [w[i] for i in outside.tolist()]
    s[outside] = symbols.codes + code_of(words, symbols.code_bits)
    h = symbols.hashes.take(r)
    h[outside] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return s, h


def by_counts(symbols: Symbols, w: list, ranks: np.ndarray) -> tuple[int, float, float, list[tuple]]:
    """Of the common words outside the head: their number, base score and the log10 of their shares of all words outside
    the head; and all other words (or their numbers, if ``w`` holds these) with how often they come, for which a join does
    the same. The mixing codes all of them."""
    log_base, log_other = symbols.logs
    common = ranks[(ranks >= symbols.n_head) & (ranks < symbols.n_common)]
    rest = Counter(compress(w, (ranks == symbols.n_common).tolist()))
    return len(common), float(log_base[common].sum()), float(log_other[common].sum()), list(rest.items())


def tokens_of(symbols: Symbols, texts: pa.Array) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, ...]]]]:
    """Distinct words of a piece, and for each text its words' numbers among these, their ranks, symbols and hashes."""
    for distinct, words, ends in pieces(texts, PIECE_BYTES):
        w = distinct.to_numpy(zero_copy_only=False).tolist()
        ranks = _ranks(symbols, w)
        syms, h = _tokens(symbols, w, ranks)
        yield distinct, [(x, ranks.take(x), syms.take(np.append(x, len(w))), h.take(x)) for x in np.split(words, ends[:-1])]


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): over all training texts, summed in each task first."""
    def run(batches):
        for batch in batches:
            for distinct, words, _ in pieces(batch.column(0), 2 * PIECE_BYTES):
                c = np.bincount(words, minlength=len(distinct))
                for i in range(0, len(c), 100_000):
                    yield pa.RecordBatch.from_arrays([distinct.slice(i, 100_000), pa.array(c[i : i + 100_000])], names=["word", "c"])

    return frozen(train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))


def packed(counts: np.ndarray) -> bytes:
    """Counts of a part, in the smallest unsigned type that holds them."""
    return counts.astype(np.min_scalar_type(counts.max())).tobytes()


def unpacked(x: pa.BinaryScalar) -> np.ndarray:
    x = x.as_buffer()
    return np.frombuffer(x, f"u{x.size // (2 * PART)}").astype(np.int64)


def slot_counts(train: DataFrame, symbols: Symbols) -> np.ndarray:
    """Counts of zeros and ones by (context, slot): an array (3, 2**SLOT_BITS, 2) of fixed size. Each task sends a row for
    each `PART` neighbouring slots that it saw."""
    spark = train.sparkSession
    held = spark.sparkContext.broadcast(symbols)
    size, schema = 1 << SLOT_BITS, pa.schema([("context", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        s, total = held.value, np.zeros((2, size * 2), np.int32)
        seen, pending, n, held_tokens = np.zeros(len(s.first) - 1, np.int64), [], 0, 0

        def count():
            syms, *contexts = (np.concatenate(x) for x in zip(*pending, strict=True))
            np.add.at(seen, syms, 1)
            for i in range(0, len(syms), COUNTED):
                bits, entry = s.entries(syms[i : i + COUNTED])
                way = s.way.take(entry)
                bit, turn = way & 1, s.turn.take(way >> 1)
                for k, context in enumerate(contexts):
                    slot = slots(context[i : i + COUNTED], bits, turn)
                    slot <<= 1
                    slot |= bit
                    np.add.at(total[k], slot, np.int32(1))

        def out():
            tree = np.bincount(s.way, np.repeat(seen, np.diff(s.first)), -(-s.n_nodes // PART) * PART * 2).astype(np.int64)
            yield from in_batches(parts((tree, *total)), schema, lambda r: len(r[2]) + 64)

        for batch in batches:
            for _, _, syms, h in chain.from_iterable(texts for _, texts in tokens_of(s, batch.column(0))):
                pending.append((syms, *context_hashes(h)))
                n += len(syms)
                if n >= COUNTED:
                    count()
                    held_tokens += n
                    pending, n = [], 0
                if held_tokens >= TABLE_TOKENS:
                    yield from out()
                    total[:], seen[:], held_tokens = 0, 0, 0
        if pending:
            count()
        yield from out()

    def parts(tables):
        for k, table in enumerate(tables):
            by_part = table.reshape(-1, PART * 2)
            for i in by_part.any(axis=1).nonzero()[0].tolist():
                yield k, i, packed(by_part[i])

    def add(batches):
        total = {}
        for batch in batches:
            for key, x in zip(zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True), batch.column(2), strict=True):
                total[key] = total.get(key, 0) + unpacked(x)
        yield from in_batches(((*k, packed(x)) for k, x in total.items()), schema, lambda r: len(r[2]) + 64)

    names = "context int, part int, counts binary"
    got = train.select("text").mapInArrow(run, names).repartition("context", "part").mapInArrow(add, names).toArrow()
    out = np.zeros((3, size // PART, PART * 2), np.int64)
    for k, i, x in zip(got["context"].to_pylist(), got["part"].to_pylist(), got["counts"], strict=True):
        out[k, i] = unpacked(x)
    return out.reshape(3, size, 2)


class Mixer:
    """Scores documents with the tables' logits; weights are each document's own."""

    def __init__(self, symbols: Symbols, counts: np.ndarray):
        self.symbols = symbols
        # a slot's logit holds the level of what it has seen in its last bits, so that both are gathered at once
        self.slots = []
        for c in counts:
            logit = np.log((c[:, 1] + 0.4) / (c[:, 0] + 0.4)).astype(np.float32).view(np.int32)
            self.slots.append(logit & ~LEVELS | np.searchsorted(SEEN, c.sum(axis=1), "right").astype(np.int32))
        self.slots[0] = self.slots[0][: symbols.n_nodes]

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Natural-log probability of each document's bits. All documents advance together, block by block."""
        n = np.array([len(s) for s, _ in docs])
        longest = np.argsort(-n, kind="stable")  # in this order, the documents that reach a block are the first ones
        n = n[longest]
        syms = np.concatenate([docs[i][0] for i in longest])
        one, two = (np.concatenate(x) for x in zip(*(context_hashes(docs[i][1]) for i in longest), strict=True))
        doc = np.repeat(np.arange(len(docs)), n)
        block = (np.arange(len(syms)) - np.repeat(np.cumsum(n) - n, n)) // BLOCK
        step = block * len(docs) + doc // MIXED
        order = np.argsort(step, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(step[order], prepend=-1)), len(order))
        out = np.zeros(len(docs))
        weights = np.tile(np.array(START_WEIGHTS)[:, None], len(docs) * GATES)
        s, by_node, (_, slots1, slots2) = self.symbols, self.slots[0].view(np.float32), self.slots
        for a, b in zip(ends, ends[1:], strict=False):
            t = order[a:b]
            d, low, high = doc[t], int(doc[t[0]]), int(doc[t[-1]]) + 1
            bits, entry = s.entries(syms[t])
            way = s.way.take(entry)
            node, sign = way >> 1, ((way & 1) * 2 - 1).astype(np.float32)
            turn = s.turn.take(node)
            x1, x2 = slots1.take(slots(one[t], bits, turn)), slots2.take(slots(two[t], bits, turn))
            gate = np.repeat((d - low) * GATES, bits)
            gate += (x1 & LEVELS) * (LEVELS + 1) + (x2 & LEVELS)
            x = (by_node.take(node), x1.view(np.float32), x2.view(np.float32), np.float32(0.3))
            own = weights[:, low * GATES : high * GATES]  # of these documents
            w = own.astype(np.float32)
            z = (w[3] * x[3]).take(gate)
            for k in range(3):
                z += x[k] * w[k].take(gate)
            np.clip(z, -12, 12, out=z)
            z *= sign
            miss = np.exp(-z)  # the odds against the bit that comes
            either = miss + np.float32(1)
            starts = np.append(0, np.cumsum(bits))[np.searchsorted(d, np.arange(low, high))]
            out[low:high] -= np.add.reduceat(np.log(either), starts, dtype=np.float64)
            if int(block[t[0]] + 1) * BLOCK >= n[low]:
                continue  # the last block of all these documents: nothing follows that has use for the weights
            miss /= either
            miss *= sign
            for k in range(4):
                own[k] += np.clip(np.bincount(gate, miss * x[k], own.shape[1]) * RATE, -0.2, 0.2)
        out[longest] = out.copy()
        return out


def scores(docs: DataFrame, is_held_out: Callable[[Column], Column] = held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), is_held_out(F.col(id_col)).alias("held_out"))
    train = d.filter(~F.col("held_out"))
    counts = word_counts(train)
    n_docs = train.count()
    by_code = counts.groupBy(F.shiftright(F.crc32("word"), 32 - CODE_BITS).cast("int").alias("code")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toArrow()
    code, c, n = (by_code[x].to_numpy().astype(np.int64) for x in ("code", "c", "n"))
    n_words, n_distinct = int(c.sum()), int(n.sum())
    top = counts.filter(F.octet_length("word") <= WORD_BYTES).orderBy(F.desc("c"), "word").limit(COMMON_WORDS).collect()
    symbols = Symbols([(bytes(r.word), r.c) for r in top], n_docs, n_words, n_distinct)
    both = np.zeros(1 << CODE_BITS, np.int64)
    both[code] = c + n
    model = spark.sparkContext.broadcast((Mixer(symbols, slot_counts(train, symbols)), symbols.shares(both)))
    tail = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("n_known", pa.int64()),
                     ("base", pa.float64()), ("score", pa.float64()), ("tail", tail)])

    def run(batches: Iterator[pa.RecordBatch]):
        mixer, shares = model.value
        s = mixer.symbols
        end_base = float(np.log10((s.head_counts[END] + 1) / s.base))

        def row(words, ranks, syms):
            head, codes = ranks[ranks < s.n_head], syms[syms >= s.codes]
            known, base, score, rest = by_counts(s, words.tolist(), ranks)
            known, base = known + len(head) + int(s.head_counts[END] > 0), base + float(s.logs[0][head].sum()) + end_base
            return len(syms), known, base, score + float(shares[codes - s.codes].sum()), rest

        for batch in batches:
            at = 0
            for distinct, texts in tokens_of(s, batch.column(2)):
                done = np.cumsum([len(syms) for _, _, syms, _ in texts]) // TOGETHER
                for together in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(done)) + 1):
                    some = texts[together[0] : together[-1] + 1]
                    n, known, base, score, rest = zip(*(row(*x[:3]) for x in some), strict=True)
                    score = np.array(score) + mixer.score([x[2:] for x in some]) / np.log(10)
                    ends = np.cumsum([0, *map(len, rest)])
                    word, tf = (pa.array(list(chain.from_iterable((x[k] for x in r) for r in rest)), pa.int32()) for k in (0, 1))
                    words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([distinct.take(word), tf], fields=list(tail.value_type)))
                    ids, held, text = (batch.column(k).slice(at, len(some)) for k in range(3))
                    n_bytes = pc.binary_length(pc.fill_null(text, "")).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, held, pa.array(n), n_bytes, pa.array(known), pa.array(base), pa.array(score), words], schema=out)
                    at += len(some)

    found = frozen(d.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, score double, tail array<struct<word:binary,tf:int>>")
        .withColumn("row", F.monotonically_increasing_id()))
    each = found.select("row", F.explode("tail").alias("x")).select("row", "x.word", "x.tf").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    more = each.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known"), F.sum(F.col("tf") * F.log10((c + 1) / F.lit(symbols.base))).alias("b"),
        F.sum(F.col("tf") * F.log10((c + 1) / F.lit(symbols.other))).alias("s"))
    all_ = found.drop("tail").join(more, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    score = add("score", "s")
    return all_.select("doc_id", "held_out", "n_tokens", add("n_known", "known").alias("n_known"), F.lit(symbols.total).cast("long").alias("train_tokens"),
                       add("base", "b").alias("base_score"), score.alias("score"),
                       F.when(F.col("n_bytes") > 0, -score * F.log2(F.lit(10.0)) / F.col("n_bytes")).alias("bits_per_byte"))
