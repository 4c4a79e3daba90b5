"""Operator 3: token ids in binary files, each id in the vocabulary's minimum number of bits.

Documents are range-sorted by id, encoded and written, one file for each range. A file holds blocks of
``BLOCK_IDS`` ids, packed at a fixed width; the blocks' byte offsets; an index of the documents (id, first
token, number of tokens); and a footer that says where these are. 64 ids fill as many 64-bit words as an id
has bits, so numpy packs and unpacks whole blocks column by column, and any slice of the tokens is read from
its blocks alone.

Scale: a range is sorted by Spark and streamed to its file block by block; a task holds one block, a
batch of texts and its documents' index. Files are written through pyarrow's file systems below
``spark.checkpoint.dir`` (or a folder given), under names of their own for each attempt; the manifest, one
row for each file, names those of the attempts that succeeded, so a lost executor or a second attempt does
no harm. Places in the whole corpus come from the manifest's running total.

Defined cases: null text is empty, and its document holds the end id alone; a null id sorts first and is read
back as null; documents with one id follow by their texts' hash; an empty table gives files without
documents; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakescope.llm.bpe import coder, default_tokenizer, in_batches
from lakescope.llm.shared import frozen
from lakescope.session import scratch_path

#: Ids of a block: a multiple of 64.
BLOCK_IDS = 1 << 16
MAGIC = b"FWTOKEN1"
#: bits, ids a block, ids, documents, blocks, place of the offsets, place of the index, magic.
FOOTER = struct.Struct("<7Q8s")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits at ``bits`` bits each, low bits first; filled up to a multiple of 64 ids."""
    groups = -(-len(ids) // 64)
    x = np.zeros(groups * 64, np.uint64)
    x[: len(ids)] = ids
    x = np.ascontiguousarray(x.reshape(groups, 64).T)
    out = np.zeros((bits, groups), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[word] |= x[k] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= x[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").tobytes()


def unpack(raw: bytes, bits: int, count: int) -> np.ndarray:
    words = np.ascontiguousarray(np.frombuffer(raw, "<u8").reshape(-1, bits).T)
    out = np.empty((64, words.shape[1]), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[k] = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            out[k] |= words[word + 1] << np.uint64(64 - shift)
    out &= np.uint64((1 << bits) - 1)
    return out.T.reshape(-1)[:count].astype(np.uint32)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow file system and the path in it; a path without a scheme is local."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file; documents in order."""

    def __init__(self, uri: str, bits: int, block_ids: int = BLOCK_IDS):
        fs, path = file_system(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.bits, self.block = fs.open_output_stream(path), bits, block_ids
        self.held, self.n_held, self.n, self.offsets, self.docs = [], 0, 0, [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n, len(ids)))
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._flush(self.n_held // self.block)

    def _flush(self, blocks: int, rest: bool = False) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for k in range(blocks + rest):
            raw = pack(ids[k * self.block : (k + 1) * self.block], self.bits)
            self.out.write(raw)
            self.offsets.append(self.offsets[-1] + len(raw))
        ids = ids[blocks * self.block :]
        self.held, self.n_held = [ids], len(ids)

    def close(self) -> None:
        self._flush(0, rest=self.n_held > 0)
        at = self.offsets[-1]
        index = [np.array([d is None for d, _, _ in self.docs], "u1"), np.array([d or 0 for d, _, _ in self.docs], "<i8"),
                 np.array([s for _, s, _ in self.docs], "<u8"), np.array([n for _, _, n in self.docs], "<u8")]
        offsets = np.array(self.offsets, "<u8").tobytes()
        self.out.write(offsets)
        for part in index:
            self.out.write(part.tobytes())
        self.out.write(FOOTER.pack(self.bits, self.block, self.n, len(self.docs), len(self.offsets) - 1, at, at + len(offsets), MAGIC))
        self.out.close()


class Reader:
    """Random access to one file: the index, and any slice of the tokens from its blocks alone."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        foot = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        self.bits, self.block, self.n, docs, blocks, at, index = foot[:7]
        if foot[7] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.offsets = np.frombuffer(self.file.read_at(8 * (blocks + 1), at), "<u8")
        raw = self.file.read_at(25 * docs, index)
        self.null = np.frombuffer(raw, "u1", docs).astype(bool)
        self.doc_ids, self.starts, self.lengths = (np.frombuffer(raw, k, docs, docs * (1 + 8 * i)) for i, k in enumerate(("<i8", "<u8", "<u8")))

    def tokens(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        a = int(self.offsets[first])
        raw = self.file.read_at(int(self.offsets[last + 1]) - a, a)
        count = min(self.n, (last + 1) * self.block) - first * self.block
        return unpack(raw, self.bits, count)[start - first * self.block : stop - first * self.block]

    def documents(self):
        """Each document's id, place and tokens, in order; runs of documents are read together."""
        k, docs = 0, len(self.starts)
        while k < docs:
            upto = int(np.searchsorted(self.starts, self.starts[k] + np.uint64(self.block), "right"))
            upto = max(k + 1, upto - 1)
            a, b = int(self.starts[k]), int(self.starts[upto - 1] + self.lengths[upto - 1])
            ids = self.tokens(a, b)
            for i in range(k, upto):
                s = int(self.starts[i])
                yield None if self.null[i] else int(self.doc_ids[i]), s, ids[s - a : s - a + int(self.lengths[i])]
            k = upto

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 0,
          files: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode and write; returns the manifest: file_no, path, n_docs, n_ids, bits, first token's place."""
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    base = folder or scratch_path(spark, "tokens")
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    schema = pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32())])

    def run(batches):
        c = coder(path)
        bits, end = bits_for(max(c.size, end_id + 1)), np.array([end_id], np.uint32)
        no = TaskContext.get().partitionId()
        uri = f"{base}/part-{no:06d}-{uuid.uuid4().hex}.tokens"
        w = Writer(uri, bits, block_ids)
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                w.add(i.as_py(), np.concatenate([np.frombuffer(c.encode(t.as_py()), "<u4"), end]))
        w.close()
        yield pa.RecordBatch.from_pylist([{"file_no": no, "path": uri, "n_docs": len(w.docs), "n_ids": w.n, "bits": bits}], schema=schema)

    manifest = frozen(d.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        run, "file_no long, path string, n_docs long, n_ids long, bits int"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_files(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    spark: SparkSession = manifest.sparkSession
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        def rows():
            for batch in batches:
                for uri, start in zip(batch.column(0), batch.column(1), strict=True):
                    r = Reader(uri.as_py())
                    for i, s, ids in r.documents():
                        yield i, start.as_py() + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                    r.close()

        yield from in_batches(rows(), out, lambda r: 64)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
