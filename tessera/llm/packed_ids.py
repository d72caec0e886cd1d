"""Token ids in patched frame-of-reference files (operator 10).

File: magic, blocks, footer, footer length (8 bytes), magic. A block holds up to BLOCK ids: the block's minimum is
subtracted, the rest is packed in as many bits as a percentile of the values needs, and the values that need more
stand whole in an exception list (positions, then values). The footer indexes the block starts and holds the
documents in file order with their numbers of ids, so a reader can fetch any block, and so any document, alone.

Documents are dealt to files by ranges of doc_id and sorted within a file. A task writes its own file under a name
of its attempt and only then reports it; the manifest names the reported files, so files left by lost executors or
failed attempts are never read. Memory is bounded by one flush of ids plus the footer.

Defined results: a null or empty text holds the end id alone; null doc_ids come first; rows with the same doc_id
stand next to each other in order of their texts; no documents give no files; further columns are ignored.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import map_arrow, materialise, scratch_path, text_input

MAGIC = b"TSPFOR1\n"
BLOCK = 256
PERCENTILE = 0.9
#: Ids that are gathered before their blocks are packed and written.
FLUSH = 256 * BLOCK
HEADER = struct.Struct("<IBHH")  # minimum, width, ids, exceptions


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Packed blocks of an array of uint32; only the last may hold fewer than BLOCK ids."""
    n = len(ids)
    count = -(-n // BLOCK)
    whole = np.empty(count * BLOCK, dtype=np.uint32)
    whole[:n], whole[n:] = ids, ids[-1] if n else 0
    table = whole.reshape(count, BLOCK)
    low = table.min(axis=1)
    table = table - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    widths = _bits(np.partition(table, rank, axis=1)[:, rank])
    out: list[bytes] = [b""] * count
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        part = table[rows]
        over = part >= np.uint32(1 << int(width)) if width < 32 else np.zeros(part.shape, bool)
        planes = ((part[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8).reshape(len(rows), -1)
        packed = np.packbits(planes, axis=1, bitorder="little") if width else np.zeros((len(rows), 0), np.uint8)
        at, where = np.nonzero(over)
        starts = np.searchsorted(at, np.arange(len(rows) + 1))
        where, values = where.astype("<u2"), part[over].astype("<u4")
        for k, row in enumerate(rows.tolist()):
            a, b = starts[k], starts[k + 1]
            held = BLOCK if row < count - 1 else n - (count - 1) * BLOCK
            out[row] = HEADER.pack(int(low[row]), int(width), held, int(b - a)) + packed[k].tobytes() + where[a:b].tobytes() + values[a:b].tobytes()
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """ids of the blocks in data that start at the given offsets."""
    count = len(starts)
    heads = [HEADER.unpack_from(data, s) for s in starts.tolist()]
    widths = np.array([h[1] for h in heads])
    raw = np.frombuffer(data, np.uint8)
    table = np.zeros((count, BLOCK), np.uint32)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        if width:
            size = BLOCK * int(width) // 8
            packed = raw[(starts[rows] + HEADER.size)[:, None] + np.arange(size)]
            planes = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
            value = np.zeros((len(rows), BLOCK), np.uint32)
            for bit in range(width):
                value |= planes[:, :, bit].astype(np.uint32) << np.uint32(bit)
            table[rows] = value
    for row, (_, width, _, exceptions) in enumerate(heads):
        if exceptions:
            at = int(starts[row]) + HEADER.size + BLOCK * width // 8
            table[row, np.frombuffer(data, "<u2", exceptions, at)] = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
    table += np.array([h[0] for h in heads], np.uint32)[:, None]
    flat = table.reshape(-1)
    return flat[: (count - 1) * BLOCK + heads[-1][2]] if count else flat


class Writer:
    """Writes documents of ids to a binary stream."""

    def __init__(self, out, percentile: float = PERCENTILE):
        self.out, self.percentile = out, percentile
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.starts: list[int] = []
        self.docs: list[int] = []
        self.sizes: list[int] = []
        self.null = 0
        self.at = len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """The null doc_ids come first; they are counted."""
        self.null += doc_id is None
        self.docs.append(doc_id or 0)
        self.sizes.append(len(ids) // 4)
        self.waiting.append(np.frombuffer(ids, "<u4"))
        self.held += len(ids) // 4
        if self.held >= FLUSH:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        keep = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, keep, FLUSH):
            blocks = pack_blocks(ids[i : min(i + FLUSH, keep)], self.percentile)
            for b in blocks:
                self.starts.append(self.at)
                self.at += len(b)
            self.out.write(b"".join(blocks))
        self.waiting, self.held = [ids[keep:].copy()], len(ids) - keep

    def close(self) -> None:
        self.flush(True)
        footer = struct.pack("<QQQ", len(self.docs), len(self.starts), self.null) + np.array(self.docs, "<i8").tobytes() + np.array(self.sizes, "<u8").tobytes() + np.array([*self.starts, self.at], "<u8").tobytes()
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class Reader:
    """Reads such a file from a seekable binary stream."""

    def __init__(self, f):
        self.f = f
        f.seek(0, io.SEEK_END)
        end = f.tell()
        f.seek(end - 16)
        tail = f.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of packed ids")
        size = struct.unpack("<Q", tail[:8])[0]
        f.seek(end - 16 - size)
        footer = f.read(size)
        docs, blocks, self.null = struct.unpack_from("<QQQ", footer)
        self.docs = np.frombuffer(footer, "<i8", docs, 24)
        self.sizes = np.frombuffer(footer, "<u8", docs, 24 + 8 * docs).astype(np.int64)
        self.starts = np.frombuffer(footer, "<u8", blocks + 1, 24 + 16 * docs).astype(np.int64)

    def blocks(self, first: int, stop: int) -> np.ndarray:
        """ids of the blocks from first up to stop."""
        stop = min(stop, len(self.starts) - 1)
        if first >= stop:
            return np.zeros(0, np.uint32)
        base = self.starts[first]
        self.f.seek(int(base))
        return unpack_blocks(self.f.read(int(self.starts[stop] - base)), self.starts[first:stop] - base)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Documents in file order, in bounded reads."""
        buffer, block, step = np.zeros(0, np.uint32), 0, FLUSH // BLOCK
        for k, (doc, size) in enumerate(zip(self.docs.tolist(), self.sizes.tolist(), strict=True)):
            while len(buffer) < size:
                buffer = np.concatenate([buffer, self.blocks(block, block + step)])
                block += step
            yield (None if k < self.null else doc), buffer[:size]
            buffer = buffer[size:]


class LibraryCodec(bpe.Codec):
    """Cached encoding in which the tokenizers library's own model encodes each new word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = dict(enumerate(bpe.byte_letters()))

    def encode_word(self, word: str) -> bytes:
        found = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(found)}I", *found)


def library_codec(path: str, _made: dict[str, LibraryCodec] = {}) -> LibraryCodec:  # noqa: B006  one per worker
    if path not in _made:
        _made[path] = LibraryCodec(path)
    return _made[path]


MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("first_doc", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])
READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_ids(documents: DataFrame, folder: str, end_id: int, vocabulary: str | None = None) -> DataFrame:
    """Encode, append end_id to each document, write files in ascending doc_id; returns the written manifest.

    One shuffle, of the texts, by ranges of doc_id.
    """
    vocab = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, end = library_codec(vocab), struct.pack("<I", end_id)
        where = f"{folder}/ids-{uuid.uuid4().hex}.pfor"
        store, path = _open(where)
        out = writer = first = None
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), bpe._texts(b.column(1)), strict=True):
                if writer is None:
                    store.create_dir(os.path.dirname(path), recursive=True)
                    out = store.open_output_stream(path)
                    writer, first = Writer(out), doc
                writer.add(doc, c.encode(text) + end)
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [where], "first_doc": pa.array([first], pa.int64()), "n_docs": [len(writer.docs)], "n_ids": [int(sum(writer.sizes))]})

    rows = text_input(documents.withColumn("doc_id", F.col("doc_id").cast("long")))
    spread = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialise(map_arrow(spread, run, MANIFEST), "manifest")


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. A task reads one file at a time.

    The only single-task step is the running sum over the manifest, which has a row for each file.
    """
    before = Window.orderBy(F.col("first_doc").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, path = _open(where)
                docs, starts, sizes, sums = [], [], [], []
                with store.open_input_file(path) as f:
                    for doc, ids in Reader(f).documents():
                        docs.append(doc)
                        starts.append(base)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4", copy=False)))
                        base += len(ids)
                        if len(docs) >= 8192:
                            yield _read_rows(docs, starts, sizes, sums)
                            docs, starts, sizes, sums = [], [], [], []
                if docs:
                    yield _read_rows(docs, starts, sizes, sums)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(files.repartition(n, "path"), run, READ)


def _read_rows(docs: list, starts: list, sizes: list, sums: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, sizes, sums)], READ.names)


def written_and_read(documents: DataFrame, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Write all documents' ids to new files in the shared store and read them back."""
    spark = documents.sparkSession
    return read_ids(spark, write_ids(documents, scratch_path(spark, "ids"), end_id, vocabulary))
