"""Byte-pair encoding and decoding with a public vocabulary (operator 2).

Words are merged with a priority queue of merge ranks over a doubly linked list of symbols: the queue holds
(rank, position) entries; an entry is stale, and skipped, when its left symbol is gone or the pair standing there
is no longer the one it was queued for. Decoding looks every id up in the vocabulary and joins the strings, with a
space between tokens, as the library does for a tokenizer file without a decoder.

Texts are cut at ASCII white space first. That is exact: the vocabulary's normalizer turns white space into single
spaces, its pre-tokenizer drops them, neither NFC nor the lower-casing of characters looks across a space, and no
special token contains one. Chunks repeat, so a bounded cache maps a chunk to its ids.

Defined results: null and empty texts have no ids, an empty decoded text, and the hashes of zero bytes. Repeated
rows give repeated results. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, text_input

#: Entries in a generation of a worker's caches, and the longest key that is kept; longer ones are encoded anew.
CACHE_CHUNKS = 400_000
CACHE_WORDS = 400_000
CACHE_CHARS = 40


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def merge_symbols(symbols: list[int], ranks: dict[int, int]) -> list[int]:
    """Merge a list of symbol ids in place of rank order; ranks maps left << 20 | right to rank << 20 | merged id."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    after[-1] = -1
    queue = [found << 32 | i for i in range(n - 1) if (found := get(symbols[i] << 20 | symbols[i + 1])) is not None]
    heapify(queue)
    while queue:
        entry = heappop(queue)
        i, rule = entry & 0xFFFFFFFF, entry >> 32
        j = after[i]
        if j < 0 or symbols[i] < 0 or get(symbols[i] << 20 | symbols[j]) != rule:
            continue  # stale: one of the two symbols has been merged since
        symbols[i] = merged = rule & 0xFFFFF
        symbols[j] = -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (found := get(merged << 20 | symbols[k])) is not None:
                heappush(queue, found << 32 | i)
        h = before[i]
        if h >= 0 and (found := get(symbols[h] << 20 | merged)) is not None:
            heappush(queue, found << 32 | h)
    return [s for s in symbols if s >= 0]  # the survivors stand in list order


class Cache(dict):
    """A bounded memo of make(key): when the young generation is full it becomes the old one, so frequent keys stay."""

    def __init__(self, make, entries: int, longest: int):
        super().__init__()
        self.make, self.entries, self.longest, self.old = make, entries, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.ranks = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(model["merges"])}
        letters = byte_letters()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")")
        self.strings = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        whole = Tokenizer.from_file(path)
        self.normalize = whole.normalizer.normalize_str
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.words = Cache(self.encode_word, CACHE_WORDS, CACHE_CHARS)
        self.chunks = Cache(self.encode_chunk, CACHE_CHUNKS, CACHE_CHARS)

    def encode_word(self, word: str) -> bytes:
        """ids of one pre-tokenized word."""
        raw = word.encode()
        symbols = list(map(self.inner.__getitem__, raw))
        symbols[-1] = self.last[raw[-1]]
        symbols = merge_symbols(symbols, self.ranks)
        return struct.pack(f"<{len(symbols)}I", *symbols)

    def encode_chunk(self, chunk: str) -> bytes:
        """ids of a text without ASCII white space."""
        if "<|" in chunk:
            parts = self.cut.split(chunk)
            if len(parts) > 1:
                return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self.encode_chunk(p) for p in parts if p)
        # Latin letters are composed already and each is lower-cased alone; all else goes through the library's normalizer.
        plain = chunk.lower() if not _beyond_latin(chunk) else self.normalize(chunk)
        if plain.isalpha() and plain.isascii():
            return self.words[plain]
        return b"".join(map(self.words.__getitem__, self.pieces(plain)))

    def encode(self, text: str | None) -> bytes:
        """ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.chunks.__getitem__, _ascii_split(text))) if text else b""

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def byte_letters() -> list[str]:
    """The byte alphabet of byte-level BPE: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


_plain = re.compile("[^\\x20\\x09-\\x0D]+").findall
_odd = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]").search
_beyond_latin = re.compile("[^\\x00-\\u024f]").search


def _ascii_split(text: str) -> list[str]:
    """Chunks between ASCII white space. str.split() is faster, and the same unless it cuts at other characters too."""
    return _plain(text) if _odd(text) else text.split()


def codec(path: str, _made: dict[str, Codec] = {}) -> Codec:  # noqa: B006  one per worker process
    if path not in _made:
        _made[path] = Codec(path)
    return _made[path]


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])
DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian uint32) of every whole text. No shuffle."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([c.encode(t) for t in _texts(b.column(1))], pa.binary())], ["doc_id", "ids"])

    return map_arrow(text_input(documents), run, ENCODED)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text: the vocabulary's strings of every id, joined."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x) if x else "" for x in _texts(b.column(1))], pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip_digests(documents: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode those ids, in one pass over the texts.

    with_ids adds the ids themselves (binary, little-endian uint32).
    """
    path = vocabulary or default_vocabulary()
    schema = T.StructType([*DIGESTS.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, a, d, held = [], [], [], []
            for t in _texts(b.column(1)):
                ids = c.encode(t)
                if with_ids:
                    held.append(ids)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            columns = [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(held, pa.binary())] if with_ids else [])], schema.names)

    return map_arrow(text_input(documents), run, schema)


def _texts(column: pa.Array) -> Iterator:
    """Values one by one, so that a batch's texts don't all exist twice."""
    return (x.as_py() for x in column)
