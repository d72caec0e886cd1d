"""Word shingles and their hashes in numpy, for whole slices of texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column's slice, and the offsets of its values (nulls are empty)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of all texts in order, and each text's number of words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~_SPACE[data]
    begins = np.empty(n, bool)
    begins[0] = solid[0]
    begins[1:] = solid[1:] & ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    begins[inner] |= solid[inner]  # a text's first byte begins a word even if the text before ends in one
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    where = np.flatnonzero(solid)
    firsts = np.searchsorted(where, starts)
    lengths = np.diff(np.append(firsts, len(where)))
    powers = np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))
    place = np.arange(len(where)) - np.repeat(firsts, lengths)
    value = _BYTE_LOWER[data[where]] * powers[place]
    return mix(np.add.reduceat(value, firsts) + lengths.astype(np.uint64)), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and each text's number of them.

    A text with fewer words has its whole sequence as the one shingle; without words it has none.
    """
    hashes, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    total = len(hashes)
    chain = np.zeros(total, np.uint64)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    left = np.repeat(ends, counts) - np.arange(total)  # words of the text from here on
    for k in range(words):
        chain = np.where(left > k, mix(chain * _STEP + padded[k : k + total] + np.uint64(k + 1)), chain)
    full = left >= words
    full[(ends - counts)[(counts > 0) & (counts < words)]] = True  # the first word of a short text
    owner = np.repeat(np.arange(len(counts)), counts)[full]
    chain = chain[full]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i in range(len(counts)):
        s = np.sort(chain[bounds[i] : bounds[i + 1]])
        if len(s):
            s = s[np.append(True, s[1:] != s[:-1])]
            sizes[i] = len(s)
            out.append(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


class MinHash:
    """The minima of universal hash functions a * x + b (mod 2**32, a odd) over sets of 32-bit values."""

    def __init__(self, hashes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, hashes, dtype=np.uint32)

    def __call__(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Signatures (one row for each set); those of empty sets hold the largest value."""
        out = np.full((len(sizes), len(self.a)), 0xFFFFFFFF, np.uint32)
        rows = np.flatnonzero(sizes)
        x = (values >> np.uint64(32)).astype(np.uint32)
        starts = (np.cumsum(sizes) - sizes)[rows]
        step = 1 << 15  # values that stay in a core's cache while every function goes over them
        first = 0
        while first < len(rows):
            stop = max(first + 1, int(np.searchsorted(starts, starts[first] + step)))
            end = starts[stop] if stop < len(rows) else len(x)
            part, at = x[starts[first] : end], starts[first:stop] - starts[first]
            y = np.empty_like(part)
            for k in range(len(self.a)):
                np.multiply(part, self.a[k], out=y)
                np.add(y, self.b[k], out=y)
                out[rows[first:stop], k] = np.minimum.reduceat(y, at)
            first = stop
        return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band (its number and its minima) of each signature."""
    n, k = signatures.shape
    rows = k // bands
    parts = signatures.reshape(n, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for r in range(rows):
        key = mix(key * _STEP + parts[:, :, r])
    return key.view(np.int64)


def set_ids(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A 128-bit name for each set."""
    ends = np.cumsum(sizes)
    raw = values.astype("<u8", copy=False)
    return [hashlib.blake2b(raw[e - s : e].tobytes(), digest_size=16).digest() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
