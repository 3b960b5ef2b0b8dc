"""Vectorised word and shingle hashing over Arrow batches of text.

All functions work on the UTF-8 buffer of an Arrow string column, in slices of bounded size, so
memory follows the slice (or the longest single text), not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20260901).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
#: Words of more bytes than this are hashed one by one.
_LONG = 64
#: A second table, for hashes of 128 bits.
OTHER = np.random.default_rng(20260903).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = np.random.default_rng(20260902).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: dict[str, np.ndarray] = {}

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: The same with ASCII punctuation and symbols.
IS_BREAK = IS_SPACE.copy()
IS_BREAK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES * 2)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, past the last row, bytes, offsets) of slices of at most ``limit`` bytes, one row at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def hash_prefix(raw: np.ndarray, table: np.ndarray = _TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums whose differences, times ``down[start]``, hash any substring."""
    up, down = powers(len(raw) + 1)
    h = np.empty(len(raw) + 1, np.uint64)
    h[0] = 0
    np.cumsum(table[raw] * up[: len(raw)], out=h[1:])
    return h, down


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word raw[start:end], A-Z read as a-z.

    Eight bytes a step go through ``mix``, which no pattern of letters cancels out; long words take BLAKE2b.
    """
    low = np.zeros(len(raw) + 8, np.uint8)
    low[: len(raw)] = _LOWER[raw]
    eight = np.ndarray((len(raw) + 1,), "<u8", low.data, strides=(1,))
    left, at = end - start, start
    h = mix(left.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    which = np.flatnonzero(left <= _LONG)
    left, at = left[which], at[which]
    while len(which):
        keep = _U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - np.minimum(left, 8).astype(np.uint64) * _U(8))
        h[which] = mix((h[which] ^ (eight[at] & keep)) + _U(0xD1B54A32D192ED03))
        more = left > 8
        which, left, at = which[more], left[more] - 8, at[more] + 8
    for i in np.flatnonzero(end - start > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, with A-Z read as a-z when hashed.

    ``breaks`` may name other bytes that part words.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        solid = ~breaks[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | edge[:n]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.hash = word_hashes(raw, self.start, self.end)
        #: For each text the index of its first word, and one past the last word of all.
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text index, hash) of each run of ``k`` words; a shorter text's whole sequence is its one shingle."""
        n = len(self.hash)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        doc = self.doc()
        left = self.first[1:][doc] - np.arange(n)
        keep = left >= k
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if n >= k:
            acc = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                acc += self.hash[j : n - k + 1 + j] * _STEP[j]
            at = np.flatnonzero(keep[: n - k + 1])
            h, d = mix(acc[at]), doc[at]
        else:
            h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(short):
            tail = []
            for s in short:
                words = self.hash[self.first[s] : self.first[s + 1]]
                tail.append(np.sum(np.append(words * _STEP[: len(words)], _STEP[40 + len(words)]), dtype=np.uint64))
            h = np.concatenate([h, mix(np.array(tail, np.uint64))])
            d = np.concatenate([d, short])
            order = np.argsort(d, kind="stable")
            h, d = h[order], d[order]
        return d, h


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, hash) pairs, sorted; ``doc`` must be sorted already."""
    if not len(h):
        return doc, h
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.empty(len(h), bool)
    new[0] = True
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]
