"""Vectorised views of text columns inside a task: byte blocks, words, shingles and their hashes.

Two word definitions are used. `words` are maximal runs of ASCII letters, digits and non-ASCII
characters of the lower-cased text. `tokens` are maximal runs of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Bytes of text worked on at a time; arrays of eight times that size stay in a core's cache.
BLOCK = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64


def _table(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64 - 1, n, dtype=np.uint64)


BYTE_VALUE, OTHER_VALUE = _table(11, 256), _table(12, 256)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = np.zeros(256, bool)
WORD[128:] = True
WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, long enough for the longest block so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, BLOCK + 1)
            for name, base in (("up", _BASE), ("down", _U(pow(int(_BASE), -1, 2**64)))):
                x = np.full(m, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_powers = _Powers()


class PrefixHash:
    """Hashes of any substrings of a byte array from one running sum; equal bytes give equal hashes."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUE):
        n = len(data)
        up, self.down = _powers.get(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def plain(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array; null is the empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return pc.fill_null(array.cast(pa.large_string()), "")


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and UTF-8 bytes of a large_string array, without a copy."""
    _, offsets, data = array.buffers()
    o = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return o - o[0], d


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Row ranges of about `limit` text bytes each, one row at least, with their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = plain(batch.column(column))
        o, _ = raw(text)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(o, o[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), text.slice(at, end - at)
            at = end


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a document's edge: starts, ends, document indexes."""
    n = len(inside)
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge - 1] = False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, start, "right") - 1


def sort_within(group: np.ndarray, value: np.ndarray, tie: np.ndarray | None = None) -> np.ndarray:
    """The order by group (whole numbers that do not fall), then by value (64 bits), then by tie."""
    if not len(group):
        return np.zeros(0, np.int64)
    bits = _U(max(1, int(group[-1]).bit_length()))
    packed = group.astype(np.uint64) << (_U(64) - bits) | value >> bits  # sorts faster than two arrays; decided below where it can't
    by = np.argsort(packed)
    at = by[np.flatnonzero(packed[by][1:] == packed[by][:-1])[:, None] + np.arange(2)]
    if any(x is not None and (x[at[:, 0]] != x[at[:, 1]]).any() for x in (value, tie)):
        return np.lexsort((value, group) if tie is None else (tie, value, group))
    return by


class Words:
    """The words of a block of texts: `hash` and `doc` by word, `first[d]:first[d + 1]` the words of text d."""

    def __init__(self, text: pa.Array):
        self.offsets, self.data = raw(pc.utf8_lower(text))
        self.start, self.end, self.doc = spans(WORD[self.data], self.offsets)
        self.hash = PrefixHash(self.data).of(self.start, self.end)
        self.first = np.searchsorted(self.doc, np.arange(len(text) + 1))

    def shingles(self, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word's index of each run of n words within one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        h = self.hash[at]
        for k in range(1, n):
            h = h * _BASE + self.hash[at + k]
        return mixed(h), at

    def whole(self, d: int) -> np.ndarray:
        """The one shingle of a text of fewer than five words: all its words, or none."""
        own = self.hash[self.first[d] : self.first[d + 1]]
        h = np.zeros(1, np.uint64)
        for x in own:
            h = h * _BASE + x
        return mixed(h + _U(len(own))) if len(own) else h[:0]


@cache
def odd_multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhashes(shingle: np.ndarray, starts: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """n MinHash values (uint32) of each segment starts[i]:starts[i+1] of shingle hashes; no segment is empty."""
    out = np.empty((len(starts), n), np.uint32)
    low = (shingle >> _U(32)).astype(np.uint32)
    for k, a in enumerate(odd_multipliers(n, seed)):
        y = low * a
        y ^= y >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def as_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a 2-d array as one binary value."""
    rows = np.ascontiguousarray(rows)
    n, width = len(rows), rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int64) * width).astype(np.int32)), pa.py_buffer(rows.tobytes())])
