"""A read-only map from 64-bit keys to row numbers, built and searched with array operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.textblock import mixed


class Table:
    """Open addressing at half load; `find` gives each key's position in the array it was built from, or -1."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.row = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = (mixed(keys) >> self.shift).astype(np.int64)
        while len(left):
            free = self.row[slot] < 0
            self.row[slot[free]] = left[free]  # the last writer of a slot has it
            self.keys[slot[free]] = keys[left[free]]
            lost = self.row[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask
        filled = self.row >= 0
        self.keys[filled] = keys[self.row[filled]]

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = (mixed(keys) >> self.shift).astype(np.int64)
        out = self.row[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            s = slot[todo]
            out[todo] = self.row[s]
            todo = todo[(self.row[s] >= 0) & (self.keys[s] != keys[todo])]
        return out


class Growing:
    """A map from 128-bit keys (two arrays of 64 bits) to their numbers in the order of their coming."""

    def __init__(self):
        self.n, self.keys = 0, [np.zeros(1 << 15, np.uint64) for _ in range(2)]
        self._room(16)

    def _room(self, bits: int) -> None:
        self.shift, self.mask, self.row = np.uint64(64 - bits), (1 << bits) - 1, np.full(1 << bits, -1, np.int32)

    def _place(self, numbers: np.ndarray) -> None:
        slot = (self.keys[0][numbers] >> self.shift).astype(np.int64)
        left = numbers.astype(np.int32)
        while len(left):
            free = self.row[slot] < 0
            self.row[slot[free]] = left[free]  # the last writer of a slot has it
            lost = self.row[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Distinct keys that are not there."""
        old, self.n = self.n, self.n + len(a)
        for k, new in enumerate((a, b)):
            if self.n > len(self.keys[k]):
                self.keys[k] = np.concatenate([self.keys[k], np.zeros(max(self.n, len(self.keys[k])), np.uint64)])
            self.keys[k][old : self.n] = new
        if 2 * self.n > len(self.row):
            self._room(int(4 * self.n - 1).bit_length())
            old = 0
        self._place(np.arange(old, self.n))

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's number, or -1."""
        slot = (a >> self.shift).astype(np.int64)
        out = self.row[slot]
        todo = np.flatnonzero((out >= 0) & ((self.keys[0][out] != a) | (self.keys[1][out] != b)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            r = self.row[slot[todo]]
            out[todo] = r
            todo = todo[(r >= 0) & ((self.keys[0][r] != a[todo]) | (self.keys[1][r] != b[todo]))]
        return out


class BitSet:
    """Which hashes are wanted: a set of at most 2^MOST_BITS bits, so of a bounded size whatever it was built from.

    The fuller it is the more other hashes it lets through; whoever uses it decides exactly afterwards.
    """

    LEAST_BITS, MOST_BITS = 20, 28

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - 6 - (len(words) - 1).bit_length())

    @classmethod
    def of(cls, table: DataFrame, column: str) -> "BitSet":
        """Built by Spark from a column of evenly spread 64-bit hashes."""
        bits = int(np.clip((16 * max(table.count(), 1) - 1).bit_length(), cls.LEAST_BITS, cls.MOST_BITS))
        word = F.expr(f"shiftrightunsigned({column}, {64 - bits + 6})")
        bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")
        rows = table.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        out = np.zeros(1 << (bits - 6), np.uint64)
        out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
        return cls(out)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> self.shift
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)) == 1
