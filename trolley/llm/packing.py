"""Best-fit decreasing packing of token streams into fixed windows.

A document longer than the window is first cut into full windows; its rest and all short documents are
packed longest first, each into the open sequence with the least room that still holds it. A segment tree
over remaining room finds that sequence in a number of steps that depends on the window only.

Pieces are dealt to groups by a hash, so groups are even whatever the documents look like, and each group
is packed on its own: a group of 20,000 pieces loses at most a few windows against packing all at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.textblock import as_batch, blocks, raw
from trolley.llm.vocab import word_bpe
from trolley.llm.workspace import Workspace

WINDOW = 2048
END = 1
GROUP = 20_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Room:
    """Open sequences by remaining room, with a segment tree that tells which rooms have any."""

    def __init__(self, window: int):
        self.window, self.leaves = window, 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest room of at least `least`, and one of its sequences, which is no longer open."""
        i = least + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i ^ 1]):  # up until something lies to the right
                i >>= 1
            if i <= 1:
                return None
            i ^= 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length, given longest first; sequences are numbered as they open."""
    rooms, opened, sequence, offset = Room(window), 0, [], []
    for n in lengths:
        if found := rooms.take(n):
            room, s = found
        else:
            room, s, opened = window, opened, opened + 1
        sequence.append(s)
        offset.append(window - room)
        if room > n:
            rooms.put(room - n, s)
    return sequence, offset


def pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", window: int = WINDOW) -> DataFrame:
    """The pieces of each row's ids and the end id: full windows, then the rest. A null text has the end id alone."""
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECE.split(", ")])

    def run(batches):
        memo = word_bpe(vocabulary)
        for batch, text in blocks(batches):
            o, data = raw(text)
            ids, first = memo.stream(data, o, END)
            n = np.diff(first)
            cuts = -(-n // window)
            doc = np.repeat(np.arange(len(n)), cuts)
            start = window * (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
            length = np.minimum(window, n[doc] - start)
            whole = ids.astype("<u4", copy=False).tobytes()
            at = 4 * (first[doc] + start)
            crc = [zlib.crc32(whole[i:j]) for i, j in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            yield as_batch(schema, doc_id=batch.column("doc_id").take(pa.array(doc)), start=start, length=length, ids_crc32=crc, doc_tokens=n[doc])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def packed(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """A row per piece with its sequence and its offset there; within a sequence the offsets have no gaps.

    doc_id may be null or repeated: every row is packed on its own. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "packing")
    cut = work.table(pieces(docs, vocabulary, window).withColumn("salt", F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())), "pieces")
    n = max(1, cut.count() // group)

    def pack(one: pa.Table) -> pa.Table:
        order = [("length", "descending"), *[(c, "ascending") for c in ("doc_id", "start", "ids_crc32")]]
        one = one.take(pc.sort_indices(one, order))
        sequence, offset = best_fit(one["length"].to_pylist(), window)
        own = pa.array(np.array(sequence, np.int64) * n + one["bin"].to_numpy())
        return one.drop_columns("bin").append_column("sequence_id", own).append_column("offset", pa.array(offset, pa.int64()))

    dealt = cut.withColumn("bin", F.pmod("salt", F.lit(n))).drop("salt")
    return dealt.groupBy("bin").applyInArrow(pack, f"{PIECE}, sequence_id long, offset long")
