"""Packing into as few windows as can be: dominance reduction after Martello and Toth, then best-fit decreasing.

Lengths are whole numbers up to the window, so an instance is a count for each length: at most `window` numbers, whatever
the number of documents. Only these counts come to the driver. There a set of one, two or three lengths that dominates every
other way to fill the window of one of them is fixed for good, as many times as its members last; what no set dominates is
packed by best fit, longest first, many equal windows at a time. The outcome is a short list of kinds of windows with the
number of each. Spark ranks the pieces of each length, and a piece finds its window by its rank.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trolley.llm.bytebpe import SLAB, byte_bpe
from trolley.llm.textblock import as_batch, blocks, raw
from trolley.llm.workspace import Workspace

WINDOW = 2048
END = 0
#: Bits of a piece's rank among those of its length.
_RANK = 44
_CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
_TYPES = {"long": pa.int64(), "int": pa.int32()}


@dataclass
class Kind:
    """n windows that hold the same lengths, each with the times that it is there."""

    n: int
    parts: tuple[tuple[int, int], ...]


def _best_pair(count: np.ndarray, sizes: np.ndarray, room: int) -> tuple[int, int]:
    """The two lengths of sizes (ascending, with their counts) with the largest sum up to room, the longer first; (0, 0) if none."""
    if not len(sizes):
        return 0, 0
    below = np.zeros(room + 1, np.int64)
    below[sizes] = sizes
    below = np.maximum.accumulate(below)
    cap = np.minimum(sizes, room - sizes)
    mate = below[np.maximum(cap, 0)]
    alone = (mate == sizes) & (count[sizes] < 2)
    mate[alone] = below[sizes[alone] - 1]
    total = np.where(mate > 0, sizes + mate, 0)
    k = len(total) - 1 - int(np.argmax(total[::-1]))  # of equal sums that with the longest length
    return (int(sizes[k]), int(mate[k])) if total[k] else (0, 0)


def dominating(count: np.ndarray, s: int, window: int) -> tuple[int, ...] | None:
    """The lengths whose set with s dominates all others that hold s, or None. count: the lengths left, s itself taken out once.

    A set dominates another if the other's members can be dealt to its members with no sum above the member's length.
    Where two fit beside s at most, the longest that fits dominates all single ones, and all pairs if it is as long as the
    best pair. The best pair dominates if its longer one is the longest that fits, unless two others fit that are both longer
    than its shorter one and together longer than its longer one.
    """
    room = window - s
    sizes = np.flatnonzero(count[: room + 1])
    if not len(sizes):
        return ()
    longest = int(sizes[-1])
    if longest == room:
        return (longest,)
    least = np.repeat(sizes[:3], np.minimum(count[sizes[:3]], 3))[:3]
    if len(least) < 2 or least[0] + least[1] > room:
        return (longest,)
    if len(least) == 3 and least.sum() <= room:
        return None
    a, b = _best_pair(count, sizes, room)
    if longest >= a + b:
        return (longest,)
    above = sizes[sizes > b]
    if a == longest and sum(_best_pair(count, above, room)) <= a:
        return a, b
    return None


def reduced(count: np.ndarray, window: int) -> tuple[list[Kind], np.ndarray]:
    """The windows that dominance fixes, and the counts of the lengths that are left.

    A set that dominates does so as long as its members last: what else there is only gets less. So it is fixed as often as
    they do, and rounds over the lengths, longest first, go on until none fixes anything.
    """
    left, kinds, more = count.copy(), [], True
    while more:
        more = False
        for s in np.flatnonzero(left)[::-1].tolist():
            while left[s]:
                left[s] -= 1
                found = dominating(left, s, window)
                left[s] += 1
                if found is None:
                    break
                members = Counter((s, *found))
                n = min(int(left[x]) // k for x, k in members.items())
                for x, k in members.items():
                    left[x] -= n * k
                kinds.append(Kind(n, tuple(sorted(members.items(), reverse=True))))
                more = True
    return kinds, left


def best_fit(count: np.ndarray, window: int) -> list[Kind]:
    """Best-fit decreasing by counts: each length, longest first, goes to the windows with the least room that still holds it.

    Once one is in a window, that has the least room of all that hold another, so a window takes as many as it can in turn.
    """
    open_: list[list[Kind]] = [[] for _ in range(window + 1)]
    has, done = np.zeros(window + 1, bool), []

    def put(kind: Kind, room: int) -> None:
        if kind.n:
            open_[room].append(kind)
            has[room] = True

    for s in np.flatnonzero(count)[::-1].tolist():
        todo = int(count[s])
        while todo:
            room = s + int(np.argmax(has[s:]))
            if has[room]:
                kind = open_[room].pop()
                has[room] = bool(open_[room])
            else:
                kind, room = Kind(-(-todo // (window // s)), ()), window
            each = room // s
            full = min(kind.n, todo // each)
            todo -= full * each
            put(Kind(full, (*kind.parts, (s, each))), room - s * each)
            rest = kind.n - full
            if rest and todo:
                put(Kind(1, (*kind.parts, (s, todo))), room - s * todo)
                rest, todo = rest - 1, 0
            put(Kind(rest, kind.parts), room)
    for kinds in open_:
        done += kinds
    return done


def plan(count: np.ndarray, window: int = WINDOW) -> list[Kind]:
    """Kinds of windows that hold count[s] pieces of each length s from 1 to window."""
    fixed, left = reduced(count, window)
    return fixed + best_fit(left, window)


@dataclass
class Places:
    """Where the pieces of a length go, by ranges of their rank: sorted keys of length and first rank, and what holds behind each."""

    key: np.ndarray
    base: np.ndarray
    times: np.ndarray
    offset: np.ndarray

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence of each piece and its offset there."""
        key = length << _RANK | rank
        at = np.searchsorted(self.key, key, "right") - 1
        nth, turn = np.divmod(key - self.key[at], self.times[at])
        return self.base[at] + nth, self.offset[at] + turn * length


def places(kinds: list[Kind], window: int) -> Places:
    """A window holds under sqrt(2 window) different lengths, and best fit makes a few kinds a length: the table has a bound of its own."""
    used, rows, base = np.zeros(window + 1, np.int64), [], 0
    for kind in kinds:
        offset = 0
        for s, times in kind.parts:
            rows.append((s << _RANK | int(used[s]), base, times, offset))
            used[s] += kind.n * times
            offset += s * times
        base += kind.n
    return Places(*np.array(sorted(rows), np.int64).reshape(-1, 4).T.copy())


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", window: int = WINDOW) -> DataFrame:
    """Each row's ids and the end id in pieces of a window, of which the first may be shorter; part and local number the pieces of a length."""
    schema = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in _CUT.split(", ")])

    def run(batches):
        memo, part, seen = byte_bpe(vocabulary), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch, text in blocks(batches):
            o, data = raw(text)
            if len(data) > SLAB:  # one text alone
                ids = memo.long(data, END)
                first = np.array([0, len(ids)])
            else:
                ids, first = memo.stream(data, o, END)
            n = np.diff(first)
            cuts = -(-n // window)
            doc = np.repeat(np.arange(len(n)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            head = (n - (cuts - 1) * window)[doc]
            start = np.where(piece > 0, head + (piece - 1) * window, 0)
            length = np.where(piece > 0, window, head)
            whole = ids.astype("<u4", copy=False).tobytes()
            at = 4 * (first[doc] + start)
            crc = [zlib.crc32(whole[i:j]) for i, j in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            by = np.argsort(length, kind="stable")
            same = length[by]
            local = np.empty(len(by), np.int64)
            local[by] = seen[same] + np.arange(len(by)) - np.searchsorted(same, same)
            seen += np.bincount(length, minlength=window + 1)
            yield as_batch(schema, doc_id=batch.column("doc_id").take(pa.array(doc)), piece=piece, start=start, length=length, ids_crc32=crc, part=np.full(len(doc), part), local=local)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CUT)


def packed(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", window: int = WINDOW) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece; within a sequence the offsets have no gaps.

    doc_id may be null or repeated: every row is a document of its own, with the pieces from 0. A null or empty text has the
    end id alone. Documents of equal length are dealt to their windows in the order of the table's files. Only a document
    longer than the window is cut. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "dominance")
    cut = work.table(pieces(docs, vocabulary, window), "pieces")
    by_part = work.table(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    count = np.zeros(window + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # at most a row for each length of a window
        count[length] = n
    sent = spark.sparkContext.broadcast(places(plan(count, window), window))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = cut.join(by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")), ["length", "part"])
    given = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            sequence, offset = sent.value.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[x.split()[0] for x in out.split(", ")])

    return given.mapInArrow(place, out)
