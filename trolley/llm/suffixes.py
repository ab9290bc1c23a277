"""Removal of byte strings that occur more than once, by suffix arrays sorted in two stages.

A string of LENGTH bytes that starts at two places is removed at both. Each window of LENGTH bytes is anchored
at the place in it whose KEY bytes hash least, so equal windows have equal anchors at equal offsets. Anchors
that occur once cannot belong to a repeated window; the others' windows travel, as one segment of text an
anchor, to the task of that anchor. There the segments form one text whose suffixes are sorted in two stages:
only suffixes smaller than their successors are compared; the others are induced by one scan of the buckets
of first bytes. Neighbours in that order with a common prefix of LENGTH bytes or more are repeats.

An anchor with very many different segments (the edge of a passage that a large share of all documents holds)
is not brought into one task: its windows are parted by the anchor's offset in them, and each part goes by all
bytes that its windows have in common. Parts that are alone in this drop out, parts of few segments are sorted,
and the rest is parted again, until a part is one window and equal parts are equal windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.hashtable import BitSet
from trolley.llm.textblock import PrefixHash, as_batch, blocks, mixed, raw
from trolley.llm.workspace import ROW_KEY, Workspace, keyed, partitions

LENGTH, KEY = 200, 50
#: Segments of one anchor that one task may sort.
CROWD = 400
#: Bytes of segments sorted at a time; whole anchors, so more if one anchor has more.
SORTED = 1 << 18
#: Parts that the windows of a crowded anchor are dealt to at a time.
FAN = 6
_PLACE = np.uint64((1 << 28) - 1)
#: Open segments whose owners a bit set still tells apart; beyond that they are joined to the texts of their owners.
MARKS = 1 << 24
#: Windows looked at together; a longer text is cut into so many, and what a cut parts is put together by sorting.
WINDOWS = 1 << 27


def anchors(o: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text index, first window's start in the block, number of windows, anchor's hash and place."""
    if len(data) < WINDOWS + LENGTH:
        return _anchors(o, data)
    found = []
    for a in range(0, len(data) - LENGTH + 1, WINDOWS):
        part = data[a : a + WINDOWS + LENGTH - 1]
        doc, first, n, anchor, place = _anchors(np.clip(o - a, 0, len(part)), part)
        found.append((doc, first + a, n, anchor, place + a))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(o: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    span, n = LENGTH - KEY + 1, len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none
    start = np.arange(n - KEY + 1)
    key = PrefixHash(data).of(start, start + KEY)
    least = key & ~_PLACE | start.astype(np.uint64)
    width = 1
    while 2 * width <= span:  # least of 2, 4, 8 ... places from each on
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[span - width : span - width + n - LENGTH + 1])
    place = (least & _PLACE).astype(np.int64)
    doc = np.repeat(np.arange(len(o) - 1), np.diff(o))[: n - LENGTH + 1]
    valid = np.arange(n - LENGTH + 1) + LENGTH <= o[1:][doc]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | ~valid[:-1] | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & valid)
    count = np.diff(np.append(np.concatenate([[0], np.cumsum(valid)])[first], valid.sum()))
    return doc[first], first, count, key[place[first]], place[first]


def _smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it; the last is."""
    step = np.sign(np.diff(text.astype(np.int16), append=np.int16(32767)))
    nearest = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    return step[nearest] > 0


def suffix_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Starts of all suffixes of a text of bytes in the order of their first `depth` bytes (or more); two stages.

    Suffixes smaller than their successors are sorted directly. A larger one, c followed by a suffix that has
    its place already, goes to the front part of the bucket of c in the order of these places; scanning the
    buckets upwards reaches every larger suffix after its successor.
    """
    small = _smaller_than_next(text)
    whole = text.tobytes()
    direct = sorted(np.flatnonzero(small).tolist(), key=lambda i: whole[i : i + depth])
    direct = np.array(direct, np.int64)
    first = text[direct]
    values = np.unique(text)
    edge = np.searchsorted(first, np.append(values.astype(np.int16), 256))
    front: dict[int, list[np.ndarray]] = {int(v): [] for v in values}
    order = []

    def induce(found: np.ndarray, value: int) -> np.ndarray:
        """Put the larger predecessors of `found` into their buckets; those of this bucket are returned."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        bucket = text[before]
        by = np.argsort(bucket, kind="stable")
        before, bucket = before[by], bucket[by]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        here = before[:0]
        for part in np.split(before, cut):
            if len(part):
                if (b := int(text[part[0]])) == value:
                    here = part
                else:
                    front[b].append(part)
        return here

    for k, value in enumerate(values.tolist()):
        found = np.concatenate(front[value]) if front[value] else direct[:0]
        while len(found):
            order.append(found)
            found = induce(found, value)
        found = direct[edge[k] : edge[k + 1]]
        order.append(found)
        induce(found, value)
    return np.concatenate(order)


def common_prefixes(text: np.ndarray, order: np.ndarray, room: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For neighbours in the order: whether they agree in `depth` values within the room that each start has."""
    a, b = order[:-1], order[1:]
    same = np.flatnonzero((room[a] >= depth) & (room[b] >= depth))
    for k in range(0, depth, 8):
        part = slice(k, min(k + 8, depth))
        i, j = a[same], b[same]
        equal = np.ones(len(same), bool)
        for x in range(part.start, part.stop):
            equal &= text[i + x] == text[j + x]
        same = same[equal]
    out = np.zeros(len(a), bool)
    out[same] = True
    return out


def repeated_windows(segments: list[bytes]) -> list[np.ndarray]:
    """By segment: which of its windows of LENGTH bytes occur again, in it or in another."""
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)  # no byte of UTF-8
    room = np.repeat(ends - 1, sizes + 1) - np.arange(len(text))
    order = suffix_order(text)
    order = order[room[order] >= LENGTH]
    pair = common_prefixes(text, order, room)
    again = np.zeros(len(text), bool)
    again[order[:-1][pair]] = True
    again[order[1:][pair]] = True
    return [again[a : a + n - LENGTH + 1] for a, n in zip(starts, sizes, strict=True)]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


FOUND = "anchor long, content long, starts array<int>, ends array<int>"
_FOUND = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _sort_segments(batches):
    """Of segments (once each) in the order of their anchors: the runs of repeated windows of each that has any."""
    held: dict[tuple[int, int], bytes] = {}
    size, last = 0, None

    def flush():
        rows = [(*key, *_runs(flags)) for key, flags in zip(held, repeated_windows(list(held.values())), strict=True) if flags.any()]
        if rows:
            yield as_batch(_FOUND, **{f.name: list(c) for f, c in zip(_FOUND, zip(*rows, strict=True), strict=True)})

    for batch in batches:
        for anchor, content, segment in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "segment")), strict=True):
            if size >= SORTED and anchor != last:
                yield from flush()
                held, size = {}, 0
            held[anchor, content] = segment
            size, last = size + len(segment), anchor
    if held:
        yield from flush()


PART = "part long, sub long, n int, anchor long, content long, shift int, place int, low int, high int, segment binary"
_PART = pa.schema([("part", pa.int64()), ("sub", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()), ("shift", pa.int32()), ("place", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("segment", pa.binary())])


def _digest(data: bytes, *numbers: int) -> int:
    return int.from_bytes(hashlib.blake2b(data + repr(numbers).encode(), digest_size=8).digest(), "little", signed=True)


def _parts(batches):
    """Of segments whose anchor lies `place` bytes in: the windows with the anchor low..high bytes in, in FAN parts.

    part: digest of the bytes that all windows with these offsets hold in common; sub: of this segment's bytes;
    anchor, content, shift: the segment it comes from and its first window there.
    """
    for batch in batches:
        rows = []
        for anchor, content, shift, place, low, high, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "shift", "place", "low", "high", "segment")), strict=True):
            n = len(text) - LENGTH + 1
            step = -(-(high - low + 1) // FAN)
            for a in range(low, high + 1, step):
                b = min(a + step - 1, high)
                least, most = max(a, place - n + 1), min(b, place)
                if least <= most:
                    own = text[place - most : place - least + LENGTH]
                    rows.append((_digest(text[place - a : place - b + LENGTH], anchor, a, b), _digest(own, anchor, a, b, most), most - least + 1, anchor, content, shift + place - most, most, a, b, own))
        if rows:
            yield as_batch(_PART, **{f.name: list(c) for f, c in zip(_PART, zip(*rows, strict=True), strict=True)})


def _crowded(texts: DataFrame, work: Workspace) -> DataFrame | None:
    """anchor, content, starts, ends: the repeated windows of segments whose anchors have too many to sort in one task."""
    source = texts.select("anchor", "content", F.lit(0).alias("shift"), "place", F.lit(0).alias("low"), F.lit(LENGTH - KEY).alias("high"), "segment")
    out, level = None, 0
    while source is not None:
        parts = work.table(source.mapInArrow(_parts, PART), f"parts-{level}")
        contents = work.table(parts.groupBy("part", "sub").agg(F.count("*").alias("times"), F.first("n").alias("n")), f"part-contents-{level}")
        groups = contents.groupBy("part").agg(F.count("*").alias("segments"), F.min("times").alias("least")).where("segments > 1 and least = 1")
        open_ = work.table(groups.select("part", (F.col("segments") > CROWD).alias("crowd")), f"part-open-{level}")
        once = parts.join(open_, "part").dropDuplicates(["part", "sub"])
        calm = once.where("not crowd").select(F.col("part").alias("anchor"), F.col("sub").alias("content"), "segment")
        calm = calm.repartition(partitions(work.spark), "anchor").sortWithinPartitions("anchor")
        found = work.table(calm.mapInArrow(_sort_segments, FOUND), f"part-found-{level}")
        equal = contents.where("times > 1").select(F.col("part").alias("anchor"), F.col("sub").alias("content"), F.array(F.lit(0)).alias("starts"), F.array("n").alias("ends"))
        hit = parts.drop("segment").join(equal.union(found).withColumnsRenamed({"anchor": "part", "content": "sub"}), ["part", "sub"])
        moved = hit.select("anchor", "content", *[F.transform(c, lambda x: x + F.col("shift")).alias(c) for c in ("starts", "ends")])
        out = moved if out is None else out.union(moved)
        source = once.where("crowd").drop("crowd", "part", "sub", "n") if open_.where("crowd").limit(1).count() else None
        level += 1
    return out.groupBy("anchor", "content").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")])


def spans(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_key, starts, ends: the windows to remove, as runs of their starts in the document's bytes.

    docs: doc_key (a number of its own for each row), text; rows without a repeated window are left out.
    """
    spark = work.spark

    def count(batches):
        schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])
        for batch, text in blocks(batches):
            key, n = np.unique(anchors(*raw(text))[3], return_counts=True)
            yield as_batch(schema, anchor=key.view(np.int64), n=n)

    counted = docs.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    many = work.table(counted.where("n > 1").select("anchor"), "many")
    sent = spark.sparkContext.broadcast(BitSet.of(many, "anchor"))
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc_key", pa.int64()), ("place", pa.int64()), ("n", pa.int32())])

    def locate(batches):
        for batch, text in blocks(batches):
            o, data = raw(text)
            doc, first, n, anchor, _, content = _segments(o, data)
            keep = sent.value.has(anchor)
            doc, first = doc[keep], first[keep]
            yield as_batch(schema, anchor=anchor[keep].view(np.int64), content=content[keep].view(np.int64), doc_key=batch.column("doc_key").to_numpy()[doc], place=first - o[doc], n=n[keep])

    places = work.table(docs.mapInArrow(locate, "anchor long, content long, doc_key long, place long, n int"), "places")
    contents = work.table(places.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min("doc_key").alias("owner"), F.first("n").alias("n")), "contents")
    # equal segments are repeats of each other in all their windows; an anchor needs sorting if one of its several segments stands alone
    groups = contents.groupBy("anchor").agg(F.count("*").alias("segments"), F.min("times").alias("least")).where("segments > 1 and least = 1").select("anchor", (F.col("segments") > CROWD).alias("crowd"))
    open_ = work.table(contents.join(groups, "anchor").select("anchor", "content", "owner", "crowd"), "open")
    return _found(places, contents, _texts(docs, open_), open_, work)


def _segments(o: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of `anchors`, and the digest of each one's bytes."""
    doc, first, n, anchor, place = anchors(o, data)
    content = mixed(PrefixHash(data).of(first, first + n + LENGTH - 1) + n.astype(np.uint64)) if len(first) else anchor
    return doc, first, n, anchor, place, content


def _owner_mark(content: np.ndarray, doc_key: np.ndarray) -> np.ndarray:
    return mixed(content ^ mixed(doc_key))


def _texts(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """anchor, content, segment, place (the anchor's, in the segment): the bytes of the open segments, sent by the row that owns them.

    Few open segments are told by a bit set of their marks (another row sends one too now and then, which changes nothing).
    Many are joined to their owners as lists, one for each row, and so no longer than its text.
    """
    marks = pa.schema([("mark", pa.int64())])
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("segment", pa.binary()), ("place", pa.int32())])

    def mark(batches):
        for batch in batches:
            content, owner = (batch.column(c).to_numpy().view(np.uint64) for c in ("content", "owner"))
            yield as_batch(marks, mark=_owner_mark(content, owner).view(np.int64))

    if many := open_.count() > MARKS:
        docs = docs.join(open_.groupBy(F.col("owner").alias("doc_key")).agg(F.collect_list("content").alias("contents")), "doc_key")
    wanted = None if many else docs.sparkSession.sparkContext.broadcast(BitSet.of(open_.select("content", "owner").mapInArrow(mark, "mark long"), "mark"))

    def owned(batch: pa.RecordBatch, doc: np.ndarray, content: np.ndarray) -> np.ndarray:
        if wanted is not None:
            return wanted.value.has(_owner_mark(content, batch.column("doc_key").to_numpy().view(np.uint64)[doc]))
        out, edge = np.zeros(len(doc), bool), np.searchsorted(doc, np.arange(batch.num_rows + 1))
        for k, own in enumerate(batch.column("contents")):
            out[edge[k] : edge[k + 1]] = np.isin(content[edge[k] : edge[k + 1]].view(np.int64), own.values.to_numpy())
        return out

    def send(batches):
        for batch, text in blocks(batches):
            o, data = raw(text)
            whole = data.tobytes()
            doc, first, n, anchor, place, content = _segments(o, data)
            keep = np.flatnonzero(owned(batch, doc, content))
            end = first + n + LENGTH - 1
            if len(keep):
                yield as_batch(schema, anchor=anchor[keep].view(np.int64), content=content[keep].view(np.int64), segment=[whole[a:b] for a, b in zip(first[keep].tolist(), end[keep].tolist(), strict=True)], place=(place - first)[keep])

    return docs.mapInArrow(send, "anchor long, content long, segment binary, place int")


def _found(places: DataFrame, contents: DataFrame, texts: DataFrame, open_: DataFrame, work: Workspace) -> DataFrame:
    spark = work.spark
    crowds = work.table(open_.where("crowd").select("anchor").distinct(), "crowds")
    if crowds.limit(100_001).count() <= 100_000:  # 8 bytes each
        crowds = F.broadcast(crowds)
    texts = work.table(texts, "texts")
    calm = texts.join(crowds, "anchor", "left_anti").repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
    found = work.table(calm.mapInArrow(_sort_segments, FOUND), "found")

    equal = contents.where("times > 1").select("anchor", "content", F.array(F.lit(0)).alias("starts"), F.array("n").alias("ends"))
    runs = equal.union(found)
    if crowds.limit(1).count():
        runs = runs.union(_crowded(texts.join(crowds, "anchor", "left_semi").dropDuplicates(["anchor", "content"]), work))
    hit = places.select("anchor", "content", "doc_key", "place").join(runs, ["anchor", "content"])
    moved = hit.select("doc_key", F.explode(F.arrays_zip(F.expr("transform(starts, x -> x + place)").alias("a"), F.expr("transform(ends, x -> x + place)").alias("b"))).alias("r"))
    return moved.groupBy("doc_key").agg(F.collect_list("r.a").alias("starts"), F.collect_list("r.b").alias("ends"))


def cleaned(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes.

    A null text is empty; a text of fewer than LENGTH bytes loses nothing. Rows of equal doc_id and text are
    repeats of each other like any others: every row has a number of its own, by which its spans come back to it.
    """
    work = Workspace(docs.sparkSession, "suffixes")
    rows = keyed(docs.select("doc_id", "text"), work).withColumnRenamed(ROW_KEY, "doc_key")
    gone = work.table(spans(rows.select("doc_key", "text"), work), "gone")
    work.clear("keyed", "gone")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def remove(batches):
        for batch, text in blocks(batches):
            o, data = raw(text)
            rows = []
            for doc, a, b, starts, ends in zip(batch.column("doc_id").to_pylist(), o[:-1], o[1:], batch.column("starts"), batch.column("ends"), strict=True):
                own = data[a:b]
                lost, runs = 0, 0
                if starts.is_valid:
                    x, y = np.asarray(starts.values), np.asarray(ends.values)
                    cover = np.zeros(len(own) + 1, np.int64)
                    np.add.at(cover, x, 1)
                    np.add.at(cover, y + LENGTH - 1, -1)
                    stay = np.cumsum(cover)[:-1] == 0
                    lost, runs = int((~stay).sum()), len(_runs(~stay)[0])
                    own = own[stay]
                kept = own.tobytes()
                rows.append((doc, int(b - a), lost, runs, hashlib.sha256(kept).hexdigest(), kept))
            yield as_batch(schema, **{f.name: list(c) for f, c in zip(schema, zip(*rows, strict=True), strict=True)})

    joined = rows.join(gone, "doc_key", "left")
    return joined.select("doc_id", "text", "starts", "ends").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
