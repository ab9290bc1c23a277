"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words. Its words are ordered by rarity in the corpus, and two lines with a Jaccard
similarity of THRESHOLD or more share one of the first |x| - ceil(THRESHOLD |x|) + 1 words of each: these
prefixes are dealt by word. Within a word's lines, pairs pass a length filter, a positional filter (what can
still be shared behind this word) and a bit-map filter (bits that differ are words that differ); what passes
is verified on the whole sets. A line goes if an earlier line is that similar.

Lines of equal sets are one class. The class's first line stays unless a similar class begins earlier. A place
is (doc_id, row, line number), null ids last: rows of one id follow each other in the order of their row keys.

A word with over CROWD lines in its group is not paired there: its lines are dealt to pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.hashtable import BitSet
from trolley.llm.jaccard import grouped
from trolley.llm.textblock import WORD, PrefixHash, as_batch, blocks, mixed, raw, sort_within, spans
from trolley.llm.workspace import ROW_KEY, Workspace, keyed, partitions, restored, steady

#: Jaccard threshold as a fraction, so that all bounds are whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
#: Words are ranked by their counts folded into so many slots; any order gives the same result, rarity makes it cheap.
SLOT_BITS = 20
#: Lines (classes) of a group that are paired in one task; those of a larger group are dealt to pairs of blocks.
CROWD = 8192
#: Likeliest candidates of a line and group, one at least, that are verified first; lines with more that none of these removes are joined in full.
LIKELIEST = 24
#: Slots of a chunk of word counts, prefix rows that a task packs at a time, rows of a bucket (about), and bytes of a batch of packed rows.
CHUNK, HELD, BUCKET, _SENT = 1 << 14, 1 << 19, 400_000, 1 << 22
#: Line classes that a task remembers, and pairs looked at together.
SEEN, _PAIRS = 300_000, 1 << 20
_U = np.uint64


class Lines:
    """The lines with a word of a block of texts: `doc`, `number` (from 0), `key` of the word set, and its words.

    Words lie sorted by line and hash without repeats: `word[first[i]:first[i + 1]]` are those of line i. Where words are
    wanted, lines without any of them are left out.
    """

    def __init__(self, text: pa.Array, wanted: BitSet | None = None):
        o, data = raw(pc.utf8_lower(text))
        start, end, doc = spans(WORD[data], o)
        word = PrefixHash(data).of(start, end)
        feeds = np.flatnonzero(data == 10)
        line = np.cumsum(np.bincount(np.searchsorted(start, feeds), minlength=len(start) + 1)[:-1]) + doc
        if wanted is not None:
            hit = np.zeros(int(line[-1]) + 1 if len(line) else 1, bool)
            hit[line[wanted.has(word)]] = True
            word, line, doc = (a[hit[line]] for a in (word, line, doc))
        edge = np.ones(len(line), bool)
        edge[1:] = line[1:] != line[:-1]
        head = np.flatnonzero(edge)
        self.doc = doc[head]
        self.number = line[head] - self.doc - np.searchsorted(feeds, o[self.doc])
        own = np.cumsum(edge) - 1
        word = word[sort_within(own, word)]
        new = edge
        new[1:] |= word[1:] != word[:-1]
        self.word, own = word[new], own[new]
        self.first = np.searchsorted(own, np.arange(len(head) + 1))
        self.size = np.diff(self.first)
        self.line = own
        at = self.first[:-1]
        self.key = mixed(np.add.reduceat(mixed(self.word + _U(7)), at) + self.size.astype(np.uint64)) if len(at) else self.word

    def bits(self) -> list[np.ndarray]:
        """A bit map of 128 bits a line that each word flips one of: bits that differ are words that differ, however long the lines."""
        bit, upper = _U(1) << (self.word & _U(63)), self.word >> _U(6) & _U(1)
        return [np.bitwise_xor.reduceat(bit * x, self.first[:-1]) if len(self.key) else self.word for x in (upper, upper ^ _U(1))]

    def slots(self) -> np.ndarray:
        return (self.word >> _U(64 - SLOT_BITS)).astype(np.int64)

    def places(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id (null: the largest number), row key and line number of each line."""
        return pc.fill_null(batch.column("doc_id"), 2**63 - 1).to_numpy()[self.doc], batch.column(ROW_KEY).to_numpy()[self.doc], self.number


class Fresh:
    """The lines whose class a task has not met at an earlier place; a bounded number of classes is remembered."""

    def __init__(self, most: int):
        self.most, self.seen = most, {}

    def __call__(self, x: Lines, places: tuple[np.ndarray, ...]) -> np.ndarray:
        by = np.lexsort(places[::-1])
        own = by[np.unique(x.key[by], return_index=True)[1]]
        if len(self.seen) > self.most:
            self.seen.clear()
        fresh = np.zeros(len(x.key), bool)
        for i, k, place in zip(own.tolist(), x.key[own].tolist(), zip(*(p[own].tolist() for p in places), strict=True), strict=True):
            if k not in self.seen or place < self.seen[k]:
                self.seen[k] = place
                fresh[i] = True
        return fresh


def surveyed(docs: DataFrame) -> DataFrame:
    """Lines (row, doc_id, line, key), rows of docs (row, doc_id), and word counts by slot (line: the chunk of CHUNK slots, counts: its 32-bit counts)."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int64()), ("key", pa.int64()), ("counts", pa.binary())])

    def run(batches):
        slots = np.zeros(1 << SLOT_BITS, np.int32)
        for batch, text in blocks(batches):
            x = Lines(text)
            np.add.at(slots, x.slots(), 1)
            doc_id, row, line = x.places(batch)
            n, m = batch.num_rows, len(line)
            empty = pa.nulls(n, pa.int64())
            yield as_batch(schema, row=batch.column(ROW_KEY), doc_id=batch.column("doc_id"), line=empty, key=empty, counts=pa.nulls(n, pa.binary()))
            yield as_batch(schema, row=row, doc_id=doc_id, line=line, key=x.key.view(np.int64), counts=pa.nulls(m, pa.binary()))
        for chunk, part in enumerate(slots.reshape(-1, CHUNK)):
            if part.any():
                yield as_batch(schema, row=[None], doc_id=[None], line=[chunk], key=[None], counts=[part.tobytes()])

    return docs.select(ROW_KEY, "doc_id", "text").mapInArrow(run, "row long, doc_id long, line long, key long, counts binary")


def rarities(survey: DataFrame) -> tuple[np.ndarray, int]:
    """By slot, the count of its words over all tasks in eighths of a power of two, rounded down, and the sum of all counts."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column("line").to_pylist(), batch.column("counts"), strict=True):
                sums.setdefault(chunk, np.zeros(CHUNK, np.int64))
                sums[chunk] += np.frombuffer(part.as_buffer(), np.int32)
        for chunk, total in sums.items():
            levels = np.minimum(8 * np.log2(total + 1.0), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([levels.tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], ["line", "levels", "words"])

    parts = survey.where("counts is not null").select("line", "counts").repartition(partitions(survey.sparkSession), "line")
    level, words = np.zeros(((1 << SLOT_BITS) // CHUNK, CHUNK), np.uint8), 0
    for row in parts.mapInArrow(run, "line long, levels binary, words long").toArrow().to_pylist():
        level[row["line"]] = np.frombuffer(row["levels"], np.uint8)
        words += row["words"]
    return level.ravel(), words


def prefix_length(size: np.ndarray) -> np.ndarray:
    return size - -(-NUMERATOR * size // DENOMINATOR) + 1


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of sets of sizes a and b at the threshold."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def _ranks(word: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Numbers that order words by rarity, then by hash."""
    return level[(word >> _U(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << _U(56) | word >> _U(8)


def _prefix(x: Lines, level: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefix words of the fresh lines of over three words: word, line, place in the line's order."""
    use = (fresh & (x.size > 3))[x.line]
    word, line = x.word[use], x.line[use]
    word = word[sort_within(line, _ranks(word, level), word)]
    edge = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else line
    place = np.arange(len(line)) - np.repeat(edge, np.diff(np.append(edge, len(line))))
    keep = place < prefix_length(x.size)[line]
    return word[keep], line[keep], place[keep]


#: A prefix row: its group within a bucket (a word, or a pair of blocks of a crowded word's lines), the line's class, its first
#: place in the task, the bit map, the set's size, and the word's place in it; the two upper bits of that tell the line's side in a
#: pair of blocks (0: no pair).
ROW = [("group", "u4"), ("key", "i8"), ("doc_id", "i8"), ("row", "i8"), ("line", "i4"), ("bits_a", "u8"), ("bits_b", "u8"), ("size", "i4"), ("place", "u4")]
_WIDTH = sum(np.dtype(t).itemsize for _, t in ROW)
_SIDE = 30


def _packed(bucket: np.ndarray, rows: dict[str, np.ndarray]):
    """Prefix rows as binary values by bucket, column by column: bucket and value."""
    by = np.argsort(bucket, kind="stable")
    rows, bucket = {n: rows[n][by].astype(t, copy=False) for n, t in ROW}, bucket[by]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
    for a, b in zip(edge, np.append(edge[1:], len(bucket)), strict=True):
        yield int(bucket[a]), b"".join(rows[n][a:b].tobytes() for n, _ in ROW)


def _batches(parts):
    """bucket, rows: packed values in batches of a bounded size."""
    at, values, size = [], [], 0
    for bucket, value in parts:
        at.append(bucket)
        values.append(value)
        size += len(value)
        if size >= _SENT:
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values, pa.binary())], ["bucket", "rows"])
            at, values, size = [], [], 0
    if at:
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values, pa.binary())], ["bucket", "rows"])


def _unpacked(values: list[bytes]) -> dict[str, np.ndarray]:
    found: dict[str, list[np.ndarray]] = {n: [] for n, _ in ROW}
    for value in values:
        n, at = len(value) // _WIDTH, 0
        for name, kind in ROW:
            found[name].append(np.frombuffer(value, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {n: np.concatenate(x) for n, x in found.items()}


def prefixes(docs: DataFrame, level: np.ndarray, buckets: int) -> DataFrame:
    """bucket, rows: a prefix row (ROW) per line class, task and prefix word, packed by bucket of words.

    Sets of up to three words are similar to equal sets only and have no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        level, fresh, held, n = sent.value, Fresh(SEEN), [], 0

        def send():
            rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            return _batches(_packed(rows.pop("bucket"), rows))

        for batch, text in blocks(batches):
            x = Lines(text)
            places = x.places(batch)
            word, i, place = _prefix(x, level, fresh(x, places))
            bits = x.bits()
            held.append({"bucket": (word % _U(buckets)).astype(np.int64), "group": word >> _U(32), "key": x.key[i].view(np.int64), "doc_id": places[0][i], "row": places[1][i], "line": places[2][i], "bits_a": bits[0][i], "bits_b": bits[1][i], "size": x.size[i], "place": place})
            n += len(i)
            if n >= HELD:
                yield from send()
                held, n = [], 0
        if n:
            yield from send()

    return docs.select(ROW_KEY, "doc_id", "text").mapInArrow(run, "bucket long, rows binary")


def _before(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether row i's place comes before row j's."""
    same, out = np.ones(len(i), bool), np.zeros(len(i), bool)
    for name in ("doc_id", "row", "line"):
        a, b = c[name][i], c[name][j]
        out |= same & (a < b)
        same &= a == b
    return out


def _classes(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One row a group and class, that of its first place, ordered by group and size."""
    mark = mixed(c["key"].view(np.uint64) + mixed(c["group"].astype(np.uint64) + _U(3)))
    by = np.argsort(mark)
    if ((mark[by][1:] == mark[by][:-1]) & ((c["key"][by][1:] != c["key"][by][:-1]) | (c["group"][by][1:] != c["group"][by][:-1]))).any():
        by = np.lexsort((c["key"], c["group"]))
    key, group = c["key"][by], c["group"][by]
    run = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (group[1:] != group[:-1]))]) if len(by) else by
    several = np.bincount(run)[run] > 1 if len(by) else by.astype(bool)
    some = by[several]
    ordered = np.lexsort((c["line"][some], c["row"][some], c["doc_id"][some], run[several]))
    runs = run[several][ordered]
    first = np.ones(len(runs), bool)
    first[1:] = runs[1:] != runs[:-1]
    by = np.concatenate([by[~several], some[ordered[first]]])
    by = by[np.argsort(c["group"][by].astype(np.uint64) << _U(32) | c["size"][by].astype(np.uint64))]
    return {n: x[by] for n, x in c.items()}


CANDIDATES = "key long, earlier long, differ int, more boolean, bucket long, rows binary"
_CANDIDATES = pa.schema([("key", pa.int64()), ("earlier", pa.int64()), ("differ", pa.int32()), ("more", pa.bool_()), ("bucket", pa.int64()), ("rows", pa.binary())])


def _pairs(c: dict[str, np.ndarray], likeliest: int):
    """Of rows by group and size: each line's likeliest earlier candidates in a group, and whether it has more there."""
    group = c["group"]
    edge = np.ones(len(group), bool)
    edge[1:] = group[1:] != group[:-1]
    shared = ~edge
    shared[:-1] |= ~edge[1:]
    c = {n: x[shared] for n, x in c.items()}
    group, size, rows = np.cumsum(edge[shared]) - 1, c["size"].astype(np.int64), int(shared.sum())
    side, place = c["place"] >> np.uint32(_SIDE), (c["place"] & np.uint32((1 << _SIDE) - 1)).astype(np.int64)
    ranked = group * (1 << 32) + size
    n = np.searchsorted(ranked, group * (1 << 32) + size * DENOMINATOR // NUMERATOR, "right") - np.arange(rows) - 1
    total = np.concatenate([[0], np.cumsum(n)])
    later, sooner, apart = [], [], []
    low = 0
    while low < rows:
        high = max(low + 1, int(np.searchsorted(total, total[low] + _PAIRS, "right")) - 1)
        m = n[low:high]
        i = np.repeat(np.arange(low, high), m)
        j = i + 1 + np.arange(len(i)) - np.repeat(total[low:high] - total[low], m)
        low = high
        most = (DENOMINATOR - NUMERATOR) * (size[i] + size[j]) // (NUMERATOR + DENOMINATOR)
        differ = np.bitwise_count(c["bits_a"][i] ^ c["bits_a"][j]).astype(np.int64)
        ok = differ <= most
        i, j, most, differ = i[ok], j[ok], most[ok], differ[ok]
        differ += np.bitwise_count(c["bits_b"][i] ^ c["bits_b"][j])
        ok = (differ <= most) & ((side[i] == 0) | (side[i] != side[j]))
        ok &= np.minimum(size[i] - place[i], size[j] - place[j]) >= _needed(size[i], size[j])
        i, j, differ = i[ok], j[ok], differ[ok]
        ahead = _before(c, i, j)
        later.append(np.where(ahead, j, i))
        sooner.append(np.where(ahead, i, j))
        apart.append(differ)
    if not later:
        return
    later, sooner, apart = np.concatenate(later), np.concatenate(sooner), np.concatenate(apart)
    by = np.lexsort((apart, later))
    later, sooner, apart = later[by], sooner[by], apart[by]
    start = np.flatnonzero(np.concatenate([[True], later[1:] != later[:-1]])) if len(later) else later
    count = np.diff(np.append(start, len(later)))
    keep = np.arange(len(later)) - np.repeat(start, count) < likeliest
    k = int(keep.sum())
    yield as_batch(_CANDIDATES, key=c["key"][later[keep]], earlier=c["key"][sooner[keep]], differ=apart[keep], more=np.repeat(count > likeliest, count)[keep], bucket=pa.nulls(k, pa.int64()), rows=pa.nulls(k, pa.binary()))


def _sizes(c: dict[str, np.ndarray]) -> np.ndarray:
    """By row of `_classes`: how many rows its group has."""
    edge = np.concatenate([[0], np.cumsum(c["group"][1:] != c["group"][:-1])]) if len(c["group"]) else np.zeros(0, np.int64)
    return np.bincount(edge)[edge] if len(edge) else edge


def _candidates(crowd: int, likeliest: int):
    """For packed prefix rows in the order of buckets: their pairs, and the rows of groups of over `crowd` classes as they are (bucket: the group)."""

    def crowded(bucket: int, c: dict[str, np.ndarray]):
        for group, value in _packed(c["group"].astype(np.int64), c):
            for a in range(0, len(value) // _WIDTH, 1 << 15):
                part = {n: x[a : a + (1 << 15)] for n, x in _unpacked([value]).items()}
                yield as_batch(_CANDIDATES, key=[None], earlier=[None], differ=[None], more=[None], bucket=[bucket << 32 | group], rows=[b"".join(part[n].tobytes() for n, _ in ROW)])

    def settle(bucket: int, held: list[bytes], hot: set[int], last: bool):
        """Send on the rows of hot groups; what is left is paired if it is the bucket's last, else returned packed."""
        c = _classes(_unpacked(held))
        n = _sizes(c)
        hot.update(np.unique(c["group"][n > crowd]).tolist())
        out = np.isin(c["group"], np.array(sorted(hot), np.uint32))
        if out.any():
            yield from crowded(bucket, {k: x[out] for k, x in c.items()})
            c = {k: x[~out] for k, x in c.items()}
        if last:
            yield from _pairs(c, likeliest)
        else:
            held[:] = [b"".join(c[k].tobytes() for k, _ in ROW)]

    def run(batches):
        held, size, limit, at, hot = [], 0, 4 * BUCKET * _WIDTH, None, set()
        for batch in batches:
            for bucket, rows in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if held and bucket != at:
                    yield from settle(at, held, hot, True)
                    held, size, limit, hot = [], 0, 4 * BUCKET * _WIDTH, set()
                at = bucket
                held.append(rows)
                size += len(rows)
                if size > limit:
                    yield from settle(at, held, hot, False)
                    size = sum(map(len, held))
                    limit = max(4 * BUCKET * _WIDTH, 2 * size)
        if held:
            yield from settle(at, held, hot, True)

    return run


def _paired_blocks(crowds: DataFrame, hot: DataFrame, buckets: int) -> DataFrame:
    """bucket, rows: each crowded group's rows dealt to the pairs of its blocks, of about CROWD rows each."""

    def run(batches):
        for batch in batches:
            for group, rows, subs in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist(), batch.column("subs").to_pylist(), strict=True):
                c = _unpacked([rows])
                own = (mixed(c["key"].view(np.uint64)) % _U(subs)).astype(np.int64)
                for other in range(subs):
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    dealt = mixed(mixed((low << 32 | high).astype(np.uint64)) + _U(group))
                    side = np.where(low == high, 0, np.where(own == low, 1, 2)).astype(np.uint32)
                    yield from _batches(_packed((dealt % _U(buckets)).astype(np.int64), {**c, "group": dealt >> _U(32), "place": c["place"] | side << np.uint32(_SIDE)}))

    return crowds.join(hot, "bucket").select("bucket", "rows", "subs").mapInArrow(run, "bucket long, rows binary")


def _sets(docs: DataFrame, wanted: BitSet) -> DataFrame:
    """key, words: the word sets of the lines whose key is wanted, as words' hashes; each once a task."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = pa.schema([("key", pa.int64()), ("words", pa.binary())])

    def run(batches):
        seen: set[int] = set()
        for _, text in blocks(batches):
            x = Lines(text)
            keys, words = [], []
            at = np.flatnonzero(sent.value.has(x.key))
            for i, k in zip(at.tolist(), x.key[at].view(np.int64).tolist(), strict=True):
                if k not in seen:
                    seen.add(k)
                    keys.append(k)
                    words.append(x.word[x.first[i] : x.first[i + 1]].tobytes())
            if len(seen) > SEEN:
                seen.clear()
            if keys:
                yield as_batch(schema, key=keys, words=words)

    return docs.select("text").mapInArrow(run, "key long, words binary").dropDuplicates(["key"])


def _flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all sets, the set of each, and the sets' sizes."""
    size = pc.binary_length(sets).to_numpy().astype(np.int64) // 8
    return np.frombuffer(b"".join(sets.to_pylist()), np.uint64), np.repeat(np.arange(len(size)), size), size


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (key, earlier) whose sets reach the threshold."""
    schema = pa.schema([("key", pa.int64()), ("earlier", pa.int64())])

    def run(batches):
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            (x, i, n), (y, j, m) = _flat(batch.column("a")), _flat(batch.column("b"))
            word, pair = np.concatenate([x, y]), np.concatenate([i, j])
            by = np.argsort(word + mixed(pair.astype(np.uint64)))  # equal words of a pair meet; a chance meeting of others is no match
            word, pair = word[by], pair[by]
            both = np.bincount(pair[1:][(word[1:] == word[:-1]) & (pair[1:] == pair[:-1])], minlength=len(n))
            keep = DENOMINATOR * both >= NUMERATOR * (n + m - both)
            yield as_batch(schema, key=batch.column("key"), earlier=batch.column("earlier")).filter(pa.array(keep))

    with_sets = pairs.join(sets.withColumnRenamed("words", "a"), "key").join(sets.select(F.col("key").alias("earlier"), F.col("words").alias("b")), "earlier")
    return with_sets.select("key", "earlier", "a", "b").mapInArrow(run, "key long, earlier long")


def _dealt(rows: DataFrame, crowd: int) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(_candidates(crowd, LIKELIEST), CANDIDATES)


def removed(docs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (row, doc_id), and their lines with a word (row, line, exact, near): whether an equal or a similar line comes earlier.

    docs: ROW_KEY, doc_id, text. Lines are counted from 0 at each line feed. Lines without a word are no lines here.
    """
    survey = work.table(surveyed(docs), "survey")
    level, words = rarities(survey)
    buckets = max(partitions(work.spark), words // (4 * BUCKET))
    lines = survey.where("key is not null").select("row", "doc_id", "line", "key")

    candidates = work.table(_dealt(prefixes(docs, level, buckets), CROWD), "candidates")
    crowds = candidates.where("rows is not null").select("bucket", "rows")
    hot = work.table(crowds.groupBy("bucket").agg(F.sum(F.length("rows") / _WIDTH).alias("n")).select("bucket", F.ceil(F.col("n") / CROWD).cast("int").alias("subs")), "crowds")
    if hot.limit(1).count():
        parts = max(partitions(work.spark), int(hot.agg(F.sum(F.col("subs") * F.col("subs"))).first()[0]) * CROWD // BUCKET)
        candidates = candidates.where("rows is null").unionByName(work.table(_dealt(_paired_blocks(crowds, hot, parts), 1 << 40), "candidates-of-crowds"))
    else:
        hot = None
    candidates = candidates.where("rows is null")

    # a line's likeliest pair is verified first: most lines that go are settled by it, and their other pairs need no sets
    pairs = work.table(candidates.groupBy("key", "earlier").agg(F.min("differ").alias("differ"), F.bool_or("more").alias("more")), "pairs")
    keys = work.table(pairs.select("key").union(pairs.select("earlier")).distinct(), "keys")
    sets = work.table(_sets(docs, BitSet.of(keys, "key")).join(keys, "key", "left_semi"), "sets")
    likeliest = pairs.groupBy("key").agg(F.min_by("earlier", "differ").alias("earlier"))
    settled = work.table(_similar(likeliest, sets).select("key").distinct(), "settled")
    rest = _similar(pairs.select("key", "earlier").join(settled, "key", "left_anti"), sets).select("key")
    gone = work.table(rest.distinct().union(settled), "gone")
    open_ = work.table(pairs.where("more").select("key").distinct().join(gone, "key", "left_anti"), "open")
    if open_.limit(1).count():
        places = lines.join(open_, "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc_id", "row", "line")).alias("place")).select("key", "place.*")
        gone = work.table(gone.union(_in_full(docs, level, sets.join(places, "key"), hot, buckets, work)), "all-gone")
    several = lines.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(False).alias("near"))
    fate = several.union(gone.withColumn("near", F.lit(True))).groupBy("key").agg(F.bool_or("near").alias("near"))
    judged = work.table(lines.join(fate, "key", "left"), "judged")
    work.clear("keyed", "survey", "judged")
    firsts = judged.where("near is not null").groupBy("key").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"))
    touched = judged.where("near is not null").join(firsts, "key").select("row", "line", (F.col("first") < F.struct("doc_id", "row", "line")).alias("exact"), "near")
    untouched = judged.where("near is null").select("row", "line", F.lit(False).alias("exact"), F.lit(False).alias("near"))
    return survey.where("line is null").select("row", "doc_id"), touched.union(untouched)


_PLACE = ["doc_id", "row", "line"]
GROUPS = "group long, crowd long, key long, doc_id long, row long, line long, words binary"
_GROUPS = pa.schema([(c, pa.int64()) for c in ("group", "crowd", "key", *_PLACE)] + [("words", pa.binary())])


def _crowd(word: np.ndarray, buckets: int) -> np.ndarray:
    """The number under which `_candidates` sends on a crowded word's rows."""
    return ((word % _U(buckets)) << _U(32) | word >> _U(32)).view(np.int64)


def _groups_of(sets: DataFrame, level: np.ndarray, buckets: int) -> DataFrame:
    """The groups of the lines of a table of sets (key, words, place)."""
    sent = sets.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        for batch in batches:
            word, own, size = _flat(batch.column("words"))
            by = sort_within(own, _ranks(word, sent.value), word) if len(word) else own
            nth = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
            use = nth < prefix_length(size)[own]
            at = pa.array(own[use])
            word = word[by][use]
            yield as_batch(_GROUPS, group=word.view(np.int64), crowd=_crowd(word, buckets), words=batch.column("words").take(at), **{c: batch.column(c).take(at) for c in ("key", *_PLACE)})

    return sets.select("key", *_PLACE, "words").mapInArrow(run, GROUPS)


def _members(docs: DataFrame, level: np.ndarray, wanted: BitSet, buckets: int) -> DataFrame:
    """The line classes of the wanted groups, with their sets."""
    context = docs.sparkSession.sparkContext
    sent, groups = context.broadcast(level), context.broadcast(wanted)

    def run(batches):
        fresh = Fresh(SEEN)
        for batch, text in blocks(batches):
            x = Lines(text, groups.value)
            places = x.places(batch)
            word, i, _ = _prefix(x, sent.value, fresh(x, places))
            near = groups.value.has(word)
            word, i = word[near], i[near]
            for a in range(0, len(i), 4096):
                j, own = i[a : a + 4096], word[a : a + 4096]
                yield as_batch(_GROUPS, group=own.view(np.int64), crowd=_crowd(own, buckets), key=x.key[j].view(np.int64), words=[x.word[x.first[m] : x.first[m + 1]].tobytes() for m in j], **{c: p[j] for c, p in zip(_PLACE, places, strict=True)})

    return docs.select(ROW_KEY, "doc_id", "text").mapInArrow(run, GROUPS)


def _removed_here(rows: pa.Table) -> np.ndarray:
    """Keys of a group's open lines that a line of the group at an earlier place is similar to."""
    mine = rows["mine"].to_numpy().astype(bool)
    rank = np.empty(len(rows), np.int64)
    rank[np.lexsort([rows[c].to_numpy() for c in reversed(_PLACE)])] = np.arange(len(rows))
    ours, theirs = np.flatnonzero(mine), np.flatnonzero(~mine)
    key = rows["key"].to_numpy()
    if not len(ours) or not len(theirs):
        return key[:0]
    sets = rows["words"].combine_chunks()
    word, own, size = _flat(sets.take(pa.array(ours)))
    by = np.argsort(word)
    word, own = word[by], own[by]
    gone = np.zeros(len(ours), bool)
    step = max(1, (1 << 21) // len(ours))
    for a in range(0, len(theirs), step):
        j = theirs[a : a + step]
        other, it, m = _flat(sets.take(pa.array(j)))
        left, right = np.searchsorted(word, other, "left"), np.searchsorted(word, other, "right")
        n = right - left
        at = np.repeat(left - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        both = np.bincount(np.repeat(it, n) * len(ours) + own[at], minlength=len(j) * len(ours)).reshape(len(j), len(ours))
        ok = DENOMINATOR * both >= NUMERATOR * (m[:, None] + size[None, :] - both)
        gone |= (ok & (key[j][:, None] != key[ours][None, :]) & (rank[j][:, None] < rank[ours][None, :])).any(0)
    return key[ours[gone]]


def _in_full(docs: DataFrame, level: np.ndarray, ours: DataFrame, hot: DataFrame | None, buckets: int, work: Workspace) -> DataFrame:
    """key: the open lines, given by their sets and places, that any line of their groups removes, whatever the number of candidates.

    Open lines and members of a group meet in one task, in the order of the group; a crowded group's members are
    dealt to its blocks, and its open lines to all of them. Only keys leave the tasks.
    """
    ours = work.table(_groups_of(ours, level, buckets), "ours")
    wanted = BitSet.of(ours.select("group").distinct(), "group")
    rows = ours.withColumn("mine", F.lit(1)).unionByName(_members(docs, level, wanted, buckets).withColumn("mine", F.lit(0)))
    block = F.lit(0)
    if hot is not None:
        rows = rows.join(hot.select(F.col("bucket").alias("crowd"), "subs"), "crowd", "left")
        every, own = F.sequence(F.lit(0), F.coalesce("subs", F.lit(1)) - 1), F.array(F.coalesce(F.pmod(F.xxhash64("key"), F.col("subs")).cast("int"), F.lit(0)))
        block = F.explode(F.when(F.col("mine") == 1, every).otherwise(own))
    rows = rows.withColumn("block", block)
    schema = pa.schema([("key", pa.int64())])

    def run(batches):
        for rows in grouped(batches, ["group", "block"]):
            yield pa.RecordBatch.from_arrays([pa.array(_removed_here(rows), pa.int64())], schema=schema)

    dealt = rows.select("group", "block", "mine", "key", *_PLACE, "words").repartition(partitions(work.spark), "group", "block").sortWithinPartitions("group", "block")
    return dealt.mapInArrow(run, "key long").distinct()


def _by_row(judged: DataFrame) -> DataFrame:
    """row, n_lines, n_exact, n_near, removed (line numbers, ascending) of each row that has a line."""
    gone = F.col("exact") | F.col("near")
    return judged.groupBy("row").agg(F.count("*").alias("n_lines"), F.count_if("exact").alias("n_exact"), F.count_if(F.col("near") & ~F.col("exact")).alias("n_near"), F.sort_array(F.collect_list(F.when(gone, F.col("line").cast("int")))).alias("removed"))


def by_document(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with a word), n_exact and n_near (removed: equal to an earlier line; else similar to one), removed (line numbers).

    One row per row of docs, whatever its doc_id; a null text has no lines.
    """
    work = Workspace(docs.sparkSession, "lines")
    own = docs.select("doc_id", "text")
    rows, judged = removed(own.withColumn(ROW_KEY, F.monotonically_increasing_id()) if steady(own) else keyed(own, work), work)
    zero = F.lit(0).cast("long")
    joined = rows.join(_by_row(judged), "row", "left")
    return joined.select("doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_lines", "n_exact", "n_near")], F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def _without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    """The texts without the lines of these numbers."""

    def rest(text: str, numbers: np.ndarray) -> str:
        gone = set(numbers.tolist())
        return "\n".join([x for i, x in enumerate(text.split("\n")) if i not in gone])

    return pd.Series([None if t is None else rest(t, n) for t, n in zip(texts, removed, strict=True)], dtype=object)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without the removed lines; a document that loses all its lines goes.

    Documents without a line to lose, empty ones too, stay as they are. Rows of equal doc_id precede each other as they come.
    """
    work = Workspace(docs.sparkSession, "deduplicated")
    rows = keyed(docs, work)
    found = _by_row(removed(rows, work)[1]).where(F.size("removed") > 0)
    found = found.select(F.col("row").alias(ROW_KEY), F.col("removed").alias("_removed"), (F.col("n_lines") == F.col("n_exact") + F.col("n_near")).alias("_emptied"))
    own = rows.select(ROW_KEY, F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_doc"))
    joined = own.join(found, ROW_KEY, "left").where(~F.coalesce("_emptied", F.lit(False)))
    hit, text = F.col("_removed").isNotNull(), F.col("_doc.text")
    rest = F.pandas_udf(_without, "string")(F.when(hit, text), "_removed")
    return restored(joined.select(F.col("_doc").withField("text", F.when(hit, rest).otherwise(text)).alias("_doc")).select("_doc.*"), docs.columns)
