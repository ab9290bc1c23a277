"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER bytes with the counts of the bytes that followed them. A
byte seen in the longest known context has its share there; else the model escapes (method C: as likely as
there are distinct followers) to the context one byte shorter, where the symbols of the longer context are
excluded, and at last to all byte values alike. A-Z are lower-cased. 0xFF, which UTF-8 never uses, stands before
a text and ends it, so the scores are log probabilities of whole texts.

Pretrained (`scored`): every context of all training texts counts. The texts are read in chunks; a chunk tells its
distinct grams (a byte and its context) and how often its training texts have each. Grams meet by their nearest
three context bytes: there the chunks' counts are summed, the trie of that part is built, and every distinct gram
is scored once; the answers go back to the chunks that asked. Contexts of up to two bytes, of which there is a
bounded number, go to all. Adaptive (`adaptive`): each text by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.files import create, reader
from trolley.llm.hashtable import Table
from trolley.llm.jaccard import grouped
from trolley.llm.languages import held_out
from trolley.llm.textblock import SPACE, PrefixHash, as_batch, blocks, mixed, raw, spans
from trolley.llm.workspace import Workspace, partitions

ORDER = 5
#: Longest contexts that go to all tasks.
LOW = 2
#: Text bytes of a chunk, rows of a part (grams with their counts, by chunk) that one task sums and scores, and bytes of text whose grams are sorted together.
CHUNK, PART, SORTED = 32 << 20, 1 << 23, 1 << 20
FOLDS, HELD = 10, 0
GRAM, WORD_KIND, LOW_KIND = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(o: np.ndarray, data: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, and each text's end: the byte and the `order` bytes before it as one number, and the text's index.

    The symbol is the lowest byte, its nearest predecessor the next.
    """
    n = len(o) - 1
    doc = np.repeat(np.arange(n), np.diff(o))
    buffer = np.full(len(data) + (n + 1) * order, 255, np.uint8)
    at = np.arange(len(data)) + order * (doc + 1)
    buffer[at] = data
    wide = buffer.astype(np.uint64)
    code = wide[order:].copy()
    for k in range(1, order + 1):
        code |= wide[order - k : -k] << np.uint64(8 * k)
    ends = o[1:] + order * np.arange(n)  # after `order` leading bytes are cut off
    use = np.zeros(len(code), bool)
    use[at - order] = True
    use[ends] = True
    owner = np.repeat(np.arange(n), np.diff(o) + 1)
    return code[use], owner


def _low(order: int) -> np.uint64:
    return np.uint64((1 << 8 * (order + 1)) - 1)


class Trie:
    """Counts by order: entries (context and symbol) and contexts with their totals."""

    def __init__(self, codes: list[np.ndarray], counts: list[np.ndarray], base: "Trie | None" = None):
        """From the entries of each order and their counts, shortest first; every entry's shorter one must be there or in the searchable base."""
        self.order, self.levels, above = len(codes) - 1, [], None
        for k, (code, n) in enumerate(zip(codes, counts, strict=True)):
            by = np.argsort(code)
            code, n = code[by], n[by].astype(np.int64)
            context, own = np.unique(code >> np.uint64(8), return_inverse=True)
            size = len(context)
            level = {"code": code, "n": n, "own": own, "context": context, "total": np.bincount(own, n, size).astype(np.int64), "distinct": np.bincount(own, minlength=size)}
            # what a context's symbols count in the next shorter context: they are excluded there after an escape
            shorter = np.zeros(len(code), np.int64)
            if k and size:
                low = code & _low(k - 1)
                left = np.ones(len(code), bool)
                if base is not None:
                    entry = base.levels[k - 1]["entries"].find(low)
                    left = entry < 0
                    shorter[~left] = base.levels[k - 1]["n"][entry[~left]]
                if left.any():
                    shorter[left] = above["n"][np.searchsorted(above["code"], low[left])]
            level["shadow"] = np.bincount(own, shorter, size).astype(np.int64)
            self.levels.append(level)
            above = level

    def searchable(self) -> "Trie":
        for level in self.levels:
            level["entries"], level["contexts"] = Table(level["code"]), Table(level["context"])
            level["log"] = np.log10(level["n"] / (level["total"] + level["distinct"])[level["own"]])
        return self

    def log10(self, code: np.ndarray, base: "Trie | None" = None) -> np.ndarray:
        """log10 probability of each code's symbol after its context; with a base, which has the contexts that are left out here."""
        state = np.zeros(len(code)), np.arange(len(code)), np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        for trie in (self,) if base is None else (self, base):
            state = trie._walk(code, *state)
        out, left, _, seen_d = state
        out[left] -= np.log10(256 - seen_d)
        return out

    def _walk(self, code: np.ndarray, out: np.ndarray, left: np.ndarray, seen_n: np.ndarray, seen_d: np.ndarray) -> tuple[np.ndarray, ...]:
        """Add the logs to out; which codes are still left, and what their longer contexts have excluded."""
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            own = code[left] & _low(k)
            entry = level["entries"].find(own)
            hit = entry >= 0
            e, at = entry[hit], left[hit]
            if k == self.order:
                out[at] = level["log"][e]
            else:
                c = level["own"][e]
                out[at] += np.log10(level["n"][e] / (level["total"][c] - seen_n[hit] + level["distinct"][c] - seen_d[hit]))
            left, seen_n, seen_d, own = left[~hit], seen_n[~hit], seen_d[~hit], own[~hit]
            c = level["contexts"].find(own >> np.uint64(8))
            known = c >= 0
            c = c[known]
            n, d = level["total"][c] - seen_n[known], level["distinct"][c] - seen_d[known]
            out[left[known]] += np.log10(np.where(d > 0, d / np.maximum(n + d, 1), 1.0))
            seen_n[known], seen_d[known] = level["shadow"][c], level["distinct"][c]
        return out, left, seen_n, seen_d


def adaptive_log10(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text under a model that starts empty and learns each byte after it has predicted it."""
    seen: dict[bytes, dict[int, int]] = {}
    padded, total = b"\xff" * order + text + b"\xff", 0.0
    for i in range(order, len(padded)):
        symbol, excluded = padded[i], set()
        for k in range(order, -1, -1):
            followers = seen.get(padded[i - k : i], {})
            live = {s: n for s, n in followers.items() if s not in excluded}
            if live:
                mass = sum(live.values()) + len(live)
                if symbol in live:
                    total += math.log10(live[symbol] / mass)
                    break
                total += math.log10(len(live) / mass)
            excluded |= followers.keys()
        else:
            total -= math.log10(256 - len(excluded))
        for k in range(order + 1):
            followers = seen.setdefault(padded[i - k : i], {})
            followers[symbol] = followers.get(symbol, 0) + 1
    return total


def _tokens(o: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each token of lower-cased bytes."""
    start, end, doc = spans(~SPACE[data], o)
    return PrefixHash(data).of(start, end), doc


class _Sums:
    """The distinct keys of a chunk and how often its training texts have each, in sorted arrays that are merged as they grow."""

    def __init__(self):
        self.keys, self.counts, self.size, self.base = [], [], 0, 0

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        for part, times in ((keys[train], 1), (keys[~train], 0)):
            part = np.sort(part)
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            self.keys.append(part[edge])
            self.counts.append(times * np.diff(np.append(edge, len(part))))
            self.size += len(edge)
        if self.size > 2 * self.base + (1 << 20):
            self.base = len(self.merged()[0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.keys, self.counts))
        keys, counts = _summed(keys.astype(np.uint64), counts)
        self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return keys, counts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys)
    keys = keys[by]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(counts[by], edge) if len(edge) else np.zeros(0, np.int64)


def _part(kind: int, keys: np.ndarray, parts: int) -> np.ndarray:
    """Where keys meet: grams by their nearest LOW + 1 context bytes, words by themselves."""
    near = keys >> np.uint64(8) & np.uint64((1 << 8 * (LOW + 1)) - 1) if kind == GRAM else keys
    return (mixed(near + np.uint64(1)) % np.uint64(parts)).astype(np.int64)


#: Rows of a chunk: keys of a kind that meet in one part and their training counts, or (kind null) the file that keeps the chunk's texts and its training tokens and texts.
_GATHERED = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("file", pa.string()), ("n_words", pa.int64()), ("n_texts", pa.int64())])
GATHERED = "kind int, part long, chunk long, keys binary, counts binary, file string, n_words long, n_texts long"
_TEXTS = pa.schema([("doc_id", pa.int64()), ("held", pa.bool_()), ("text", pa.large_string())])


def gathered(docs: DataFrame, folder: str, parts: int, order: int = ORDER) -> DataFrame:
    """What each chunk of docs (doc_id, held, text) has (GATHERED); its texts are kept in a file of their own."""

    def flush(sums: dict[int, _Sums], chunk: int, file: str, words: int, texts: int):
        none = {f.name: [None] for f in _GATHERED}
        yield as_batch(_GATHERED, **none | {"chunk": [chunk], "file": [file], "n_words": [words], "n_texts": [texts]})
        keys, counts = sums[GRAM].merged()
        low = _summed(keys & _low(LOW), counts)
        for kind, (keys, counts) in ((GRAM, (keys, counts)), (WORD_KIND, sums[WORD_KIND].merged()), (LOW_KIND, low)):
            part = _part(kind, keys, parts)
            by = np.argsort(part, kind="stable")
            keys, counts, part = keys[by], counts[by].astype("<u4"), part[by]
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
            ends = np.append(edge[1:], len(part))
            for a in range(0, len(edge), 256):
                pairs = list(zip(edge[a : a + 256], ends[a : a + 256], strict=True))
                n = len(pairs)
                none = {f.name: [None] * n for f in _GATHERED}
                yield as_batch(_GATHERED, **none | {"kind": [kind] * n, "part": part[edge[a : a + 256]], "chunk": [chunk] * n, "keys": [keys[i:j].tobytes() for i, j in pairs], "counts": [counts[i:j].tobytes() for i, j in pairs]})

    def run(batches):
        chunk, out = TaskContext.get().partitionId() << 24, None
        for batch, text in blocks(batches, limit=SORTED):
            if out is None:
                sums, size, words, texts = {GRAM: _Sums(), WORD_KIND: _Sums()}, 0, 0, 0
                file, stream = create(folder, ".arrow")
                out = pa.ipc.new_stream(stream, _TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            out.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held"), text], schema=_TEXTS))
            o, data = raw(text)
            data = _LOWER[data]
            train = ~batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            code, owner = grams(o, data, order)
            sums[GRAM].add(code, train[owner])
            word, doc = _tokens(o, data)
            sums[WORD_KIND].add(word, train[doc])
            size, words, texts = size + len(data), words + int(train[doc].sum()), texts + int(train.sum())
            if size >= CHUNK:
                out.close()
                stream.close()
                yield from flush(sums, chunk, file, words, texts)
                chunk, out = chunk + 1, None
        if out is not None:
            out.close()
            stream.close()
            yield from flush(sums, chunk, file, words, texts)

    return docs.select("doc_id", "held", "text").mapInArrow(run, GATHERED)


def low_trie(rows: DataFrame, order: int = ORDER) -> Trie:
    """The trie of contexts of up to LOW bytes from all chunks' counts; its longer levels are empty."""

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            more = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("counts", "<u4")))
            keys, counts = _summed(*(np.concatenate(x) for x in zip((keys, counts), more, strict=True)))
        for a in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 16)].view(np.int64)), pa.array(counts[a : a + (1 << 16)])], ["key", "n"])

    low = rows.where(F.col("kind") == LOW_KIND).select("part", "keys", "counts").repartition(partitions(rows.sparkSession), "part")
    found = low.mapInArrow(run, "key long, n long").where("n > 0").toArrow()  # at most 256^(LOW + 1) rows, whatever the corpus
    keys, n = found["key"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy()
    levels = [_summed(keys & _low(k), n) for k in range(LOW + 1)] + [(keys[:0], n[:0])] * (order - LOW)
    return Trie([k for k, _ in levels], [m for _, m in levels])


ANSWERS = "kind int, chunk long, keys binary, values binary, distinct long"
_ANSWERS = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("values", pa.binary()), ("distinct", pa.int64())])


def answered(rows: DataFrame, low: Trie, order: int = ORDER) -> DataFrame:
    """For the keys of each chunk and part their values: a gram's log10 probability, a word's training count. Per part one row (chunk null) with the distinct words.

    A part of over PART rows is summed by Spark, key by key, and its sums go to as many tasks as share its chunks.
    """
    sent = rows.sparkSession.sparkContext.broadcast(low)
    rows = rows.where(F.col("kind").isin(GRAM, WORD_KIND)).select("kind", "part", "chunk", "keys", "counts")
    sizes = rows.groupBy("kind", "part").agg(F.sum(F.length("keys") / 8).alias("n")).where(F.col("n") > PART)
    hot = sizes.select("kind", "part", F.ceil(F.col("n") / PART).cast("int").alias("salts"))

    def unpack(batches):
        for batch in batches:
            for kind, part, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "keys", "counts")), strict=True):
                keys, counts = np.frombuffer(keys, np.int64), np.frombuffer(counts, "<u4").astype(np.int64)
                for a in range(0, len(keys), 1 << 16):
                    some = slice(a, a + (1 << 16))
                    n = len(keys[some])
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array(keys[some]), pa.array(counts[some])], ["kind", "part", "key", "n"])

    def pack(batches):
        for some in grouped(batches, ["kind", "part"]):
            yield pa.RecordBatch.from_arrays([pa.array([some["kind"][0].as_py()], pa.int32()), pa.array([some["part"][0].as_py()], pa.int64()), pa.array([some["key"].to_numpy().tobytes()], pa.binary()), pa.array([some["n"].to_numpy().astype("<u8").tobytes()], pa.binary())], ["kind", "part", "keys", "sums"])

    crowded = rows.join(hot, ["kind", "part"])
    keyed = crowded.select("kind", "part", "keys", "counts").mapInArrow(unpack, "kind int, part long, key long, n long").where("n > 0").groupBy("kind", "part", "key").agg(F.sum("n").alias("n"))
    sums = keyed.repartition("kind", "part").sortWithinPartitions("kind", "part").mapInArrow(pack, "kind int, part long, keys binary, sums binary")
    spread = sums.join(hot, ["kind", "part"]).select("kind", "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("chunk"), "keys", F.lit(None).cast("binary").alias("counts"), "sums")
    asks = rows.join(hot, ["kind", "part"], "left").select("kind", "part", F.coalesce(F.pmod(F.xxhash64("chunk"), F.col("salts")), F.lit(0)).cast("int").alias("salt"), "chunk", "keys", F.when(F.col("salts").isNull(), F.col("counts")).alias("counts"), F.lit(None).cast("binary").alias("sums"))

    def run(batches):
        base = sent.value.searchable()
        for some in grouped(batches, ["kind", "part", "salt"]):
            kind, salt = some["kind"][0].as_py(), some["salt"][0].as_py()
            chunk, whole = some["chunk"].to_pylist(), some["keys"].to_pylist()
            n = [len(x) // 8 for x in whole]
            keys = np.frombuffer(b"".join(whole), np.uint64)
            counts = np.zeros(len(keys), np.int64)
            at = 0
            for size, one, sums_ in zip(n, some["counts"].to_pylist(), some["sums"].to_pylist(), strict=True):
                if one is not None or sums_ is not None:
                    counts[at : at + size] = np.frombuffer(one, "<u4") if sums_ is None else np.frombuffer(sums_, "<u8")
                at += size
            by = np.argsort(keys)
            new = np.concatenate([[True], keys[by][1:] != keys[by][:-1]])
            which = np.empty(len(keys), np.int64)
            which[by] = np.cumsum(new) - 1
            distinct, counts = keys[by][new], np.bincount(which, counts).astype(np.int64)
            known = counts > 0
            values = counts.astype(np.float64) if kind == WORD_KIND else _part_trie(distinct[known], counts[known], base).log10(distinct, base)
            at = 0
            for c, size, key in zip(chunk, n, whole, strict=True):
                if c is not None:
                    yield as_batch(_ANSWERS, kind=[kind], chunk=[c], keys=[key], values=[values[which[at : at + size]].tobytes()], distinct=[None])
                at += size
            if kind == WORD_KIND and salt == 0:
                yield as_batch(_ANSWERS, kind=[kind], chunk=[None], keys=[None], values=[None], distinct=[int(known.sum())])

    dealt = asks.unionByName(spread).repartition(partitions(rows.sparkSession), "kind", "part", "salt").sortWithinPartitions("kind", "part", "salt")
    return dealt.mapInArrow(run, ANSWERS)


def _part_trie(keys: np.ndarray, counts: np.ndarray, base: Trie) -> Trie:
    """The longer contexts of a part, searchable; base has the shorter ones."""
    empty = (keys[:0], counts[:0])
    levels = [empty] * (LOW + 1) + [_summed(keys & _low(k), counts) for k in range(LOW + 1, base.order + 1)]
    return Trie([k for k, _ in levels], [n for _, n in levels], base).searchable()


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())])


def scored(docs: DataFrame) -> DataFrame:
    """Scores of every row's whole text by a model of the rows outside the held-out tenth, beside a unigram base.

    doc_id, held_out, n_tokens (words and one end), n_known (with a training count), train_tokens, base_score
    (log10 under smoothed token counts), score (log10 under the byte model). A null text is empty: its end alone.
    Rows of the same doc_id are scored each; a null doc_id is never held out. Without training rows every byte
    is as likely as any other. Tokens are told apart by 64-bit hashes. A long text is a block and at most a chunk of its own.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "ppm")
    folder = work.path("texts")
    parts = partitions(spark)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # an estimate: it sets how many parts there are, no result
    parts = max(parts, min(size >> 24, 1 << 16))
    flagged = docs.select("doc_id", F.coalesce(held_out(FOLDS, HELD), F.lit(False)).alias("held"), "text")
    rows = work.table(gathered(flagged, folder, parts), "gathered")
    files = work.table(rows.where("file is not null").select("chunk", "file", "n_words", "n_texts"), "files")
    words, ends = files.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_texts"), F.lit(0))).first()
    answers = work.table(answered(rows, low_trie(rows)), "answers")
    work.drop("gathered")
    distinct = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    n, v = words + ends, distinct + (ends > 0)
    floor, end = math.log10(n + 0.1 * (v + 1)), math.log10(ends + 0.1)

    def finish(batches):
        for some in grouped(batches, ["chunk"]):
            kinds = some["kind"].to_pylist()
            look = {}
            for kind, dtype in ((GRAM, np.float64), (WORD_KIND, np.float64)):
                mine = some.filter(pa.array([k == kind for k in kinds]))
                keys = np.frombuffer(b"".join(mine["keys"].to_pylist()), np.uint64)
                look[kind] = Table(keys), np.frombuffer(b"".join(mine["values"].to_pylist()), dtype)
            file = next(f for f in some["file"].to_pylist() if f is not None)
            for batch, text in blocks(pa.ipc.open_stream(reader(f"{folder}/{file}"))):
                o, data = raw(text)
                data, m = _LOWER[data], len(text)
                code, owner = grams(o, data)
                table, logs = look[GRAM]
                score = np.bincount(owner, logs[table.find(code)], m)
                word, doc = _tokens(o, data)
                table, counts = look[WORD_KIND]
                c = counts[table.find(word)] if len(word) else np.zeros(0)
                base = np.bincount(doc, np.log10(c + 0.1) - floor, m) + end - floor
                yield as_batch(_SCORED, doc_id=batch.column("doc_id"), held_out=batch.column("held"), n_tokens=np.bincount(doc, minlength=m) + 1, n_known=np.bincount(doc, c > 0, m).astype(np.int64) + (1 if ends else 0), train_tokens=np.full(m, n), base_score=base, score=score)

    asked = answers.where("chunk is not null").select("chunk", "kind", "keys", "values", F.lit(None).cast("string").alias("file"))
    named = files.select("chunk", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("values"), "file")
    return asked.unionByName(named).repartition(partitions(spark), "chunk").sortWithinPartitions("chunk").mapInArrow(finish, SCORED)


def adaptive(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_bytes, score of every row: its text's log10 probability under a model that learns as it reads, from nothing."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch, text in blocks(batches):
            o, data = raw(text)
            whole = _LOWER[data].tobytes()
            texts = [whole[a:b] for a, b in zip(o[:-1], o[1:], strict=True)]
            yield as_batch(schema, doc_id=batch.column("doc_id"), n_bytes=np.diff(o), score=[adaptive_log10(t, order) for t in texts])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, score double")
