"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is a set of shingles of five words. Items are parted by size; an item's sketch holds the shingles
that are smallest under SKETCH hash functions (all its shingles, if it is small). If a share c of an item's
shingles stands in a document, each sketch entry does with probability c, whatever the document's length: the
document's own shingles are looked up in the sketches, never sketched themselves. Each size class asks for as
many hits as an item contained to THRESHOLD yields but for one in 10^9, and every pair that has them is
verified by counting the item's shingles in the document, word by word.

The items are a query set: they go to the tasks in blocks of a bounded size, one pass over the documents each.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.textblock import SHINGLE, Words, as_batch, blocks, minhashes, plain
from trolley.llm.workspace import ROW_KEY, Workspace, by_key, keyed, restored

THRESHOLD = 0.8
#: Upper sizes (shingles) of the size classes, and the sketch of each; beyond the last, that one.
SIZES, SKETCHES = (24, 64, 256, 1 << 62), (24, 24, 32, 48)
MISS = 1e-9
#: Bounds of a block of items: rows and characters.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
_WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")
PAIR = "doc_id long, item_id long, n_shingles long, n_found long, containment double"


def hits_needed(sketch: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """The most hits that an item contained to `threshold` falls short of with probability below `miss`."""
    below, k = 0.0, 0
    while True:
        below += math.comb(sketch, k) * threshold**k * (1 - threshold) ** (sketch - k)
        if below >= miss:
            return max(1, k)
        k += 1


def shingle_set(lowered: str) -> set[tuple[str, ...]]:
    words = _WORD.findall(lowered)
    return set(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


class Sketches:
    """The sketches of a block of items, searchable by shingle hash."""

    def __init__(self, items: pa.Table, threshold: float):
        text = plain(items["text"])
        words = Words(text)
        hashes, at = words.shingles()
        first = np.searchsorted(words.doc[at], np.arange(len(text) + 1))
        lowered = pc.utf8_lower(text).to_pylist()
        self.item_id, self.sets, self.needed = items["item_id"].to_pylist(), [shingle_set(t) for t in lowered], []
        keys, owner, weight = [], [], []
        for i in range(len(text)):
            own = np.unique(hashes[first[i] : first[i + 1]])
            size = SKETCHES[int(np.searchsorted(SIZES, len(own)))]
            if len(own) <= size:
                chosen, times = own, np.ones(len(own), int)
                self.needed.append(max(1, math.ceil(threshold * len(own) - 1e-9)))
            else:
                least = minhashes(own, np.zeros(1, int), size)[0]
                values = minhashes(own, np.arange(len(own)), size)
                chosen, times = np.unique(own[(values == least).argmax(0)], return_counts=True)
                self.needed.append(hits_needed(size, threshold))
            keys.append(chosen)
            owner.append(np.full(len(chosen), i))
            weight.append(times)
        keys, owner, weight = (np.concatenate(x) if x else np.zeros(0, int) for x in (keys, owner, weight))
        by = np.argsort(keys, kind="stable")
        self.key, start = np.unique(keys[by].astype(np.uint64), return_index=True)
        self.start = np.append(start, len(by))
        self.owner, self.weight, self.needed = owner[by].astype(np.int64), weight[by], np.array(self.needed, int)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.key >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and item whose sketch is hit often enough by the text's shingles."""
        near = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.key, hashes[near])
        at[at == len(self.key)] = 0
        found = self.key[at] == hashes[near] if len(self.key) else np.zeros(len(near), bool)
        hit = np.unique(np.stack([doc[near[found]], at[found]], 1), axis=0)
        n = self.start[hit[:, 1] + 1] - self.start[hit[:, 1]]
        entry = np.repeat(self.start[hit[:, 1]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pair, where = np.unique(np.stack([np.repeat(hit[:, 0], n), self.owner[entry]], 1), axis=0, return_inverse=True)
        enough = np.bincount(where.ravel(), self.weight[entry], len(pair)) >= self.needed[pair[:, 1]]
        return pair[enough, 0], pair[enough, 1]


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each row of docs (doc_id, text) with each row of items (item_id, text) that it holds to `threshold` or more.

    Words are runs of letters, digits and non-ASCII characters, lower-cased. Items of fewer than five words
    (null and empty ones too) have no shingle and match nothing. Repeated rows match each by itself, so a
    pair of ids can come more than once. Without items there are no rows.
    """
    spark = docs.sparkSession
    items = Workspace(spark, "items").table(items.select("item_id", "text", F.monotonically_increasing_id().alias("_row")), "items")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_found", pa.int64()), ("containment", pa.float64())])
    out = None
    for part in range(parts):
        block = items.where(F.pmod(F.xxhash64("_row"), F.lit(parts)) == part).select(F.col("item_id").cast("long"), "text").toArrow()
        sent = spark.sparkContext.broadcast(Sketches(block, threshold))

        def run(batches, sent=sent):
            sketches = sent.value
            for batch, text in blocks(batches):
                words = Words(text)
                hashes, at = words.shingles()
                rows, doc_ids, last = [], batch.column("doc_id"), None
                for d, i in zip(*sketches.candidates(hashes, words.doc[at]), strict=True):
                    if d != last:
                        last, own = d, shingle_set(pc.utf8_lower(text[int(d)]).as_py())
                    size = len(sketches.sets[i])
                    found = len(own & sketches.sets[i])
                    if found >= threshold * size - 1e-9:
                        rows.append((doc_ids[int(d)].as_py(), sketches.item_id[i], size, found, found / size))
                if rows:
                    yield as_batch(schema, **{f.name: list(c) for f, c in zip(schema, zip(*rows, strict=True), strict=True)})

        found = docs.select("doc_id", "text").mapInArrow(run, PAIR)
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that are in no pair of `contained`, whatever their doc_id."""
    rows = keyed(docs, Workspace(docs.sparkSession, "decontaminated"))
    bad = contained(by_key(rows), items, threshold).select(F.col("doc_id").alias(ROW_KEY)).distinct()
    return restored(rows.join(bad, ROW_KEY, "left_anti"), docs.columns)
