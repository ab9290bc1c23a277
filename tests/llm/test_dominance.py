"""Byte-level pieces against whole texts; dominance and best fit against plain searches; the packing against its contract."""

import functools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trolley.llm import bytebpe, dominance, vocab

TEXTS = ["", None, " ", "\n\n", "a b", "  two  spaces ", "a\n b\r\n\tc", "x  y  z   w", "　 a 　\n b", "q  r   s", "don't we'll  I'VE", "<|endoftext|> a <|endoftext|>b", "été 日本 語", "3.14 v2 !!! (ok)", "a\x85 b\x1c c  d", "z" * 3000, "word " * 2500, "tab\tx \t y\x0b\x0cz ", "“quoted” text"]


def plain():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab.vocabulary_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("slab", [7, 1 << 20])
def test_pieces_give_the_ids_of_whole_texts(slab, monkeypatch):
    monkeypatch.setattr(bytebpe, "SLAB", slab)
    memo, whole = bytebpe.byte_bpe.__wrapped__(), plain()
    rng = random.Random(4)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice([" ", "\n", " ", "　", "a", "é", "'s", "7", "!"]) for _ in range(40)) for _ in range(300)]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:40]
    for text, own in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert memo.long(np.frombuffer(text.encode(), np.uint8), 0).tolist() == [*own.ids, 0], text


@functools.cache
def fewest(items, window):
    """The least number of windows for a sorted tuple of lengths, by search."""
    if not items:
        return 0
    best = len(items)

    def fill(first, rest, room, kept):
        nonlocal best
        best = min(best, 1 + fewest(tuple(kept + list(rest)), window))
        for k, x in enumerate(rest):
            if x <= room and (k == 0 or rest[k - 1] != x):
                fill(first, rest[k + 1 :], room - x, kept + list(rest[:k]))

    fill(items[0], items[1:], window - items[0], [])
    return best


def counted(items, window):
    return np.bincount(np.array(items, np.int64), minlength=window + 1)


def test_reduction_loses_no_window():
    rng, fixed_any = random.Random(1), 0
    for _ in range(120):
        window = rng.randint(8, 24)
        items = sorted((rng.randint(max(1, window // 5), window) for _ in range(rng.randint(1, 8))), reverse=True)
        kinds, left = dominance.reduced(counted(items, window), window)
        rest = tuple(sorted(np.repeat(np.arange(window + 1), left).tolist(), reverse=True))
        fixed = sum(k.n for k in kinds)
        fixed_any += fixed
        assert fixed + fewest(rest, window) == fewest(tuple(items), window), items
        assert all(sum(s * t for s, t in k.parts) <= window for k in kinds)
        assert Counter(items) == Counter(rest) + sum((Counter({s: t * k.n for s, t in k.parts}) for k in kinds), Counter())
    assert fixed_any > 100


def plain_best_fit(items, window):
    rooms = []
    for s in sorted(items, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= s]
        k = min(fits, key=lambda k: rooms[k]) if fits else len(rooms)
        rooms[k:] = [(rooms[k] if fits else window) - s] + rooms[k + 1 :]
    return sorted(rooms)


def test_best_fit_by_counts_equals_one_by_one():
    rng = random.Random(2)
    for _ in range(200):
        window = rng.randint(5, 60)
        items = [rng.randint(1, rng.choice([window, max(1, window // 3)])) for _ in range(rng.randint(0, 80))]
        kinds = dominance.best_fit(counted(items, window), window)
        assert sorted(window - sum(s * t for s, t in k.parts) for k in kinds for _ in range(k.n)) == plain_best_fit(items, window)


def check(rows, texts_by_id, window):
    """Every id in one piece, pieces cut as stated, offsets without gaps."""
    whole = plain()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for key, texts in texts_by_id.items():
        want = Counter()
        for t in texts:
            ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
            k = -(-len(ids) // window)
            edges = [0, *range(len(ids) - (k - 1) * window, len(ids) + 1, window)]
            for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                want[p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in docs[key]) == want
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(seqs)


@pytest.mark.parametrize("window", [16, 2048])
def test_packing(spark, window):
    big = 2**53
    texts = TEXTS + ["same text"] * 40
    ids = [None, None, 5, 5, *range(big + 1, big + 1 + len(texts) - 4)]
    rows = list(zip(ids, texts, ["x"] * len(ids), [1] * len(ids), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, local int").repartition(3)
    by_id = defaultdict(list)
    for i, t, *_ in rows:
        by_id[i].append(t)
    got = dominance.packed(df, window=window).collect()
    used = check(got, by_id, window)
    assert used <= 1.2 * sum(r.length for r in got) / window + 1
    assert not dominance.packed(df.limit(0), window=window).count()


def test_whole_table_is_near_the_least(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = dominance.packed(docs)
    lengths = [r[0] for r in got.select("length").collect()]
    least = max(-(-sum(lengths) // dominance.WINDOW), sum(n > dominance.WINDOW // 2 for n in lengths))
    assert got.agg(F.count_distinct("sequence_id")).first()[0] <= least + 1
    assert got.agg(F.count_distinct("doc_id")).first()[0] == docs.count()
