"""Pruned search against exhaustive search; vectors by cells against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trolley.operators import matching, postings, vectors


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdeghiklmnorst") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    weights = [1 / (k + 1) for k in range(150)]
    products = sorted({" ".join(rng.choices(words, weights, k=rng.choice([1, 2, 3, 5, 9, 14]))) for _ in range(900)})
    queries = sorted({" ".join(rng.choices(words, weights, k=rng.randint(1, 3))) for _ in range(40)} | {"nothing like it", words[0][:-1]})
    return products, queries


def frames(spark, texts):
    products, queries = texts
    return spark.createDataFrame([(x,) for x in products], "product string"), spark.createDataFrame([(x,) for x in queries], "q string")


def top(scores, k):
    out = defaultdict(list)
    for (q, p), s in scores.items():
        out[q].append((-s, p))
    return {(q, p): (-s, n) for q, rows in out.items() for n, (s, p) in enumerate(sorted(rows)[:k], 1)}


@pytest.mark.parametrize("k", [3, 25])
def test_words(spark, texts, k):
    products, queries = texts
    p, q = frames(spark, texts)
    found, read = postings.bm25_topk(q, postings.bm25_index(p), k)
    n, avgdl = len(products), sum(len(x.split(" ")) for x in products) / len(products)
    df = Counter(w for x in products for w in set(x.split(" ")))
    scores = {}
    for a in queries:
        for b in products:
            both = Counter(b.split(" "))
            s = sum(both[w] * (math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(b.split(" ")) / avgdl))) for w in a.split(" "))
            if any(both[w] for w in a.split(" ")):
                scores[a, b] = s
    got = {(r.q, r.product): (r.score, r["rank"]) for r in found.collect()}
    want = top({key: round(s * 1e6) for key, s in scores.items()}, k)
    assert got.keys() == want.keys() and all(abs(got[x][0] - want[x][0]) <= 1 for x in got)
    rows = read.collect()
    assert all(r.read <= r.postings for r in rows)
    if k == 3:
        assert sum(r.read for r in rows) < 0.95 * sum(r.postings for r in rows)


@pytest.mark.parametrize("k", [3, 25])
def test_trigrams(spark, texts, k):
    products, queries = texts
    p, q = frames(spark, texts)
    found, read = postings.trigram_topk(q, postings.trigram_index(p), k)
    grams = lambda x: {x[i : i + 3] for i in range(len(x) - 2)}
    scores = {(a, b): 1000 * len(grams(a) & grams(b)) // len(grams(a) | grams(b)) for a in queries for b in products if grams(a) & grams(b)}
    assert {(r.q, r.product): (r.score, r["rank"]) for r in found.collect()} == top(scores, k)
    rows = read.collect()
    assert all(r.read <= r.postings for r in rows)
    if k == 3:
        assert sum(r.read for r in rows) < 0.9 * sum(r.postings for r in rows)


def brute(ids, x, label, queries, k):
    out = {}
    for i in queries:
        s = np.round(x @ x[i] * 1e6).astype(np.int64)
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != i and label[j] == label[i])[:k]
        out[ids[i]] = [b for _, b in order]
    return out


def test_recall_of_the_vector_index(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = rows.toPandas().sort_values("vec_id", ignore_index=True)
    x = np.stack(table["embedding"].to_list()).astype(float)
    asked = rows.where("vec_id % 50 = 0")
    index = vectors.fit(rows, "vec_id", "embedding")
    want = brute(table["vec_id"].tolist(), x, table["label"].tolist(), np.flatnonzero(table["vec_id"] % 50 == 0), 10)
    got = defaultdict(set)
    for r in vectors.search(index, rows, asked, "vec_id", "embedding", 10, "label").collect():
        got[r.a].add(r.b)
    recall = np.mean([len(got[q] & set(b)) / len(b) for q, b in want.items()])
    assert recall >= 0.9, (recall, index.probes, len(index.centres))


@pytest.mark.parametrize("size", [7, 5000])
def test_all_cells_are_exact_whatever_the_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(vectors, "VECTORS", size)
    monkeypatch.setattr(vectors, "QUERIES", size)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(120, 6)) * (rng.random((120, 1)) < 0.7), 1)  # a third of the vectors are equal
    df = spark.createDataFrame([(k, v.tolist(), k % 2) for k, v in enumerate(x)] + [(999, None, 0)], "id long, v array<double>, label int")
    index = vectors.fit(df, "id", "v")
    index.probes = len(index.centres)
    got = defaultdict(list)
    for r in vectors.search(index, df, df, "id", "v", 5, "label").orderBy("a", "place").collect():
        got[r.a].append(r.b)
    assert dict(got) == brute(list(range(120)), x, [k % 2 for k in range(120)], range(120), 5)
    assert not vectors.search(index, df.limit(0), df.limit(0), "id", "v", 5).count()


def test_exhaustive_search_equals_plain_pairs(spark, monkeypatch):
    """All pairs of a block, in tiles of several sizes: equal and opposite vectors, nulls, other lengths, repeated ids, and blocks smaller than k."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(150, 5)) * (rng.random((150, 1)) < 0.7), 1)
    rows = [(i if i != 77 else 76, None if i % 31 == 0 else [float(c) for c in r][: 4 if i % 29 == 0 else 5], i % 3 if i < 144 else None if i < 146 else 9) for i, r in enumerate(x)]
    rows[50] = (50, [1.0, None, 0.5, 0.0, 0.0], 2)
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")

    def dot(u, v):
        if u is None or v is None or len(u) != len(v) or None in u or None in v:
            return None
        s = 0.0
        for p, q in zip(u, v, strict=True):
            s += p * q
        return int(np.floor(abs(s * 1e6) + 0.5) * np.sign(s))

    for size, asked in ((16, df), (10_000, df.where("id % 5 = 0"))):
        monkeypatch.setattr(vectors, "TILE", size)
        want = []
        for a, u, block in rows:
            if block is not None and (asked is df or a % 5 == 0):
                want.append([a, sorted((-(s if (s := dot(u, v)) is not None else -(1 << 62)), b) for b, v, other in rows if other == block and b != a)])
        got = matching.vector_topk(df, "id", "label", "v", 6, queries=asked).collect()
        for a in {w[0] for w in want} - {76}:
            mine = [((-r["score"] if r["score"] is not None else 1 << 62), r["b"]) for r in sorted(got, key=lambda r: r["place"]) if r["a"] == a]
            assert mine == next(w[1] for w in want if w[0] == a)[:6], a
    plan = matching.vector_topk(df, "id", "label", "v", 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "InArrow" in plan  # no row for each pair


def test_a_scan_for_neighbours_scores_few_pairs(monkeypatch):
    """Copies of one vector cost a product each: what is scored and held at a time does not grow with the tile."""
    seen, scores = [], vectors._scores
    monkeypatch.setattr(vectors, "_scores", lambda x, y, i, j: seen.append(len(i)) or scores(x, y, i, j))
    x = np.repeat(np.random.default_rng(2).normal(size=(1, 8)), 6000, axis=0)
    ids = np.arange(6000)
    r, c, s = vectors.nearest(x[:600], ids[:600], x, ids, 3)
    assert r.tolist() == np.repeat(np.arange(600), 3).tolist() and c[:6].tolist() == [1, 2, 3, 0, 2, 3] and len(set(s.tolist())) == 1
    assert max(seen) <= 64 * vectors.ASK and sum(seen) < 100 * 600


def test_rows_for_cells_are_handed_on_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HANDED", 40)
    df = spark.range(500).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")).coalesce(1)
    index = vectors.Index(np.random.default_rng(1).normal(size=(30, 2)), 12, 1.0)
    sent = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda rows, run, schema: sent.append(run) or rows)
    vectors._celled(df, "id", "v", None, "a", index.looked)
    whole = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([0] * 500), pa.array([[float(i), 1.0] for i in range(500)])], names=["a", "block", "v"])
    out = list(sent[0]([whole]))
    assert sum(len(b) for b in out) == 500 * 12 and max(len(b) for b in out) <= 40
    assert pa.Table.from_batches(out)["a"].to_pylist() == [i for i in range(500) for _ in range(12)]
