"""Nearest vectors by an inverted file of bounded cells: fitted on a sample, filled with every row, searched in several cells.

Cells come from k-means over a sample of at most SAMPLE vectors; every vector lies in the cell whose centre is nearest. A query
looks in the cells whose centres have the largest products with it, as many as found the wanted share of true neighbours within the
sample; what it finds there is scored exactly. Vectors of a cell and the queries that look there meet in blocks of bounded sizes, so
neither a crowded cell nor a popular query region is one task's work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trolley.operators.shared import ship, written

#: Vectors that the cells are fitted on, rounds of k-means, and queries of the sample that the number of probes is measured with.
SAMPLE, ROUNDS, MEASURED = 20_000, 12, 300
#: Vectors and queries of a block of cells, and of a tile of the exhaustive search.
VECTORS, QUERIES, TILE = 4096, 1024, 32_768
#: Queries and vectors that are multiplied at a time, pairs that are scored at a time, and rows that a step hands on at a time.
ASK, LOOK, PAIRS, HANDED = 512, 2048, 16_384, 4096


@dataclass
class Index:
    """Centres of the cells, how many a query looks in, and the share of true neighbours that this found in the sample."""

    centres: np.ndarray
    probes: int
    recall: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each row."""
        return ((self.centres**2).sum(1) - 2 * x @ self.centres.T).argmin(1)

    def looked(self, x: np.ndarray) -> np.ndarray:
        """The cells that each query looks in."""
        return np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, : self.probes]


def fit(items: DataFrame, key: str, vector: str, k: int = 10, recall: float = 0.97, seed: int = 1) -> Index:
    """Cells from the sample with the least hashes of the key; as many probes as reach the recall for k neighbours there."""
    rows = items.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(key)).limit(SAMPLE).toArrow()
    x = np.array(rows[vector].to_pylist(), np.float64)
    if not len(x):
        return Index(np.zeros((1, 1)), 1, 1.0)
    n = max(1, int(np.sqrt(len(x)) / 2))
    index = Index(x[np.random.default_rng(seed).choice(len(x), n, replace=False)], n, 1.0)
    for _ in range(ROUNDS):
        cell = index.cells(x)
        size = np.bincount(cell, minlength=n)
        total = np.zeros_like(index.centres)
        np.add.at(total, cell, x)
        index.centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], index.centres)
    cell, q = index.cells(x), x[:MEASURED]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(q @ index.centres.T), axis=1, kind="stable"), axis=1)
    depth = np.take_along_axis(place, cell[best], axis=1)  # how far down a query's list of cells its neighbours lie
    found = [(depth < p).mean() if depth.size else 1.0 for p in range(1, n + 1)]
    index.probes = next((p for p, r in enumerate(found, 1) if r >= recall), n)
    index.recall = float(found[index.probes - 1])
    return index


def _scores(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Millionths of the products of rows i of x and j of y, summed from the first entry to the last and rounded half away from zero, as `columns.dot` has it."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), PAIRS):
        u, v = x[i[a : a + PAIRS]], y[j[a : a + PAIRS]]
        s = np.zeros(len(u))
        for c in range(x.shape[1]):
            s += u[:, c] * v[:, c]
        s *= 1e6
        whole = np.trunc(s)
        s = np.where(np.abs(s - whole) == 0.5, whole + np.sign(s), np.rint(s))
        out[a : a + PAIRS] = np.clip(np.nan_to_num(s, nan=0.0), -(2.0**62), 2.0**62)
    return out


def nearest(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of p and score of each query's k best of p, those of its own id left out; ties by the row of p, which stand by id.

    Products of a few hundred queries and a few thousand vectors are made at a time. Only pairs that may come before a query's k-th best
    so far are scored, so memory has a bound and equal vectors cost a product each.
    """
    found = []
    with np.errstate(all="ignore"):
        error = (p.shape[1] + 4) * 2.0**-51 * np.sqrt((p**2).sum(1)).max(initial=0.0)
        for a in range(0, len(q), ASK):
            x, own = q[a : a + ASK], q_ids[a : a + ASK]
            slack = error * np.sqrt((x**2).sum(1)) + 1e-12
            least = np.full(len(x), -np.inf)
            rows, cols, score = (np.empty(0, np.int64) for _ in range(3))
            b, step = 0, 64
            while b < len(p):
                i, j = np.nonzero(~(x @ p[b : b + step].T < least[:, None]))
                j += b
                other = own[i] != p_ids[j]
                i, j = i[other], j[other]
                b, step = b + step, min(4 * step, LOOK)
                if not len(i):
                    continue
                rows, cols, score = np.concatenate([rows, i]), np.concatenate([cols, j]), np.concatenate([score, _scores(x, p, i, j)])
                order = np.lexsort((cols, -score, rows))
                rows, cols, score = rows[order], cols[order], score[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                last = place == k - 1
                after = (score[last] + 0.5) / 1e6
                least[rows[last]] = after - slack[rows[last]] - np.abs(after) * 1e-12
                top = place < k
                rows, cols, score = rows[top], cols[top], score[top]
            found.append((rows + a, cols, score))
    return tuple(np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found) if found else [()] * 3))


def _tile(rows: pa.Table, k: int) -> pa.Table:
    """a, b, score: each query's k best of a tile (id, v, asks), itself left out, ties by id. Without a vector, with a null in it or of another length there is no score; such pairs come last."""
    asks, ids = rows["asks"].to_numpy(), rows["id"].combine_chunks()
    key = ids.to_numpy(zero_copy_only=False)
    q, p = np.flatnonzero(asks), np.flatnonzero(~asks)
    p = p[np.argsort(key[p], kind="stable")]
    v = rows["v"].combine_chunks()
    size = v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).copy()
    if v.flatten().null_count:
        size[np.repeat(np.arange(len(v)), np.maximum(size, 0))[v.flatten().is_null().to_numpy(zero_copy_only=False)]] = -1
    a, b, score = [], [], []
    for n in np.unique(size[size >= 0]):
        i, j = q[size[q] == n], p[size[p] == n]
        x, y = (v.take(pa.array(z)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(z), n) for z in (i, j))
        r, c, s = nearest(x, key[i], y, key[j], k)
        a.append(i[r])
        b.append(j[c])
        score.append(pa.array(s, pa.int64()))
    if len(np.unique(size)) > 1 or (size < 0).any():
        have = np.bincount(np.concatenate(a), minlength=len(size)) if a else np.zeros(len(size), np.int64)
        for i in q[have[q] < k]:
            rest = p[((size[p] != size[i]) | (size[i] < 0))]
            rest = rest[key[rest] != key[i]][: k - have[i]]
            a.append(np.full(len(rest), i))
            b.append(rest)
            score.append(pa.nulls(len(rest), pa.int64()))
    take = lambda parts: ids.take(pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))
    return pa.table({"a": take(a), "b": take(b), "score": pa.chunked_array(score, pa.int64())})


def _tiled(items: DataFrame, queries: DataFrame, both: DataFrame, by: list[str], k: int) -> DataFrame:
    """a, b, score, place from items (b, v) and queries (a, v) that meet by the columns `by`, in as many parts and turns as `both` says for each."""
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = items.join(both, by).withColumn("part", own("b", "parts")).withColumn("turn", every("turns")).select(*by, "part", "turn", F.col("b").alias("id"), "v", F.lit(False).alias("asks"))
    right = queries.join(both, by).withColumn("turn", own("a", "turns")).withColumn("part", every("parts")).select(*by, "part", "turn", F.col("a").alias("id"), "v", F.lit(True).alias("asks"))
    kind = dict(items.dtypes)["b"]
    found = left.union(right).groupBy(*by, "part", "turn").applyInArrow(lambda rows: _tile(rows, k), f"a {kind}, b {kind}, score long")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def exhaustive(items: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: str) -> DataFrame:
    """a, b, score, place: the k best items of each query's block among all of them. A block's queries and items meet in square tiles, each once."""
    ship(items.sparkSession)
    kind = dict(items.dtypes)[vector]
    v = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    held, asked = (rows.where(F.col(key).isNotNull()).select(F.col(key).alias(name), F.col(block).alias("block"), v.alias("v")) for rows, name in ((items, "b"), (queries, "a")))
    sizes = lambda rows, name: rows.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    return _tiled(held, asked, sizes(held, "parts").join(sizes(asked, "turns"), "block"), ["block"], k)


def _celled(rows: DataFrame, key: str, vector: str, block: str | None, name: str, cells) -> DataFrame:
    """key, block, cell, vector: a row for each cell that `cells` gives a vector."""
    kind = dict(rows.dtypes)
    own = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias(name), (F.col(block) if block else F.lit(0)).alias("block"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches):
        for whole in batches:
            step = HANDED
            while len(whole):
                b = whole.slice(0, step)
                x = np.array(b.column("v").flatten()).reshape(len(b), -1)
                c = cells(x).reshape(len(b), -1)
                if c.size > HANDED and len(b) > 1:  # a query's row is repeated for each cell: fewer at a time
                    step = max(1, HANDED // c.shape[1])
                    b, c = b.slice(0, step), c[:step]
                whole = whole.slice(len(b))
                at = pa.array(np.repeat(np.arange(len(b)), c.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(name).take(at), b.column("block").take(at), pa.array(c.ravel().astype(np.int32)), b.column("v").take(at)], names=[name, "block", "cell", "v"])

    return own.mapInArrow(run, f"{name} {kind[key]}, block {kind[block] if block else 'int'}, cell int, v array<double>")


def search(index: Index, items: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: str | None = None) -> DataFrame:
    """a, b, score (millionths of the product), place: the k best items b of each query a in the cells that it looks in, itself left out; ties by b.

    With block, only items of the query's own block count. With as many probes as cells the result is exact.
    """
    ship(items.sparkSession)
    filed = written(_celled(items, key, vector, block, "b", index.cells), "filed")
    asked = written(_celled(queries, key, vector, block, "a", index.looked), "asked")
    sizes = filed.groupBy("block", "cell").agg(F.count("*").alias("n"))
    wanted = asked.groupBy("block", "cell").agg(F.count("*").alias("m"))
    both = sizes.join(wanted, ["block", "cell"]).select("block", "cell", F.ceil(F.col("n") / VECTORS).cast("int").alias("parts"), F.ceil(F.col("m") / QUERIES).cast("int").alias("turns"))
    return _tiled(filed, asked, both, ["block", "cell"], k)
