"""Whitening of embeddings: exact sums, a Gramian of exactly centred rows, and a broadcast projection.

Entries become whole numbers first (`fixed`), so the number of vectors and each dimension's sum are exact. A row minus
the mean is then (n x - S) / n with a whole numerator: no rounding before the one division. MLlib's RowMatrix sums the
products of those rows; divided by n that is the covariance. What comes to the driver is d sums and a d x d matrix,
whatever the number of rows; its eigenvectors go to the tasks as a broadcast of d x k numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.workspace import Workspace

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Scaled entries from here on have no whole number of 64 bits: their vector counts as one with a non-finite entry.
LIMIT = float(2**62)
COMPONENTS = 8
#: Low bits of a whole number that are summed apart, so that a batch's sums fit 64 bits.
_LOW = 20


def usable(embedding: Column) -> Column:
    """Whether a vector is there and has only entries that a whole number can stand for."""
    fits = F.forall(embedding, lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < LIMIT, F.lit(False)))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & fits, F.lit(False))


def fixed(embedding: pd.Series) -> np.ndarray:
    """A row of whole numbers for each vector."""
    return np.floor(SCALE * np.stack(embedding.to_list()).astype(np.float64)).astype(np.int64) + SHIFT


@dataclass
class Sums:
    """The number of vectors and the exact sum of each dimension, as Python's whole numbers."""

    n: int
    total: list[int]

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: in 64 bits where these numbers fit, else as Python's whole numbers."""
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.total)) < 2**62:
            return self.n * x - np.array(self.total, np.int64)
        return self.n * x.astype(object) - np.array(self.total, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.numerators(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of squares of the numerators of each row, exactly."""
        v = self.numerators(x)
        if v.dtype != object and len(v) and v.shape[1] * int(np.abs(v).max()) ** 2 >= 2**63:
            v = v.astype(object)
        return [int(y) for y in (v * v).sum(axis=1)]


def sums(rows: DataFrame) -> Sums:
    """n and S of the vectors in the column embedding; all have one length, and there is at least one."""

    def run(frames):
        for f in frames:
            if len(f):
                x = fixed(f["embedding"])
                yield pd.DataFrame({"place": np.arange(x.shape[1]), "n": len(x), "high": (x >> _LOW).sum(axis=0), "low": (x & ((1 << _LOW) - 1)).sum(axis=0)})

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = rows.select("embedding").mapInPandas(run, "place long, n long, high long, low long").groupBy("place").agg(F.sum("n").alias("n"), exact("high"), exact("low"))
    got = sorted(found.collect())  # a row for each dimension
    return Sums(got[0]["n"], [(int(r["high"]) << _LOW) + int(r["low"]) for r in got])


def covariance(centred: DataFrame, n: int) -> np.ndarray:
    """The mean product of each two dimensions of the array column that is the only one of centred."""
    column = centred.columns[0]
    vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector(F.col(column)).alias(column)), column)
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance, largest first, and a unit eigenvector of each as a column."""
    e, u = np.linalg.eigh(v)
    by = np.argsort(-e, kind="stable")[:k]
    return e[by], u[:, by]


def whitened(vectors: DataFrame, key: str = "vec_id", k: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation (decimal), whitened, explained, identity_error for each vector and component.

    A vector is left out if it is null or empty, or has a null, non-finite or unrepresentable (2^62 / 1024 and more)
    entry; where lengths differ, entries that a shorter vector lacks count as null. Repeated rows are rows of their own,
    and a null or repeated key is carried as it is. A component without variance (all vectors equal in its direction)
    has whitened null; without any variance explained is null as well. Components of equal variance have any
    orthogonal directions in their common space. deviation is null where it has over 38 digits. identity_error is taken
    over the components that have variance, and null if none has. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "whitening")
    rows = vectors.select(F.col(key).alias("key"), "embedding").where(usable(F.col("embedding")))
    kind = vectors.schema[key].dataType
    d = rows.agg(F.max(F.size("embedding"))).first()[0]
    if d is None:
        nothing = spark.createDataFrame([], "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
        return nothing.select(F.lit(None).cast(kind).alias(key), "*")
    rows = rows.where(F.size("embedding") == d)
    of = sums(rows)
    sent = spark.sparkContext.broadcast(of)

    def centre(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"centred": list(sent.value.centred(fixed(f["embedding"])))})

    v = covariance(rows.select("embedding").mapInPandas(centre, "centred array<double>"), of.n)
    e, u = components(v, min(k, d))
    varied = int((e > max(e[0], 0) * d * np.finfo(float).eps).sum())
    project = spark.sparkContext.broadcast(u[:, :varied] / np.sqrt(e[:varied]))

    def whiten(frames):
        for f in frames:
            if len(f):
                x = fixed(f["embedding"])
                w = sent.value.centred(x) @ project.value
                yield pd.DataFrame({"key": f["key"], "deviation": [str(y) for y in sent.value.deviations(x)], "whitened": list(w)})

    # keys pass as text: pandas has no whole numbers beside nulls
    out = work.table(rows.select(F.col("key").cast("string"), "embedding").mapInPandas(whiten, "key string, deviation string, whitened array<double>"), "whitened")
    error = None
    if varied:
        one = lambda i: F.get("whitened", F.lit(i))
        mean = out.agg(*[F.avg(one(i)) for i in range(varied)]).first()
        again = covariance(out.select(F.array(*[one(i) - mean[i] for i in range(varied)]).alias("c")), of.n)
        error = float(np.abs(again - np.eye(varied)).max())
    trace = float(np.trace(v))
    explained = F.array(*[F.lit(float(x) / trace if trace > 0 else None).cast("double") for x in np.maximum(e, 0)])
    each = out.select("key", "deviation", "whitened", F.explode(F.sequence(F.lit(1), F.lit(len(e)))).alias("component"))
    place = F.col("component") - 1
    return each.select(F.col("key").cast(kind).alias(key), "component", F.lit(of.n).cast("long").alias("n"), F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), F.get("whitened", place).alias("whitened"), F.get(explained, place).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
