"""Whitening against a plain eigendecomposition over Python's whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trolley.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, key string, whitened int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 1) for i, v in rows], SCHEMA).repartition(3)


def by_row(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    return out


def plain(vectors):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    whole = [[n * c - s for c, s in zip(v, total, strict=True)] for v in x]
    centred = np.array([[c / n for c in v] for v in whole])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    return [sum(c * c for c in row) for row in whole], centred, e[::-1], u[:, ::-1], np.trace(v)


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_whitening(spark, scale):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(60, 12)) * np.linspace(1, 4, 12) * scale).tolist()
    big = 2**53
    rows = list(zip([None, 5, 5, *range(big + 1, big + 58)], good, strict=True))
    bad = [(1, None), (2, [None] * 12), (3, [math.nan, *good[0][1:]]), (4, [*good[0][:-1], math.inf]), (6, good[0][:5]), (7, []), (8, [1e300, *good[0][1:]])]
    got = by_row(whitening.whitened(frame(spark, rows + bad)))
    deviation, centred, e, u, trace = plain(good)
    assert got.keys() == {i for i, _ in rows}
    sign = {}
    for (i, _), own, c in zip(rows, deviation, centred, strict=True):
        assert got[i].keys() == set(range(1, 9))
        for k in range(8):
            match = [r for r in got[i][k + 1] if r.deviation == own]
            assert match and match[0].n == 60 and match[0].identity_error < 1e-4
            assert math.isclose(match[0].explained, e[k] / trace, rel_tol=1e-9)
            w = c @ u[:, k] / math.sqrt(e[k])
            sign.setdefault(k, 1 if w * match[0].whitened > 0 else -1)
            assert math.isclose(w, sign[k] * match[0].whitened, rel_tol=1e-6, abs_tol=1e-9)


def test_without_variance_and_without_rows(spark):
    got = whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(got)] == [(k, 0, None, None, None) for k in (1, 1, 2, 2)]
    line = whitening.whitened(frame(spark, [(k, [float(k), 2.0 * k, 7.0]) for k in range(5)]))
    assert line.where("component > 1 AND whitened IS NULL").count() == 10 and line.where("component = 1 AND whitened IS NOT NULL").count() == 5
    assert line.agg(F.max("identity_error")).first()[0] < 1e-9
    assert not whitening.whitened(frame(spark, [(1, None)])).count() and not whitening.whitened(frame(spark, []).limit(0)).count()
