"""Whitening against a dense eigenvalue solver."""

import math

import numpy as np
import pytest
from conftest import SMALL

from touchline.llm import whitening


def plain(rows, wanted=4):
    """The values by numpy.linalg.eigh of the exact covariance."""
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
             if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(x) for _, x in whole]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k))
    whole = [(i, x) for i, x in whole if len(x) == d]
    fit = np.array(sorted({tuple(x) for _, x in whole}))
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    centred = fit - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:wanted]
    return whole, n, sums, values[order], vectors[:, order], values.sum()


def check(rows, found, wanted=4, kept=None, alone=True):
    whole, n, sums, values, vectors, trace = plain(rows, wanted)
    kept = len(values) if kept is None else kept
    assert len(found) == len(whole) * kept
    key = lambda i: (i is None, i or 0)
    by_row = {}
    for i, x in whole:
        by_row.setdefault(i, []).append(x)
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.component), []).append(r)
    for k in range(kept):
        sign = None
        for i in sorted(by_row, key=key):
            xs, rs = by_row[i], got[i, k + 1]
            want_dev = sorted(sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs)
            assert sorted(r.deviation for r in rs) == want_dev
            if alone:
                want = [float((np.array(x) - np.array([s / n for s in sums])) @ vectors[:, k]
                              / math.sqrt(values[k])) for x in xs]
                for a, r in zip(want, rs):
                    if len(xs) == 1 and abs(a) > 1e-6:
                        sign = sign or math.copysign(1, a * r.whitened)
                        assert r.whitened == pytest.approx(sign * a, rel=1e-9, abs=1e-9)
            for r in rs:
                assert r.n == n and r.identity_error < 1e-9
                assert r.explained == pytest.approx(values[k] / trace, rel=1e-9)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, [2.0]) for i, v in rows],
                                 "vec_id long, embedding array<double>, n int, x array<double>")


def test_given_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in df.collect()], whitening.whitened(df).collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 6)) * [5, 3, 2, 1, .5, .2] + 7
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(i + 100, rows[3][1]) for i in range(40)]
    rows += [(500, None), (501, []), (502, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (503, [float("nan")] * 6),
             (504, [float("inf")] * 6), (505, [1.0, 2.0]), (None, rows[5][1]), rows[7], (506, [-0.0] * 6)]
    check(rows, whitening.whitened(frame(spark, rows)).collect())


def test_repeated_eigenvalues(spark):
    """All four components have one eigenvalue: any basis, whitened all the same."""
    rows = [(2 * k + s, [(1 - 2 * s) * (k == j) * 1.0 for j in range(4)]) for k in range(4) for s in (0, 1)]
    found = whitening.whitened(frame(spark, rows)).collect()
    check(rows, found, alone=False)
    assert {r.component for r in found} == {1, 2, 3, 4}


def test_fewer_components(spark):
    """Rank two in five dimensions; one vector has no deviation at all."""
    rng = np.random.default_rng(3)
    plane = rng.integers(-20, 20, (50, 2)) @ rng.integers(-3, 4, (2, 5))
    rows = [(i, (v / 4).tolist()) for i, v in enumerate(plane)]
    check(rows, whitening.whitened(frame(spark, rows)).collect(), kept=2)
    alone = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert whitening.whitened(alone).collect() == []


def test_large_numbers(spark):
    """Deviations stay exact up to 64 bits and are null beyond."""
    rows = [(1, [3e6, 1.0]), (2, [-2e6, 5.0]), (3, [1.0, 2.5])]
    check(rows, whitening.whitened(frame(spark, rows)).collect(), kept=2)
    far = whitening.whitened(frame(spark, [(1, [1e12, 0.0]), (2, [0.0, 1e30]), (3, [1.0, 2.0])]))
    assert {r.deviation for r in far.collect()} == {None}


def test_empty(spark):
    empty = whitening.whitened(frame(spark, [(1, [1.0])]).limit(0))
    assert empty.collect() == []
    assert empty.columns == [c.split()[0] for c in whitening.RESULT.split(", ")]
    assert whitening.whitened(frame(spark, [(1, None), (2, [])])).collect() == []
