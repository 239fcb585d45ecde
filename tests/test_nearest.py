"""Nearest neighbours and the whole spectrum against NumPy."""

import numpy as np
import pytest

from touchline.operators import cluster, nearest


def plain(ids, u, k):
    out = []
    for i, name in enumerate(ids):
        gaps = sorted((round(float(1 - u[i] @ u[j]), nearest.DIGITS), ids[j])
                      for j in range(len(ids)) if j != i)
        out += [(name, r + 1, other, d) for r, (d, other) in enumerate(gaps[:k])]
    return sorted(out)


@pytest.mark.parametrize("n, k, blocks, part", [(200, 5, None, 4096), (60, 3, 9, 4), (4, 5, 2, 1), (1, 5, 1, 8)])
def test_neighbours(spark, monkeypatch, n, k, blocks, part):
    """Also with many equal rows (ties by id) and blocks that are cut."""
    monkeypatch.setattr(nearest, "PART_ROWS", part)
    rng = np.random.default_rng(n)
    u = rng.normal(size=(n, 6)) + rng.integers(0, 3, (n, 1)) * 2
    u[: n // 3] = u[0]
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids = [f"t{i:03d}" for i in rng.permutation(n)]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, u)], "team_id string, u array<double>")
    got = sorted(map(tuple, nearest.nearest(df, k, blocks).collect()))
    want = plain(ids, u, k)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-8)


def test_far_blocks_are_not_searched(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(8)
    u = np.repeat(centres, 50, axis=0) + rng.normal(size=(400, 8)) * 0.01
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"t{i}", r.tolist()) for i, r in enumerate(u)],
                               "team_id string, u array<double>")
    placed, stats = nearest.partitioned(df, 20)
    assert stats["size"].sum() == 400 and len(stats) <= 20 and placed.count() == 400
    assert nearest.nearest(df, 5, 20).count() == 2_000


def test_spectrum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4))
    x[:, 3] = 7.0  # never varies
    df = spark.createDataFrame([(f"t{i}", *map(float, r)) for i, r in enumerate(x)],
                               "team_id string, a double, b double, c double, d double")
    scaled = cluster.scaled_vectors(df, ["a", "b", "c", "d"])
    rows = cluster.spectrum(scaled, 4).collect()
    want = np.sort(np.linalg.eigvalsh(np.corrcoef(x[:, :3].T)))[::-1]
    assert np.allclose([r.eigenvalue for r in rows], [*want, 0.0], atol=1e-9)
    assert rows[-1].cumulative == pytest.approx(1.0) and [r.component for r in rows] == [1, 2, 3, 4]
