"""Clustering and classification against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import classify, cluster

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(3, 4)) * 4
    return np.vstack([c + rng.normal(size=(8, 4)) for c in centres])


@pytest.fixture(scope="module")
def scaled(spark, matrix):
    rows = [(f"t{i:02d}", *map(float, r)) for i, r in enumerate(matrix)]
    df = spark.createDataFrame(rows, "team_id string, a double, b double, c double, d double")
    return cluster.scaled_vectors(df, NAMES)


def units_of(matrix):
    z = (matrix - matrix.mean(0)) / matrix.std(0, ddof=1)
    return z / np.linalg.norm(z, axis=1, keepdims=True)


def distances_of(matrix):
    u = units_of(matrix)
    return 1 - u @ u.T


def test_distance_to_one_team(spark, matrix):
    rows = [(f"t{i:02d}", *map(float, r)) for i, r in enumerate(matrix)]
    df = spark.createDataFrame(rows, "team_id string, a double, b double, c double, d double")
    out = cluster.cosine_from(cluster.scaled_long(df, NAMES), "t05").collect()
    wanted = distances_of(matrix)[5]
    for r in out:
        assert r["distance"] == pytest.approx(wanted[int(r["team_id"][1:])], abs=1e-12)


def test_gram_root_keeps_distance_row_geometry(scaled, matrix):
    units = cluster.unit_rows(scaled)
    root = cluster.gram_root(units, 4)
    u, d = units_of(matrix), distances_of(matrix)
    mapped = u @ root
    for i, j in [(0, 1), (3, 17), (9, 23)]:
        assert ((d[i] - d[j]) ** 2).sum() == pytest.approx(
            ((mapped[i] - mapped[j]) ** 2).sum())


def cost(rows, labels):
    return sum(((rows[labels == k] - rows[labels == k].mean(0)) ** 2).sum()
               for k in set(labels))


def test_kmeans_on_distance_rows(scaled, matrix):
    out = cluster.kmeans_teams(scaled, k=3, restarts=5, size=4).collect()
    labels = np.array([r["cluster"] for r in sorted(out, key=lambda r: r["team_id"])])
    rows = distances_of(matrix)
    rng = np.random.default_rng(0)
    best = np.inf
    for _ in range(60):
        centres = rows[rng.choice(len(rows), 3, replace=False)]
        for _ in range(50):
            near = ((rows[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([rows[near == k].mean(0) if (near == k).any() else centres[k]
                                for k in range(3)])
        best = min(best, cost(rows, near))
    assert cost(rows, labels) == pytest.approx(best)


def naive_ward(d):
    """One pair at a time on the full matrix, with the size-weighted update."""
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    size = {i: 1 for i in range(len(d))}
    groups = {i: [i] for i in size}
    heights, three = [], None
    while len(size) > 1:
        if len(size) == 3:
            three = {frozenset(g) for g in groups.values()}
        live = sorted(size)
        i, j = min(((a, b) for a in live for b in live if a < b), key=lambda p: d[p])
        heights.append(d[i, j])
        for k in live:
            if k not in (i, j):
                t = size[i] + size[j] + size[k]
                d[i, k] = d[k, i] = ((size[i] + size[k]) * d[i, k]
                                     + (size[j] + size[k]) * d[j, k]
                                     - size[k] * d[i, j]) / t
        size[i] += size.pop(j)
        groups[i] += groups.pop(j)
    return sorted(heights), three


@pytest.mark.parametrize("block_rows", [100_000, 7])
def test_ward_matches_sequential_merging(scaled, matrix, block_rows):
    heights, three = naive_ward(distances_of(matrix))
    merges, _ = cluster.ward_merges(scaled, block_rows)
    found = sorted(r["height"] for r in merges.collect())
    assert found == pytest.approx(heights)
    groups = {}
    for r in cluster.ward_teams(scaled, 3).collect():
        groups.setdefault(r["cluster"], set()).add(int(r["team_id"][1:]))
    assert {frozenset(g) for g in groups.values()} == three


def test_components(scaled, matrix):
    z = (matrix - matrix.mean(0)) / matrix.std(0, ddof=1)
    values = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    out = cluster.variable_coordinates(scaled, NAMES, top=20).collect()
    assert [r["ranking"] for r in out] == [1, 2, 3, 4]
    assert sum(r["pca_1"] ** 2 for r in out) == pytest.approx(values[0])
    assert sum(r["pca_2"] ** 2 for r in out) == pytest.approx(values[1])


def test_components_with_a_constant_feature(spark, matrix):
    """A feature that never varies adds nothing to the loadings of the others."""
    rows = [(f"t{i:02d}", *map(float, r), 3.0) for i, r in enumerate(matrix)]
    df = spark.createDataFrame(
        rows, "team_id string, a double, b double, c double, d double, e double")
    out = {r["variable"]: r for r in cluster.variable_coordinates(
        cluster.scaled_vectors(df, [*NAMES, "e"]), [*NAMES, "e"]).collect()}
    z = (matrix - matrix.mean(0)) / matrix.std(0, ddof=1)
    values = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    assert sum(r["pca_1"] ** 2 for r in out.values()) == pytest.approx(values[0])
    assert out["e"]["pca_1"] == pytest.approx(0) and out["e"]["distance"] == pytest.approx(0)


def test_teams_without_cluster_are_listed(spark, scaled):
    ids = spark.createDataFrame([("t00",), ("t01",), ("none",)], "team_id string")
    out = {r[0]: (r[1], r[2]) for r in cluster.with_reason(
        ids, cluster.kmeans_teams(scaled, k=3, restarts=2, size=4)).collect()}
    assert set(out) == {"t00", "t01", "none"} and out["none"] == (None, "incomplete profile")
    assert out["t00"][0] in (0, 1, 2) and out["t00"][1] is None


def test_split_is_exact_per_label(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(1003)]
    df = spark.createDataFrame(rows, "id long, lab string")
    out = classify.stratified_split(df, "lab", ["id"], 0.8, bucket_digits=1)
    counts = {(r[0], r[1]): r[2] for r in
              out.groupBy("lab", "in_train").count().collect()}
    small = sum(1 for _, lab in rows if lab == "small")
    assert counts["small", True] == int(np.ceil(small * 0.8 - 1e-9))
    assert counts["big", True] == int(np.ceil((1003 - small) * 0.8 - 1e-9))
    deeper = classify.stratified_split(df, "lab", ["id"], 0.8, bucket_digits=2)
    assert out.exceptAll(deeper).count() == 0


@pytest.fixture(scope="module")
def labelled_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        label = i % 3
        rows.append((f"G{i}", "t", "true", "2024-01-01", label,
                     float(label + rng.normal() * 0.2), float(rng.normal())))
    df = spark.createDataFrame(
        rows, "gameID string, teamName string, playByUs string, gameDate string, "
              "default int, x double, y double")
    return classify.as_vectors(df, ["x", "y"]).cache()


def test_forest_and_boosting_find_the_signal(labelled_rows):
    for tuned in (
        classify.random_forest(labelled_rows, trees=10, mtry=(1, 2), depth=4, folds=2,
                               repeats=2),
        classify.gradient_boosting(labelled_rows, trees=(3,), depths=(2,), min_leaf=(1, 5),
                                   folds=2, repeats=1),
    ):
        assert tuned.accuracy > 0.9 and len(tuned.grid_accuracy) == 2
        out = classify.predictions(tuned, labelled_rows)
        right = out.filter("predicted = label").count()
        assert right > 140
        sums = out.select((F.col("p_loss") + F.col("p_draw") + F.col("p_win")).alias("s"))
        assert all(abs(r["s"] - 1) < 1e-9 for r in sums.collect())
        cells = classify.confusion_matrix(out).agg(F.sum("cnt")).first()[0]
        assert cells == 150
        ranked = {r[0]: r[1] for r in
                  classify.importance(tuned, labelled_rows, ["x", "y"]).collect()}
        assert ranked["x"] > ranked["y"]


def test_incomplete_rows_are_listed(spark, labelled_rows):
    tuned = classify.random_forest(labelled_rows, trees=5, mtry=(1,), depth=3, folds=2, repeats=1)
    row = ("G900", "t", "true", "2024-01-01", 1, None, 0.5)
    extra = classify.as_vectors(spark.createDataFrame(
        [row], "gameID string, teamName string, playByUs string, gameDate string, "
               "default int, x double, y double"), ["x", "y"])
    out = classify.predictions(tuned, labelled_rows.unionByName(extra))
    assert out.count() == 151
    lost = out.filter("predicted IS NULL").collect()
    assert [(r.gameID, r.reason, r.label) for r in lost] == [("G900", "incomplete features", 1)]


def test_correlation(labelled_rows):
    out = {r[0]: r[1] for r in
           classify.label_correlation(labelled_rows, ["x", "y"]).collect()}
    pdf = labelled_rows.select("default", "x", "y").toPandas()
    assert out["x"] == pytest.approx(np.corrcoef(pdf["default"], pdf["x"])[0, 1])
