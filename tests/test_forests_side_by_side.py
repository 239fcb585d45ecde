"""Forests and boosted trees that grow at the same time, to the results of one by one."""

import threading

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from touchline.functions.constants import PREDICTORS
from touchline.operators import boosting, classify, forests, slices
from touchline.operators.boosting import Setting
from touchline.plans import models

WAIT = 60


def table(spark, names, count=60):
    rng = np.random.default_rng(17)
    rows = [(f"G{i}", "t", "true", "d", i % 3, *map(float, rng.normal(size=len(names)) + i % 3))
            for i in range(count)]
    return spark.createDataFrame(
        rows, "gameID string, teamName string, playByUs string, gameDate string, default int, "
              + ", ".join(f"{n} double" for n in names))


@pytest.fixture(scope="module")
def vectors(spark):
    return slices.stage(classify.as_vectors(table(spark, ["x", "y"]), ["x", "y"]))


def grow(rows, folder):
    return {(r.gameID, r.mtry): r for r in forests.grow_forests(
        rows, rows, ["gameID"], str(folder), (1, 2), 6, 3, 5, ["x", "y"]).collect()}


def meeting(monkeypatch, parties, *places):
    """Each of the functions goes on only when all have begun."""
    barrier = threading.Barrier(parties)
    for module, name in places:
        def wrapped(*args, real=getattr(module, name), **kwargs):
            barrier.wait(WAIT)
            return real(*args, **kwargs)
        monkeypatch.setattr(module, name, wrapped)


def test_small_batches_grow_side_by_side(monkeypatch, vectors, tmp_path):
    alone = grow(vectors, tmp_path / "alone")
    meeting(monkeypatch, 4, (forests, "grow_batch"))
    assert grow(vectors, tmp_path / "together") == alone


def test_large_batches_grow_alone(monkeypatch, vectors, tmp_path):
    monkeypatch.setattr(forests, "AT_ONCE", 60 * 3 * 2 - 1)
    real, lock = forests.grow_batch, threading.Lock()

    def only(*args):
        assert lock.acquire(blocking=False)
        try:
            real(*args)
        finally:
            lock.release()

    monkeypatch.setattr(forests, "grow_batch", only)
    assert len(grow(vectors, tmp_path / "forest")) == 120


def test_nodes_of_rows_are_kept(monkeypatch, vectors, tmp_path):
    """Spark's own forest gives the same votes without it."""
    kept, real = [], RandomForestClassifier.fit

    def fit(self, *args):
        kept.append(self.getCacheNodeIds())
        return real(self, *args)

    monkeypatch.setattr(RandomForestClassifier, "fit", fit)
    found = grow(vectors, tmp_path / "forest")
    assert kept == [True] * 4
    votes = {}
    for m in (1, 2):
        for b in (0, 3):
            model = RandomForestClassifier(numTrees=3, maxDepth=5, featureSubsetStrategy=str(m),
                                           seed=forests.batch_seed(m, b)).fit(vectors)
            for r in model.transform(vectors).select(
                    "gameID", vector_to_array("rawPrediction").alias("v")).collect():
                votes[r.gameID, m] = votes.get((r.gameID, m), 0) + np.array(r.v)
    assert all(np.allclose(found[k].p, v / 6, rtol=0, atol=1e-12) for k, v in votes.items())


def test_a_failed_batch_is_told(monkeypatch, vectors, tmp_path):
    def fail(*args):
        raise ValueError("no batch")

    monkeypatch.setattr(forests, "grow_batch", fail)
    with pytest.raises(ValueError, match="no batch"):
        grow(vectors, tmp_path / "forest")


PLAN = models.Plan(settings=(Setting(2, 3),), boosted_trees=(1, 2), mtry=(2,), forest_trees=3,
                   forest_batch=3)


def beside(monkeypatch):
    meeting(monkeypatch, 2, (boosting, "fit_boosted"), (forests, "grow_forests"))


def test_importance_of_both_models(monkeypatch, spark):
    rows = table(spark, PREDICTORS)
    alone = models.importance(rows, PLAN).collect()
    beside(monkeypatch)
    assert models.importance(rows, PLAN).collect() == alone


def test_predictions_of_both_models(monkeypatch, spark):
    rows = table(spark, PREDICTORS)
    alone = models.all_predictions(rows, PLAN)
    beside(monkeypatch)
    found = models.all_predictions(rows, PLAN)
    assert sorted(found.collect()) == sorted(alone.collect())
    # Whatever is counted from them.
    for of in (models.confusion, models.label_totals):
        assert sorted(of(found).collect()) == sorted(of(alone).collect())


def test_label_totals_of_both_models(monkeypatch, spark):
    """Every test row once a point, with the ones that no model can score."""
    rows = table(spark, PREDICTORS).withColumn(
        PREDICTORS[0], F.when(F.col("gameID").rlike("[1-4]$"), F.col(PREDICTORS[0])))
    beside(monkeypatch)
    totals = models.label_totals(models.all_predictions(rows, PLAN)).collect()
    want = {r.label: r["count"] for r in models.split_rows(rows).filter("NOT in_train").groupBy(
        F.col("default").alias("label")).count().collect()}
    points = {(r.model, r.setting, r.trees) for r in totals}
    assert len(points) == 3 and len(totals) == 3 * len(want)
    assert all(r.n == want[r.label] for r in totals)
