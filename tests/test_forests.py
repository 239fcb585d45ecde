"""Forests grown in batches, and the long table of predictions."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions.constants import PREDICTORS
from touchline.operators import classify, forests
from touchline.operators.boosting import Setting
from touchline.plans import models


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(f"G{i}", "t", "true", "d", i % 3, float(i % 3 + rng.normal() * 0.3), float(rng.normal()))
            for i in range(60)]
    df = spark.createDataFrame(rows, "gameID string, teamName string, playByUs string, "
                                     "gameDate string, default int, x double, y double")
    return classify.as_vectors(df, ["x", "y"]).cache()


def files(folder):
    return sorted((os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns)
                  for d, _, names in os.walk(folder) for f in names if not f.startswith("."))


def test_batches_add_up_and_are_kept(spark, vectors, tmp_path):
    folder = str(tmp_path / "forest")

    def grow(trees):
        return {(r.gameID, r.mtry): r for r in forests.grow_forests(
            vectors, vectors, ["gameID"], folder, (1, 2), trees, 4, 5, ["x", "y"]).collect()}

    first = grow(8)
    assert len(first) == 120 and all(r.trees == 8 and abs(sum(r.p) - 1) < 1e-9 for r in first.values())
    before = files(folder)
    assert grow(8) == first and files(folder) == before
    # A batch that did not get to its end is grown again, to the same votes.
    os.remove(f"{folder}/mtry=2/batch=4/votes/_SUCCESS")
    again = grow(8)
    assert all(np.allclose(again[k].p, first[k].p) for k in first)
    more = grow(12)
    assert all(r.trees == 12 for r in more.values()) and set(files(folder)) > set(
        f for f in before if "mtry=1" in f[0])
    shares = forests.importances(spark, folder, (1, 2), 12, 4)
    assert {(m, p) for m, p, _ in shares} == {(m, p) for m in (1, 2) for p in ("x", "y")}
    by = {(m, p): v for m, p, v in shares}
    assert by[2, "x"] > by[2, "y"] and abs(by[1, "x"] + by[1, "y"] - 1) < 1e-9


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(9)
    names = ", ".join(f"{p} double" for p in PREDICTORS)
    rows = []
    for i in range(90):
        x = rng.normal(size=len(PREDICTORS)) + (i % 3)
        rows.append((f"G{i}", "t", "true", "d", i % 3, *map(float, x[:-1]),
                     None if i % 30 == 7 else float(x[-1])))
    return spark.createDataFrame(
        rows, f"gameID string, teamName string, playByUs string, gameDate string, default int, {names}")


PLAN = models.Plan(settings=(Setting(2, 3),), boosted_trees=(1, 3), mtry=(2, 6), forest_trees=6,
                   forest_batch=3, folds=3, repeats=2)


def test_one_table_for_all_models(labelled):
    split = models.split_rows(labelled)
    test = split.filter("NOT in_train").count()
    found = models.all_predictions(labelled, PLAN)
    assert found.columns == models.PREDICTED
    assert [r["count"] for r in found.groupBy("model", "setting", "trees").count().collect()] == [test] * 4
    scored = found.filter("reason IS NULL").collect()
    for r in scored:
        p = [r.p_loss, r.p_draw, r.p_win]
        assert abs(sum(p) - 1) < 1e-9 and r.predicted == int(np.argmax(p))
    assert np.mean([r.predicted == r.label for r in scored]) > 0.6
    left = test - split.filter("NOT in_train AND complete").count()
    assert found.filter("predicted IS NULL AND reason = 'incomplete features'").count() == 4 * left
    totals = models.label_totals(found).groupBy("model", "setting", "trees").agg(F.sum("n").alias("n"))
    assert [r.n for r in totals.collect()] == [test] * 4
    cells = models.confusion(found).agg(F.sum("cnt")).first()[0]
    assert cells == len(scored)


def test_out_of_fold_table(labelled):
    train = models.split_rows(labelled).filter("in_train AND complete").count()
    out = models.cv_predictions(labelled, PLAN)
    counts = out.groupBy("repeat", "trees").count().collect()
    assert sorted((r["repeat"], r.trees, r["count"]) for r in counts) == [
        (r, t, train) for r in (0, 1) for t in (1, 3)]
    assert out.select("repeat", "trees", "gameID").distinct().count() == out.count()
