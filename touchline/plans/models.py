"""Match-result models: one long table of predictions for all of them.

Every model (boosted trees, forests) gives a row for each test row and point of its
grid; confusion, most likely result and accuracy are aggregates of that one table.
Rows that cannot be scored are listed with a reason.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import boosting, classify, forests
from touchline.operators.boosting import Setting
from touchline.operators.slices import side_by_side, stage, workspace

ROW = [*classify.ROW_ID, "label"]
CHANCES = [f"p_{c}" for c in classify.CLASSES]
PREDICTED = ["model", "setting", "trees", *ROW, *CHANCES, "predicted", "reason"]


@dataclass(frozen=True)
class Plan:
    """What is fitted; the defaults are the published grids."""

    settings: tuple[Setting, ...] = boosting.GRID
    boosted_trees: tuple[int, ...] = boosting.TREES
    mtry: tuple[int, ...] = forests.MTRY
    forest_trees: int = forests.TREES
    forest_batch: int = forests.BATCH
    folds: int = 5
    repeats: int = 3


def split_rows(labelled: DataFrame) -> DataFrame:
    """The labelled rows with the split, a vector of features, a class and whether
    they are complete; written once, read by all models."""
    return stage(classify.as_vectors(classify.stratified_split(labelled)))


def _test_rows(split: DataFrame) -> DataFrame:
    return split.filter("NOT in_train").withColumn("label", F.col("label").cast("int"))


def _train_rows(split: DataFrame) -> DataFrame:
    return split.filter("in_train AND complete")


def boosted(split: DataFrame, plan: Plan, with_folds: bool = False) -> boosting.Boosted:
    """All settings on the training rows, and without each fold if wanted."""
    folds, repeats = (plan.folds, plan.repeats) if with_folds else (0, 0)
    train = _train_rows(split)
    if with_folds:
        train = boosting.fold_numbers(train, folds=folds, repeats=repeats)
    return boosting.fit_boosted(train, boosting.all_fits(plan.settings, folds, repeats),
                                max(plan.boosted_trees))


def boosted_predictions(split: DataFrame, model: boosting.Boosted,
                        trees: Sequence[int]) -> DataFrame:
    rows = boosting.scored(model, _test_rows(split).filter("complete"), ROW, trees)
    setting = F.concat_ws(" ", F.lit("depth"), "depth", F.lit("leaf"), "min_leaf")
    return rows.select(F.lit("boosted").alias("model"), setting.alias("setting"), "trees", *ROW,
                       *CHANCES, "predicted", F.lit(None).cast("string").alias("reason"))


def forest_predictions(split: DataFrame, plan: Plan, folder: str) -> DataFrame:
    found = forests.grow_forests(_train_rows(split), _test_rows(split).filter("complete"), ROW,
                                 folder, plan.mtry, plan.forest_trees, plan.forest_batch)
    chances = found.withColumns({c: F.col("p")[i] for i, c in enumerate(CHANCES)})
    return chances.select(
        F.lit("forest").alias("model"), F.concat_ws(" ", F.lit("mtry"), "mtry").alias("setting"),
        "trees", *ROW, *CHANCES, boosting.likely(*CHANCES).alias("predicted"),
        F.lit(None).cast("string").alias("reason"))


def with_left_out(predicted: DataFrame, split: DataFrame) -> DataFrame:
    """Also the test rows without complete features, for each model and point."""
    points = predicted.select("model", "setting", "trees").distinct()
    left_out = _test_rows(split).filter("NOT complete").select(*ROW)
    # A few points, each a constant of a query.
    for p in sorted(points.collect()):
        predicted = predicted.unionByName(left_out.select(
            F.lit(p.model).alias("model"), F.lit(p.setting).alias("setting"),
            F.lit(p.trees).alias("trees"), *ROW,
            F.lit("incomplete features").alias("reason")), allowMissingColumns=True)
    return predicted.select(*PREDICTED)


def all_predictions(labelled: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The long table of both models (staged)."""
    split = split_rows(labelled)
    folder = f"{workspace(split.sparkSession)}/forests-{uuid.uuid4().hex}"
    model, forest = side_by_side(split.sparkSession, [
        lambda: boosted(split, plan), lambda: forest_predictions(split, plan, folder)], 2)
    boost = boosted_predictions(split, model, plan.boosted_trees)
    both = stage(boost.unionByName(forest))
    return stage(with_left_out(both, split))


def confusion(predicted: DataFrame) -> DataFrame:
    """How often each class was predicted for each label, by model and point."""
    return predicted.filter("reason IS NULL").groupBy(
        "model", "setting", "trees", "predicted", "label").agg(F.count(F.lit(1)).alias("cnt"))


def label_totals(predicted: DataFrame) -> DataFrame:
    """Test rows of each label, by model and point: scored ones from the confusion
    counts, and the others."""
    counts = confusion(predicted).groupBy("model", "setting", "trees", "label").agg(
        F.sum("cnt").alias("n"))
    other = predicted.filter("reason IS NOT NULL").groupBy(
        "model", "setting", "trees", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(other).groupBy("model", "setting", "trees", "label").agg(
        F.sum("n").alias("n"))


def cv_predictions(labelled: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Every complete training row once a repeat and grid point, scored by the fit
    that did not see it."""
    split = split_rows(labelled)
    train = stage(boosting.fold_numbers(_train_rows(split), folds=plan.folds, repeats=plan.repeats))
    model = boosting.fit_boosted(
        train, boosting.all_fits(plan.settings, plan.folds, plan.repeats), max(plan.boosted_trees))
    rows = train.withColumn("label", F.col("label").cast("int"))
    return boosting.out_of_fold(model, rows, plan.boosted_trees, plan.repeats, ROW)


def importance(labelled: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """model, setting, predictor, importance: gain shares (boosted), mean decrease of
    impurity (forest)."""
    split = split_rows(labelled)
    spark = split.sparkSession
    folder = f"{workspace(spark)}/forests-{uuid.uuid4().hex}"
    model, _ = side_by_side(spark, [lambda: boosted(split, plan), lambda: forests.grow_forests(
        _train_rows(split), _test_rows(split).filter("complete"), ROW, folder, plan.mtry,
        plan.forest_trees, plan.forest_batch)], 2)
    rows = [("boosted", f"depth {d} leaf {m}", p, v) for d, m, p, v in boosting.importance(model)]
    rows += [("forest", f"mtry {m}", p, v) for m, p, v in forests.importances(
        spark, folder, plan.mtry, plan.forest_trees, plan.forest_batch)]
    return spark.createDataFrame(
        rows, "model string, setting string, predictor string, importance double")


def cv_folds(labelled: DataFrame, folds: int = 5, repeats: int = 3) -> DataFrame:
    """The row's fold in each repeat (long), for every labelled row."""
    dealt = boosting.fold_numbers(labelled, folds=folds, repeats=repeats)
    return dealt.select(*classify.ROW_ID, "default", F.posexplode("folds").alias("repeat", "fold"))


