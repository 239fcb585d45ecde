"""Match-result classifiers on match-feature shares."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.ml.classification import (
    GBTClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.constants import PREDICTORS
from touchline.operators.slices import stage

ROW_ID = ["gameID", "teamName", "playByUs", "gameDate"]
CLASSES = ["loss", "draw", "win"]


# --------------------------------------------------------------------------
# stratified split
# --------------------------------------------------------------------------
def stratified_split(
    df: DataFrame, label: str = "default", ids: Sequence[str] = tuple(ROW_ID),
    fraction: float = 0.8, seed: int = 7, bucket_digits: int = 3,
) -> DataFrame:
    """Exact per-label split, as a boolean ``in_train`` column.

    Rows are drawn in the order of a seeded hash of their id.  A label may hold
    most of the table, so a row's rank is its rank inside one of 16^digits hash
    buckets plus the counts of the earlier buckets.
    """
    keyed = df.withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), *ids)))
    # Read twice: by the rows and by the bucket counts.
    keyed = stage(keyed.withColumn("bucket", F.substring("draw", 1, bucket_digits)))
    group = Window.partitionBy(label)
    earlier = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(label, "bucket").agg(F.count(F.lit(1)).alias("_rows")).select(
        label, "bucket",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(group).alias("_all"))
    nth = F.row_number().over(Window.partitionBy(label, "bucket").orderBy("draw"))
    wanted = F.ceil(F.round(F.col("_all") * fraction, 9))
    return (keyed.withColumn("_nth", nth).join(counts, [label, "bucket"])
            .withColumn("in_train", F.col("_before") + F.col("_nth") <= wanted)
            .drop("draw", "bucket", "_nth", "_before", "_all"))


def as_vectors(labelled: DataFrame, predictors: Sequence[str] = PREDICTORS) -> DataFrame:
    """Rows with a feature vector, a numeric label, and whether they are complete
    (a model can only be fitted on, and only score, complete rows)."""
    assembler = VectorAssembler(
        inputCols=list(predictors), outputCol="features", handleInvalid="keep")
    known = [F.col(c).isNotNull() & ~F.isnan(c) for c in predictors]
    return assembler.transform(labelled).withColumns({
        "label": F.col("default").cast("double"),
        "complete": reduce(lambda a, b: a & b, known)})


# --------------------------------------------------------------------------
# models
# --------------------------------------------------------------------------
@dataclass
class Tuned:
    """A model refitted on all training rows with the best settings found."""

    model: Any
    accuracy: float
    grid_accuracy: list[float] = field(default_factory=list)


def repeated_cv(
    estimator, grid: list[dict], train: DataFrame, folds: int = 5, repeats: int = 3,
    parallelism: int = 4,
) -> Tuned:
    """Repeated k-fold search over the complete rows, and a fit on all of them."""
    if "complete" in train.columns:
        train = train.filter("complete")
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy")
    scores = np.zeros(len(grid))
    for seed in range(repeats):
        search = CrossValidator(
            estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator,
            numFolds=folds, seed=seed, parallelism=parallelism)
        scores += np.asarray(search.fit(train).avgMetrics) / repeats
    best = int(scores.argmax())
    return Tuned(estimator.fit(train, grid[best]), float(scores[best]), list(scores))


def random_forest(
    train: DataFrame, trees: int = 2000, mtry: Sequence[int] = (2, 6, 10, 14, 18),
    depth: int = 30, folds: int = 5, repeats: int = 3,
) -> Tuned:
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=1)
    grid = ParamGridBuilder().addGrid(
        forest.featureSubsetStrategy, [str(m) for m in mtry]).build()
    return repeated_cv(forest, grid, train, folds, repeats)


def _boosted_grid(boost: GBTClassifier, points: list[dict]) -> tuple[OneVsRest, list[dict]]:
    """A one-vs-rest estimator and one parameter map per grid point."""
    versus = OneVsRest(classifier=boost, parallelism=3)
    maps = []
    for point in points:
        one = boost.copy({boost.getParam(n): v for n, v in point.items()})
        maps.append({versus.classifier: one})
    return versus, maps


def gradient_boosting(
    train: DataFrame, trees: Sequence[int] = (500, 1000, 1500, 2000),
    depths: Sequence[int] = (5, 10), min_leaf: Sequence[int] = (5, 10),
    shrinkage: float = 0.1, folds: int = 5, repeats: int = 3,
) -> Tuned:
    boost = GBTClassifier(stepSize=shrinkage, seed=1)
    points = [{"maxIter": t, "maxDepth": d, "minInstancesPerNode": m}
              for t in trees for d in depths for m in min_leaf]
    versus, maps = _boosted_grid(boost, points)
    return repeated_cv(versus, maps, train, folds, repeats)


def boosted_random_search(
    train: DataFrame, tries: int = 9, trees: Sequence[int] = (50, 150),
    folds: int = 5, repeats: int = 3, seed: int = 1,
) -> Tuned:
    """Boosted trees with settings drawn at random from their usual ranges."""
    draw = random.Random(seed)
    points = [{
        "maxIter": draw.randint(*trees),
        "maxDepth": draw.randint(1, 6),
        "stepSize": round(draw.uniform(0.05, 0.6), 3),
        "subsamplingRate": round(draw.uniform(0.5, 1.0), 2),
        "minInstancesPerNode": draw.randint(1, 20),
    } for _ in range(tries)]
    versus, maps = _boosted_grid(GBTClassifier(seed=1), points)
    return repeated_cv(versus, maps, train, folds, repeats)


# --------------------------------------------------------------------------
# results
# --------------------------------------------------------------------------
def _class_scores(scored: DataFrame) -> Column:
    """Class probabilities; boosted one-vs-rest margins are normalised."""
    if "probability" in scored.columns:
        return vector_to_array("probability")
    chance = F.transform(vector_to_array("rawPrediction"),
                         lambda margin: 1 / (1 + F.exp(-2 * margin)))
    total = F.aggregate(chance, F.lit(0.0), lambda t, v: t + v)
    return F.transform(chance, lambda v: v / total)


def predictions(tuned: Tuned, rows: DataFrame) -> DataFrame:
    """Probability of each result and the most likely one.

    Every row is returned; ``reason`` tells why one has no prediction.
    """
    left_out = None
    if "complete" in rows.columns:
        left_out, rows = rows.filter("NOT complete"), rows.filter("complete")
    scored = tuned.model.transform(rows)
    scored = scored.withColumn("p", _class_scores(scored))
    likely = F.array_position("p", F.array_max("p")) - 1
    out = scored.select(
        *ROW_ID, F.col("label").cast("int").alias("label"),
        *[F.col("p")[i].alias(f"p_{c}") for i, c in enumerate(CLASSES)],
        likely.cast("int").alias("predicted"), F.lit(None).cast("string").alias("reason"))
    if left_out is None:
        return out
    return out.unionByName(left_out.select(
        *ROW_ID, F.col("label").cast("int").alias("label"),
        F.lit("incomplete features").alias("reason")), allowMissingColumns=True)


def confusion_matrix(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("predicted", "label").agg(F.count(F.lit(1)).alias("cnt"))


def importance(tuned: Tuned, rows: DataFrame,
               predictors: Sequence[str] = PREDICTORS) -> DataFrame:
    """Importance per predictor (mean over the sub-models of one-vs-rest)."""
    parts = getattr(tuned.model, "models", [tuned.model])
    mean = np.mean([m.featureImportances.toArray() for m in parts], axis=0)
    return rows.sparkSession.createDataFrame(
        [(n, float(v)) for n, v in zip(predictors, mean)],
        "predictor string, importance double")


def label_correlation(labelled: DataFrame,
                      predictors: Sequence[str] = PREDICTORS) -> DataFrame:
    """Pearson correlation of the label with each predictor, complete rows.

    A predictor that never varies has no correlation (NULL).
    """
    complete = labelled.dropna(subset=list(predictors))

    def pearson(column: str) -> Column:
        spread = F.stddev_pop("default") * F.stddev_pop(column)
        return F.try_divide(F.covar_pop("default", column), spread)

    wide = complete.agg(*[pearson(c).alias(c) for c in predictors])
    return wide.unpivot([], list(predictors), "predictor", "correlation")
