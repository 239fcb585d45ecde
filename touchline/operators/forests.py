"""Random forests as mergeable ensembles.

A forest of many trees is grown in batches with a seed each.  A batch's votes (the
sum over its trees of the shares of each class in the leaf) for all rows to be scored
are written to the shared folder as soon as it is done; votes of batches simply add
up.  So a forest that stops, or loses its executors, goes on with the batches that are
missing, and a larger forest keeps the smaller one's.

A level of a forest is a job or a few, mostly too small for all cores, so small batches
grow side by side.  The node that each row has come to is kept with the rows: the open
trees, as large as all nodes so far, are neither sent out nor walked down for each level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import partial

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.constants import PREDICTORS
from touchline.operators.classify import CLASSES
from touchline.operators.slices import side_by_side

TREES, BATCH = 2000, 500
#: Rows times trees of the batches that may grow at the same time, as the driver holds
#: their nodes (a single batch may have more).
AT_ONCE = 1 << 17
MTRY = (2, 6, 10, 14, 18)
#: The deepest that Spark's trees get; leaves are pure long before.
DEPTH = 30


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def batch_seed(mtry: int, batch: int) -> int:
    return int.from_bytes(hashlib.md5(f"{mtry}|{batch}".encode()).digest()[:4], "big")


def grow_batch(train: DataFrame, rows: DataFrame, keep: Sequence[str], path: str, mtry: int,
               batch: int, trees: int, depth: int, predictors: Sequence[str]) -> None:
    """Write a batch's votes for ``rows`` and its importances, unless they are there."""
    spark = rows.sparkSession
    if is_written(spark, f"{path}/importance") and is_written(spark, f"{path}/votes"):
        return
    model = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy=str(mtry),
        seed=batch_seed(mtry, batch), cacheNodeIds=True).fit(train)
    votes = model.transform(rows).select(
        *keep, F.lit(trees).alias("trees"), vector_to_array("rawPrediction").alias("votes"))
    votes.write.mode("overwrite").parquet(f"{path}/votes")
    shares = model.featureImportances.toArray()
    spark.createDataFrame(
        [(p, float(v) * trees) for p, v in zip(predictors, shares)],
        "predictor string, importance double").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/importance")


def grow_forests(train: DataFrame, rows: DataFrame, keep: Sequence[str], folder: str,
                 mtry: Sequence[int] = MTRY, trees: int = TREES, batch: int = BATCH,
                 depth: int = DEPTH, predictors: Sequence[str] = PREDICTORS) -> DataFrame:
    """``keep``, mtry, trees, p (chances of the classes): the merged votes.

    ``train`` and ``rows`` have feature vectors (see ``classify.as_vectors``) of
    complete rows.  Calling it again with the same folder grows what is missing.
    """
    spark = rows.sparkSession
    batches = [(m, b, f"{folder}/mtry={m}/batch={b}") for m in mtry for b in range(0, trees, batch)]
    most = AT_ONCE // max(1, train.count() * min(batch, trees))
    side_by_side(spark, [partial(grow_batch, train, rows, keep, path, m, b, min(batch, trees - b),
                                 depth, predictors) for m, b, path in batches], most)
    out = None
    for m, _, path in batches:
        part = spark.read.parquet(f"{path}/votes").withColumn("mtry", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return merged(out, keep)


def merged(votes: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Votes of batches added up, as chances."""
    sums = [F.sum(F.col("votes")[i]) for i in range(len(CLASSES))]
    whole = F.sum("trees")
    return votes.groupBy(*keep, "mtry").agg(
        whole.cast("int").alias("trees"), F.array(*[s / whole for s in sums]).alias("p"))


def importances(spark: SparkSession, folder: str, mtry: Sequence[int], trees: int,
                batch: int) -> list[tuple[int, str, float]]:
    """mtry, predictor, mean importance over all trees of its batches."""
    out = []
    for m in mtry:
        parts = [spark.read.parquet(f"{folder}/mtry={m}/batch={b}/importance")
                 for b in range(0, trees, batch)]
        rows = [r for part in parts for r in part.collect()]  # one row a predictor and batch
        for p in dict.fromkeys(r.predictor for r in rows):
            out.append((m, p, float(np.sum([r.importance for r in rows if r.predictor == p]) / trees)))
    return out
