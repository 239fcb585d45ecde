"""Exact nearest neighbours on unit rows, without comparing all pairs.

Rows are cut into blocks by a space partition: about the square root of their number
of centres, each row with its nearest one.  A block is known by its centre, radius
and size (a table of as many rows as blocks, which is broadcast).  For a row, blocks
in the order of the farthest that a member can be bound how far its k nearest are;
only blocks whose nearest possible member is not farther are searched, the others
cannot have any of the k.  A block that many rows share is searched in parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.slices import stage

#: Members of a block that one task searches at once.
PART_ROWS = 4096
#: Rounding that a bound must not trip over; distances are ordered to as many digits.
SLACK, DIGITS = 1e-9, 9


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    """The frame with ids as plain objects, which convert alike in any number."""
    return frame.astype({c: object for c in ("team_id", "other_id") if c in frame})


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between the rows of two matrices."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0.0))


def partitioned(rows: DataFrame, blocks: int) -> tuple[DataFrame, pd.DataFrame]:
    """The rows with their block and part of it; and a row for each block: centre,
    radius, size."""
    picked = rows.orderBy(F.xxhash64("team_id"), "team_id").limit(blocks).collect()
    centres = np.array([r["u"] for r in picked], dtype=float)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                gaps = _gaps(_matrix(part["u"]), centres)
                yield _plain(part.assign(block=gaps.argmin(1), gap=gaps.min(1)))

    placed = stage(rows.mapInPandas(place, "team_id string, u array<double>, block int, gap double"))
    stats = placed.groupBy("block").agg(
        F.max("gap").alias("radius"), F.count(F.lit(1)).alias("size")).toPandas()
    stats["centre"] = [centres[b] for b in stats["block"]]
    parts = placed.sparkSession.createDataFrame(
        [(int(b), -(-int(n) // PART_ROWS)) for b, n in zip(stats["block"], stats["size"])],
        "block int, parts int")
    cut = F.pmod(F.xxhash64("team_id"), F.col("parts")).cast("int")
    return placed.join(F.broadcast(parts), "block").withColumn("part", cut), stats


def nearest(rows: DataFrame, k: int = 5, blocks: int | None = None) -> DataFrame:
    """team_id, rank, other_id, distance: the ``k`` other rows (team_id, u) with the
    least cosine distance, ties by id."""
    rows = stage(rows.select("team_id", "u"))
    n = rows.count()
    out = "team_id string, other_id string, distance double"
    if n < 2:
        return rows.sparkSession.createDataFrame(
            [], "team_id string, rank int, other_id string, distance double")
    placed, stats = partitioned(rows, blocks or math.isqrt(n - 1) + 1)
    number = stats["block"].to_numpy()
    centres, radius = np.stack(stats["centre"].to_list()), stats["radius"].to_numpy()
    size = stats["size"].to_numpy()
    parts = -(-size // PART_ROWS)

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each part of a block that may have one of the nearest."""
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                gaps = _gaps(_matrix(part["u"]), centres)
                order = np.argsort(gaps + radius, axis=1)
                enough = np.cumsum(size[order], axis=1) >= min(k + 1, n)
                last = np.take_along_axis(order, enough.argmax(1)[:, None], axis=1)
                bound = np.take_along_axis(gaps + radius, last, axis=1)
                row, block = np.nonzero(gaps - radius <= bound + SLACK)
                times = parts[block]
                row, block = np.repeat(row, times), np.repeat(block, times)
                which = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                yield _plain(pd.DataFrame({
                    "team_id": part["team_id"].to_numpy()[row], "u": part["u"].to_numpy()[row],
                    "block": number[block], "part": which}))

    def compare(wanted: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted) or not len(members):
            return _plain(pd.DataFrame([], columns=["team_id", "other_id", "distance"]))
        ids, y = members["team_id"].to_numpy(), _matrix(members["u"])
        by_id = np.argsort(ids, kind="stable")
        ids, y = ids[by_id], y[by_id]
        found = []
        for at in range(0, len(wanted), 256):
            some = wanted.iloc[at:at + 256]
            gaps = np.round(1.0 - _matrix(some["u"]) @ y.T, DIGITS)
            gaps[some["team_id"].to_numpy()[:, None] == ids[None]] = np.inf
            for name, row in zip(some["team_id"], gaps):
                found += [(name, ids[j], row[j]) for j in np.argsort(row, kind="stable")[:k]
                          if np.isfinite(row[j])]
        return _plain(pd.DataFrame(found, columns=["team_id", "other_id", "distance"]))

    wanted = placed.select("team_id", "u").mapInPandas(
        searched, "team_id string, u array<double>, block int, part int")
    pairs = (wanted.groupBy("block", "part")
             .cogroup(placed.select("team_id", "u", "block", "part").groupBy("block", "part"))
             .applyInPandas(compare, out))
    best = pairs.groupBy("team_id").agg(F.slice(F.array_sort(F.collect_list(
        F.struct("distance", "other_id"))), 1, k).alias("best"))
    return best.select("team_id", F.posexplode("best").alias("at", "b")).select(
        "team_id", (F.col("at") + 1).alias("rank"), "b.other_id", "b.distance")
