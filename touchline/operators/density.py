"""Kernel density of event positions on a pitch grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.constants import PITCH_LENGTH, PITCH_WIDTH

#: Default smoothing: an eighth of the shorter side of the window.
BANDWIDTH = PITCH_WIDTH / 8


def _kernel(at: Column, extent: float, cells: int, bandwidth: float) -> Column:
    """Gaussian mass of one point in each cell along one axis."""
    size = extent / cells
    centres = F.array(*[F.lit((i + 0.5) * size) for i in range(cells)])
    scale = size / (bandwidth * (2 * 3.141592653589793) ** 0.5)

    def mass(centre: Column) -> Column:
        z = (at - centre) / bandwidth
        return F.exp(-0.5 * z * z) * scale

    return F.transform(centres, mass)


def _added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def density_grid(
    points: DataFrame,
    columns: int = 22,
    rows: int = 15,
    bandwidth: float = BANDWIDTH,
) -> DataFrame:
    """Edge-corrected Gaussian density per square metre at each cell centre.

    Each point is weighted by one over the part of its kernel that falls on
    the pitch.  The kernel is a product of one term per axis, so a point is
    expanded over the grid columns only and the grid rows are sums in the same
    pass: points are never joined with the grid, the sums combine map-side,
    and the shuffle carries at most ``columns`` rows per task.
    """
    cell = (PITCH_LENGTH / columns) * (PITCH_WIDTH / rows)
    x, y = F.col("lengthMetres"), F.col("widthMetres")
    placed = points.filter(x.between(0, PITCH_LENGTH) & y.between(0, PITCH_WIDTH)).select(
        _kernel(x, PITCH_LENGTH, columns, bandwidth).alias("across"),
        _kernel(y, PITCH_WIDTH, rows, bandwidth).alias("down"),
    )
    weighted = placed.withColumn(
        "weight", 1 / (_added(F.col("across")) * _added(F.col("down"))))
    sums = (
        weighted.select(F.posexplode("across").alias("gx", "mass"), "down", "weight")
        .groupBy("gx")
        .agg(*[F.sum(F.col("weight") * F.col("mass") * F.col("down")[j]).alias(f"row_{j}")
               for j in range(rows)])
    )
    cells = F.array(*[F.col(f"row_{j}") for j in range(rows)])
    return sums.select("gx", F.posexplode(cells).alias("gy", "mass")).select(
        "gx", "gy",
        ((F.col("gx") + 0.5) * (PITCH_LENGTH / columns)).alias("x"),
        ((F.col("gy") + 0.5) * (PITCH_WIDTH / rows)).alias("y"),
        (F.col("mass") / cell).alias("density"),
    )
