"""Team profiles as vectors: scaling, cosine distance, PCA, k-means, Ward.

The n x n distance matrix is never built.  On unit rows u the cosine distance
is half a squared Euclidean distance, which lets the two clusterings run on
n x p data (p = 25 features):

* k-means on the *rows* of the distance matrix D: since D_ik = 1 - u_i.u_k,
  ``|D_i - D_j|^2 = (u_i - u_j)' G (u_i - u_j)`` with the p x p Gram matrix G,
  so it is k-means on ``u_i R`` with ``R R' = G``;
* Ward merging on D: the dissimilarity of two clusters has the closed form
  ``ab/(a+b) |c_A - c_B|^2`` in their sizes and centroids.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.constants import (
    BOYS_14, CLUSTER_FEATURES, GIRLS_16, TOP_FLIGHT,
)
from touchline.operators.slices import number_rows, stage, stage_at, unstage

FEATURES = list(CLUSTER_FEATURES)
#: Clusters in a block of the Ward search; a task compares two blocks.
BLOCK_ROWS = 1024
#: Ward compares all pairs of clusters in each round, so it is for up to so many.
TEAM_LIMIT = 100_000


def chosen_teams(
    profile: DataFrame, competitions: Sequence[str] | None = None
) -> DataFrame:
    """Complete profiles of the wanted competitions, with a team id."""
    df = profile if competitions is None else profile.filter(
        F.col("competition").isin(list(competitions)))
    team_id = F.concat_ws("|", "competition", "teamName", "playByUs")
    return df.withColumn("team_id", team_id).select(
        "team_id", "competition", "teamName", "playByUs", "age_group", *FEATURES
    ).dropna(subset=FEATURES)


def dashboard_ids(profile: DataFrame, include_top_flight: bool = True) -> DataFrame:
    """All the wanted teams, also those without a complete profile."""
    wanted = [GIRLS_16, *TOP_FLIGHT] if include_top_flight else [GIRLS_16]
    return profile.filter(F.col("competition").isin(wanted)).select(
        F.concat_ws("|", "competition", "teamName", "playByUs").alias("team_id"),
        "competition", "teamName", "playByUs")


def with_reason(ids: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every id with its cluster, or why it has none."""
    known = clusters.withColumn("scored", F.lit(True))
    return ids.join(known, "team_id", "left").select(
        "team_id", "cluster",
        F.when(F.col("scored").isNull(), "incomplete profile")
        .when(F.col("cluster").isNull(), "average in every feature").alias("reason"))


def dashboard_teams(profile: DataFrame, include_top_flight: bool = True) -> DataFrame:
    wanted = [GIRLS_16, *TOP_FLIGHT] if include_top_flight else [GIRLS_16]
    return chosen_teams(profile, wanted)


def display_names(teams: DataFrame) -> DataFrame:
    return teams.withColumnsRenamed(CLUSTER_FEATURES)


# --------------------------------------------------------------------------
# scaling and cosine distance
# --------------------------------------------------------------------------
def scaled_long(teams: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Standardised features in long form: one row per team and feature.

    Mean and deviation are one row per feature, so that side of the join has
    a fixed, known size.  A constant feature scales to 0.
    """
    long = teams.unpivot(["team_id"], list(features), "feature", "v")
    stats = long.groupBy("feature").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    z = F.when(F.col("sd") == 0, 0.0).otherwise(
        F.try_divide(F.col("v") - F.col("mean"), F.col("sd")))
    return long.join(F.broadcast(stats), "feature").select(
        "team_id", "feature", z.alias("z"))


def cosine_from(scaled: DataFrame, team_id: str) -> DataFrame:
    """Cosine distance of every team to one team: a row of the matrix."""
    anchor = scaled.filter(F.col("team_id") == team_id).select(
        "feature", F.col("z").alias("a"))
    sums = scaled.join(F.broadcast(anchor), "feature").groupBy("team_id").agg(
        F.sum(F.col("z") * F.col("a")).alias("dot"),
        F.sum(F.col("z") * F.col("z")).alias("own"),
        F.sum(F.col("a") * F.col("a")).alias("other"),
    )
    similarity = F.try_divide(F.col("dot"), F.sqrt("own") * F.sqrt("other"))
    return sums.select("team_id", F.lit(team_id).alias("other_id"),
                       (1 - similarity).alias("distance"))


def scaled_vectors(teams: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    return standardised(VectorAssembler(
        inputCols=list(features), outputCol="raw", handleInvalid="skip").transform(teams))


def standardised(assembled: DataFrame) -> DataFrame:
    """Centred ``raw`` vectors over their sample deviation, as ``scaled``."""
    scaler = StandardScaler(
        inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
    return scaler.fit(assembled).transform(assembled).drop("raw")


# --------------------------------------------------------------------------
# principal components
# --------------------------------------------------------------------------
def principal_components(scaled: DataFrame, k: int = 2):
    return PCA(k=k, inputCol="scaled", outputCol="components").fit(scaled)


def _signs(loadings: np.ndarray) -> np.ndarray:
    """Make the largest loading of each component positive."""
    top = np.abs(loadings).argmax(axis=0)
    return np.sign(loadings[top, range(loadings.shape[1])])


def variable_coordinates(
    scaled: DataFrame, features: Sequence[str] = FEATURES, top: int = 20
) -> DataFrame:
    """Features by squared length on the first two components.

    The frame has one row per feature, whatever the number of teams.
    """
    model = principal_components(scaled)
    loadings = model.pc.toArray()
    loadings = loadings * _signs(loadings)
    # Total variance: 1 for each feature, but 0 for one that never varies.
    at = vector_to_array("scaled")
    varying = scaled.agg(*[F.max(F.abs(at[i])).alias(f"m{i}") for i in range(len(features))])
    total = sum(bool(m) for m in varying.first())
    spread = np.sqrt(np.asarray(model.explainedVariance) * total)
    coords = loadings * spread
    spark = scaled.sparkSession
    rows = [(name, float(x), float(y)) for name, (x, y) in zip(features, coords)]
    df = spark.createDataFrame(rows, "variable string, pca_1 double, pca_2 double")
    df = df.withColumn("distance", F.col("pca_1") ** 2 + F.col("pca_2") ** 2)
    rank = F.row_number().over(Window.orderBy(F.desc("distance"), "variable"))
    return df.withColumn("ranking", rank).filter(F.col("ranking") <= top)


def spectrum(scaled: DataFrame, size: int = len(FEATURES)) -> DataFrame:
    """All components: eigenvalue, share and running share of the variance.

    The correlation matrix is one aggregate over the teams (size x size sums, however
    many there are); a feature that never varies adds nothing.
    """
    z = scaled.select(vector_to_array("scaled").alias("z"))
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    n, *sums = z.agg(F.count(F.lit(1)), *[
        F.sum(F.col("z")[i] * F.col("z")[j]) for i, j in cells]).first()
    matrix = np.zeros((size, size))
    for (i, j), value in zip(cells, sums):
        matrix[i, j] = matrix[j, i] = (value or 0.0) / max(n - 1, 1)
    values = np.clip(np.linalg.eigvalsh(matrix)[::-1], 0.0, None)
    shares = values / (values.sum() or 1.0)
    rows = [(i + 1, float(v), float(s), float(t))
            for i, (v, s, t) in enumerate(zip(values, shares, np.cumsum(shares)))]
    return scaled.sparkSession.createDataFrame(
        rows, "component int, eigenvalue double, share double, cumulative double")


def individual_coordinates(scaled: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Teams on the first two components, with their display group.

    With ``ids`` also those of them without a place, and why.
    """
    group = (
        F.when(F.col("competition") == GIRLS_16,
               F.when(F.col("playByUs") == "true", "Us").otherwise("Opposition"))
        .when(F.col("competition") == BOYS_14, "14s")
        .otherwise("Top-Flight Teams")
    )
    names = ["team_id", "competition", "teamName", "playByUs"]
    places = on_components(scaled)
    if ids is None:
        return places.select(*names, group.alias("team_group"), "pca_1", "pca_2")
    return ids.join(places.select("team_id", "pca_1", "pca_2"), "team_id", "left").select(
        *names, group.alias("team_group"), "pca_1", "pca_2",
        F.when(F.col("pca_1").isNull(), "incomplete profile").alias("reason"))


def on_components(scaled: DataFrame) -> DataFrame:
    """Every row's place on the first two components."""
    model = principal_components(scaled)
    signs = _signs(model.pc.toArray())
    at = vector_to_array("components")
    return model.transform(scaled).withColumns({
        "pca_1": at[0] * float(signs[0]), "pca_2": at[1] * float(signs[1])})


# --------------------------------------------------------------------------
# unit rows
# --------------------------------------------------------------------------
def unit_rows(scaled: DataFrame) -> DataFrame:
    """Scaled rows divided by their length, as arrays; all-zero rows go."""
    z = vector_to_array("scaled")
    length = F.sqrt(F.aggregate(z, F.lit(0.0), lambda t, v: t + v * v))
    return (scaled.select("team_id", z.alias("z"), length.alias("length"))
            .filter(F.col("length") > 0)
            .select("team_id",
                    F.transform("z", lambda v: v / F.col("length")).alias("u")))


def gram_root(units: DataFrame, size: int) -> np.ndarray:
    """R with ``R R' = sum of u' u``; size x size, whatever the row count."""
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    sums = units.agg(*[
        F.sum(F.col("u")[i] * F.col("u")[j]).alias(f"g_{i}_{j}") for i, j in cells
    ]).first()
    gram = np.zeros((size, size))
    for (i, j), value in zip(cells, sums):
        gram[i, j] = gram[j, i] = value
    values, vectors = np.linalg.eigh(gram)
    return vectors * np.sqrt(np.clip(values, 0.0, None))


def _times(column: str, matrix: np.ndarray) -> Column:
    def dot(weights: np.ndarray) -> Column:
        terms = [F.col(column)[i] * float(w) for i, w in enumerate(weights)]
        return reduce(lambda a, b: a + b, terms)
    return F.array(*[dot(matrix[:, j]) for j in range(matrix.shape[1])])


# --------------------------------------------------------------------------
# k-means on distance rows
# --------------------------------------------------------------------------
def _pool(rows: DataFrame, size: int) -> np.ndarray:
    """At most ``size`` rows, in the order of a hash of their id."""
    picked = rows.orderBy(F.xxhash64("team_id"), "team_id").limit(size).collect()
    return np.array([r["features"] for r in picked], dtype=float)


def _sums(rows: DataFrame, centres: np.ndarray) -> list:
    """Rows, cost and sum of the features for each restart and cluster.

    One pass over the rows serves all restarts; a task returns one row for each
    restart and cluster.  ``centres`` has restart, cluster and feature axes.
    """
    shape = centres.shape

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, cost, total = np.zeros(shape[:2]), np.zeros(shape[:2]), np.zeros(shape)
        for batch in batches:
            for at in range(0, len(batch), 256):
                x = np.array(batch["features"].iloc[at:at + 256].tolist(), dtype=float)
                for r in range(shape[0]):
                    gap = ((x[:, None, :] - centres[r][None]) ** 2).sum(axis=2)
                    near = gap.argmin(axis=1)
                    np.add.at(n[r], near, 1)
                    np.add.at(cost[r], near, gap.min(axis=1))
                    np.add.at(total[r], near, x)
        r, c = np.indices(shape[:2])
        yield pd.DataFrame({"restart": r.ravel(), "cluster": c.ravel(), "n": n.ravel(),
                            "cost": cost.ravel(), "total": list(total.reshape(-1, shape[2]))})

    parts = rows.mapInPandas(
        work, "restart int, cluster int, n double, cost double, total array<double>")
    return parts.groupBy("restart", "cluster").agg(
        F.sum("n"), F.sum("cost"),
        F.array(*[F.sum(F.col("total")[i]) for i in range(shape[2])])).collect()


def kmeans_teams(
    scaled: DataFrame, k: int = 3, restarts: int = 100, size: int = len(FEATURES),
    iterations: int = 100,
) -> DataFrame:
    """Best of ``restarts`` k-means runs on the rows of the distance matrix.

    All restarts advance together, so an iteration is one pass over the rows,
    and the passes end when no restart moves any more.  Rows of teams without a
    direction (all features average) get no cluster.  Clusters are numbered by
    size, then cost.
    """
    units = stage(unit_rows(scaled))
    root = gram_root(units, size)
    rows = stage(units.select("team_id", _times("u", root).alias("features")))
    pool = _pool(rows, k * restarts)
    if len(pool) < k:
        raise ValueError(f"{k} clusters need at least {k} teams")
    draw = np.random.default_rng(1)
    centres = np.stack([
        pool[draw.choice(len(pool), k, replace=False)] for _ in range(restarts)])
    cost = np.zeros((restarts, k))
    number = np.zeros((restarts, k))
    for _ in range(iterations):
        new = centres.copy()
        for r, c, n, spent, total in _sums(rows, centres):
            cost[r, c], number[r, c] = spent, n
            if n:
                new[r, c] = np.asarray(total) / n
        still = np.allclose(new, centres, rtol=0, atol=1e-12)
        centres = new
        if still:
            break
    best = int(np.round(cost.sum(axis=1), 9).argmin())
    order = np.lexsort((cost[best], -number[best]))
    chosen = centres[best][order]

    def gap(centre: np.ndarray) -> Column:
        terms = [(F.col("features")[i] - float(v)) ** 2 for i, v in enumerate(centre)]
        return reduce(lambda a, b: a + b, terms)

    gaps = F.array(*[gap(c) for c in chosen])
    found = rows.withColumn("gaps", gaps).select(
        "team_id", (F.array_position("gaps", F.array_min("gaps")) - 1).cast("int").alias("cluster"))
    return scaled.select("team_id").join(found, "team_id", "left")


# --------------------------------------------------------------------------
# Ward merging
# --------------------------------------------------------------------------
def _search(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """Nearest of the other block's clusters, for each of this block's."""
    ids, sizes = others["id"].to_numpy(), others["size"].to_numpy(dtype=float)
    centres = np.array(others["centre"].tolist(), dtype=float)
    found = []
    for at in range(0, len(mine) if len(others) else 0, 64):
        part = mine.iloc[at:at + 64]
        me, n = part["id"].to_numpy(), part["size"].to_numpy(dtype=float)
        here = np.array(part["centre"].tolist(), dtype=float)
        gap = ((here[:, None, :] - centres[None]) ** 2).sum(axis=2)
        height = sizes[None] * n[:, None] / (sizes[None] + n[:, None]) * gap
        height[me[:, None] == ids[None]] = np.inf
        low = height.min(axis=1)
        # Equal heights: the pair with the smallest ids comes first.
        first = np.minimum(me[:, None], ids[None]) * (1 << 32) + np.maximum(me[:, None], ids[None])
        first[height != low[:, None]] = np.iinfo(np.int64).max
        near = first.argmin(axis=1)
        found += [(int(i), int(ids[j]), float(h)) for i, j, h in zip(me, near, low)
                  if np.isfinite(h)]
    return pd.DataFrame(found, columns=["id", "near", "height"])


def _nearest(clusters: DataFrame, last_id: int, block_rows: int) -> DataFrame:
    """Nearest other cluster of each cluster.

    Clusters are cut into blocks of ``block_rows`` ids; every pair of blocks is
    a task of its own, and the best answer of each cluster is kept.
    """
    blocks = F.sequence(F.lit(0), F.lit((last_id - 1) // block_rows))
    own = F.floor((F.col("id") - 1) / block_rows).cast("int")
    placed = clusters.withColumn("block", own).withColumn("other", F.explode(blocks))
    pairs = placed.groupBy("block", "other").cogroup(
        placed.select("id", "size", "centre", F.col("other").alias("block"),
                      F.col("block").alias("other")).groupBy("block", "other"))
    parts = pairs.applyInPandas(_search, "id long, near long, height double")
    order = F.struct("height", F.least("id", "near"), F.greatest("id", "near"))
    return (parts.groupBy("id").agg(F.min_by(F.struct("near", "height"), order).alias("best"))
            .select("id", "best.*"))


def ward_merges(
    scaled: DataFrame, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """All merges ``(a, b, height)`` and the numbered teams they start from.

    Every round merges all pairs that are each other's nearest cluster; Ward
    heights make that equal to merging one pair at a time.  A merged cluster
    keeps the smaller id.
    """
    # Cut from the first row on: numbered by ranges, not in one task.
    numbered = number_rows(unit_rows(scaled).withColumn("all", F.lit(1)), ["all"],
                           ["team_id"], out="id", chunk_rows=block_rows)
    teams = stage(numbered.select("id", "team_id", "u"))
    last_id = teams.count()
    if last_id > TEAM_LIMIT:
        raise ValueError(f"Ward merging compares all pairs; {last_id} teams are too many")
    spark = scaled.sparkSession
    clusters = teams.select("id", F.lit(1).cast("long").alias("size"),
                            F.col("u").alias("centre"))
    merges, left, read = [], last_id, []
    while left > 1:
        near, near_at = stage_at(_nearest(clusters, last_id, block_rows))
        a, b = near.alias("a"), near.alias("b")
        pairs = (
            a.join(b, (F.col("a.near") == F.col("b.id")) & (F.col("b.near") == F.col("a.id")))
            .filter(F.col("a.id") < F.col("b.id"))
            .select(F.col("a.id").alias("a"), F.col("b.id").alias("b"),
                    F.col("a.height").alias("height"))
        )
        pairs = stage(pairs)
        merges.append(pairs)
        gone = pairs.select(F.col("b").alias("id"), F.col("a").alias("into"))
        moved = clusters.join(gone, "id", "left").withColumn(
            "id", F.coalesce("into", "id")).drop("into")
        whole = F.sum("size")
        width = F.transform(F.col("centre"), lambda v: v * F.col("size"))
        # At most two clusters meet under one id.
        clusters, clusters_at = stage_at(
            moved.withColumn("weighted", width).groupBy("id").agg(
                whole.alias("size"), F.collect_list("weighted").alias("parts"))
            .select("id", "size", F.transform(
                F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(
                    F.zip_with(F.col("parts")[0], F.get("parts", F.lit(1)),
                               lambda x, y: x + y)),
                lambda v: v / F.col("size")).alias("centre")))
        unstage(spark, [near_at, *read])
        read = [clusters_at]
        left = clusters.count()
    unstage(spark, read)
    empty = spark.createDataFrame([], "a long, b long, height double")
    return reduce(DataFrame.unionByName, merges, empty), teams.select("id", "team_id")


def ward_unmerged(scaled: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows like those of ``ward_steps`` for the teams that the tree leaves out."""
    inside = unit_rows(scaled).select("team_id", F.lit(0).alias("cluster"))
    listed = with_reason(ids, scaled.select("team_id").join(inside, "team_id", "left"))
    return listed.filter(F.col("reason").isNotNull()).select(
        F.lit(None).cast("double").alias("height"), F.col("team_id").alias("team_a"),
        F.lit(None).cast("string").alias("team_b"), "reason")


def ward_steps(scaled: DataFrame) -> DataFrame:
    """The merge table in height order, with team ids for cluster names."""
    merges, teams = ward_merges(scaled)
    names = teams.select(F.col("id").alias("a"), F.col("team_id").alias("team_a"))
    others = teams.select(F.col("id").alias("b"), F.col("team_id").alias("team_b"))
    return (merges.join(names, "a").join(others, "b")
            .select("height", "team_a", "team_b").orderBy("height", "team_a"))


def ward_teams(scaled: DataFrame, k: int = 3) -> DataFrame:
    """Cluster of each team when the tree is cut into ``k`` groups.

    Teams without a direction (all features average) get no cluster.
    """
    merges, teams = ward_merges(scaled)
    cut = merges.orderBy(F.desc("height"), F.desc("a"), F.desc("b")).limit(k - 1)
    kept = stage(merges.join(cut.select("a", "b"), ["a", "b"], "left_anti"))
    # Each id points to the id it merged into; follow the pointers, doubling.
    at = stage(teams.select("id", "team_id").join(
        kept.select(F.col("b").alias("id"), F.col("a").alias("up")), "id", "left")
        .withColumn("up", F.coalesce("up", "id")))
    while True:
        above = at.select(F.col("id").alias("up"), F.col("up").alias("top"))
        step = stage(at.join(above, "up").select("id", "team_id", "up", "top"))
        moving = step.filter(F.col("up") != F.col("top")).limit(1).count()
        at = step.select("id", "team_id", F.col("top").alias("up"))
        if not moving:
            break
    found = at.select("team_id", F.col("up").alias("cluster"))
    return scaled.select("team_id").join(found, "team_id", "left")
