"""Teams without a complete profile are listed by every team query, with a reason."""

import random

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from touchline.functions.constants import GIRLS_16
from touchline.operators import cluster
from touchline.plans import catalogue


def test_incomplete_teams_are_listed(spark, monkeypatch):
    rng = random.Random(4)
    names = ["competition", "teamName", "playByUs", "age_group", *cluster.FEATURES]
    rows = [(GIRLS_16, f"T{i}", "true", "16", *(rng.random() for _ in cluster.FEATURES)) for i in range(8)]
    rows.append((*rows[0][:1], "none", *rows[0][2:-1], None))
    schema = ", ".join(f"`{n}` {'string' if i < 4 else 'double'}" for i, n in enumerate(names))
    table = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(catalogue, "plays", lambda spark, sf: None)
    monkeypatch.setattr(catalogue.profile, "team_profile", lambda plays: table)
    lost, ids = f"{GIRLS_16}|none|true", {f"{GIRLS_16}|T{i}|true" for i in range(8)}
    out = {r.team_id: r for r in catalogue.ward_teams(spark, None).collect()}
    assert set(out) == ids | {lost} and out[lost][1:] == (None, "incomplete profile")
    assert all(out[i].cluster is not None and out[i].reason is None for i in ids)
    out = {r.team_id: r for r in catalogue.pca_individuals(spark, None).collect()}
    assert set(out) == ids | {lost}
    assert out[lost][1:] == (GIRLS_16, "none", "true", "Us", None, None, "incomplete profile")
    assert all(out[i].pca_1 is not None and out[i].reason is None for i in ids)
    out = catalogue.ward_steps(spark, None).collect()
    assert [tuple(r) for r in out if r.reason] == [(None, lost, None, "incomplete profile")]
    assert len(out) == 8 and sum(r.height is not None for r in out) == 7


def test_average_teams_are_listed(spark):
    scaled = spark.createDataFrame(
        [("a", Vectors.dense([1.0, 0.0])), ("b", Vectors.dense([0.0, 2.0])), ("c", Vectors.dense([0.0, 0.0]))],
        ["team_id", "scaled"])
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "team_id string")
    out = cluster.ward_unmerged(scaled, ids).select("team_a", F.col("reason")).collect()
    assert sorted(map(tuple, out)) == [("c", "average in every feature"), ("d", "incomplete profile")]
    found = {r.team_id: r.cluster for r in cluster.ward_teams(scaled, 2).collect()}
    assert set(found) == {"a", "b", "c"} and found["c"] is None and found["a"] != found["b"]
