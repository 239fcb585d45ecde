"""Small games for the sequencing tests."""

from __future__ import annotations

import random

from pyspark.sql import types as T

NAMES = (
    ["first touch"] * 12 + ["dribble"] * 4 + ["keeper"] * 4 + ["sideline out"] * 3
    + ["corner", "goalkick", "penalty", "goal", "shot", "rebound", "offside",
       "direct freekick", "indirect freekick", "change ends"] * 1 + ["offside", "goal"])

SCHEMA = T.StructType(
    [T.StructField("gameID", T.StringType()), T.StructField("ord", T.LongType()),
     T.StructField("eventName", T.StringType()), T.StructField("byUs", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in (
        "lengthFraction", "widthFraction", "lengthMetres", "widthMetres",
        "lengthChangeMetres", "distance", "distanceToNextEventMetres", "duration",
        "direction")])


def row(game, ord_, name, us=True, at=(0.5, 0.5), gain=0.0, distance=5.0,
        duration=2.0, direction=0.0):
    l, w = at
    return dict(gameID=game, ord=ord_, eventName=name, byUs="true" if us else "false",
                lengthFraction=l, widthFraction=w, lengthMetres=l * 110,
                widthMetres=w * 75, lengthChangeMetres=gain, distance=distance,
                distanceToNextEventMetres=distance, duration=duration,
                direction=direction)


def random_game(rng: random.Random, game: str, length: int):
    rows, us = [], True
    for i in range(1, length + 1):
        us = us if rng.random() < 0.6 else not us
        deep = rng.random() < 0.5
        rows.append(row(
            game, i, rng.choice(NAMES), us,
            (rng.uniform(0, 0.3 if deep else 1.0), rng.random()),
            gain=rng.uniform(-5, 15),
            distance=None if rng.random() < 0.05 else rng.uniform(0, 25),
            duration=None if rng.random() < 0.1 else rng.choice([0.0, 0.5, 2.0, 6.0]),
            direction=None if rng.random() < 0.05 else rng.uniform(-180, 180)))
    if rng.random() < 0.7:
        rows[-1]["eventName"] = "finish"
    return rows


def frame(spark, rows, chunk_rows=None):
    df = spark.createDataFrame([tuple(r[n] for n in SCHEMA.names) for r in rows], SCHEMA)
    if chunk_rows:
        df = df.selectExpr("*", f"(ord - 1) div {chunk_rows} AS chunk")
    return df
