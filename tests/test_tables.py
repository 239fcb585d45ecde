"""Play, profile and report semantics on hand-made rows."""

import math

import numpy as np
import pytest
from conftest import CHECKED, SMALL
from pyspark.sql import functions as F

from touchline.functions.exprs import (
    choose, flag, one_of, open_flag, ratio, strict_max, strict_sum,
)
from touchline.operators.density import density_grid
from touchline.operators.enrich import enrich_events, zone
from touchline.operators.plays import roll_up_plays
from touchline.operators.profile import (
    RATIOS, lenient, match_features, part, result_label,
)
from touchline.operators.sequence import sequence_events
from touchline.plans import catalogue, reports
from touchline.plans.registry import STATS
from touchline.sources import feed as sources


def one(df):
    return df.first()[0]


def test_null_rules(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert one(df.agg(strict_sum(F.col("x")))) is None
    assert one(df.agg(strict_max(F.col("x")))) is None
    none = df.filter("x is null")
    gaps = spark.createDataFrame([(1.0,), (None,)], "distance double")
    assert one(gaps.agg(lenient("distance"))) == 1.0
    assert one(gaps.filter("distance is null").agg(lenient("distance"))) == 0.0
    assert one(none.select(flag(F.col("x") > 0))) == 0
    assert one(none.select(open_flag(F.col("x") > 0))) is None
    assert one(none.select(choose(F.col("x") > 0, F.lit(1), F.lit(0)))) is None
    text = spark.createDataFrame([(None,)], "s string")
    assert one(text.select(one_of(F.col("s"), ["a"]))) is False


def test_division_rules(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()] \
        == [None, None, 0.25]
    assert [r[0] for r in df.selectExpr(part("a", "b")).collect()] == [None, None, 0.25]


@pytest.mark.parametrize("goals,total,label", [
    (0, 0, "Draw"), (2, 4, "Draw"), (1, 3, "Loss"), (2, 3, "Win"), (1, 1, "Win")])
def test_result_labels(spark, goals, total, label):
    df = spark.createDataFrame([(goals, total)], "g int, t int")
    assert one(df.select(result_label(F.col("g"), F.col("t")))) == label


def test_zones_cover_the_pitch(spark):
    points = [(w / 20, l / 20) for w in range(21) for l in range(21)]
    df = spark.createDataFrame(points, "widthFraction double, lengthFraction double")
    found = {r[0] for r in df.select(zone()).collect()}
    assert found == set(range(1, 19))


def test_pass_buckets_add_up(spark):
    plays = catalogue.plays(spark, SMALL)
    wrong = plays.filter("passZero + pass1 + pass2_3 + pass4_6 + pass7Plus <> 1")
    assert wrong.count() == 0
    assert len(plays.columns) == 72


def test_shares_of_a_match_add_up(spark):
    features = match_features(catalogue.plays(spark, SMALL))
    sums = features.groupBy("competition", "gameID").agg(F.sum("totalPasses_pcnt"))
    assert all(abs(r[2] - 1) < 1e-9 for r in sums.collect() if r[2])


def test_left_channel_uses_left_attacks():
    assert RATIOS["leftAttack_pcnt"][0] == "leftAttack"
    assert len(RATIOS) + 1 == 39


def test_registry():
    assert len(STATS) == 15
    assert STATS["PassSequence"].labels["pass7Plus"] == "7+"


def test_bars_in_share_mode_add_up(spark):
    ages = catalogue.profile.age_totals(catalogue.plays(spark, SMALL))
    bars = reports.age_stats(ages, ["PassDirection", "ppm"], as_share=True)
    sums = bars.filter("stat = 'PassDirection'").groupBy("age_group", "side").agg(
        F.sum("Measurement"))
    assert all(abs(r[2] - 1) < 1e-9 for r in sums.collect() if r[2] is not None)
    assert bars.filter("stat = 'ppm' AND Measurement > 1").count() > 0


def test_filters(spark):
    plays = catalogue.plays(spark, SMALL)
    fouls = reports.by_phase(plays, "foul").select("firstEvent").distinct().collect()
    assert {r[0] for r in fouls} <= {"offside restart", "direct restart", "indirect restart"}
    name = plays.select("theirName").first()[0]
    only = reports.passing_breakdown(plays, opponent=name, include_no_pass=False)
    counted = one(only.agg(F.sum("cnt")))
    assert counted == plays.filter((F.col("theirName") == name)
                                   & (F.col("totalPasses") > 0)).count()


def brute_density(points, nx, ny, h):
    xs = (np.arange(nx) + 0.5) * 110 / nx
    ys = (np.arange(ny) + 0.5) * 75 / ny
    cell = 110 / nx * 75 / ny
    out = np.zeros((nx, ny))
    for px, py in points:
        k = np.exp(-((px - xs[:, None]) ** 2 + (py - ys[None, :]) ** 2) / (2 * h * h))
        k /= 2 * math.pi * h * h
        out += k / (k.sum() * cell)
    return out


def test_density_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    points = [(float(x), float(y)) for x, y in
              zip(rng.uniform(0, 110, 60), rng.uniform(0, 75, 60))] + [(120.0, 10.0)]
    df = spark.createDataFrame(points, "lengthMetres double, widthMetres double")
    grid = density_grid(df, 11, 5, 9.375).collect()
    wanted = brute_density(points[:-1], 11, 5, 9.375)
    assert len(grid) == 55
    for r in grid:
        assert r["density"] == pytest.approx(wanted[r["gx"], r["gy"]])
    # Each point inside the pitch adds exactly one to the integral.
    assert sum(r["density"] for r in grid) * 10 * 15 == pytest.approx(60)


def test_density_has_no_cross_join(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "lengthMetres double, widthMetres double")
    plan = density_grid(df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_two_feature_rows_a_game(spark):
    """One match name a game, one feature row a side, every result label used."""
    found = catalogue.match_labels(spark, CHECKED)
    sides = found.groupBy("gameID").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("playByUs").alias("sides"))
    assert sides.filter("n <> sides OR n > 2").count() == 0
    assert sides.filter("n = 2").count() > 0.9 * sides.count()
    labels = {r[0]: r[1] for r in found.groupBy("default").count().collect()}
    assert set(labels) == {0, 1, 2} and min(labels.values()) > 0.05 * sum(labels.values())


def test_bad_input_is_unknown(spark):
    """A bad time or JSON text gives NULL, and no failure."""
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    feed = sources.adapt_events(events.withColumn("props", F.when(
        F.col("event_id") % 50 == 0, F.lit('{"k": "x"}')).otherwise(F.col("props"))))
    bad = feed.withColumn("time", F.when(F.col("ord") % 40 == 3, F.lit("yesterday"))
                          .otherwise(F.col("time")))
    enriched = enrich_events(sequence_events(bad))
    assert enriched.filter("kickoff_date IS NULL").count() > 0
    assert enriched.count() >= events.count()
    unknown = bad.withColumn("byUs", F.when(F.col("ord") % 40 != 3, F.col("byUs")))
    played = roll_up_plays(enrich_events(sequence_events(unknown)))
    assert played.filter("possessionDuration IS NULL").count() > 0
