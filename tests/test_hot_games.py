"""One game holding a third of the table gives the same rows as a plain run."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from touchline.operators.enrich import enrich_events
from touchline.operators.plays import roll_up_plays
from touchline.operators.sequence import sequence_events
from touchline.operators.slices import largest_group, number_rows, running_sums
from touchline.plans.reports import play_map
from touchline.sources.feed import adapt_events, read_feed


@pytest.fixture(scope="module")
def events(spark):
    df = spark.read.parquet(f"{SMALL}/events.parquet")
    hot = F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id"))
    return df.withColumn("user_id", hot.cast("long"))


def same(a, b, digits=9):
    def rows(df):
        cols = sorted(set(df.columns) - {"chunk"})
        out = [tuple(round(v, digits) if isinstance(v, float) else v for v in r)
               for r in df.select(*cols).collect()]
        return cols, sorted(out, key=repr)
    assert rows(a) == rows(b)


CHUNK, PLAY_CHUNK = 20, 2


def test_feed(spark, events):
    cut = adapt_events(events, CHUNK)
    assert "chunk" in cut.columns
    assert largest_group(cut, ["gameID", "chunk"]) <= CHUNK
    same(adapt_events(events), cut)


def test_events_plays_and_segments(spark, events):
    whole = enrich_events(sequence_events(adapt_events(events)))
    sequenced = sequence_events(adapt_events(events, CHUNK), CHUNK)
    assert "chunk" in sequenced.columns
    cut = enrich_events(sequenced, PLAY_CHUNK)
    same(whole, cut)
    same(roll_up_plays(whole), roll_up_plays(cut))
    same(play_map(whole), play_map(cut, chunk_rows=PLAY_CHUNK))
    # Plays really are cut.
    assert largest_group(cut, ["gameID", "playNumber"]) > PLAY_CHUNK


def test_no_window_over_a_whole_game(spark, events):
    cut = sequence_events(adapt_events(events, CHUNK), CHUNK)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    # Windows by game alone only scan per-chunk summaries, never event columns.
    for line in plan.splitlines():
        if re.search(r"Window \[.*\[gameID#\d+\]", line):
            assert not re.search(r"row_number|byUs#|\bname#|rule#|opens#|ord#", line)


def test_number_rows_agrees_either_way(spark, events):
    base = events.select("user_id", "event_id", "ts")
    plain = number_rows(base, ["user_id"], ["ts", "event_id"])
    cut = number_rows(base, ["user_id"], ["ts", "event_id"], chunk_rows=10)
    assert "chunk" not in plain.columns and "chunk" in cut.columns
    same(plain, cut)


def test_running_sums_carry_over(spark):
    df = spark.range(1, 101).select(
        F.lit("g").alias("g"), F.col("id").alias("ord"),
        F.floor((F.col("id") - 1) / 7).alias("chunk"))
    out = running_sums(df, ["g"], "ord", {"s": F.col("ord")}).orderBy("ord").collect()
    assert [r["s"] for r in out] == [n * (n + 1) // 2 for n in range(1, 101)]


def test_file_order_of_a_cut_feed(spark, tmp_path):
    names = "gameID competition ourName theirName time epochTime eventName byUs".split()
    header = "|".join([*names, *["x"] * 15])
    lines = [f"G{i % 2}|c|us|them|2024-01-01 00:00:00|{i}|first touch|true" + "|1.5" * 15
             for i in range(50)]
    (tmp_path / "data.csv").write_text("\n".join([header, *lines]) + "\n")
    for chunk_rows in (1000, 6):
        rows = read_feed(spark, str(tmp_path / "data.csv"), chunk_rows=chunk_rows).collect()
        assert len(rows) == 50
        for game in ("G0", "G1"):
            times = [r["epochTime"] for r in sorted(
                (r for r in rows if r["gameID"] == game), key=lambda r: r["ord"])]
            assert times == sorted(times)
            assert sorted(r["ord"] for r in rows if r["gameID"] == game) == list(range(1, 26))
