"""Feed files to stage tables, in one go and game by game."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from touchline.functions.constants import GIRLS_16, TOP_FLIGHT
from touchline.operators.profile import team_profile
from touchline.plans import catalogue, reports
from touchline.plans.conversion import Tables, convert, convert_files
from touchline.sources import feed as sources
from touchline.sources.feed import FEED_COLUMNS, events_feed


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                   for r in df.select(*cols).collect()), key=repr)


def test_two_deliveries_equal_one(spark, tmp_path):
    feed = events_feed(spark, SMALL)
    first = feed.filter(F.col("competition").isin(TOP_FLIGHT))
    once = convert(feed, str(tmp_path / "once"))
    convert(first, str(tmp_path / "twice"))
    twice = convert(feed, str(tmp_path / "twice"))
    for name in ("sequenced", "enriched", "plays", "ages", "team_profiles"):
        assert rows(once.read(name)) == rows(twice.read(name))
    assert rows(once.read("plays")) == rows(catalogue.plays(spark, SMALL))
    # A third delivery of the same feed adds nothing.
    again = convert(feed, str(tmp_path / "twice"))
    assert again.read("sequenced").count() == once.read("sequenced").count()


@pytest.mark.parametrize("failing", ["enriched", "plays", "sequenced", "batches"])
def test_interrupted_batch_is_replaced(spark, tmp_path, monkeypatch, failing):
    """A delivery that dies before any of its writes leaves nothing behind."""
    feed = events_feed(spark, SMALL)
    first = feed.filter(F.col("competition").isin(TOP_FLIGHT))
    path = str(tmp_path / "t")
    convert(first, path)
    before = rows(convert(first, path).read("plays"))

    def dying(write):
        def attempt(df, to, *args):
            if f"/{failing}" in to:
                # Part of the rows, as a job leaves them that loses its driver.
                if failing != "batches":
                    write(df.limit(7), to, *args)
                raise RuntimeError("lost")
            return write(df, to, *args)
        return attempt

    with monkeypatch.context() as m:
        m.setattr(sources, "write_extracts", dying(sources.write_extracts))
        m.setattr(sources, "append_games", dying(sources.append_games))
        with pytest.raises(RuntimeError):
            convert(feed, path)
    tables = Tables(spark, path)
    assert tables.batches() == 1 and rows(tables.read("plays")) == before
    retried = convert(feed, path)
    clean = convert(feed, str(tmp_path / "clean"))
    for name in ("sequenced", "enriched", "plays", "ages", "team_profiles"):
        assert rows(retried.read(name)) == rows(clean.read(name))
    assert "chunk" not in retried.read("sequenced").columns


def test_pipe_separated_delivery(spark, tmp_path):
    feed = events_feed(spark, SMALL)
    lines = ["|".join(FEED_COLUMNS)]
    for r in feed.orderBy("gameID", "ord").select(*FEED_COLUMNS).collect():
        lines.append("|".join("NA" if v is None else str(v) for v in r))
    (tmp_path / "data.csv").write_text("\n".join(lines) + "\n")
    tables = convert_files(spark, str(tmp_path / "data.csv"), str(tmp_path / "tables"))
    assert rows(tables.read("plays")) == rows(catalogue.plays(spark, SMALL))


def test_reports_push_filters_into_the_stage_scan(spark, tmp_path):
    tables = convert(events_feed(spark, SMALL), str(tmp_path / "t"))
    plays = tables.read("plays").filter(F.col("competition") == GIRLS_16)
    out = reports.passing_breakdown(plays, "foul", False, "Opp_3")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "competition" in plan.split("PartitionFilters")[1].split("]")[0]
    pushed = plan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "theirName" in pushed and "totalPasses" in pushed
    schema = plan.split("ReadSchema")[1].split(">")[0]
    assert "possessionDuration" not in schema


def test_profile_shuffles_only_partial_sums(spark, tmp_path):
    plays = convert(events_feed(spark, SMALL), str(tmp_path / "t")).read("plays")
    plan = team_profile(plays)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


def test_a_delivery_reads_only_its_own_events(spark, tmp_path):
    """The ledger tells what is converted; earlier batches are not needed."""
    feed = events_feed(spark, SMALL)
    path = str(tmp_path / "t")
    tables = convert(feed.filter(F.col("competition").isin(TOP_FLIGHT)), path)
    counts = feed.groupBy("gameID").agg(F.count(F.lit(1)).alias("rows"))
    first = tables.ledger()
    assert first.count() > 0 and first.exceptAll(counts).count() == 0
    for name in ("enriched", "sequenced", "plays", "age_sums", "team_sums"):
        (tmp_path / "t" / name).rename(tmp_path / f"away-{name}")
    convert(feed, path)
    for name in ("enriched", "sequenced", "plays", "age_sums", "team_sums"):
        (tmp_path / f"away-{name}" / "batch=0").rename(tmp_path / "t" / name / "batch=0")
    assert Tables(spark, path).batches() == 2
    whole = convert(feed, str(tmp_path / "whole"))
    for name in ("ages", "team_profiles", "match_profiles", "match_features", "ledger"):
        assert rows(tables.read(name)) == rows(whole.read(name))
    assert rows(tables.ledger()) == rows(counts)
