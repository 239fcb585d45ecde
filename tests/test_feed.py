"""Sources, sinks and incremental conversion."""

from conftest import SMALL

from touchline.functions.constants import BOYS_13, GIRLS_16, TOP_FLIGHT
from touchline.sources import feed as f


def test_missing_history_is_empty(spark, tmp_path):
    events = f.events_feed(spark, SMALL)
    history = f.read_table(spark, str(tmp_path / "none"), events.schema)
    assert history.count() == 0
    assert f.unconverted_games(events, history).count() == 15


def test_only_unseen_games_are_converted_and_appended(spark, tmp_path):
    events = f.events_feed(spark, SMALL)
    path = str(tmp_path / "history")
    f.write_full(f.competition_extract(events, TOP_FLIGHT), path)
    history = f.read_table(spark, path, events.schema)
    seen = {r[0] for r in history.select("gameID").distinct().collect()}
    fresh = f.pending_events(events, history)
    assert seen and not seen & {r[0] for r in fresh.select("gameID").collect()}
    f.append_games(fresh, path)
    assert f.read_table(spark, path, events.schema).count() == events.count()
    again = f.pending_events(events, f.read_table(spark, path, events.schema))
    assert again.count() == 0


def test_competition_folders_prune(spark, tmp_path):
    events = f.events_feed(spark, SMALL)
    path = str(tmp_path / "extracts")
    f.write_extracts(events, path)
    boys = f.competition_extract(spark.read.parquet(path), [BOYS_13])
    plan = boys._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(competition" in plan \
        or "PartitionFilters: [competition" in plan
    assert boys.count() == f.competition_extract(events, [BOYS_13]).count() > 0
    assert f.competition_extract(events, [GIRLS_16]).count() > 0


def test_csv_sink(spark, tmp_path):
    events = f.events_feed(spark, SMALL)
    path = str(tmp_path / "csv")
    f.write_full(events, path, as_csv=True)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == events.columns and back.count() == events.count()
