"""Feeds written to files and read back."""

from conftest import SMALL

from touchline.sources import feed as f


def test_round_trip(spark, tmp_path):
    events = f.events_feed(spark, SMALL)
    path = str(tmp_path / "feed")
    f.write_feed(events, path)
    back = f.read_feed(spark, path, bad_rows="bad_row")
    names = [*f.FEED_COLUMNS, "ord"]
    assert back.filter("bad_row IS NOT NULL").count() == 0
    want = events.select(*names)
    assert back.select(*names).exceptAll(want).count() == 0 and back.count() == want.count()


def test_separators_quotes_and_unknown_values(spark, tmp_path):
    names = ["a|b", 'say "hi"', None, "plain", " both | and \"", "x,y"]
    row = {c: None for c in f.FEED_COLUMNS}
    rows = [({**row, "gameID": "G1", "ourName": n, "eventName": "goal", "duration": i / 3}, i + 1)
            for i, n in enumerate(names)]
    df = spark.createDataFrame([(*r.values(), o) for r, o in rows],
                               f.FEED_SCHEMA.simpleString()[7:-1].replace(":", " ") + ", ord long")
    path = str(tmp_path / "odd")
    f.write_feed(df, path)
    back = f.read_feed(spark, path, bad_rows="bad").orderBy("ord").collect()
    assert [r.ourName for r in back] == names
    assert [r.duration for r in back] == [i / 3 for i in range(6)] and {r.bad for r in back} == {None}


def test_bad_rows_are_caught(spark, tmp_path):
    header = "|".join(f.FEED_COLUMNS)
    good = "|".join(["G1", "c", "us", "them", "2024-01-01 00:00:00", "5", "goal", "true",
                     *["1.5"] * (len(f.FEED_COLUMNS) - 8)])
    wrong = good.replace("|5|", "|five|")
    path = tmp_path / "feed.csv"
    path.write_text("\n".join([header, good, wrong, "G1|short", good]) + "\n")
    rows = f.read_feed(spark, str(path), bad_rows="bad").orderBy("ord").collect()
    assert [r.bad for r in rows] == [None, wrong, "G1|short", None]
    assert [r.epochTime for r in rows] == [5, None, None, 5] and rows[1].eventName == "goal"
