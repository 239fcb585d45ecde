"""Batch conversion: feed files in, stage tables out.

Only games the history has not seen are sequenced, enriched and rolled up.  All
three are per-game, so adding batches gives the same tables as converting
everything again.  Which games are converted is in a ledger (game, rows, batch), so
a delivery reads the ledger and its own events, and no earlier batch: profiles of
matches are tables by batch like the plays, and roll-ups over matches (ages, teams)
are kept as sums by batch, which a reader adds up before it takes rates.

Every delivery is a batch with the next free number; each table has a folder for
it.  A batch counts only when its number has been added to ``batches``, which is
written last: an interrupted batch is invisible, and the retry, which has the
same number, replaces its folders.  One conversion runs at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.constants import TEAM_KEYS
from touchline.operators import profile
from touchline.operators.enrich import enrich_events
from touchline.operators.plays import roll_up_plays
from touchline.operators.sequence import sequence_events
from touchline.operators.slices import CHUNK_ROWS, stage
from touchline.sources import feed as sources

BY_COMPETITION = ("enriched", "plays", "sequenced")
#: Tables that a batch adds its own rows to, made of its plays.
OF_PLAYS = {
    "age_sums": profile.age_sums,
    "team_sums": lambda plays: profile.team_sums(plays, TEAM_KEYS),
    "match_profiles": profile.match_team_profile,
    "match_features": profile.match_features,
}
#: Tables that are put together from the sums of all batches.
ROLL_UPS = {
    "ages": lambda t: profile.numeric_rates(
        profile.numeric_sums(t.read("age_sums"), profile.AGE_KEYS)),
    "team_profiles": lambda t: profile.team_rates(
        profile.merged_team_sums(t.read("team_sums"), TEAM_KEYS), TEAM_KEYS),
}
LEDGER = T.StructType([T.StructField("gameID", T.StringType()), T.StructField("rows", T.LongType())])


BATCH = T.StructType([T.StructField("batch", T.IntegerType())])


@dataclass(frozen=True)
class Tables:
    """Stage tables under one folder."""

    spark: SparkSession
    path: str

    def batches(self) -> int:
        """How many batches are complete."""
        done = sources.read_table(self.spark, f"{self.path}/batches", BATCH)
        return done.agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]

    def read(self, name: str) -> DataFrame:
        """A stage table, of complete batches only."""
        if name in ROLL_UPS:
            return ROLL_UPS[name](self)
        df = self.spark.read.parquet(f"{self.path}/{name}")
        return df.filter(F.col("batch") < self.batches()).drop("batch")

    def ledger(self) -> DataFrame:
        """The converted games and their feed rows."""
        if not self.batches():
            return self.spark.createDataFrame([], LEDGER)
        return self.read("ledger")


def convert(
    feed: DataFrame, path: str, chunk_rows: int = CHUNK_ROWS
) -> Tables:
    """Convert the feed's new games; what is there already is not read."""
    tables = Tables(feed.sparkSession, path)
    batch = tables.batches()
    pending = sources.pending_events(feed, tables.ledger())
    if pending.isEmpty():
        return tables
    # Written once and read twice: by the event table and by the enrichment.
    converted = stage(sequence_events(pending, chunk_rows))
    enriched = stage(enrich_events(converted, chunk_rows))
    fresh = {"enriched": enriched, "plays": roll_up_plays(enriched), "sequenced": converted}
    for name in BY_COMPETITION:
        # A folder per competition: an extract is a filter that prunes files.
        sources.write_extracts(fresh[name].drop("chunk"), f"{path}/{name}/batch={batch}")
    plays = tables.spark.read.parquet(f"{path}/plays/batch={batch}")
    for name, made in OF_PLAYS.items():
        sources.write_full(made(plays), f"{path}/{name}/batch={batch}")
    games = converted.filter("NOT pseudoEvent").groupBy("gameID").agg(
        F.count(F.lit(1)).alias("rows"))
    sources.write_full(games, f"{path}/ledger/batch={batch}")
    sources.append_games(
        tables.spark.createDataFrame([(batch,)], BATCH).coalesce(1), f"{path}/batches")
    return tables


def convert_files(
    spark: SparkSession, feed_path: str, path: str, chunk_rows: int = CHUNK_ROWS
) -> Tables:
    return convert(sources.read_feed(spark, feed_path, chunk_rows=chunk_rows), path,
                   chunk_rows)
