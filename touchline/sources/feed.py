"""Feed scans, history handling and the adapter from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.constants import (
    ATTACK_FRACTION, BOYS_13, DEFENCE_FRACTION, GIRLS_16, ODD_COMPETITION,
    PITCH_LENGTH, PITCH_WIDTH, TOP_FLIGHT,
)
from touchline.operators.slices import (
    CHUNK_ROWS, at_home, number_rows, running_sums, stage, with_halo,
)

POSSESSION = [
    "ourPossession", "theirPossession", "ourDefensivePossession",
    "theirDefensivePossession", "ourAttackingPossession",
    "theirAttackingPossession",
]

FEED_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "gameID", "competition", "ourName", "theirName", "time")]
    + [T.StructField("epochTime", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("eventName", "byUs")]
    + [T.StructField(n, T.DoubleType()) for n in (
        "lengthFraction", "widthFraction", "lengthMetres", "widthMetres",
        "lengthChangeMetres", "distance", "distanceToNextEventMetres",
        "duration", "direction", *POSSESSION)]
)
FEED_COLUMNS = FEED_SCHEMA.names


# --------------------------------------------------------------------------
# files
# --------------------------------------------------------------------------
def write_feed(feed: DataFrame, path: str, sep: str = "|") -> None:
    """Write a pipe-separated feed whose file order is that of ``ord``.

    Rows are cut into files by ranges of the game and its order, so a game of any
    size is spread over files that follow each other.  Separators and quotes inside a
    text are quoted, unknown values are ``NA``.
    """
    order = ["gameID", "ord"]
    (feed.select(*FEED_COLUMNS, "ord").repartitionByRange(*order).sortWithinPartitions(*order)
     .select(*FEED_COLUMNS).write.mode("overwrite").option("sep", sep).option("header", True)
     .option("nullValue", "NA").option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def read_feed(
    spark: SparkSession, path: str, sep: str = "|", chunk_rows: int = CHUNK_ROWS,
    bad_rows: str | None = None,
) -> DataFrame:
    """Scan a pipe-separated feed; file order becomes the explicit ``ord``.

    Spark has no row order, so the position is taken from the file name, the
    byte offset of the split and the row's place in the split.  With ``bad_rows``,
    that column has the line of a row that does not fit the schema (what can be read
    of it is kept, the rest is unknown).
    """
    schema = T.StructType(list(FEED_SCHEMA.fields))
    scan = spark.read.option("sep", sep).option("header", True)
    if bad_rows:
        schema = schema.add(bad_rows, T.StringType())
        scan = scan.option("columnNameOfCorruptRecord", bad_rows)
    rows = (
        scan.schema(schema).option("nullValue", "NA").option("escape", '"').csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"),
                F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_line"))
    )
    if bad_rows:
        # Lines of bad rows can only be asked for next to other columns of a scan.
        rows = stage(rows)
    numbered = number_rows(rows, ["gameID"], ["_file", "_block", "_line"],
                           chunk_rows=chunk_rows)
    return numbered.drop("_file", "_block", "_line", "cnt")


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, as_csv: bool = False
) -> DataFrame:
    """Read a stage table, or an empty frame if it is not there yet."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    fs = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(location):
        return spark.createDataFrame([], schema)
    source = spark.read.schema(schema)
    return source.option("header", True).csv(path) if as_csv else source.parquet(path)


def write_full(df: DataFrame, path: str, as_csv: bool = False) -> None:
    """Replace a stage table."""
    out = df.write.mode("overwrite")
    if as_csv:
        out.option("header", True).csv(path)
    else:
        out.parquet(path)


def append_games(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_extracts(df: DataFrame, path: str) -> None:
    """One folder per competition, so a competition filter prunes files.

    A large competition is spread over many writers (no shuffle on the
    competition, which would put a third of the table into one task).
    """
    df.write.mode("overwrite").partitionBy("competition").parquet(path)


def competition_extract(df: DataFrame, competitions: list[str]) -> DataFrame:
    return df.filter(F.col("competition").isin(competitions))


# --------------------------------------------------------------------------
# incremental conversion
# --------------------------------------------------------------------------
def unseen(rows: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the history does not have."""
    return (rows.select(key).distinct()
            .join(history.select(key).distinct(), key, "left_anti"))


def unconverted_games(feed: DataFrame, history: DataFrame) -> DataFrame:
    """Distinct games in the feed that the history has never seen."""
    return unseen(feed, history, "gameID")


def pending_events(feed: DataFrame, history: DataFrame) -> DataFrame:
    """Feed rows of unconverted games.

    No broadcast hint: the runtime size decides, and a hot game stays on the
    streamed side of the semi join, where adaptive execution may split it.
    """
    return feed.join(unconverted_games(feed, history), "gameID", "left_semi")


def converted_append(history: DataFrame, converted: DataFrame) -> DataFrame:
    return history.unionByName(converted)


# --------------------------------------------------------------------------
# events table -> feed
# --------------------------------------------------------------------------
def _event_name(k: Column, ord_: Column, cnt: Column) -> Column:
    return (
        F.when(ord_ == 1, "change ends")
        .when(ord_ == cnt, "finish")
        .when(ord_ == F.floor(cnt / 2), "change ends")
        .when(k <= 44, "first touch")
        .when(k <= 59, "dribble")
        .when(k <= 65, "sideline out")
        .when(k <= 69, "goalkick")
        .when(k <= 73, "corner")
        .when(k <= 76, "keeper")
        .when(k <= 79, "offside")
        .when(k <= 82, "direct freekick")
        .when(k <= 84, "indirect freekick")
        .when(k <= 88, "shot")
        .when(k <= 90, "rebound")
        .when(k <= 93, "goal")
        .when(k <= 94, "penalty")
        .otherwise("first touch")
    )


def events_feed(
    spark: SparkSession, sf_dir: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The ``events`` table as a match feed."""
    return adapt_events(spark.read.parquet(f"{sf_dir}/events.parquet"), chunk_rows)


def adapt_events(events: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Map generic events to the feed layout; one game per user."""
    user = F.col("user_id")
    base = events.select(
        F.concat(F.lit("G"), user).alias("gameID"),
        "user_id", "event_id", "ts",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )
    numbered = number_rows(base, ["gameID"], ["ts", "event_id"], chunk_rows=chunk_rows)
    split = "chunk" in numbered.columns
    # A game is one day: its first one.
    if split:
        numbered = numbered.join(
            base.groupBy("gameID").agg(F.min("ts").alias("first_ts")), "gameID")
    else:
        numbered = numbered.withColumn(
            "first_ts", F.min("ts").over(Window.partitionBy("gameID")))

    k, ord_, cnt = F.col("k"), F.col("ord"), F.col("cnt")
    competitions = F.array(*[F.lit(c) for c in (
        *TOP_FLIGHT, BOYS_13, GIRLS_16, ODD_COMPETITION)])
    runs = F.floor((ord_ + user % 7) / 3) % 2 == 0
    length = ((F.col("event_id") * 7919 + k * 31) % 1000) / F.lit(999.0)
    width = ((F.col("event_id") * 104729 + k * 17) % 1000) / F.lit(999.0)
    ts = F.col("ts")
    millis = (
        F.datediff(ts, F.lit("1970-01-01")).cast("long") * 86400000
        + F.hour(ts) * 3600000 + F.minute(ts) * 60000 + F.second(ts) * 1000
        + F.date_format(ts, "SSS").cast("int")
    )
    placed = numbered.select(
        "gameID", *(["chunk"] if split else []), "ord",
        F.element_at(competitions, (user % 7 + 1).cast("int")).alias("competition"),
        F.concat(F.lit("Us_"), user % 4).alias("ourName"),
        F.concat(F.lit("Opp_"), user % 11).alias("theirName"),
        F.concat(F.date_format("first_ts", "yyyy-MM-dd"), F.date_format(ts, " HH:mm:ss"))
        .alias("time"),
        millis.alias("epochTime"),
        _event_name(k, ord_, cnt).alias("eventName"),
        F.when(runs != (k % 10 == 0), "true").otherwise("false").alias("byUs"),
        length.alias("lengthFraction"),
        width.alias("widthFraction"),
        F.when(k != 99, 0.5 * (1 + k % 8)).alias("duration"),
    ).withColumns({
        "lengthMetres": F.col("lengthFraction") * PITCH_LENGTH,
        "widthMetres": F.col("widthFraction") * PITCH_WIDTH,
    })

    keys, seen = ["gameID"], placed
    if split:
        seen = with_halo(placed, "ord", before=0, after=1, chunk_rows=chunk_rows)
        keys = ["gameID", "slot"]
    step = Window.partitionBy(*keys).orderBy("ord")
    moved = seen.withColumns({
        "lengthChangeMetres": F.lead("lengthMetres").over(step) - F.col("lengthMetres"),
        "_across": F.lead("widthMetres").over(step) - F.col("widthMetres"),
    })
    if split:
        moved = at_home(moved)
    along, across = F.col("lengthChangeMetres"), F.col("_across")
    moved = moved.withColumns({
        "distance": F.sqrt(along * along + across * across),
        "distanceToNextEventMetres": F.sqrt(along * along + across * across),
        "direction": F.degrees(F.atan2(across, along)),
    })

    spent = F.coalesce("duration", F.lit(0.0))
    us = F.col("byUs") == "true"
    back = F.col("lengthFraction") <= DEFENCE_FRACTION
    front = F.col("lengthFraction") >= ATTACK_FRACTION
    series = dict(zip(POSSESSION, [
        us, ~us, us & back, ~us & back, us & front, ~us & front]))
    timed = running_sums(moved, ["gameID"], "ord", {
        n: F.when(c, spent).otherwise(0.0) for n, c in series.items()}, source=placed)
    if split:
        # Later stages read a cut feed more than once.
        return stage(timed.select(*FEED_COLUMNS, "ord", "chunk"))
    return timed.select(*FEED_COLUMNS, "ord")
