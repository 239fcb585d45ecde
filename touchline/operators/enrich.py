"""Event enrichment: passes, zones, display coordinates, play-level columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.constants import (
    ATTACK_FRACTION, DEFENCE_FRACTION, LONG_PASS, PITCH_LENGTH, PITCH_WIDTH,
    PLAY_KEYS, SHORT_PASS, SIDE_FROM, SIDE_TO, TOP_FLIGHT,
)
from touchline.functions.exprs import flag, open_flag
from touchline.operators.slices import (
    CHUNK_ROWS, at_home, number_rows, with_halo,
)

PLAY_ORDER = ["sequenceNumber", "pseudoEvent", "ord"]


def mark_passes(events: DataFrame) -> DataFrame:
    """Null fill, pass direction and length, goal position, zone."""
    passed, gain = F.col("adjPass") == 1, F.col("lengthChangeMetres")
    turn = F.abs("direction")
    straight = (turn < SIDE_FROM) | (turn > SIDE_TO)
    forward, metres = F.col("isFwdPass") == 1, F.col("distance")
    goal = F.col("adjEventName") == "goal"
    return (
        events.na.fill(0.0, ["direction", "duration"])
        .withColumns({
            "isBackPass": open_flag(passed & (gain < 0) & straight),
            "isFwdPass": open_flag(passed & (gain > 0) & straight),
            "isSidePass": open_flag(passed & (turn >= SIDE_FROM) & (turn <= SIDE_TO)),
        })
        .withColumns({
            "isPass10m": open_flag(forward & (metres <= SHORT_PASS)),
            "isPass10_20m": open_flag(
                forward & (metres > SHORT_PASS) & (metres <= LONG_PASS)),
            "isPass20m": open_flag(forward & (metres > LONG_PASS)),
            "lengthMetres": F.when(goal, PITCH_LENGTH).otherwise(F.col("lengthMetres")),
            "lengthFraction": F.when(goal, 1.0).otherwise(F.col("lengthFraction")),
        })
        .withColumn("zone", zone())
    )


def zone() -> Column:
    """Pitch zone 1-18: three across, six along."""
    w, l = F.col("widthFraction"), F.col("lengthFraction")
    across = F.floor(F.when(w == 1, 2.0).otherwise(w * 3))
    along = F.floor(F.when(l >= 1, 5.0).otherwise(l * 6))
    return (across + 1 + 3 * along).cast("int")


def third() -> Column:
    l = F.col("lengthFraction")
    return (F.when(l <= DEFENCE_FRACTION, "Defence")
            .when(l >= ATTACK_FRACTION, "Attack").otherwise("Midfield"))


def age_group() -> Column:
    c = F.col("competition")
    return F.when(c.isin(TOP_FLIGHT), "Top-Flight") \
        .otherwise(F.substring_index(c, " ", -1))


def match_name() -> Column:
    day = F.substring("time", 1, 10).try_cast("date")
    return F.concat_ws(" ", F.date_format(day, "dd/MM/yy"), F.lit("-"),
                       F.col("theirName"))


def mirror_opposition(events: DataFrame) -> DataFrame:
    """Let the opposition run the other way, for display."""
    theirs = F.col("playByUs") == "false"

    def turned(column: str, extent: float) -> Column:
        return F.when(theirs, extent - F.col(column)).otherwise(F.col(column))

    return events.withColumns({
        "lengthMetres": turned("lengthMetres", PITCH_LENGTH),
        "widthMetres": turned("widthMetres", PITCH_WIDTH),
        "lengthFraction": turned("lengthFraction", 1.0),
        "widthFraction": turned("widthFraction", 1.0),
    })


#: Text and time values of a play's first or last event; the roll-up groups by
#: them, which keeps its aggregation buffers numeric.
PLAY_LABELS = {
    "gameDate": ("first", "kickoff_date"),
    "playMatch": ("first", "matchName"),
    "firstUsPhase": ("first", "usPhase"),
    "firstOppositionPhase": ("first", "oppositionPhase"),
    "firstHalf": ("first", "half"),
    "firstArea": ("first", "playArea"),
    "firstZone": ("first", "zone"),
    "firstPenalyIncursion": ("first", "penaltyIncursion"),
    "lastArea": ("last", "playArea"),
    "lastZone": ("last", "zone"),
}


def _play_values() -> dict[str, tuple[str, Column]]:
    """Play-level values that every event of the play carries."""
    return {
        **{n: (how, F.col(c)) for n, (how, c) in PLAY_LABELS.items()},
        "maxSequenceNumber": ("max", F.col("sequenceNumber")),
        "isAttackIncursion": ("max", F.col("attackIncursion")),
        "numberPasses": ("sum", F.col("adjPass")),
        "isGoal": ("last", flag(F.col("adjEventName") == "goal")),
        "playByUs": ("first", F.col("byUs")),
        "firstEvent": ("first", F.col("adjEventName")),
        "lastEvent": ("last", F.col("adjEventName")),
    }


NEXT = {"next_event": "adjEventName", "next_zone": "zone",
        "next_side": "byUs", "next_area": "playArea"}


def _whole_play(df: DataFrame) -> DataFrame:
    """Next-row and play-level columns, one window per play."""
    play = Window.partitionBy(*PLAY_KEYS)
    order = play.orderBy(*PLAY_ORDER)
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = {"max": F.max, "sum": F.sum, "first": F.first, "last": F.last}
    return df.withColumns({
        **{n: F.lead(c).over(order) for n, c in NEXT.items()},
        **{n: over[how](c).over(full) for n, (how, c) in _play_values().items()},
    })


def _cut_play(df: DataFrame, chunk_rows: int) -> DataFrame:
    """The same columns when some play is too large for one task."""
    seen = with_halo(df, "pos", before=0, after=1, chunk_rows=chunk_rows)
    order = Window.partitionBy(*PLAY_KEYS, "slot").orderBy("pos")
    led = at_home(seen.withColumns({n: F.lead(c).over(order) for n, c in NEXT.items()}))

    local = {"max": F.max, "sum": F.sum,
             "first": lambda c: F.min_by(c, "pos"),
             "last": lambda c: F.max_by(c, "pos")}
    chunks = df.groupBy(*PLAY_KEYS, "chunk").agg(*[
        local[how](c).alias(n) for n, (how, c) in _play_values().items()])
    full = (Window.partitionBy(*PLAY_KEYS).orderBy("chunk")
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    over = {"max": F.max, "sum": F.sum, "first": F.first, "last": F.last}
    totals = chunks.select(*PLAY_KEYS, "chunk", *[
        over[how](n).over(full).alias(n) for n, (how, _) in _play_values().items()])
    return led.join(totals, [*PLAY_KEYS, "chunk"])


def enrich_events(events: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Play-window columns on every sequenced event."""
    df = mark_passes(events).withColumns({
        "kickoff_date": F.substring("time", 1, 19).try_cast("timestamp_ntz"),
        "age_group": age_group(),
        "matchName": match_name(),
        "widthMetres": PITCH_WIDTH - F.col("widthMetres"),
        "widthFraction": 1 - F.col("widthFraction"),
        "playArea": third(),
    })
    if "chunk" in df.columns:
        df = number_rows(df.drop("chunk"), PLAY_KEYS, PLAY_ORDER, out="pos",
                         total="play_rows", chunk_rows=chunk_rows)
        df = _cut_play(df, chunk_rows) if "chunk" in df.columns else _whole_play(df)
        df = df.drop("pos", "play_rows", "chunk")
    else:
        df = _whole_play(df)
    return _moves(df)


def _moves(df: DataFrame) -> DataFrame:
    zone_, next_zone = F.col("zone"), F.col("next_zone")
    same_side = F.col("byUs") == F.col("next_side")
    passed = F.col("adjPass") == 1
    closing = F.col("sequenceNumber") == F.col("maxSequenceNumber")
    received = (F.col("sequenceNumber") == 1) & (F.col("adjEventName") == "first touch")

    def moves(cond: Column) -> Column:
        return F.when(closing, 0).otherwise(open_flag(cond & same_side))

    def channel(start: int, ends: list[int]) -> Column:
        into = F.coalesce(next_zone.isin(ends), F.lit(False))
        return moves((zone_ == start) & into)

    def enters(target: int) -> Column:
        return (zone_ != target) & (next_zone == target)

    def moved(start: str, end: str) -> Column:
        return passed & (F.col("playArea") == start) & (F.col("next_area") == end)

    return df.withColumns({
        "backPassTurnover": open_flag((F.col("isBackPass") == 1) & received),
        "fwdPassTurnover": open_flag((F.col("isFwdPass") == 1) & received),
        "sidePassTurnover": open_flag((F.col("isSidePass") == 1) & received),
        "rightAttack": channel(10, [13, 16]),
        "middleAttack": channel(11, [14, 17]),
        "leftAttack": channel(12, [15, 18]),
        "isZone14Incursion": moves(enters(14)),
        "isZone17Incursion": moves(enters(17)),
        "isZone11PassIncursion": moves(enters(11) & passed),
        "isBackKeeperPass": moves(enters(2) & passed),
        "Movement": F.when((F.col("playNumber") == 0) | closing, "")
        .when(moved("Defence", "Midfield"), "D-M")
        .when(moved("Midfield", "Defence"), "M-D")
        .when(moved("Midfield", "Attack"), "M-A")
        .when(moved("Attack", "Midfield"), "A-M")
        .otherwise(""),
    }).drop("next_zone", "next_side", "next_area")
