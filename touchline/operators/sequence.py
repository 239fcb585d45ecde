"""Possession sequencing: from an ordered event log to numbered plays.

The rules read the *rewritten* previous name and the *raw* next name, which
looks recursive.  Only a few names matter to a successor, though, and each can
be told from at most four rows back, so the whole thing is a short cascade of
lag/lead and running-sum columns: no UDF, and one shuffle (by game).

A game that outgrows one task arrives with a ``chunk`` column (see
``slices``).  Then look-around columns use copied border rows, and the running
state (play number, half, sequence, player, phases) enters each chunk from a
scan over one summary row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.constants import (
    BOX_DEPTH, BOX_FAR, BOX_NEAR, CLEARANCE_FRACTION, CLEARANCE_GAIN,
    CLEARANCE_METRES, DEAD_BALLS, DRIBBLE_METRES, DRIBBLE_SPEED, ENDS, FOULS,
    INCURSION_FRACTION, OUTS, PASSING_EVENTS, PITCH_LENGTH, PITCH_WIDTH,
    SAME_PLAYER_AFTER, SAME_PLAYER_EVENTS,
)
from touchline.functions.exprs import flag, one_of, sure
from touchline.operators.slices import CHUNK_ROWS, at_home, stage, with_halo

# Which rule a row fell under; the order of the cascade is in `_rule`.
OPENING = [
    "first kick off", "throw in", "goal kick", "corner kick", "penalty kick",
    "missed punt", "punt", "foul restart", "second half", "after goal",
    "turnover",
]
IDLE = ["not started", "end", "held"]
LOOK_BACK, LOOK_AHEAD = 4, 2


def reclassified_name() -> Column:
    """A dribble that is too fast or too long counts as a first touch.

    Speed is compared by multiplication, so a zero duration needs no division.
    """
    metres = F.col("distanceToNextEventMetres")
    fast = (metres > DRIBBLE_SPEED * F.col("duration")) | (metres > DRIBBLE_METRES)
    dribble = F.col("eventName") == "dribble"
    return F.when(dribble & fast, "first touch").otherwise(F.col("eventName"))


def _outside_box() -> Column:
    return sure(
        (F.col("lengthMetres") > BOX_DEPTH)
        | (F.col("widthMetres") > BOX_FAR)
        | (F.col("widthMetres") < BOX_NEAR)
    )


def _kick_offs(named: DataFrame) -> DataFrame:
    """Ordinal of each game's first touch of the ball, one row per chunk."""
    touch = F.when(F.col("name") == "first touch", F.col("ord"))
    return (
        named.groupBy("gameID", "chunk").agg(F.min(touch).alias("kick"))
        .select("gameID", F.col("chunk").alias("slot"),
                F.min("kick").over(Window.partitionBy("gameID")).alias("kick"))
    )


def _named(feed: DataFrame, split: bool, chunk_rows: int) -> DataFrame:
    """Rule and final name of every row (bounded look-around only)."""
    df = feed.withColumn("name", reclassified_name())
    if split:
        seen = with_halo(df, "ord", LOOK_BACK, LOOK_AHEAD, chunk_rows)
        df = seen.join(_kick_offs(df), ["gameID", "slot"])
        order = Window.partitionBy("gameID", "slot").orderBy("ord")
    else:
        game = Window.partitionBy("gameID")
        touch = F.when(F.col("name") == "first touch", F.col("ord"))
        df = df.withColumn("kick", F.min(touch).over(game))
        order = game.orderBy("ord")
    name, by = F.col("name"), F.col("byUs")

    df = df.withColumns({
        "prev_name": F.lag("name").over(order),
        "next_name": F.lead("name").over(order),
        "prev_by": F.lag("byUs").over(order),
        "next_by": F.lead("byUs").over(order),
        "outside": _outside_box(),
        "live": sure(F.col("ord") > F.col("kick")),
    })
    live, next_name = F.col("live"), F.col("next_name")
    df = df.withColumns({
        "swapped": sure(by != F.col("prev_by")),
        "next_outside": F.lead("outside", 1, False).over(order),
        "cleared": sure(
            (by != F.col("next_by"))
            & (F.col("distance") >= CLEARANCE_METRES)
            & (F.col("lengthChangeMetres") > CLEARANCE_GAIN)
            & (F.col("lengthFraction") <= CLEARANCE_FRACTION)
        ),
    })
    keeper = live & (name == "keeper")
    punted = F.col("next_outside") & next_name.isNotNull() & ~one_of(next_name, ENDS)
    df = df.withColumns({"missed": keeper & punted, "held": keeper & ~punted})
    df = df.withColumn("prev_held", F.lag("held", 1, False).over(order))
    df = df.withColumn(
        "foul",
        live & one_of(name, FOULS) & ~F.col("prev_held")
        & ~next_name.eqNullSafe("keeper"),
    )
    df = df.withColumn("prev_foul", F.lag("foul", 1, False).over(order))
    renamed = F.col("swapped") & ~one_of(next_name, OUTS) & F.col("cleared")
    df = df.withColumn("dead_ball", F.when(
        live & one_of(name, DEAD_BALLS)
        & ~F.col("prev_held") & ~F.col("prev_foul") & ~renamed, name))
    df = df.withColumn("prev_dead", F.lag("dead_ball").over(order))
    df = df.withColumn("rule", _rule()).withColumn("named", _name_by_rule())
    df = df.withColumns({
        "prev_rule": F.lag("rule").over(order),
        "prev_named": F.lag("named").over(order),
    })
    adjusted = F.when(
        (F.col("prev_rule") == "last action") & (F.col("named") == "sideline out"),
        "sideline out defence",
    ).otherwise(F.col("named"))
    df = df.withColumn("adjEventName", adjusted)
    return at_home(df) if split else df


def _rule() -> Column:
    """First matching rule wins."""
    name, next_name = F.col("name"), F.col("next_name")
    touch = name == "first touch"
    dead = F.col("prev_dead")
    return (
        F.when(F.col("ord") == F.col("kick"), "first kick off")
        .when(~F.col("live"), "not started")
        .when(one_of(name, ENDS), "end")
        .when(touch & (dead == "sideline out"), "throw in")
        .when(touch & (dead == "goalkick"), "goal kick")
        .when(touch & (dead == "corner"), "corner kick")
        .when(touch & (dead == "penalty"), "penalty kick")
        .when(F.col("missed"), "missed punt")
        .when(F.col("held"), "held")
        .when(next_name == "keeper", "catch")
        .when(F.col("prev_held") & ~F.col("outside"), "punt")
        .when(one_of(name, FOULS), "foul")
        .when(F.col("prev_foul"), "foul restart")
        .when(touch & (F.col("prev_name") == "change ends"), "second half")
        .when(touch & (dead == "goal"), "after goal")
        .when(one_of(next_name, OUTS) & F.col("swapped"), "last action")
        .when(~F.col("swapped"), "same side")
        .otherwise("turnover")
    )


def _name_by_rule() -> Column:
    rule = F.col("rule")
    restart = (
        F.when(F.col("prev_name") == "offside", "offside restart")
        .when(F.col("prev_name") == "direct freekick", "direct restart")
        .otherwise("indirect restart")
    )
    return (
        F.when(rule.isin("first kick off", "second half", "after goal"), "kick off")
        .when(rule.isin("throw in", "goal kick", "corner kick", "penalty kick"), rule)
        .when(rule.isin("missed punt", "punt"), "keeper punt")
        .when(rule == "catch", "keeper catch")
        .when(rule == "foul restart", restart)
        .when((rule == "turnover") & F.col("cleared"), "clearance")
        .otherwise(F.col("name"))
    )


def _player_step() -> Column:
    name = F.when(F.col("adjEventName") == "sideline out defence",
                  F.col("adjEventName")).otherwise(F.col("name"))
    stays = (
        (one_of(F.col("prev_named"), SAME_PLAYER_AFTER) & (name == "dribble"))
        | one_of(name, SAME_PLAYER_EVENTS)
    )
    return (
        F.when(F.col("idle") | (F.col("rule") == "foul"), 0)
        .when((F.col("rule") == "same side") & stays, 0)
        .otherwise(1)
    )


def _opening_phase(for_us: bool) -> Column:
    """Phase of play a new play starts in, for us or for the opposition."""
    rule = F.col("rule")
    has_ball = F.col("byUs") == ("true" if for_us else "false")
    return (
        F.when(F.col("idle"), "")
        .when(rule == "turnover", F.when(has_ball, "BPO > BP").otherwise("BP > BPO"))
        .when((rule == "second half") & (F.col("byUs") != "true"), "")
        .otherwise(F.when(has_ball, "BP").otherwise("BPO"))
    )


def _runs(df: DataFrame, split: bool) -> DataFrame:
    """Running counters, local to a game or, when split, to a chunk."""
    game = ["gameID", "chunk"] if split else ["gameID"]
    order = Window.partitionBy(*game).orderBy("ord")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({
        "opens": F.col("rule").isin(OPENING),
        "idle": F.col("rule").isin(IDLE),
    })
    switch = (F.col("rule") == "end") & (F.col("name") == "change ends")
    df = df.withColumns({
        "step": _player_step(),
        "switch": flag(switch),
        "us_open": _opening_phase(True),
        "opp_open": _opening_phase(False),
        "run": F.sum(flag(F.col("opens"))).over(so_far),
        "stretch": F.sum(flag(F.col("opens") | F.col("idle"))).over(so_far),
        "switches": F.coalesce(F.sum(flag(switch)).over(earlier), F.lit(0)),
    })
    inside = Window.partitionBy(*game, "stretch").orderBy("ord")
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fouled = F.max(flag(F.col("rule") == "foul")).over(until) == 1
    return df.withColumns({
        "nth": F.row_number().over(inside) - flag(F.first("idle").over(until)),
        "steps": F.sum("step").over(until),
        "fouled": fouled,
        "us_run": F.when(fouled, "").otherwise(F.first("us_open").over(until)),
        "opp_run": F.when(fouled, "").otherwise(F.first("opp_open").over(until)),
    })


def _carried(df: DataFrame) -> DataFrame:
    """State entering each chunk, from one summary row per chunk.

    A chunk without any play start or idle row only extends the state it was
    given, so chunks are grouped by the last chunk that had one.
    """
    tail = ["stretch", "nth", "steps", "fouled", "us_run", "opp_run"]
    chunks = (
        df.groupBy("gameID", "chunk").agg(
            F.max_by(F.struct(*tail), "ord").alias("tail"),
            F.max("run").alias("plays"), F.sum("switch").alias("ends"))
        .select("gameID", "chunk", "plays", "ends", "tail.*")
    )
    order = Window.partitionBy("gameID").orderBy("chunk")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("stretch") > 0
    chunks = chunks.withColumns({
        "base": F.sum(flag(own)).over(so_far),
        "in_run": F.coalesce(F.sum("plays").over(earlier), F.lit(0)),
        "in_switches": F.coalesce(F.sum("ends").over(earlier), F.lit(0)),
    })
    since = (Window.partitionBy("gameID", "base").orderBy("chunk")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later_foul = F.max(flag(~own & F.col("fouled"))).over(since) == 1
    chunks = chunks.withColumns({
        "out_seq": F.sum("nth").over(since),
        "out_player": F.sum("steps").over(since),
        "out_us": F.when(later_foul, "").otherwise(F.first("us_run").over(since)),
        "out_opp": F.when(later_foul, "").otherwise(F.first("opp_run").over(since)),
    })
    return chunks.select(
        "gameID", "chunk", "in_run", "in_switches",
        *[F.lag(f"out_{c}").over(order).alias(f"in_{c}")
          for c in ("seq", "player", "us", "opp")])


def sequence_events(feed: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number plays, sequences and players; add turnover pseudo-events."""
    split = "chunk" in feed.columns
    df = _runs(_named(feed, split, chunk_rows), split)
    if split:
        # Read twice: for the rows and for the chunk summaries.
        df = stage(df)

    run, switches = F.col("run"), F.col("switches")
    nth, steps = F.col("nth"), F.col("steps")
    us, opp = F.col("us_run"), F.col("opp_run")
    if split:
        df = df.join(_carried(df), ["gameID", "chunk"])
        run, switches = run + F.col("in_run"), switches + F.col("in_switches")
        entered = F.col("stretch") == 0
        nth = F.when(entered, F.col("in_seq") + nth).otherwise(nth)
        steps = F.when(entered, F.col("in_player") + steps).otherwise(steps)
        us = F.when(entered & ~F.col("fouled"), F.col("in_us")).otherwise(us)
        opp = F.when(entered & ~F.col("fouled"), F.col("in_opp")).otherwise(opp)
    df = df.withColumns({
        "half": (switches + 1).cast("int"),
        "run": run.cast("int"),
        "playNumber": F.when(F.col("idle"), 0).otherwise(run).cast("int"),
        "sequenceNumber": F.when(F.col("idle"), 0).otherwise(nth).cast("int"),
        "player": steps.cast("int"),
        "usPhase": us,
        "oppositionPhase": opp,
    })

    order = Window.partitionBy("gameID", *(["chunk"] if split else [])).orderBy("ord")

    def before(column: str, entering: str) -> Column:
        value = F.lag(column).over(order)
        return F.coalesce(value, F.col(entering)) if split else value

    df = df.withColumns({
        "last_seq": before("sequenceNumber", "in_seq"),
        "last_player": before("player", "in_player"),
        "last_us": before("usPhase", "in_us"),
        "last_opp": before("oppositionPhase", "in_opp"),
    })
    return _with_pseudo_events(_with_progress(df), feed.columns)


def _with_progress(df: DataFrame) -> DataFrame:
    """Completed passes and incursions, while rows still are the real rows."""
    keeps = (F.col("playNumber") > 0) & (F.col("byUs") == F.col("next_by"))
    in_box = (
        (F.col("lengthMetres") >= PITCH_LENGTH - BOX_DEPTH)
        & (F.col("widthMetres") <= BOX_FAR)
        & (F.col("widthMetres") >= BOX_NEAR)
    )
    return df.withColumns({
        "adjPass": flag(keeps & one_of(F.col("adjEventName"), PASSING_EVENTS)
                        & (F.col("next_name") == "first touch")),
        "attackIncursion": flag(keeps & (F.col("lengthFraction") >= INCURSION_FRACTION)),
        "penaltyIncursion": flag(keeps & in_box),
    })


def _with_pseudo_events(df: DataFrame, feed_columns: list[str]) -> DataFrame:
    """Close the old play of each turnover with a mirrored copy of the row.

    The copy is the second element of a one- or two-element array, so the
    cascade runs once; the game key stays outside the array and keeps the
    partitioning.
    """
    moved = ["lengthFraction", "lengthMetres", "widthFraction", "widthMetres"]
    changed = [
        *moved, "playNumber", "sequenceNumber", "player", "usPhase",
        "oppositionPhase", "adjEventName", "adjPass", "attackIncursion",
        "penaltyIncursion",
    ]
    copy = {
        "lengthFraction": 1 - F.col("lengthFraction"),
        "lengthMetres": PITCH_LENGTH - F.col("lengthMetres"),
        "widthFraction": 1 - F.col("widthFraction"),
        "widthMetres": PITCH_WIDTH - F.col("widthMetres"),
        "playNumber": F.col("run") - 1,
        "sequenceNumber": (F.col("last_seq") + 1).cast("int"),
        "player": (F.col("last_player") + 1).cast("int"),
        "usPhase": F.col("last_us"),
        "oppositionPhase": F.col("last_opp"),
        "adjEventName": F.lit("turnover"),
        "adjPass": F.lit(0),
        "attackIncursion": F.lit(0),
        "penaltyIncursion": F.lit(0),
    }
    real = F.struct(*[F.col(c) for c in changed], F.lit(False).alias("pseudoEvent"))
    pseudo = F.struct(*[copy[c].alias(c) for c in changed],
                      F.lit(True).alias("pseudoEvent"))
    versions = F.when(F.col("rule") == "turnover", F.array(real, pseudo)) \
        .otherwise(F.array(real))
    kept = [c for c in feed_columns if c not in moved]
    return (
        df.select(*kept, "half", F.explode(versions).alias("v"))
        .select(*kept, "half", "v.*")
    )
