"""The seven end-user reports, as functions of their inputs.

Every filter is optional, so a report runs over one match, one opponent or the
whole table with the same plan; filters on plain columns reach the scan of the
stage table they are applied to.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.constants import (
    BOYS_13, BOYS_14, FOUL_RESTARTS, GIRLS_16, HOME_TEAM, TOP_FLIGHT,
)
from touchline.functions.exprs import ratio
from touchline.operators.density import BANDWIDTH, density_grid
from touchline.operators.enrich import PLAY_ORDER, mirror_opposition
from touchline.operators.slices import CHUNK_ROWS, at_home, number_rows, with_halo
from touchline.plans.registry import STATS

ALL = "All"
SIDE = {"true": "Us", "false": "Opponents"}


# --------------------------------------------------------------------------
# filters
# --------------------------------------------------------------------------
def by_phase(df: DataFrame, phase: str = "all") -> DataFrame:
    if phase == "all":
        return df
    events = FOUL_RESTARTS if phase == "foul" else [phase]
    return df.filter(F.col("firstEvent").isin(events))


def by_outcome(df: DataFrame, outcome: str = ALL) -> DataFrame:
    if outcome == "goal":
        return df.filter(F.col("isGoal") == 1)
    if outcome == "AttackIncursion":
        return df.filter(F.col("isAttackIncursion") == 1)
    return df


def by_value(df: DataFrame, column: str, value: str = ALL) -> DataFrame:
    return df if value == ALL else df.filter(F.col(column) == value)


def time_slice(df: DataFrame, start_pct: float, end_pct: float) -> DataFrame:
    """Rows inside a relative part of their match's time span.

    The bounds are one row per match and are joined on the match name, so
    there is no cross join and no window over a whole match.
    """
    if (start_pct, end_pct) == (0, 100):
        return df
    spans = df.groupBy("matchName").agg(
        F.min("epochTime").alias("_from"), F.max("epochTime").alias("_to"))
    length = F.col("_to") - F.col("_from")
    return (
        df.join(spans, "matchName")
        .filter((F.col("epochTime") >= F.col("_from") + length * start_pct / 100)
                & (F.col("epochTime") <= F.col("_from") + length * end_pct / 100))
        .drop("_from", "_to")
    )


# --------------------------------------------------------------------------
# 1 passing breakdown
# --------------------------------------------------------------------------
def passing_breakdown(
    plays: DataFrame, phase: str = "all", include_no_pass: bool = True,
    opponent: str = ALL,
) -> DataFrame:
    """How many passes possessions have, per side, as counts and shares."""
    df = by_value(by_phase(plays, phase), "theirName", opponent)
    if not include_no_pass:
        df = df.filter(F.col("totalPasses") > 0)
    return distribution(df, "totalPasses", "playByUs")


def distribution(df: DataFrame, value: str, side: str) -> DataFrame:
    """Rows per value, and their share of the side's rows.

    The side total is summed over the counted rows, not over the input.
    """
    return (
        df.groupBy(side, value).agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("max_tp", F.sum("cnt").over(Window.partitionBy(side)))
        .withColumn("perc", ratio(F.col("cnt"), F.col("max_tp")))
    )


# --------------------------------------------------------------------------
# 2 heat map
# --------------------------------------------------------------------------
def heat_map(
    enriched: DataFrame, side: str, phase: str = "all", include_no_pass: bool = True,
    outcome: str = ALL, just_first: bool = False, opponent: str = ALL,
    match: str = ALL, columns: int = 22, rows: int = 15,
    bandwidth: float = BANDWIDTH,
) -> DataFrame:
    df = by_outcome(by_phase(enriched, phase), outcome)
    if not include_no_pass:
        df = df.filter(F.col("numberPasses") > 0)
    if just_first:
        df = df.filter(F.col("sequenceNumber") == 1)
    df = by_value(by_value(df, "theirName", opponent), "matchName", match)
    points = mirror_opposition(df.filter(F.col("playByUs") == side))
    return density_grid(points, columns, rows, bandwidth)


# --------------------------------------------------------------------------
# 3 play map
# --------------------------------------------------------------------------
def play_map(
    enriched: DataFrame, match: str = ALL, phase: str = "all", outcome: str = ALL,
    start_pct: float = 0, end_pct: float = 100, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Segments from each event of a play to the next one.

    The rows are read twice (the size of the largest play decides how), so
    pass a staged table.
    """
    df = by_value(by_outcome(by_phase(enriched, phase), outcome), "matchName", match)
    df = time_slice(df, start_pct, end_pct)
    # Rows outside plays are their own last row and never draw a segment.
    df = mirror_opposition(df.filter(F.col("playNumber") > 0))
    keys, order = ["gameID", "playNumber"], PLAY_ORDER
    df = number_rows(df, keys, order, "pos", "play_rows", chunk_rows)
    split = "chunk" in df.columns
    if split:
        df = with_halo(df, "pos", before=0, after=1, chunk_rows=chunk_rows)
        keys, order = [*keys, "slot"], ["pos"]
    step = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumns({"x1": F.lead("lengthMetres").over(step),
                         "y1": F.lead("widthMetres").over(step)})
    if split:
        df = at_home(df)
    return df.filter(F.col("sequenceNumber") != F.col("maxSequenceNumber")).select(
        "matchName", "gameID", "playNumber", "sequenceNumber", "ord", "pseudoEvent",
        F.col("lengthMetres").alias("x"), F.col("widthMetres").alias("y"),
        "x1", "y1", "playByUs")


def scoreboard(enriched: DataFrame, match: str = ALL) -> DataFrame:
    """Goals of both sides, per match."""
    goal = F.col("adjEventName") == "goal"

    def scored(side: str) -> Column:
        return F.sum(F.when(goal & (F.col("playByUs") == side), F.col("isGoal"))
                     .otherwise(0))

    return by_value(enriched, "matchName", match).groupBy("matchName").agg(
        scored("true").alias("our_goals"), scored("false").alias("their_goals"))


# --------------------------------------------------------------------------
# 4 and 5 stacked statistics
# --------------------------------------------------------------------------
def stacked(
    df: DataFrame, ids: Sequence[str], stats: Sequence[str], category: str,
    as_share: bool, extra: Sequence[str] = (),
) -> DataFrame:
    """Metric families in long form, with labels and display order.

    ``as_share`` turns each bar into parts of its family, category and side;
    families that only make sense as counts stay counts.  Bar totals are
    grouped sums joined back while the rows are still wide (many games can
    share a category, and a window would sort them all in one task), so the
    unpivot comes last and moves nothing.
    """
    wanted = [(s, c) for s in stats for c in STATS[s].labels]
    shared = [(s, c) for s, c in wanted if as_share and STATS[s].kind != "count"]
    values = {c: F.col(c).cast("double") for _, c in wanted}
    if shared:
        if f"_all_{shared[0][1]}" not in df.columns:
            bar = [category, "playByUs"]
            df = df.join(df.groupBy(*bar).agg(*[
                F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(f"_all_{c}")
                for _, c in shared]), bar)
        for stat, column in shared:
            parts = [F.col(f"_all_{c}") for c in STATS[stat].labels]
            values[column] = ratio(values[column], reduce(lambda a, b: a + b, parts))
    bars = [
        F.struct(
            F.lit(stat).alias("stat"), F.lit(column).alias("Key"),
            F.lit(label).alias("label"), F.lit(place).alias("label_order"),
            values[column].alias("Measurement"))
        for stat in stats
        for place, (column, label) in enumerate(STATS[stat].labels.items(), 1)
    ]
    side = F.when(F.col("playByUs") == "true", SIDE["true"]).otherwise(SIDE["false"])
    return df.select(*ids, *extra, side.alias("side"), F.inline(F.array(*bars)))


def result_code(us: str, them: str) -> Column:
    """2 for a draw, 1 for a loss, 3 for a win (fixed values)."""
    us, them = F.col(us), F.col(them)
    return F.when(us == them, 2).when(us < them, 1).otherwise(3)


def match_results(games: DataFrame) -> DataFrame:
    """2 for a draw, 1 for a loss, 3 for a win; goals of both sides."""
    us = F.sum(F.when(F.col("playByUs") == "true", F.col("isGoal")).otherwise(0))
    them = F.sum(F.when(F.col("playByUs") == "false", F.col("isGoal")).otherwise(0))
    return games.groupBy("matchName", "gameDate").agg(
        us.alias("_us"), them.alias("_them")).select(
        "matchName", "gameDate", result_code("_us", "_them").alias("wld"))


def team_stats(
    games: DataFrame, stats: Sequence[str], as_share: bool = False
) -> DataFrame:
    """Stacked statistics per match, with the result and the display order.

    Rows are dealt by match once.  Everything that belongs to the match (results
    by date, the latest date, both sides' bar totals) becomes one row for it, and
    is joined once.  ``games`` is read twice, so pass a staged table.
    """
    games = games.repartition("matchName")
    shared = [c for s in stats for c in STATS[s].labels
              if as_share and STATS[s].kind != "count"]
    sides = {"us": "true", "them": "false"}

    def of_side(side: str, column: str) -> Column:
        return F.sum(F.when(F.col("playByUs") == sides[side], F.col(column)))

    days = games.groupBy("matchName", "gameDate").agg(
        *[F.coalesce(of_side(s, "isGoal"), F.lit(0)).alias(f"_{s}") for s in sides],
        *[of_side(s, c).cast("double").alias(f"_{s}_{c}") for s in sides for c in shared])
    matches = days.groupBy("matchName").agg(
        F.max("gameDate").alias("match_order"),
        F.collect_list(F.struct("gameDate", result_code("_us", "_them").alias("wld"))).alias("_days"),
        *[F.coalesce(F.sum(f"_{s}_{c}"), F.lit(0.0)).alias(f"_{s}_{c}")
          for s in sides for c in shared])
    placed = games.join(matches, "matchName").withColumns({
        "wld": F.get(F.filter("_days", lambda d: d["gameDate"].eqNullSafe(F.col("gameDate"))),
                     F.lit(0))["wld"],
        **{f"_all_{c}": F.when(F.col("playByUs") == "true", F.col(f"_us_{c}"))
           .when(F.col("playByUs") == "false", F.col(f"_them_{c}")) for c in shared}})
    return stacked(placed, ["gameID", "matchName", "playByUs", "gameDate"], stats,
                   "matchName", as_share, ["wld", "match_order"])


def age_stats(
    ages: DataFrame, stats: Sequence[str], as_share: bool = False
) -> DataFrame:
    """Stacked statistics per age group."""
    return stacked(ages, ["age_group", "playByUs"], stats, "age_group", as_share)


# --------------------------------------------------------------------------
# 6 game possession
# --------------------------------------------------------------------------
POSSESSION_PAIRS = {
    "all": ["ourPossession", "theirPossession"],
    "defPossession": ["ourDefensivePossession", "theirDefensivePossession"],
    "attPossession": ["ourAttackingPossession", "theirAttackingPossession"],
}


def game_possession(
    enriched: DataFrame, kind: str = "all", match: str = ALL
) -> DataFrame:
    """Possession series of both sides in long form."""
    return by_value(enriched, "matchName", match).unpivot(
        ["matchName", "gameID", "ord", "pseudoEvent", "epochTime"],
        POSSESSION_PAIRS[kind], "TeamPossession", "TimePossesion")


# --------------------------------------------------------------------------
# inputs of the reports
# --------------------------------------------------------------------------
def pick_list(enriched: DataFrame, column: str) -> DataFrame:
    """Distinct choices with the place they first appear at.

    Order by the place columns, ascending for opponents and descending for
    matches.  Play and sequence share one long, so the pass over the events is
    a hash aggregate; only the (choice, game) rows left are compared as structs.
    """
    at = F.shiftleft(F.col("playNumber").cast("long"), 31) + F.col("sequenceNumber")
    games = enriched.groupBy(F.col(column).alias("choice"), "gameID").agg(
        F.min(at).alias("at"))
    first = games.groupBy("choice").agg(F.min(F.struct("gameID", "at")).alias("p"))
    return first.select(
        "choice", "p.gameID",
        F.shiftright("p.at", 31).cast("int").alias("playNumber"),
        (F.col("p.at") % (1 << 31)).cast("int").alias("sequenceNumber"))


def team_priority(
    plays: DataFrame, competition: str = GIRLS_16, team: str = HOME_TEAM
) -> DataFrame:
    """Display order of teams: own team, youth, friendlies, cup, the rest."""
    c = F.col("competition")
    order = (
        F.when((c == competition) & (F.col("teamName") == team), 0)
        .when(c.isin(BOYS_13, GIRLS_16, BOYS_14), 1)
        .when(c == TOP_FLIGHT[1], 2)
        .when(c == TOP_FLIGHT[2], 3)
        .otherwise(4)
    )
    return plays.withColumn("orderCol", order)
