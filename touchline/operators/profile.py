"""Match, team, age-group and game roll-ups of the play table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.constants import (
    FEATURE_KEYS, MATCH_DERIVED, MATCH_SUMS, MATCH_TEAM_KEYS, ODD_COMPETITION,
    PREDICTORS, TEAM_KEYS,
)
from touchline.functions.exprs import flag, ratio

# Ratio columns of a profile: name -> (numerator, denominator parts).  The
# denominator is the sum of the named totals; the name is built from the
# numerator, so "leftAttack_pcnt" really is the left share.
_LENGTHS = ["total10mPasses", "total10_20mPasses", "total20mPasses"]
_TURNOVERS = ["backPassTurnover", "sidePassTurnover", "fwdPassTurnover"]
_CHANNELS = ["rightAttack", "middleAttack", "leftAttack"]
_MOVES = ["MAPlay", "AMPlay", "MDPlay", "DMPlay"]
RATIOS: dict[str, tuple[str, list[str]]] = {
    "attackDuration_pcnt": ("AttackDuration", ["gameDuration"]),
    "midfieldDuration_pcnt": ("MidfieldDuration", ["gameDuration"]),
    "defenceDuration_pcnt": ("DefenceDuration", ["gameDuration"]),
    "AttackHalfDuration_pcnt": ("AttackHalfDuration", ["gameDuration"]),
    "DefenceHalfDuration_pcnt": ("DefenceHalfDuration", ["gameDuration"]),
    "attackDistance_pcnt": ("attackDistance", ["gameDistance"]),
    "midfieldDistance_pcnt": ("midfieldDistance", ["gameDistance"]),
    "defenceDistance_pcnt": ("defenceDistance", ["gameDistance"]),
    **{f"{c}_pcnt": (c, ["isAttackIncursion"]) for c in (
        "isZone17Incursion", "isZone14Incursion", "isZone11PassIncursion")},
    **{f"{c}_pcnt": (c, ["totalPasses"]) for c in (
        "totalBackPasses", "totalFwdPasses", "totalSidePasses")},
    **{f"{c}_pcnt": (c, _LENGTHS) for c in _LENGTHS},
    **{f"{c}_pcnt": (c, ["totalPasses"]) for c in (
        "attackPasses", "midfieldPasses", "defencePasses")},
    "crossfieldPlay_pcnt": ("crossfieldPlay", ["defencePasses"]),
    **{f"{c}_pcnt": (c, _TURNOVERS) for c in _TURNOVERS},
    **{f"{c}_pcnt": (c, _CHANNELS) for c in _CHANNELS},
    **{f"{c}_pcnt": (c, _MOVES) for c in _MOVES},
    "backKeeperPasses_pcnt": ("backKeeperPasses", ["totalBackPasses"]),
    **{f"{c}_pcnt": (c, ["plays"]) for c in (
        "clearances", "passZero", "pass1", "pass2_3", "pass4_6", "pass7Plus")},
}
LENIENT = [
    "distance", "attackDistance", "midfieldDistance", "defenceDistance",
    "isZone17Incursion", "isZone14Incursion", "isZone11PassIncursion",
]
_NAMED_TOTALS = {"gameDuration": "possessionDuration", "gameDistance": "distance"}
PROFILE_RATIOS = [*RATIOS, "passPlay_pcnt"]
# Distances and durations are doubles; every other summed column is an integer.
_DOUBLES = ("distance", "duration")
_TOTALS = ["gameDuration", "gameDistance", "plays", "goals", "shots", "totalPasses"]


def part(top: str, whole: str) -> str:
    """Division that is NULL for a zero denominator, as SQL text."""
    return f"try_divide(CAST({top} AS DOUBLE), CAST({whole} AS DOUBLE))"


def lenient(column: str) -> Column:
    """Sum that skips NULLs and is 0 when there is nothing to add."""
    zero = "0D" if column.lower().endswith(_DOUBLES) else "0L"
    return F.expr(f"coalesce(sum({column}), {zero})")


_NEEDED = sorted(
    ({t for t, _ in RATIOS.values()} | {p for _, ps in RATIOS.values() for p in ps}
     | {"goals", "shots", *_NAMED_TOTALS.values()})
    - {*_NAMED_TOTALS, "plays"})


def team_sums(plays: DataFrame, keys: Sequence[str], count: str = "count(1)") -> DataFrame:
    """What the profiles of the keys are made of: sums, and the number of plays.

    Every aggregate combines map-side, so the shuffle carries one row per key
    and task.  The text maxima make it a sort-based aggregate; grouping by game
    first would hash instead, but shuffles a row per game to save a local sort,
    and measured slower.
    """
    def total(column: str) -> Column:
        if column in LENIENT:
            return lenient(column)
        return F.expr(f"CASE WHEN count({column}) = count(1) THEN sum({column}) END")

    return plays.groupBy(*keys).agg(
        F.min("gameDate").alias("gameDate"),
        F.max("theirName").alias("theirName"),
        F.max("matchName").alias("matchName"),
        F.expr(count).alias("plays"),
        *[total(c).alias(c) for c in _NEEDED],
    )


def merged_team_sums(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sums of tables of ``team_sums`` put together: an unknown sum stays unknown."""
    return team_sums(parts, keys, "sum(plays)")


def team_rates(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals, rates and ratio columns of the sums."""
    sums = sums.withColumnsRenamed({src: n for n, src in _NAMED_TOTALS.items()})
    return sums.selectExpr(
        *keys, "gameDate", "theirName", "matchName", *_TOTALS,
        f"{part('totalPasses', 'gameDuration / 60')} AS ppm",
        f"{part('gameDistance', 'gameDuration')} AS aveVelocity",
        *[f"{part(top, ' + '.join(parts))} AS {n}" for n, (top, parts) in RATIOS.items()],
        f"1 - {part('passZero', 'plays')} AS passPlay_pcnt",
    )


def team_profiles(plays: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals, rates and ratio columns of the plays of each key."""
    return team_rates(team_sums(plays, keys), keys)


def result_label(goals: Column, total: Column) -> Column:
    part = ratio(goals, total)
    return (F.when((total == 0) | (part == 0.5), "Draw")
            .when(part < 0.5, "Loss").otherwise("Win"))


def match_team_profile(plays: DataFrame) -> DataFrame:
    match = Window.partitionBy("competition", "gameID")
    return team_profiles(plays, MATCH_TEAM_KEYS).withColumn(
        "result", result_label(F.col("goals"), F.sum("goals").over(match)))


def team_profile(plays: DataFrame) -> DataFrame:
    return team_profiles(plays, TEAM_KEYS)


# --------------------------------------------------------------------------
# every numeric column, summed
# --------------------------------------------------------------------------
def with_goal_origins(plays: DataFrame) -> DataFrame:
    """Where goals start: by area, and from open play or a restart."""
    goal, open_play = F.col("isGoal") == 1, F.col("firstEvent") == "first touch"
    return plays.withColumns({
        "goalAttack": flag(goal & (F.col("Area") == "Attack")),
        "goalMidfield": flag(goal & (F.col("Area") == "Midfield")),
        "goalDefence": flag(goal & (F.col("Area") == "Defence")),
        "goalTurnover": flag(goal & open_play),
        "goalRestart": flag(goal & ~open_play),
    })


def numeric_columns(df: DataFrame, without: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in without]


def numeric_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-skipping sums of all numeric columns (of plays, or of such sums)."""
    return rows.groupBy(*keys).agg(*[lenient(c).alias(c) for c in numeric_columns(rows, keys)])


def numeric_rates(sums: DataFrame) -> DataFrame:
    """The sums, plus pass and ball rates."""
    def per_minute(passes: str, seconds: str) -> Column:
        return F.expr(part(passes, f"{seconds} / 60"))

    def velocity(metres: str, seconds: str) -> Column:
        return F.expr(part(metres, seconds))

    return sums.withColumns({
        "ppm": per_minute("totalPasses", "possessionDuration"),
        "ppmAttack": per_minute("attackPasses", "AttackDuration"),
        "ppmMidfield": per_minute("midfieldPasses", "MidfieldDuration"),
        "ppmDefence": per_minute("defencePasses", "DefenceDuration"),
        "aveVelocity": velocity("distance", "possessionDuration"),
        "attackVelocity": velocity("attackDistance", "AttackDuration"),
        "midfieldVelocity": velocity("midfieldDistance", "MidfieldDuration"),
        "defenceVelocity": velocity("defenceDistance", "DefenceDuration"),
    })


def numeric_totals(plays: DataFrame, keys: Sequence[str]) -> DataFrame:
    return numeric_rates(numeric_sums(plays, keys))


AGE_KEYS = ["age_group", "playByUs"]


def age_sums(plays: DataFrame) -> DataFrame:
    return numeric_sums(with_goal_origins(plays), AGE_KEYS)


def age_totals(plays: DataFrame) -> DataFrame:
    return numeric_rates(age_sums(plays))


def game_totals(plays: DataFrame) -> DataFrame:
    dated = with_goal_origins(plays).withColumn(
        "gameDate", F.date_format("gameDate", "yyyy-MM-dd"))
    return numeric_totals(dated, ["gameID", "matchName", "playByUs", "gameDate"])


# --------------------------------------------------------------------------
# match features
# --------------------------------------------------------------------------
def match_sums(plays: DataFrame) -> DataFrame:
    """One row per team and match: named sums and four derived columns."""
    dated = plays.withColumn("gameDate", F.date_format("gameDate", "yyyy-MM-dd"))
    sums = [lenient(c).alias(c) for c in MATCH_SUMS]
    return dated.groupBy(*FEATURE_KEYS).agg(*sums).withColumns({
        "ppm": F.expr(part("totalPasses", "possessionDuration / 60")),
        "aveVelocity": F.expr(part("distance", "possessionDuration")),
        "zone14_17": F.col("isZone17Incursion") + F.col("isZone14Incursion"),
        "goal_shots": F.col("goals") + F.col("shots"),
    })


def match_features(plays: DataFrame) -> DataFrame:
    """Each side's share of the match total, and the result label.

    The pair total is a window sum over the rows of one match, not a join.
    """
    match = Window.partitionBy("competition", "gameID")
    rows = match_sums(plays).withColumn("goal_total", F.sum("goals").over(match))
    pair = "OVER (PARTITION BY competition, gameID)"

    def share_of_pair(c: str) -> str:
        known = f"sum({c}) {pair}"
        if c in ("ppm", "aveVelocity"):  # the others are sums, never NULL
            known = f"CASE WHEN count({c}) {pair} = count(1) {pair} THEN {known} END"
        return f"CASE WHEN {c} = 0 THEN 0D ELSE {part(c, known)} END AS {c}_pcnt"

    result = result_label(F.col("goals"), F.col("goal_total"))
    return rows.withColumn("result", result).selectExpr(
        *FEATURE_KEYS, "result",
        "CASE result WHEN 'Draw' THEN 1 WHEN 'Loss' THEN 0 ELSE 2 END AS default",
        *[share_of_pair(c) for c in (*MATCH_SUMS, *MATCH_DERIVED)],
    )


def labelled_predictors(features: DataFrame) -> DataFrame:
    """Predictor columns and label, without the competition of odd games."""
    return (features.filter(F.col("competition") != ODD_COMPETITION)
            .select("gameID", "teamName", "playByUs", "gameDate", "default",
                    *PREDICTORS))
