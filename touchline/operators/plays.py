"""Play roll-up: one row per possession sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.constants import (
    CROSSFIELD_METRES, HALFWAY, NOT_CARRIED_BEFORE, PLAY_KEYS,
)
from touchline.functions.exprs import choose, flag, one_of, strict_max, strict_sum

# play column <- enriched column that is the same on every event of the play
CONSTANT = {
    "age_group": "age_group", "gameDate": "gameDate", "playByUs": "playByUs",
    "matchName": "playMatch", "usPhase": "firstUsPhase", "half": "firstHalf",
    "oppositionPhase": "firstOppositionPhase", "firstEvent": "firstEvent",
    "lastEvent": "lastEvent", "Area": "firstArea", "lastArea": "lastArea",
    "firstPenalyIncursion": "firstPenalyIncursion", "firstZone": "firstZone",
    "lastZone": "lastZone",
}

# Flags that may be unknown are summed strictly; the rest never are NULL.
SUMS = {
    "totalBackPasses": "isBackPass", "totalFwdPasses": "isFwdPass",
    "totalSidePasses": "isSidePass", "total10mPasses": "isPass10m",
    "total10_20mPasses": "isPass10_20m", "total20mPasses": "isPass20m",
    "backKeeperPasses": "isBackKeeperPass",
}
KNOWN_SUMS = {"totalPasses": "adjPass", "playDuration": "duration"}
MAXES = {
    "backPassTurnover": "backPassTurnover", "fwdPassTurnover": "fwdPassTurnover",
    "sidePassTurnover": "sidePassTurnover", "rightAttack": "rightAttack",
    "middleAttack": "middleAttack", "leftAttack": "leftAttack",
}
KNOWN_MAXES = {
    "isAttackIncursion": "attackIncursion", "isGoal": "isGoal",
    "isPenaltyIncursion": "penaltyIncursion",
}
MOVES = {"MAPlay": "M-A", "AMPlay": "A-M", "MDPlay": "M-D", "DMPlay": "D-M"}
EVENT_COUNTS = {"goals": "goal", "shots": "shot", "clearances": "clearance"}

PLAY_COLUMNS = [
    "gameID", "competition", "age_group", "ourName", "theirName", "playNumber",
    "gameDate", "playByUs", "matchName", "teamName", "usPhase", "half",
    "oppositionPhase", "firstEvent", "lastEvent", "Area", "lastArea",
    "firstEventArea", "firstPenalyIncursion", "firstZone", "lastZone",
    "numSequences", "numPlayers", "distance", "attackDistance",
    "midfieldDistance", "defenceDistance", "isAttackIncursion", "isGoal",
    "isPenaltyIncursion", "isZone17Incursion", "isZone14Incursion",
    "isZone11PassIncursion", "playPhase", "totalPasses", "totalBackPasses",
    "totalFwdPasses", "totalSidePasses", "total10mPasses", "total10_20mPasses",
    "total20mPasses", "possessionDuration", "AttackDuration",
    "MidfieldDuration", "DefenceDuration", "AttackHalfDuration",
    "DefenceHalfDuration", "playDuration", "attackPasses", "midfieldPasses",
    "defencePasses", "crossfieldPlay", "goals", "shots", "backPassTurnover",
    "fwdPassTurnover", "sidePassTurnover", "rightAttack", "middleAttack",
    "leftAttack", "defenceOut", "MAPlay", "AMPlay", "MDPlay", "DMPlay",
    "backKeeperPasses", "clearances", "passZero", "pass1", "pass2_3",
    "pass4_6", "pass7Plus",
]


def roll_up_plays(enriched: DataFrame) -> DataFrame:
    """All play columns in one grouped pass.

    Values of the first and last event are already on every row of the play,
    so they group rather than aggregate.  Every aggregate combines map-side: a
    very long play costs one row per task in the shuffle.
    """
    area = F.col("playArea")
    ours = (F.col("playByUs") == F.col("byUs")) \
        & ~one_of(F.col("next_event"), NOT_CARRIED_BEFORE)

    def carried(value: str, where: Column | None = None) -> Column:
        cond = ours if where is None else ours & where
        return choose(cond, F.col(value), F.lit(0.0))

    def in_area(name: str) -> Column:
        return F.sum(F.when(area == name, F.col("adjPass")).otherwise(0))

    metres, seconds = "distanceToNextEventMetres", "duration"
    far_half = F.col("lengthMetres") >= HALFWAY
    sums = {
        "distance": strict_sum(carried(metres)),
        "attackDistance": strict_sum(carried(metres, area == "Attack")),
        "midfieldDistance": strict_sum(carried(metres, area == "Midfield")),
        "defenceDistance": strict_sum(carried(metres, area == "Defence")),
        "possessionDuration": strict_sum(carried(seconds)),
        "AttackDuration": strict_sum(carried(seconds, area == "Attack")),
        "MidfieldDuration": strict_sum(carried(seconds, area == "Midfield")),
        "DefenceDuration": strict_sum(carried(seconds, area == "Defence")),
        "AttackHalfDuration": strict_sum(carried(seconds, far_half)),
        "DefenceHalfDuration": strict_sum(carried(seconds, ~far_half)),
        "attackPasses": in_area("Attack"),
        "midfieldPasses": in_area("Midfield"),
        "defencePasses": in_area("Defence"),
    }
    grouped = (
        enriched.filter(F.col("playNumber") != 0)
        .groupBy(*PLAY_KEYS, *CONSTANT.values())
        .agg(
            F.max("sequenceNumber").alias("numSequences"),
            F.max("player").alias("numPlayers"),
            *[c.alias(n) for n, c in sums.items()],
            *[strict_sum(F.col(c)).alias(n) for n, c in SUMS.items()],
            *[F.sum(c).alias(n) for n, c in KNOWN_SUMS.items()],
            *[F.max(c).alias(n) for n, c in KNOWN_MAXES.items()],
            *[strict_max(F.col(c)).alias(n) for n, c in MAXES.items()],
            *[F.max(flag(F.col("Movement") == m)).alias(n) for n, m in MOVES.items()],
            *[F.sum(flag(F.col("adjEventName") == e)).alias(n)
              for n, e in EVENT_COUNTS.items()],
            *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in (
                "isZone17Incursion", "isZone11PassIncursion")],
            F.coalesce(F.max("isZone14Incursion"), F.lit(0)).alias("zone14"),
            (strict_max(F.col("widthMetres")) - F.min("widthMetres")).alias("spread"),
        )
        .withColumnsRenamed({c: n for n, c in CONSTANT.items() if n != c})
    )
    by_us = F.col("playByUs") == "true"
    passes = F.col("totalPasses")
    return grouped.withColumns({
        "teamName": F.when(by_us, F.col("ourName")).otherwise(F.col("theirName")),
        "playPhase": F.when(by_us, F.col("usPhase")).otherwise(F.col("oppositionPhase")),
        "firstEventArea": F.concat_ws(" - ", "firstEvent", "Area"),
        "isZone14Incursion": F.when(F.col("isZone17Incursion") == 1, 0)
        .otherwise(F.col("zone14")),
        "crossfieldPlay": flag((F.col("spread") > CROSSFIELD_METRES)
                               & (F.col("Area") == "Defence")),
        "defenceOut": flag(F.col("lastEvent") == "sideline out defence"),
        "passZero": flag(passes == 0),
        "pass1": flag(passes == 1),
        "pass2_3": flag(passes.between(2, 3)),
        "pass4_6": flag(passes.between(4, 6)),
        "pass7Plus": flag(passes >= 7),
    }).select(*PLAY_COLUMNS)
