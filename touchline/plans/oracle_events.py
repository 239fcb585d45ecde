"""DuckDB statements for the event-level tables, one CTE per stage."""

from __future__ import annotations

from touchline.functions.constants import (
    BOYS_13, DEAD_BALLS, ENDS, FOULS, GIRLS_16, ODD_COMPETITION, OUTS,
    PASSING_EVENTS, PLAY_KEYS, SAME_PLAYER_AFTER, SAME_PLAYER_EVENTS, TOP_FLIGHT,
)


def quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def rounded(column: str, alias: str | None = None) -> str:
    return f"round({column}, 6) + 0.0 AS {alias or column}"


STAGES: dict[str, str] = {}

STAGES["raw"] = """
SELECT 'G' || user_id AS gameID, user_id, event_id, ts,
       CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord,
       count(*) OVER (PARTITION BY user_id) AS cnt,
       min(ts) OVER (PARTITION BY user_id) AS first_ts
FROM events
"""

STAGES["placed"] = f"""
SELECT gameID, ord, k,
       list_extract([{quoted([*TOP_FLIGHT, BOYS_13, GIRLS_16, ODD_COMPETITION])}],
                    CAST(user_id % 7 + 1 AS INTEGER)) AS competition,
       'Us_' || (user_id % 4) AS ourName,
       'Opp_' || (user_id % 11) AS theirName,
       strftime(first_ts, '%Y-%m-%d') || strftime(ts, ' %H:%M:%S') AS time,
       epoch_us(ts) // 1000 AS epochTime,
       CASE WHEN ord = 1 THEN 'change ends'
            WHEN ord = cnt THEN 'finish'
            WHEN ord = cnt // 2 THEN 'change ends'
            WHEN k BETWEEN 0 AND 44 THEN 'first touch'
            WHEN k BETWEEN 45 AND 59 THEN 'dribble'
            WHEN k BETWEEN 60 AND 65 THEN 'sideline out'
            WHEN k BETWEEN 66 AND 69 THEN 'goalkick'
            WHEN k BETWEEN 70 AND 73 THEN 'corner'
            WHEN k BETWEEN 74 AND 76 THEN 'keeper'
            WHEN k BETWEEN 77 AND 79 THEN 'offside'
            WHEN k BETWEEN 80 AND 82 THEN 'direct freekick'
            WHEN k BETWEEN 83 AND 84 THEN 'indirect freekick'
            WHEN k BETWEEN 85 AND 88 THEN 'shot'
            WHEN k BETWEEN 89 AND 90 THEN 'rebound'
            WHEN k BETWEEN 91 AND 93 THEN 'goal'
            WHEN k = 94 THEN 'penalty'
            ELSE 'first touch' END AS eventName,
       CASE WHEN (((ord + user_id % 7) // 3) % 2 = 0) <> (k % 10 = 0)
            THEN 'true' ELSE 'false' END AS byUs,
       CAST((event_id * 7919 + k * 31) % 1000 AS DOUBLE) / 999 AS lengthFraction,
       CAST((event_id * 104729 + k * 17) % 1000 AS DOUBLE) / 999 AS widthFraction,
       CASE WHEN k <> 99 THEN CAST(1 + k % 8 AS DOUBLE) / 2 END AS duration
FROM raw
"""

STAGES["moved"] = """
SELECT *, lengthFraction * 110 AS lengthMetres, widthFraction * 75 AS widthMetres,
       lead(lengthFraction * 110) OVER g - lengthFraction * 110 AS lengthChangeMetres,
       lead(widthFraction * 75) OVER g - widthFraction * 75 AS across
FROM placed WINDOW g AS (PARTITION BY gameID ORDER BY ord)
"""


def _series(name: str, cond: str) -> str:
    return (f"sum(CASE WHEN {cond} THEN coalesce(duration, 0) ELSE 0 END) "
            f"OVER r AS {name}")


STAGES["feed"] = f"""
SELECT * EXCLUDE (k, across),
       sqrt(lengthChangeMetres * lengthChangeMetres + across * across) AS distance,
       sqrt(lengthChangeMetres * lengthChangeMetres + across * across)
         AS distanceToNextEventMetres,
       degrees(atan2(across, lengthChangeMetres)) AS direction,
       {_series('ourPossession', "byUs = 'true'")},
       {_series('theirPossession', "byUs = 'false'")},
       {_series('ourDefensivePossession', "byUs = 'true' AND lengthFraction <= 0.333333")},
       {_series('theirDefensivePossession', "byUs = 'false' AND lengthFraction <= 0.333333")},
       {_series('ourAttackingPossession', "byUs = 'true' AND lengthFraction >= 0.666667")},
       {_series('theirAttackingPossession', "byUs = 'false' AND lengthFraction >= 0.666667")}
FROM moved
WINDOW r AS (PARTITION BY gameID ORDER BY ord
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

STAGES["names"] = """
SELECT *, min(CASE WHEN nm = 'first touch' THEN ord END)
            OVER (PARTITION BY gameID) AS kick
FROM (SELECT *, CASE WHEN eventName = 'dribble'
                      AND (distanceToNextEventMetres > 8 * duration
                           OR distanceToNextEventMetres > 15)
                     THEN 'first touch' ELSE eventName END AS nm
      FROM feed)
"""

STAGES["around"] = """
SELECT *, lag(nm) OVER g AS pnm, lead(nm) OVER g AS nnm,
       coalesce(byUs <> lag(byUs) OVER g, false) AS swapped,
       coalesce(byUs = lead(byUs) OVER g, false) AS kept,
       coalesce(byUs <> lead(byUs) OVER g, false) AS lost,
       coalesce(lengthMetres > 16.5 OR widthMetres > 57.66 OR widthMetres < 17.34,
                false) AS outside,
       coalesce(ord > kick, false) AS live
FROM names WINDOW g AS (PARTITION BY gameID ORDER BY ord)
"""

STAGES["keepers"] = f"""
SELECT *, live AND nm = 'keeper' AND coalesce(lead(outside) OVER g, false)
             AND coalesce(nnm NOT IN ({quoted(ENDS)}), false) AS missed,
       lost AND coalesce(distance >= 10 AND lengthChangeMetres > 3
                         AND lengthFraction <= 0.33, false) AS cleared
FROM around WINDOW g AS (PARTITION BY gameID ORDER BY ord)
"""

STAGES["holds"] = """
SELECT *, live AND nm = 'keeper' AND NOT missed AS held FROM keepers
"""

STAGES["fouls"] = f"""
SELECT *, live AND nm IN ({quoted(FOULS)}) AND NOT pheld
            AND coalesce(nnm <> 'keeper', true) AS foul
FROM (SELECT *, coalesce(lag(held) OVER (PARTITION BY gameID ORDER BY ord), false)
        AS pheld FROM holds)
"""

STAGES["deads"] = f"""
SELECT *, CASE WHEN live AND nm IN ({quoted(DEAD_BALLS)}) AND NOT pheld AND NOT pfoul
                 AND NOT (swapped AND cleared
                          AND coalesce(nnm NOT IN ({quoted(OUTS)}), true))
               THEN nm END AS dead
FROM (SELECT *, coalesce(lag(foul) OVER (PARTITION BY gameID ORDER BY ord), false)
        AS pfoul FROM fouls)
"""

STAGES["ruled"] = f"""
SELECT *, CASE
    WHEN ord = kick THEN 'C1'
    WHEN NOT live THEN 'pre'
    WHEN nm IN ({quoted(ENDS)}) THEN 'C2'
    WHEN nm = 'first touch' AND pdead = 'sideline out' THEN 'C3a'
    WHEN nm = 'first touch' AND pdead = 'goalkick' THEN 'C3b'
    WHEN nm = 'first touch' AND pdead = 'corner' THEN 'C3c'
    WHEN nm = 'first touch' AND pdead = 'penalty' THEN 'C3d'
    WHEN missed THEN 'C4'
    WHEN held THEN 'U'
    WHEN nnm = 'keeper' THEN 'C5'
    WHEN pheld AND NOT outside THEN 'C6'
    WHEN nm IN ({quoted(FOULS)}) THEN 'C7'
    WHEN pfoul THEN 'C8'
    WHEN nm = 'first touch' AND pnm = 'change ends' THEN 'C9'
    WHEN nm = 'first touch' AND pdead = 'goal' THEN 'C10'
    WHEN coalesce(nnm IN ({quoted(OUTS)}), false) AND swapped THEN 'C11'
    WHEN NOT swapped THEN 'C12'
    ELSE 'C13' END AS rule
FROM (SELECT *, lag(dead) OVER (PARTITION BY gameID ORDER BY ord) AS pdead FROM deads)
"""

STAGES["called"] = """
SELECT *, CASE rule
    WHEN 'C1' THEN 'kick off' WHEN 'C9' THEN 'kick off' WHEN 'C10' THEN 'kick off'
    WHEN 'C3a' THEN 'throw in' WHEN 'C3b' THEN 'goal kick'
    WHEN 'C3c' THEN 'corner kick' WHEN 'C3d' THEN 'penalty kick'
    WHEN 'C4' THEN 'keeper punt' WHEN 'C6' THEN 'keeper punt'
    WHEN 'C5' THEN 'keeper catch'
    WHEN 'C8' THEN CASE pnm WHEN 'offside' THEN 'offside restart'
                            WHEN 'direct freekick' THEN 'direct restart'
                            ELSE 'indirect restart' END
    WHEN 'C13' THEN CASE WHEN cleared THEN 'clearance' ELSE nm END
    ELSE nm END AS called
FROM ruled
"""

STAGES["counted"] = f"""
SELECT *, CASE WHEN idle OR rule = 'C7' THEN 0
               WHEN rule = 'C12'
                AND ((coalesce(pcalled IN ({quoted(SAME_PLAYER_AFTER)}), false)
                      AND nm = 'dribble')
                     OR nm IN ({quoted(SAME_PLAYER_EVENTS)})) THEN 0
               ELSE 1 END AS step,
       CASE WHEN prule = 'C11' AND called = 'sideline out'
            THEN 'sideline out defence' ELSE called END AS adjEventName,
       1 + coalesce(sum(CASE WHEN rule = 'C2' AND nm = 'change ends' THEN 1 ELSE 0 END)
           OVER (PARTITION BY gameID ORDER BY ord
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS half,
       sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER r AS run,
       sum(CASE WHEN opens OR idle THEN 1 ELSE 0 END) OVER r AS stretch,
       CASE WHEN idle THEN ''
            WHEN rule = 'C13' THEN
              CASE WHEN byUs = 'true' THEN 'BPO > BP' ELSE 'BP > BPO' END
            WHEN rule = 'C9' AND byUs <> 'true' THEN ''
            WHEN byUs = 'true' THEN 'BP' ELSE 'BPO' END AS us0,
       CASE WHEN idle THEN ''
            WHEN rule = 'C13' THEN
              CASE WHEN byUs = 'true' THEN 'BP > BPO' ELSE 'BPO > BP' END
            WHEN rule = 'C9' AND byUs <> 'true' THEN ''
            WHEN byUs = 'true' THEN 'BPO' ELSE 'BP' END AS opp0
FROM (SELECT *, lag(rule) OVER g AS prule, lag(called) OVER g AS pcalled,
             rule IN ('C1','C3a','C3b','C3c','C3d','C4','C6','C8','C9','C10','C13')
               AS opens,
             rule IN ('pre', 'C2', 'U') AS idle
      FROM called WINDOW g AS (PARTITION BY gameID ORDER BY ord))
WINDOW r AS (PARTITION BY gameID ORDER BY ord
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

STAGES["stretched"] = """
SELECT *, CASE WHEN idle THEN 0 ELSE run END AS playNumber,
       CASE WHEN idle THEN 0
            ELSE row_number() OVER s
                 - CASE WHEN first_value(idle) OVER s THEN 1 ELSE 0 END
       END AS sequenceNumber,
       sum(step) OVER s AS player,
       CASE WHEN max(CASE WHEN rule = 'C7' THEN 1 ELSE 0 END) OVER s = 1 THEN ''
            ELSE first_value(us0) OVER s END AS usPhase,
       CASE WHEN max(CASE WHEN rule = 'C7' THEN 1 ELSE 0 END) OVER s = 1 THEN ''
            ELSE first_value(opp0) OVER s END AS oppositionPhase
FROM counted
WINDOW s AS (PARTITION BY gameID, stretch ORDER BY ord
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

STAGES["progress"] = f"""
SELECT *,
   CASE WHEN playNumber > 0 AND kept AND adjEventName IN ({quoted(PASSING_EVENTS)})
         AND nnm = 'first touch' THEN 1 ELSE 0 END AS adjPass,
   CASE WHEN playNumber > 0 AND kept AND lengthFraction >= 0.66666667
        THEN 1 ELSE 0 END AS attackIncursion,
   CASE WHEN playNumber > 0 AND kept AND lengthMetres >= 93.5
         AND widthMetres <= 57.66 AND widthMetres >= 17.34
        THEN 1 ELSE 0 END AS penaltyIncursion,
   lag(sequenceNumber) OVER g AS pseq, lag(player) OVER g AS pplayer,
   lag(usPhase) OVER g AS pus, lag(oppositionPhase) OVER g AS popp
FROM stretched WINDOW g AS (PARTITION BY gameID ORDER BY ord)
"""

FEED_PLAIN = [
    "gameID", "competition", "ourName", "theirName", "time", "epochTime",
    "eventName", "byUs",
]
FEED_DOUBLES = [
    "lengthFraction", "widthFraction", "lengthMetres", "widthMetres",
    "lengthChangeMetres", "distance", "distanceToNextEventMetres", "duration",
    "direction", "ourPossession", "theirPossession", "ourDefensivePossession",
    "theirDefensivePossession", "ourAttackingPossession",
    "theirAttackingPossession",
]
_FIXED = [c for c in FEED_PLAIN + FEED_DOUBLES + ["ord"] if c not in (
    "lengthFraction", "widthFraction", "lengthMetres", "widthMetres")]

STAGES["seq"] = f"""
SELECT {', '.join(_FIXED)}, CAST(half AS INTEGER) AS half,
       lengthFraction, lengthMetres, widthFraction, widthMetres,
       CAST(playNumber AS INTEGER) AS playNumber,
       CAST(sequenceNumber AS INTEGER) AS sequenceNumber,
       CAST(player AS INTEGER) AS player, usPhase, oppositionPhase, adjEventName,
       adjPass, attackIncursion, penaltyIncursion, false AS pseudoEvent
FROM progress
UNION ALL
SELECT {', '.join(_FIXED)}, CAST(half AS INTEGER),
       1 - lengthFraction, 110 - lengthMetres, 1 - widthFraction, 75 - widthMetres,
       CAST(run - 1 AS INTEGER), CAST(pseq + 1 AS INTEGER),
       CAST(pplayer + 1 AS INTEGER), pus, popp, 'turnover', 0, 0, 0, true
FROM progress WHERE rule = 'C13'
"""


def _three(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 WHEN NOT ({cond}) THEN 0 END"


_STRAIGHT = "(abs(direction) < 75 OR abs(direction) > 105)"
STAGES["passes"] = f"""
SELECT *, CAST(floor(CASE WHEN widthFraction = 1 THEN 2 ELSE widthFraction * 3 END) + 1
          + 3 * floor(CASE WHEN lengthFraction >= 1 THEN 5 ELSE lengthFraction * 6 END)
          AS INTEGER) AS zone,
       {_three('isFwdPass = 1 AND distance <= 10')} AS isPass10m,
       {_three('isFwdPass = 1 AND distance > 10 AND distance <= 20')} AS isPass10_20m,
       {_three('isFwdPass = 1 AND distance > 20')} AS isPass20m
FROM (SELECT * REPLACE (
               CASE WHEN adjEventName = 'goal' THEN 110 ELSE lengthMetres END
                 AS lengthMetres,
               CASE WHEN adjEventName = 'goal' THEN 1 ELSE lengthFraction END
                 AS lengthFraction),
             {_three(f'adjPass = 1 AND lengthChangeMetres < 0 AND {_STRAIGHT}')}
               AS isBackPass,
             {_three(f'adjPass = 1 AND lengthChangeMetres > 0 AND {_STRAIGHT}')}
               AS isFwdPass,
             {_three('adjPass = 1 AND abs(direction) >= 75 AND abs(direction) <= 105')}
               AS isSidePass
      FROM (SELECT * REPLACE (coalesce(direction, 0) AS direction,
                              coalesce(duration, 0) AS duration) FROM seq))
"""

STAGES["shown"] = f"""
SELECT * REPLACE (75 - widthMetres AS widthMetres, 1 - widthFraction AS widthFraction),
       CAST(substr(time, 1, 19) AS TIMESTAMP) AS kickoff_date,
       CASE WHEN competition IN ({quoted(TOP_FLIGHT)}) THEN 'Top-Flight'
            ELSE list_extract(string_split(competition, ' '), -1) END AS age_group,
       strftime(CAST(substr(time, 1, 10) AS DATE), '%d/%m/%y') || ' - ' || theirName
         AS matchName,
       CASE WHEN lengthFraction <= 0.333333 THEN 'Defence'
            WHEN lengthFraction >= 0.666667 THEN 'Attack'
            ELSE 'Midfield' END AS playArea
FROM passes
"""

STAGES["windowed"] = f"""
SELECT *, max(sequenceNumber) OVER w AS maxSequenceNumber,
       max(attackIncursion) OVER w AS isAttackIncursion,
       CAST(sum(adjPass) OVER w AS BIGINT) AS numberPasses,
       CASE WHEN last_value(adjEventName) OVER w = 'goal' THEN 1 ELSE 0 END AS isGoal,
       first_value(byUs) OVER w AS playByUs,
       first_value(adjEventName) OVER w AS firstEvent,
       last_value(adjEventName) OVER w AS lastEvent,
       lead(adjEventName) OVER o AS nev, lead(zone) OVER o AS nz,
       lead(byUs) OVER o AS nby, lead(playArea) OVER o AS narea
FROM shown
WINDOW o AS (PARTITION BY {', '.join(PLAY_KEYS)}
             ORDER BY sequenceNumber, pseudoEvent, ord),
       w AS (PARTITION BY {', '.join(PLAY_KEYS)}
             ORDER BY sequenceNumber, pseudoEvent, ord
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def _into(cond: str) -> str:
    return (f"CASE WHEN sequenceNumber = maxSequenceNumber THEN 0 "
            f"WHEN {cond} AND byUs = nby THEN 1 ELSE 0 END")


def _received(kind: str) -> str:
    return _three(f"{kind} = 1 AND sequenceNumber = 1 AND adjEventName = 'first touch'")


def _move(start: str, end: str) -> str:
    return f"adjPass = 1 AND playArea = '{start}' AND narea = '{end}'"


STAGES["enriched"] = f"""
SELECT *, {_received('isBackPass')} AS backPassTurnover,
       {_received('isFwdPass')} AS fwdPassTurnover,
       {_received('isSidePass')} AS sidePassTurnover,
       {_into('zone = 10 AND nz IN (13, 16)')} AS rightAttack,
       {_into('zone = 11 AND nz IN (14, 17)')} AS middleAttack,
       {_into('zone = 12 AND nz IN (15, 18)')} AS leftAttack,
       {_into('zone <> 14 AND nz = 14')} AS isZone14Incursion,
       {_into('zone <> 17 AND nz = 17')} AS isZone17Incursion,
       {_into('zone <> 11 AND nz = 11 AND adjPass = 1')} AS isZone11PassIncursion,
       {_into('zone <> 2 AND nz = 2 AND adjPass = 1')} AS isBackKeeperPass,
       CASE WHEN playNumber = 0 OR sequenceNumber = maxSequenceNumber THEN ''
            WHEN {_move('Defence', 'Midfield')} THEN 'D-M'
            WHEN {_move('Midfield', 'Defence')} THEN 'M-D'
            WHEN {_move('Midfield', 'Attack')} THEN 'M-A'
            WHEN {_move('Attack', 'Midfield')} THEN 'A-M'
            ELSE '' END AS Movement
FROM windowed
"""


def statement(select: str, stages: dict[str, str] = STAGES, last: str | None = None) -> str:
    """A SELECT over the stages up to ``last`` (all of them by default)."""
    names = list(stages)
    if last:
        names = names[: names.index(last) + 1]
    ctes = ",\n".join(f"{n} AS ({stages[n].strip()})" for n in names)
    return f"WITH {ctes}\n{select.strip()}"
