"""DuckDB statements for plays, roll-ups and reports."""

from __future__ import annotations

from touchline.functions.constants import (
    BOYS_13, BOYS_14, FOUL_RESTARTS, GIRLS_16, HOME_TEAM, ODD_COMPETITION, TOP_FLIGHT,
)
from touchline.plans.oracle_events import STAGES, quoted, rounded, statement
from touchline.plans.oracle_lists import (
    LABELS, MATCH_KEYS, MATCH_PREDICTORS, MATCH_RATES, MATCH_TEAM_KEYS, MATCH_TOTALS,
    PLAY_COLUMNS, PLAY_EVENTS, PLAY_KEYS, PLAY_MAXES, PLAY_MOVES, PLAY_SUMS,
    PROFILE_SHARES, SHARED, SKIPPING, STRICT_MAXES, TEAM_FEATURES, TEAM_KEYS,
)

TABLES: dict[str, str] = dict(STAGES)

# Double columns of the play table; the other numbers are integers.
PLAY_DOUBLES = [
    "distance", "attackDistance", "midfieldDistance", "defenceDistance",
    "possessionDuration", "AttackDuration", "MidfieldDuration",
    "DefenceDuration", "AttackHalfDuration", "DefenceHalfDuration",
    "playDuration",
]
PLAY_TEXT = [
    "gameID", "competition", "age_group", "ourName", "theirName", "gameDate",
    "playByUs", "matchName", "teamName", "usPhase", "oppositionPhase",
    "firstEvent", "lastEvent", "Area", "lastArea", "firstEventArea", "playPhase",
]
PLAY_INTS = [c for c in PLAY_COLUMNS if c not in PLAY_TEXT + PLAY_DOUBLES]
GOAL_ORIGINS = ["goalAttack", "goalMidfield", "goalDefence", "goalTurnover",
                "goalRestart"]
RATES = ["ppm", "ppmAttack", "ppmMidfield", "ppmDefence", "aveVelocity",
         "attackVelocity", "midfieldVelocity", "defenceVelocity"]


def strict(expr: str, cast: str = "") -> str:
    total = f"CAST(sum({expr}) AS {cast})" if cast else f"sum({expr})"
    return f"CASE WHEN count({expr}) = count(*) THEN {total} END"


def tidy(columns, doubles) -> str:
    return ", ".join(rounded(c) if c in doubles else c for c in columns)


# --------------------------------------------------------------------------
# plays
# --------------------------------------------------------------------------
_OWN = "playByUs = byUs AND coalesce(nev NOT IN ('goal kick', 'sideline out'), true)"
_WHERE = {
    "": "true", "Attack": "playArea = 'Attack'", "Midfield": "playArea = 'Midfield'",
    "Defence": "playArea = 'Defence'", "AttackHalf": "lengthMetres >= 55",
    "DefenceHalf": "lengthMetres < 55",
}


def _carried(value: str, where: str) -> str:
    return strict(f"CASE WHEN {_OWN} AND {_WHERE[where]} THEN {value} ELSE 0 END")


FIRST = {
    "age_group": "age_group", "gameDate": "kickoff_date", "playByUs": "playByUs",
    "matchName": "matchName", "usPhase": "usPhase", "half": "half",
    "oppositionPhase": "oppositionPhase", "firstEvent": "adjEventName",
    "Area": "playArea", "firstPenalyIncursion": "penaltyIncursion",
    "firstZone": "zone",
}
LAST = {"lastEvent": "adjEventName", "lastArea": "playArea", "lastZone": "zone"}
_AT = "ORDER BY sequenceNumber, pseudoEvent, ord"
TABLES["rolled"] = f"""
SELECT {', '.join(PLAY_KEYS)},
       {', '.join(f'first({src} {_AT}) AS {n}' for n, src in FIRST.items())},
       {', '.join(f'last({src} {_AT}) AS {n}' for n, src in LAST.items())},
       max(sequenceNumber) AS numSequences, max(player) AS numPlayers,
       {_carried('distanceToNextEventMetres', '')} AS distance,
       {_carried('distanceToNextEventMetres', 'Attack')} AS attackDistance,
       {_carried('distanceToNextEventMetres', 'Midfield')} AS midfieldDistance,
       {_carried('distanceToNextEventMetres', 'Defence')} AS defenceDistance,
       {_carried('duration', '')} AS possessionDuration,
       {_carried('duration', 'Attack')} AS AttackDuration,
       {_carried('duration', 'Midfield')} AS MidfieldDuration,
       {_carried('duration', 'Defence')} AS DefenceDuration,
       {_carried('duration', 'AttackHalf')} AS AttackHalfDuration,
       {_carried('duration', 'DefenceHalf')} AS DefenceHalfDuration,
       {', '.join(
           f"CAST(sum(CASE WHEN playArea = '{a}' THEN adjPass ELSE 0 END) AS BIGINT) AS {n}"
           for n, a in (('attackPasses', 'Attack'), ('midfieldPasses', 'Midfield'),
                        ('defencePasses', 'Defence')))},
       {', '.join(strict(src, '' if n == 'playDuration' else 'BIGINT') + f' AS {n}'
                  for n, src in PLAY_SUMS.items())},
       {', '.join(f'max({src}) AS {n}' for n, src in PLAY_MAXES.items())},
       {', '.join(f'CASE WHEN count({c}) = count(*) THEN max({c}) END AS {c}' for c in STRICT_MAXES)},
       {', '.join(f"max(CASE WHEN Movement = '{m}' THEN 1 ELSE 0 END) AS {n}"
                  for n, m in PLAY_MOVES.items())},
       {', '.join(f"count(*) FILTER (WHERE adjEventName = '{e}') AS {n}"
                  for n, e in PLAY_EVENTS.items())},
       max(isZone17Incursion) AS isZone17Incursion,
       max(isZone14Incursion) AS zone14,
       max(isZone11PassIncursion) AS isZone11PassIncursion,
       max(widthMetres) - min(widthMetres) AS spread
FROM enriched WHERE playNumber <> 0 GROUP BY {', '.join(PLAY_KEYS)}
"""


def _yes(cond: str, name: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END AS {name}"


TABLES["plays"] = f"""
SELECT *, CASE WHEN playByUs = 'true' THEN ourName ELSE theirName END AS teamName,
       CASE WHEN playByUs = 'true' THEN usPhase ELSE oppositionPhase END AS playPhase,
       firstEvent || ' - ' || Area AS firstEventArea,
       CASE WHEN isZone17Incursion = 1 THEN 0 ELSE zone14 END AS isZone14Incursion,
       {_yes("spread > 50 AND Area = 'Defence'", 'crossfieldPlay')},
       {_yes("lastEvent = 'sideline out defence'", 'defenceOut')},
       {_yes('totalPasses = 0', 'passZero')},
       {_yes('totalPasses > 0 AND totalPasses < 2', 'pass1')},
       {_yes('totalPasses > 1 AND totalPasses < 4', 'pass2_3')},
       {_yes('totalPasses > 3 AND totalPasses < 7', 'pass4_6')},
       {_yes('totalPasses > 6', 'pass7Plus')}
FROM rolled
"""


# --------------------------------------------------------------------------
# profiles
# --------------------------------------------------------------------------
def _total(column: str) -> str:
    return f"coalesce(sum({column}), 0)" if column in SKIPPING else strict(column)


_NAMED = {"gameDuration": strict("possessionDuration"),
          "gameDistance": "coalesce(sum(distance), 0)", "plays": "count(*)"}


def _part(column: str) -> str:
    return _NAMED.get(column) or _total(column)


def profile(keys: list[str]) -> str:
    ratios = ",\n       ".join(
        f"CAST({_part(top)} AS DOUBLE) / nullif({' + '.join(map(_part, parts))}, 0) AS {n}"
        for n, (top, parts) in PROFILE_SHARES.items())
    return f"""
SELECT {', '.join(keys)}, min(gameDate) AS gameDate, max(theirName) AS theirName,
       max(matchName) AS matchName, {_NAMED['gameDuration']} AS gameDuration,
       {_NAMED['gameDistance']} AS gameDistance, count(*) AS plays,
       {strict('goals', 'BIGINT')} AS goals, {strict('shots', 'BIGINT')} AS shots,
       {strict('totalPasses', 'BIGINT')} AS totalPasses,
       {strict('totalPasses')} / nullif({_NAMED['gameDuration']} / 60, 0) AS ppm,
       {_NAMED['gameDistance']} / nullif({_NAMED['gameDuration']}, 0) AS aveVelocity,
       {ratios},
       1 - {_total('passZero')} / CAST(count(*) AS DOUBLE) AS passPlay_pcnt
FROM plays GROUP BY {', '.join(keys)}
"""


def result_case(goals: str, total: str) -> str:
    return (f"CASE WHEN {total} = 0 THEN 'Draw' WHEN {goals} / {total} = 0.5 THEN 'Draw' "
            f"WHEN {goals} / {total} < 0.5 THEN 'Loss' ELSE 'Win' END")


_PROFILE_DOUBLES = ["gameDuration", "gameDistance", "ppm", "aveVelocity", *PROFILE_SHARES,
                    "passPlay_pcnt"]
_PROFILE_COLUMNS = ["gameDate", "theirName", "matchName", "gameDuration",
                    "gameDistance", "plays", "goals", "shots", "totalPasses", "ppm",
                    "aveVelocity", *PROFILE_SHARES, "passPlay_pcnt"]

TABLES["match_team"] = profile(MATCH_TEAM_KEYS)
TABLES["team"] = profile(TEAM_KEYS)


# --------------------------------------------------------------------------
# numeric totals
# --------------------------------------------------------------------------
TABLES["origins"] = f"""
SELECT *, strftime(gameDate, '%Y-%m-%d') AS gameDay,
       {_yes("isGoal = 1 AND Area = 'Attack'", 'goalAttack')},
       {_yes("isGoal = 1 AND Area = 'Midfield'", 'goalMidfield')},
       {_yes("isGoal = 1 AND Area = 'Defence'", 'goalDefence')},
       {_yes("isGoal = 1 AND firstEvent = 'first touch'", 'goalTurnover')},
       {_yes("isGoal = 1 AND firstEvent <> 'first touch'", 'goalRestart')}
FROM plays
"""


def numeric_totals(keys: dict[str, str]) -> str:
    sums = ", ".join(
        [f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in PLAY_INTS + GOAL_ORIGINS]
        + [f"coalesce(sum({c}), 0) AS {c}" for c in PLAY_DOUBLES])
    return f"""
SELECT *, totalPasses / nullif(possessionDuration / 60, 0) AS ppm,
       attackPasses / nullif(AttackDuration / 60, 0) AS ppmAttack,
       midfieldPasses / nullif(MidfieldDuration / 60, 0) AS ppmMidfield,
       defencePasses / nullif(DefenceDuration / 60, 0) AS ppmDefence,
       distance / nullif(possessionDuration, 0) AS aveVelocity,
       attackDistance / nullif(AttackDuration, 0) AS attackVelocity,
       midfieldDistance / nullif(MidfieldDuration, 0) AS midfieldVelocity,
       defenceDistance / nullif(DefenceDuration, 0) AS defenceVelocity
FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in keys.items())}, {sums}
      FROM origins GROUP BY ALL)
"""


_NUMERIC = PLAY_INTS + GOAL_ORIGINS + PLAY_DOUBLES + RATES
TABLES["ages"] = numeric_totals({"age_group": "age_group", "playByUs": "playByUs"})
_GAME_KEYS = {"gameID": "gameID", "matchName": "matchName", "playByUs": "playByUs",
              "gameDate": "gameDay"}
TABLES["games"] = numeric_totals(_GAME_KEYS)


# --------------------------------------------------------------------------
# match features
# --------------------------------------------------------------------------
_FEATURE_SELECT = ", ".join("gameDay AS gameDate" if c == "gameDate" else c
                            for c in MATCH_KEYS)
TABLES["match_sums"] = f"""
SELECT *, totalPasses / nullif(possessionDuration / 60, 0) AS ppm,
       distance / nullif(possessionDuration, 0) AS aveVelocity,
       isZone17Incursion + isZone14Incursion AS zone14_17,
       goals + shots AS goal_shots
FROM (SELECT {_FEATURE_SELECT},
             {', '.join(f'coalesce(sum({c}), 0) AS {c}' for c in MATCH_TOTALS)}
      FROM origins GROUP BY ALL)
"""


def _share(c: str) -> str:
    known = f"CASE WHEN count({c}) OVER m = count(*) OVER m THEN sum({c}) OVER m END"
    return (f"CASE WHEN {c} = 0 THEN 0 "
            f"ELSE CAST({c} AS DOUBLE) / nullif({known}, 0) END AS {c}_pcnt")


_SHARES = [f"{c}_pcnt" for c in (*MATCH_TOTALS, *MATCH_RATES)]
TABLES["features"] = f"""
SELECT *, CAST(CASE result WHEN 'Draw' THEN 1 WHEN 'Loss' THEN 0 ELSE 2 END
               AS INTEGER) AS "default"
FROM (SELECT {', '.join(MATCH_KEYS)},
             {result_case('goals', 'sum(goals) OVER m')} AS result,
             {', '.join(_share(c) for c in (*MATCH_TOTALS, *MATCH_RATES))}
      FROM match_sums WINDOW m AS (PARTITION BY competition, gameID))
"""

TABLES["labelled"] = f"""
SELECT gameID, teamName, playByUs, gameDate, "default", {', '.join(MATCH_PREDICTORS)}
FROM features WHERE competition <> '{ODD_COMPETITION}'
"""


# --------------------------------------------------------------------------
# reports
# --------------------------------------------------------------------------
def passing(where: str = "true") -> str:
    return f"""
SELECT playByUs, totalPasses, cnt, CAST(sum(cnt) OVER (PARTITION BY playByUs) AS BIGINT)
         AS max_tp,
       round(cnt / sum(cnt) OVER (PARTITION BY playByUs), 6) + 0.0 AS perc
FROM (SELECT playByUs, totalPasses, count(*) AS cnt FROM plays WHERE {where}
      GROUP BY playByUs, totalPasses)
"""


def heat(side: str, where: str = "true", columns: int = 22, rows: int = 15,
         bandwidth: float = 75 / 8) -> str:
    w, h = 110 / columns, 75 / rows
    return f"""
, points AS (SELECT row_number() OVER () AS id,
        CASE WHEN playByUs = 'false' THEN 110 - lengthMetres ELSE lengthMetres END AS px,
        CASE WHEN playByUs = 'false' THEN 75 - widthMetres ELSE widthMetres END AS py
   FROM enriched WHERE playByUs = '{side}' AND {where}),
gxs AS (SELECT CAST(unnest(range({columns})) AS INTEGER) AS gx),
gys AS (SELECT CAST(unnest(range({rows})) AS INTEGER) AS gy),
kernels AS (SELECT id, gx, gy,
        exp(-0.5 * pow((px - (gx + 0.5) * {w!r}) / {bandwidth!r}, 2)
            - 0.5 * pow((py - (gy + 0.5) * {h!r}) / {bandwidth!r}, 2))
          / (2 * pi() * {bandwidth!r} * {bandwidth!r}) AS dens
   FROM points, gxs, gys
   WHERE px BETWEEN 0 AND 110 AND py BETWEEN 0 AND 75),
edges AS (SELECT id, sum(dens) * {w * h!r} AS mass FROM kernels GROUP BY id)
SELECT gx, gy, round(CAST(gx + 0.5 AS DOUBLE) * {w!r}, 6) AS x,
       round(CAST(gy + 0.5 AS DOUBLE) * {h!r}, 6) AS y,
       round(sum(dens / mass), 6) + 0.0 AS density
FROM kernels JOIN edges USING (id) GROUP BY gx, gy
"""


def play_map(start_pct: float, end_pct: float, where: str = "true") -> str:
    return f"""
, mine AS (SELECT *, min(epochTime) OVER m AS t0, max(epochTime) OVER m AS t1
   FROM enriched WHERE {where} WINDOW m AS (PARTITION BY matchName)),
cut AS (SELECT *,
          CASE WHEN playByUs = 'false' THEN 110 - lengthMetres ELSE lengthMetres END AS x,
          CASE WHEN playByUs = 'false' THEN 75 - widthMetres ELSE widthMetres END AS y
   FROM mine WHERE epochTime >= t0 + CAST(t1 - t0 AS DOUBLE) * {start_pct} / 100
               AND epochTime <= t0 + CAST(t1 - t0 AS DOUBLE) * {end_pct} / 100),
segments AS (SELECT *, lead(x) OVER s AS x1, lead(y) OVER s AS y1 FROM cut
   WINDOW s AS (PARTITION BY gameID, playNumber
                ORDER BY sequenceNumber, pseudoEvent, ord))
SELECT matchName, gameID, playNumber, sequenceNumber, ord, pseudoEvent,
       {rounded('x')}, {rounded('y')}, {rounded('x1')}, {rounded('y1')}, playByUs
FROM segments WHERE sequenceNumber <> maxSequenceNumber
"""


SCOREBOARD = """
SELECT matchName,
       CAST(sum(CASE WHEN adjEventName = 'goal' AND playByUs = 'true' THEN isGoal
                     ELSE 0 END) AS BIGINT) AS our_goals,
       CAST(sum(CASE WHEN adjEventName = 'goal' AND playByUs = 'false' THEN isGoal
                     ELSE 0 END) AS BIGINT) AS their_goals
FROM enriched GROUP BY matchName
"""

RESULTS = """
SELECT matchName, gameDate,
       CAST(CASE WHEN us = them THEN 2 WHEN us < them THEN 1 ELSE 3 END AS INTEGER) AS wld
FROM (SELECT matchName, gameDate,
             sum(CASE WHEN playByUs = 'true' THEN isGoal ELSE 0 END) AS us,
             sum(CASE WHEN playByUs = 'false' THEN isGoal ELSE 0 END) AS them
      FROM games GROUP BY matchName, gameDate)
"""


def stacked(table: str, ids: list[str], stats: list[str], category: str,
            as_share: bool) -> str:
    parts = []
    for stat in stats:
        for place, (column, label) in enumerate(LABELS[stat].items(), 1):
            parts.append(
                f"SELECT {', '.join(ids)}, '{stat}' AS stat, '{column}' AS Key, "
                f"'{label}' AS label, {place} AS label_order, "
                f"CAST({column} AS DOUBLE) AS m FROM {table}")
    bars = [s for s in stats if s in SHARED]
    value = "m"
    if as_share and bars:
        value = (f"CASE WHEN stat IN ({quoted(bars)}) THEN m / nullif(sum(m) OVER "
                 f"(PARTITION BY stat, {category}, playByUs), 0) ELSE m END")
    return f"""
SELECT {', '.join(ids)}, stat, Key, label, label_order,
       CASE playByUs WHEN 'true' THEN 'Us' ELSE 'Opponents' END AS side,
       round({value}, 6) + 0.0 AS Measurement
FROM ({' UNION ALL '.join(parts)})
"""


def team_stats(stats: list[str], as_share: bool) -> str:
    ids = ["gameID", "matchName", "playByUs", "gameDate"]
    return f"""
, bars AS ({stacked('games', ids, stats, 'matchName', as_share)}),
results AS ({RESULTS}),
latest AS (SELECT matchName, max(gameDate) AS match_order FROM games GROUP BY matchName)
SELECT bars.*, wld, match_order
FROM bars JOIN results USING (matchName, gameDate) JOIN latest USING (matchName)
"""


def age_stats(stats: list[str], as_share: bool) -> str:
    return stacked("ages", ["age_group", "playByUs"], stats, "age_group", as_share)


def possession(series: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT matchName, gameID, ord, pseudoEvent, epochTime, "
        f"'{c}' AS TeamPossession, {rounded(c, 'TimePossesion')} FROM enriched"
        for c in series)


def pick_list(column: str) -> str:
    return f"""
SELECT choice, gameID, playNumber, sequenceNumber
FROM (SELECT {column} AS choice, *, row_number() OVER (
          PARTITION BY {column}
          ORDER BY gameID, playNumber, sequenceNumber) AS nth
      FROM enriched) WHERE nth = 1
"""


PRIORITY = f"""
SELECT gameID, competition, teamName, playNumber,
       CAST(CASE WHEN competition = '{GIRLS_16}' AND teamName = '{HOME_TEAM}' THEN 0
            WHEN competition IN ({quoted([BOYS_13, GIRLS_16, BOYS_14])}) THEN 1
            WHEN competition = '{TOP_FLIGHT[1]}' THEN 2
            WHEN competition = '{TOP_FLIGHT[2]}' THEN 3
            ELSE 4 END AS INTEGER) AS orderCol
FROM plays
"""


def over(select: str, last: str) -> str:
    return statement(select, TABLES, last)


_EVENT_KEY = "gameID, ord, pseudoEvent"
_SEQ_DOUBLES = ["lengthFraction", "lengthMetres", "widthFraction", "widthMetres"]
_SEQ = ["gameID", "ord", "eventName", "byUs", "half", *_SEQ_DOUBLES, "playNumber",
        "sequenceNumber", "player", "usPhase", "oppositionPhase", "adjEventName",
        "adjPass", "attackIncursion", "penaltyIncursion", "pseudoEvent"]
ENRICHED_COLUMNS = [
    "gameID", "ord", "pseudoEvent", "kickoff_date", "age_group", "matchName",
    "widthMetres", "widthFraction", "playArea", "maxSequenceNumber",
    "isAttackIncursion", "numberPasses", "isGoal", "playByUs", "firstEvent",
    "lastEvent", "backPassTurnover", "fwdPassTurnover", "sidePassTurnover",
    "rightAttack", "middleAttack", "leftAttack", "isZone14Incursion",
    "isZone17Incursion", "isZone11PassIncursion", "isBackKeeperPass", "Movement",
]

_TOP = quoted(TOP_FLIGHT)
TEAM_COMPETITIONS = [GIRLS_16, *TOP_FLIGHT]
_FEATURES = list(TEAM_FEATURES)
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in _FEATURES)
_TEAM_ID = "competition || '|' || teamName || '|' || playByUs"

SCALED = f"""
, chosen AS (SELECT *, {_TEAM_ID} AS team_id FROM team
             WHERE competition IN ({quoted(TEAM_COMPETITIONS)}) AND {_COMPLETE}),
long AS ({' UNION ALL '.join(
    f"SELECT team_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM chosen"
    for c in _FEATURES)}),
scaled AS (SELECT team_id, feature,
    CASE WHEN stddev_samp(v) OVER f = 0 THEN 0
         ELSE (v - avg(v) OVER f) / stddev_samp(v) OVER f END AS z
    FROM long WINDOW f AS (PARTITION BY feature))
"""


def labels_correlation() -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in MATCH_PREDICTORS)
    return " UNION ALL ".join(
        f"SELECT '{c}' AS predictor, CASE WHEN stddev_pop({c}) > 0 "
        f"THEN round(corr(\"default\", {c}), 6) + 0.0 END AS correlation "
        f"FROM labelled WHERE {complete}" for c in MATCH_PREDICTORS)


def split_statement(fraction: float = 0.8, seed: int = 7) -> str:
    return f"""
, keyed AS (SELECT "default", gameID, teamName, playByUs, gameDate,
     md5('{seed}|' || gameID || '|' || teamName || '|' || playByUs || '|' || gameDate)
       AS draw FROM labelled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "default" ORDER BY draw) AS nth,
     count(*) OVER (PARTITION BY "default") AS n FROM keyed)
SELECT gameID, teamName, playByUs, gameDate, "default",
       nth <= ceil(round(n * {fraction}, 9)) AS in_train FROM ranked
"""


def folds_statement(folds: int = 5, repeats: int = 3) -> str:
    return f"""
SELECT gameID, teamName, playByUs, gameDate, "default", CAST(r AS INTEGER) AS repeat,
       CAST((row_number() OVER (PARTITION BY "default", r ORDER BY md5(
         'fold' || r || '|' || gameID || '|' || teamName || '|' || playByUs || '|' || gameDate))
         - 1) % {folds} AS INTEGER) AS fold
FROM labelled, range({repeats}) AS t(r)
"""


def label_totals_statement() -> str:
    """Test rows of each label, for every point of the models' grids."""
    points = [("boosted", "depth 3 leaf 5", trees) for trees in (4, 8)]
    points += [("forest", f"mtry {m}", 40) for m in (2, 6, 10, 14, 18)]
    values = ", ".join(f"('{m}', '{s}', {t})" for m, s, t in points)
    split = split_statement()
    return split.replace("SELECT gameID, teamName, playByUs, gameDate, \"default\",\n       nth", """
, split AS (SELECT "default" AS label, nth""", 1).rstrip() + f""")
SELECT model, setting, trees, label, count(*) AS n
FROM split, (VALUES {values}) AS p(model, setting, trees)
WHERE NOT in_train GROUP BY ALL
"""


NEAREST = SCALED + """
, unit AS (SELECT team_id, feature, z / sqrt(sum(z * z) OVER (PARTITION BY team_id)) AS u
           FROM scaled QUALIFY sum(z * z) OVER (PARTITION BY team_id) > 0),
gaps AS (SELECT a.team_id, b.team_id AS other_id, round(1 - sum(a.u * b.u), 9) AS distance
         FROM unit a JOIN unit b ON a.feature = b.feature AND a.team_id <> b.team_id
         GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY distance, other_id) AS rank
           FROM gaps)
SELECT team_id, CAST(rank AS INTEGER) AS rank, other_id, round(distance, 5) + 0.0 AS distance
FROM ranked WHERE rank <= 5
"""

# Power iteration by repeated squaring; the component found is taken out of the matrix
# (a), and the search (p) starts again with the rest.
SPECTRUM = "".join([SCALED, f"""
, cells AS (SELECT a.feature AS f, b.feature AS g, sum(a.z * b.z) / (count(*) - 1) AS c
            FROM scaled a JOIN scaled b USING (team_id) GROUP BY ALL),
lines AS (SELECT f, list(c ORDER BY g) AS line FROM cells GROUP BY f),
first AS (SELECT list(line ORDER BY f) AS a FROM lines),
steps AS (
  SELECT * FROM (
    WITH RECURSIVE power AS (
      SELECT 1 AS component, 0 AS step, a, a AS p, NULL::DOUBLE AS eigenvalue FROM first
      UNION ALL
      SELECT CASE WHEN step = 40 THEN component + 1 ELSE component END,
             CASE WHEN step = 40 THEN 0 ELSE step + 1 END,
             CASE WHEN step = 40 THEN rest ELSE a END,
             CASE WHEN step = 40 THEN rest ELSE squared END,
             CASE WHEN step = 40 THEN value END
      FROM (SELECT *, list_transform(a, lambda r, i: list_transform(r, lambda x, j:
                     x - value * v[i] * v[j])) AS rest,
                   list_transform(raw, lambda r: list_transform(r, lambda x: x / size)) AS squared
            FROM (SELECT *, list_dot_product(v, list_transform(a, lambda r:
                           list_dot_product(r, v))) AS value,
                         greatest(list_sum(list_transform(raw, lambda r, i: r[i])), 1e-300) AS size
                  FROM (SELECT *, list_transform(p, lambda r: list_transform(p, lambda q:
                                 list_dot_product(r, q))) AS raw,
                               list_transform(p[top], lambda x: x / sqrt(greatest(p[top][top], 1e-300))) AS v
                        FROM (SELECT *, list_position(diagonal, list_max(diagonal)) AS top
                              FROM (SELECT *, list_transform(p, lambda r, i: r[i]) AS diagonal
                                    FROM power WHERE component <= {len(_FEATURES)})))))
    ) SELECT component - 1 AS component, eigenvalue FROM power WHERE eigenvalue IS NOT NULL)),
values_ AS (SELECT component, greatest(eigenvalue, 0) AS eigenvalue FROM steps)
SELECT CAST(component AS INTEGER) AS component, round(eigenvalue, 4) + 0.0 AS eigenvalue,
       round(eigenvalue / sum(eigenvalue) OVER (), 4) + 0.0 AS share,
       round(sum(eigenvalue) OVER (ORDER BY component) / sum(eigenvalue) OVER (), 4) + 0.0
         AS cumulative
FROM values_
"""])


ORACLE: dict[str, str] = {
    "feed_events": over(
        "SELECT gameID, competition, ourName, theirName, time, epochTime, eventName, "
        "byUs, ord, " + ", ".join(rounded(c) for c in (
            "lengthFraction", "widthFraction", "lengthMetres", "widthMetres",
            "lengthChangeMetres", "distance", "distanceToNextEventMetres", "duration",
            "direction")) + " FROM feed", "feed"),
    "sequence_events": over(f"SELECT {tidy(_SEQ, _SEQ_DOUBLES)} FROM seq", "seq"),
    "turnover_pseudo_events": over(
        f"SELECT {tidy(_SEQ, _SEQ_DOUBLES)} FROM seq WHERE pseudoEvent", "seq"),
    "completed_passes": over(
        f"SELECT {_EVENT_KEY}, adjEventName, playNumber, sequenceNumber FROM seq "
        "WHERE adjPass = 1", "seq"),
    "incursions": over(
        f"SELECT {_EVENT_KEY}, attackIncursion, penaltyIncursion FROM seq "
        "WHERE attackIncursion = 1 OR penaltyIncursion = 1", "seq"),
    "pass_flags": over(
        f"SELECT {_EVENT_KEY}, {rounded('direction')}, {rounded('duration')}, isBackPass, "
        "isFwdPass, isSidePass, isPass10m, isPass10_20m, isPass20m FROM passes", "passes"),
    "zones": over(f"SELECT {_EVENT_KEY}, zone FROM passes", "passes"),
    "goal_fix": over(
        f"SELECT {_EVENT_KEY}, {rounded('lengthMetres')}, {rounded('lengthFraction')}, "
        "zone FROM passes WHERE adjEventName = 'goal'", "passes"),
    "enriched_events": over(
        "SELECT " + tidy(ENRICHED_COLUMNS, ["widthMetres", "widthFraction"])
        + " FROM enriched", "enriched"),
    "plays": over(f"SELECT {tidy(PLAY_COLUMNS, PLAY_DOUBLES)} FROM plays", "plays"),
    "match_team_profile": over(
        f"SELECT {tidy(MATCH_TEAM_KEYS + _PROFILE_COLUMNS, _PROFILE_DOUBLES)}, "
        f"{result_case('goals', 'sum(goals) OVER m')} AS result FROM match_team "
        "WINDOW m AS (PARTITION BY competition, gameID)", "match_team"),
    "team_profile": over(
        f"SELECT {tidy(TEAM_KEYS + _PROFILE_COLUMNS, _PROFILE_DOUBLES)} FROM team",
        "team"),
    "age_totals": over(
        f"SELECT age_group, playByUs, {tidy(_NUMERIC, PLAY_DOUBLES + RATES)} FROM ages",
        "ages"),
    "game_totals": over(
        f"SELECT gameID, matchName, playByUs, gameDate, "
        f"{tidy(_NUMERIC, PLAY_DOUBLES + RATES)} FROM games", "games"),
    "match_features": over(
        f"SELECT {tidy(MATCH_KEYS + _SHARES, _SHARES)} FROM features", "features"),
    "match_labels": over(
        f"SELECT {', '.join(MATCH_KEYS)}, result, \"default\" FROM features", "features"),
    "new_games": over(
        f"SELECT DISTINCT gameID FROM feed WHERE gameID NOT IN (SELECT gameID FROM feed "
        f"WHERE competition IN ({_TOP}))", "feed"),
    "pending_events": over(
        f"SELECT gameID, ord, competition, eventName FROM feed WHERE gameID NOT IN "
        f"(SELECT gameID FROM feed WHERE competition IN ({_TOP}))", "feed"),
    "converted_append": over(
        "SELECT gameID, competition, count(*) AS n_events, "
        "max(playNumber) AS n_plays FROM seq GROUP BY gameID, competition", "seq"),
    "converted_batches": over("""
SELECT e.gameID, competition, n_events, coalesce(n_plays, 0) AS n_plays
FROM (SELECT gameID, competition, count(*) AS n_events FROM seq GROUP BY gameID, competition) e
LEFT JOIN (SELECT gameID, count(*) AS n_plays FROM plays GROUP BY gameID) p
ON e.gameID = p.gameID""", "plays"),
    "competition_extract": over(
        f"SELECT {tidy(PLAY_COLUMNS, PLAY_DOUBLES)} FROM plays "
        f"WHERE competition IN ({_TOP})", "plays"),
    "passing_breakdown": over(passing(), "plays"),
    "passing_breakdown_fouls": over(
        passing(f"firstEvent IN ({quoted(FOUL_RESTARTS)}) AND totalPasses > 0"), "plays"),
    "heat_map_us": over(heat("true"), "enriched"),
    "heat_map_goals": over(heat("true", "isGoal = 1 AND theirName = 'Opp_3'"), "enriched"),
    "game_possession_match": over(
        "SELECT * FROM (" + possession(["ourPossession", "theirPossession"])
        + ") WHERE matchName = (SELECT min(matchName) FROM enriched)", "enriched"),
    "unlabelled_documents": """
SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""",
    "heat_map_opposition": over(heat("false"), "enriched"),
    "heat_map_first_contacts": over(
        heat("true", "isAttackIncursion = 1 AND sequenceNumber = 1 AND numberPasses > 0"),
        "enriched"),
    "play_map_segments": over(play_map(0, 100), "enriched"),
    "play_map_attacks": over(
        play_map(25, 75, "isAttackIncursion = 1"), "enriched"),
    "scoreboard": over(SCOREBOARD, "enriched"),
    "team_stats_count": over(team_stats(list(LABELS), False), "games"),
    "team_stats_share": over(team_stats(SHARED, True), "games"),
    "match_result": over(RESULTS, "games"),
    "age_stats_count": over(age_stats(list(LABELS), False), "ages"),
    "age_stats_share": over(age_stats(SHARED, True), "ages"),
    "game_possession": over(possession(["ourPossession", "theirPossession"]), "enriched"),
    "game_possession_attacking": over(
        possession(["ourAttackingPossession", "theirAttackingPossession"]), "enriched"),
    "game_possession_defensive": over(
        possession(["ourDefensivePossession", "theirDefensivePossession"]), "enriched"),
    "pick_list_opponents": over(pick_list("theirName"), "enriched"),
    "pick_list_matches": over(pick_list("matchName"), "enriched"),
    "team_priority": over(PRIORITY, "plays"),
    "scaled_profiles": over(
        SCALED + "SELECT team_id, feature, round(z, 5) + 0.0 AS z FROM scaled", "team"),
    "cosine_distances": over(SCALED + f"""
, anchor AS (SELECT feature, z AS a FROM scaled WHERE team_id = '{GIRLS_16}|Us_1|true')
SELECT team_id, '{GIRLS_16}|Us_1|true' AS other_id,
       round(1 - sum(z * a) / (sqrt(sum(z * z)) * sqrt(sum(a * a))), 5) + 0.0 AS distance
FROM scaled JOIN anchor USING (feature) GROUP BY team_id""", "team"),
    "cluster_input": over(
        f"SELECT {_TEAM_ID} AS team_id, competition, teamName, playByUs, age_group, "
        + ", ".join(rounded(c, f'"{n}"') for c, n in TEAM_FEATURES.items())
        + f" FROM team WHERE {_COMPLETE}", "team"),
    "line_distribution": """
SELECT l_returnflag, l_linenumber, cnt,
       CAST(sum(cnt) OVER (PARTITION BY l_returnflag) AS BIGINT) AS max_tp,
       round(cnt / sum(cnt) OVER (PARTITION BY l_returnflag), 6) + 0.0 AS perc
FROM (SELECT l_returnflag, l_linenumber, count(*) AS cnt FROM lineitem GROUP BY ALL)
""",
    "customers_without_orders": """
SELECT DISTINCT c_custkey AS custkey FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
""",
    "label_correlation": over(labels_correlation(), "labelled"),
    "stratified_split": over(split_statement(), "labelled"),
    "cv_folds": over(folds_statement(), "labelled"),
    "model_label_totals": over(label_totals_statement(), "labelled"),
    "nearest_teams": over(NEAREST, "team"),
    "pca_spectrum": over(SPECTRUM, "team"),
    "feed_roundtrip": over(
        "SELECT gameID, competition, ourName, theirName, time, epochTime, eventName, "
        "byUs, ord, CAST(NULL AS VARCHAR) AS bad_row, " + ", ".join(rounded(c) for c in (
            "lengthFraction", "widthFraction", "lengthMetres", "widthMetres",
            "lengthChangeMetres", "distance", "distanceToNextEventMetres", "duration",
            "direction")) + " FROM feed", "feed"),
}
