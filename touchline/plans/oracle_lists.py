"""Column definitions for the DuckDB statements (fixed values).

Written from the definitions of the tables, not from the code under check:
nothing here is imported from the operators, and they import nothing from here.
"""

from __future__ import annotations

# --- play table ---------------------------------------------------------------
PLAY_KEYS = "gameID competition ourName theirName playNumber".split()
PLAY_COLUMNS = """
gameID competition age_group ourName theirName playNumber gameDate playByUs matchName teamName
usPhase half oppositionPhase firstEvent lastEvent Area lastArea firstEventArea
firstPenalyIncursion firstZone lastZone numSequences numPlayers
distance attackDistance midfieldDistance defenceDistance
isAttackIncursion isGoal isPenaltyIncursion isZone17Incursion isZone14Incursion
isZone11PassIncursion playPhase
totalPasses totalBackPasses totalFwdPasses totalSidePasses
total10mPasses total10_20mPasses total20mPasses
possessionDuration AttackDuration MidfieldDuration DefenceDuration
AttackHalfDuration DefenceHalfDuration playDuration
attackPasses midfieldPasses defencePasses crossfieldPlay goals shots
backPassTurnover fwdPassTurnover sidePassTurnover rightAttack middleAttack leftAttack
defenceOut MAPlay AMPlay MDPlay DMPlay backKeeperPasses clearances
passZero pass1 pass2_3 pass4_6 pass7Plus
""".split()
#: Sums over the play's rows.
PLAY_SUMS = {
    "totalPasses": "adjPass", "totalBackPasses": "isBackPass", "totalFwdPasses": "isFwdPass",
    "totalSidePasses": "isSidePass", "total10mPasses": "isPass10m",
    "total10_20mPasses": "isPass10_20m", "total20mPasses": "isPass20m",
    "playDuration": "duration", "backKeeperPasses": "isBackKeeperPass",
}
#: Highest over the play's rows; an unknown one makes it unknown in STRICT_MAXES.
STRICT_MAXES = "backPassTurnover fwdPassTurnover sidePassTurnover rightAttack middleAttack leftAttack".split()
PLAY_MAXES = {"isAttackIncursion": "attackIncursion", "isGoal": "isGoal",
              "isPenaltyIncursion": "penaltyIncursion"}
PLAY_MOVES = {"MAPlay": "M-A", "AMPlay": "A-M", "MDPlay": "M-D", "DMPlay": "D-M"}
PLAY_EVENTS = {"goals": "goal", "shots": "shot", "clearances": "clearance"}

# --- profiles -------------------------------------------------------------------
TEAM_KEYS = "competition teamName playByUs age_group".split()
MATCH_TEAM_KEYS = "competition gameID teamName playByUs".split()
#: Sums that skip unknown values.
SKIPPING = """distance attackDistance midfieldDistance defenceDistance
isZone17Incursion isZone14Incursion isZone11PassIncursion""".split()
#: Shares: denominator, then the numerators (the column is named numerator_pcnt).
_SHARES = {
    "gameDuration": "AttackDuration MidfieldDuration DefenceDuration AttackHalfDuration DefenceHalfDuration",
    "gameDistance": "attackDistance midfieldDistance defenceDistance",
    "isAttackIncursion": "isZone17Incursion isZone14Incursion isZone11PassIncursion",
    "totalPasses": "totalBackPasses totalFwdPasses totalSidePasses",
    "total10mPasses total10_20mPasses total20mPasses": "total10mPasses total10_20mPasses total20mPasses",
    "totalPasses ": "attackPasses midfieldPasses defencePasses",
    "defencePasses": "crossfieldPlay",
    "backPassTurnover sidePassTurnover fwdPassTurnover": "backPassTurnover sidePassTurnover fwdPassTurnover",
    "rightAttack middleAttack leftAttack": "rightAttack middleAttack leftAttack",
    "MAPlay AMPlay MDPlay DMPlay": "MAPlay AMPlay MDPlay DMPlay",
    "totalBackPasses": "backKeeperPasses",
    "plays": "clearances passZero pass1 pass2_3 pass4_6 pass7Plus",
}
#: Three shares begin with a small letter although their sums do not.
_RENAMED = {"AttackDuration": "attackDuration", "MidfieldDuration": "midfieldDuration",
            "DefenceDuration": "defenceDuration"}
PROFILE_SHARES = {
    f"{_RENAMED.get(top, top)}_pcnt": (top, parts.split())
    for parts, tops in _SHARES.items() for top in tops.split()}
TEAM_FEATURES = {
    "ppm": "Passes Per Minute", "aveVelocity": "Velocity",
    "isZone17Incursion_pcnt": "Zone 17 Incursions", "isZone14Incursion_pcnt": "Zone 14 Incursions",
    "isZone11PassIncursion_pcnt": "Passes into Zone 11",
    "totalBackPasses_pcnt": "Back Pass", "totalFwdPasses_pcnt": "Forward Pass",
    "totalSidePasses_pcnt": "Side Pass", "total10mPasses_pcnt": "10m Passes",
    "total10_20mPasses_pcnt": "10-20m Passes", "total20mPasses_pcnt": "20m+ Passes",
    "crossfieldPlay_pcnt": "Crossfield Play across Back",
    "backPassTurnover_pcnt": "Back Pass from Turnover",
    "fwdPassTurnover_pcnt": "Forward Pass from Turnover",
    "sidePassTurnover_pcnt": "Side Pass from Turnover",
    "AMPlay_pcnt": "Attack to Midfield", "MDPlay_pcnt": "Midfield to Defence",
    "backKeeperPasses_pcnt": "Passes to Keeper", "clearances_pcnt": "Clearances",
    "passZero_pcnt": "Plays with No Passes", "passPlay_pcnt": "Plays with Passes",
    "pass1_pcnt": "Plays with 1 Pass", "pass2_3_pcnt": "Plays with 2-3 Passes",
    "pass4_6_pcnt": "Plays with 4-6 Passes", "pass7Plus_pcnt": "Plays with 7+ Passes",
}

# --- match features ---------------------------------------------------------------
MATCH_KEYS = "competition gameID teamName playByUs matchName gameDate ourName theirName".split()
MATCH_TOTALS = """
distance attackDistance midfieldDistance defenceDistance
isAttackIncursion isPenaltyIncursion isZone17Incursion isZone14Incursion isZone11PassIncursion
totalPasses totalBackPasses totalFwdPasses totalSidePasses
total10mPasses total10_20mPasses total20mPasses
possessionDuration AttackDuration MidfieldDuration DefenceDuration AttackHalfDuration
DefenceHalfDuration playDuration attackPasses midfieldPasses defencePasses
crossfieldPlay goals shots backPassTurnover fwdPassTurnover sidePassTurnover
rightAttack middleAttack leftAttack defenceOut MAPlay AMPlay MDPlay DMPlay
backKeeperPasses clearances passZero pass1 pass2_3 pass4_6 pass7Plus
""".split()
MATCH_RATES = "ppm aveVelocity zone14_17 goal_shots".split()
MATCH_PREDICTORS = [f"{c}_pcnt" for c in """
totalBackPasses totalFwdPasses totalSidePasses total10mPasses total10_20mPasses total20mPasses
crossfieldPlay backPassTurnover fwdPassTurnover sidePassTurnover rightAttack middleAttack
leftAttack backKeeperPasses passZero pass1 pass2_3 pass4_6 pass7Plus ppm aveVelocity
isZone11PassIncursion
""".split()]

# --- stacked reports: display name and, in order, column and label ------------------
BARS = {
    "AttackSides": "leftAttack Left, middleAttack Middle, rightAttack Right",
    "PassSequence": "pass7Plus 7+, pass4_6 4 - 6, pass2_3 2 - 3, pass1 1, passZero 0",
    "TurnoverDirection": "backPassTurnover Back, sidePassTurnover Side, fwdPassTurnover Forward",
    "RegionDuration": "AttackDuration Attack, MidfieldDuration Midfield, DefenceDuration Defence",
    "PassDirection": "totalBackPasses Back, totalSidePasses Side, totalFwdPasses Forward",
    "PassLength": "total10mPasses < 10m, total10_20mPasses 10 - 20m, total20mPasses 20m +",
    "RegionDistance": "attackDistance Attack, midfieldDistance Midfield, defenceDistance Defence",
    "RegionPass": "attackPasses Attack, midfieldPasses Midfield, defencePasses Defence",
    "CrossfieldPlay": "crossfieldPlay CrossField",
    "ppm": "ppm Passes Per Minute",
    "velocity": "aveVelocity Velocity",
    "backKeeper": "backKeeperPasses Back to Keeper",
    "RegionMoves": "MAPlay Mid - Att, AMPlay Att - Mid, MDPlay Mid - Def, DMPlay Def - Mid",
    "goalRegion": "goalAttack Attack, goalMidfield Midfield, goalDefence Defence",
    "goalTransition": "goalTurnover Turnover, goalRestart Restart",
}
LABELS = {stat: dict(x.split(" ", 1) for x in bars.split(", ")) for stat, bars in BARS.items()}
#: These are only counted, never shown as shares.
COUNTED = ("CrossfieldPlay", "ppm", "velocity", "backKeeper")
SHARED = [s for s in BARS if s not in COUNTED]
