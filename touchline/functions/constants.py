"""Fixed values of the match-event domain.

Everything in this module is a fixed value: results only agree with the
published definitions when these are spelled exactly like this.
"""

# --- pitch, in metres (fixed values) ---------------------------------------
PITCH_LENGTH = 110.0
PITCH_WIDTH = 75.0
BOX_DEPTH = 16.5
BOX_NEAR = 17.34
BOX_FAR = 75 - 17.34
HALFWAY = 55.0

# --- thresholds (fixed values; the three "third" limits really do differ) --
INCURSION_FRACTION = 0.66666667
DEFENCE_FRACTION = 0.333333
ATTACK_FRACTION = 0.666667
DRIBBLE_SPEED = 8.0
DRIBBLE_METRES = 15.0
CLEARANCE_METRES = 10.0
CLEARANCE_GAIN = 3.0
CLEARANCE_FRACTION = 0.33
SIDE_FROM = 75.0
SIDE_TO = 105.0
SHORT_PASS = 10.0
LONG_PASS = 20.0
CROSSFIELD_METRES = 50.0

# --- event vocabulary (fixed values) ---------------------------------------
ENDS = ["change ends", "finish"]
OUTS = ["sideline out", "corner", "goalkick"]
FOULS = ["offside", "direct freekick", "indirect freekick"]
FOUL_RESTARTS = ["offside restart", "direct restart", "indirect restart"]
DEAD_BALLS = ["sideline out", "goalkick", "corner", "penalty", "goal"]
SAME_PLAYER_AFTER = ["first touch", "dribble", "clearance"]
SAME_PLAYER_EVENTS = [
    "sideline out", "corner", "goalkick", "shot", "rebound", "goal",
    "sideline out defence",
]
PASSING_EVENTS = [
    "throw in", "dribble", "kick off", "first touch", "goal kick",
    "keeper punt", "corner kick", "offside restart", "direct restart",
    "indirect restart",
]
NOT_CARRIED_BEFORE = ["goal kick", "sideline out"]

# --- competitions (fixed values) -------------------------------------------
TOP_FLIGHT = [
    "2019 World Cup 2019 Mens Open",
    "2019 International Friendly Mens Open",
    "2019 Icc Football Mens Open",
    "2019 Mens Open",
]
BOYS_13 = "2019 NSFA 1 Boys Under 13"
GIRLS_16 = "2019 NSFA 1 Girls Under 16"
BOYS_14 = "2019 Boys Under 14"
ODD_COMPETITION = "2017 Mens Open"
HOME_TEAM = "NFC Red"

# --- keys ------------------------------------------------------------------
PLAY_KEYS = ["gameID", "competition", "ourName", "theirName", "playNumber"]
MATCH_TEAM_KEYS = ["competition", "gameID", "teamName", "playByUs"]
TEAM_KEYS = ["competition", "teamName", "playByUs", "age_group"]
FEATURE_KEYS = [
    "competition", "gameID", "teamName", "playByUs", "matchName", "gameDate",
    "ourName", "theirName",
]

# --- column families (fixed names) -----------------------------------------
MATCH_SUMS = [
    "distance", "attackDistance", "midfieldDistance", "defenceDistance",
    "isAttackIncursion", "isPenaltyIncursion", "isZone17Incursion",
    "isZone14Incursion", "isZone11PassIncursion", "totalPasses",
    "totalBackPasses", "totalFwdPasses", "totalSidePasses", "total10mPasses",
    "total10_20mPasses", "total20mPasses", "possessionDuration",
    "AttackDuration", "MidfieldDuration", "DefenceDuration",
    "AttackHalfDuration", "DefenceHalfDuration", "playDuration",
    "attackPasses", "midfieldPasses", "defencePasses", "crossfieldPlay",
    "goals", "shots", "backPassTurnover", "fwdPassTurnover",
    "sidePassTurnover", "rightAttack", "middleAttack", "leftAttack",
    "defenceOut", "MAPlay", "AMPlay", "MDPlay", "DMPlay", "backKeeperPasses",
    "clearances", "passZero", "pass1", "pass2_3", "pass4_6", "pass7Plus",
]
MATCH_DERIVED = ["ppm", "aveVelocity", "zone14_17", "goal_shots"]
PREDICTORS = [
    "totalBackPasses_pcnt", "totalFwdPasses_pcnt", "totalSidePasses_pcnt",
    "total10mPasses_pcnt", "total10_20mPasses_pcnt", "total20mPasses_pcnt",
    "crossfieldPlay_pcnt", "backPassTurnover_pcnt", "fwdPassTurnover_pcnt",
    "sidePassTurnover_pcnt", "rightAttack_pcnt", "middleAttack_pcnt",
    "leftAttack_pcnt", "backKeeperPasses_pcnt", "passZero_pcnt", "pass1_pcnt",
    "pass2_3_pcnt", "pass4_6_pcnt", "pass7Plus_pcnt", "ppm_pcnt",
    "aveVelocity_pcnt", "isZone11PassIncursion_pcnt",
]

# Team-profile features used for clustering, with their display labels.
CLUSTER_FEATURES = {
    "ppm": "Passes Per Minute",
    "aveVelocity": "Velocity",
    "isZone17Incursion_pcnt": "Zone 17 Incursions",
    "isZone14Incursion_pcnt": "Zone 14 Incursions",
    "isZone11PassIncursion_pcnt": "Passes into Zone 11",
    "totalBackPasses_pcnt": "Back Pass",
    "totalFwdPasses_pcnt": "Forward Pass",
    "totalSidePasses_pcnt": "Side Pass",
    "total10mPasses_pcnt": "10m Passes",
    "total10_20mPasses_pcnt": "10-20m Passes",
    "total20mPasses_pcnt": "20m+ Passes",
    "crossfieldPlay_pcnt": "Crossfield Play across Back",
    "backPassTurnover_pcnt": "Back Pass from Turnover",
    "fwdPassTurnover_pcnt": "Forward Pass from Turnover",
    "sidePassTurnover_pcnt": "Side Pass from Turnover",
    "AMPlay_pcnt": "Attack to Midfield",
    "MDPlay_pcnt": "Midfield to Defence",
    "backKeeperPasses_pcnt": "Passes to Keeper",
    "clearances_pcnt": "Clearances",
    "passZero_pcnt": "Plays with No Passes",
    "passPlay_pcnt": "Plays with Passes",
    "pass1_pcnt": "Plays with 1 Pass",
    "pass2_3_pcnt": "Plays with 2-3 Passes",
    "pass4_6_pcnt": "Plays with 4-6 Passes",
    "pass7Plus_pcnt": "Plays with 7+ Passes",
}
