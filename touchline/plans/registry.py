"""Statistic families a stacked report can show (fixed names and labels)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Stat:
    title: str
    ylab: str
    labels: dict[str, str]  # column -> display label, in display order
    kind: str = "both"      # "both": counts and shares; "count": counts only


STATS: dict[str, Stat] = {
    "AttackSides": Stat(
        "Channel into Attacking Third", "Attack Channel",
        {"leftAttack": "Left", "middleAttack": "Middle", "rightAttack": "Right"}),
    "PassSequence": Stat(
        "Number of Passes per Play", "Possession",
        {"pass7Plus": "7+", "pass4_6": "4 - 6", "pass2_3": "2 - 3", "pass1": "1",
         "passZero": "0"}),
    "TurnoverDirection": Stat(
        "First Pass Direction After Turnover", "Pass Direction",
        {"backPassTurnover": "Back", "sidePassTurnover": "Side",
         "fwdPassTurnover": "Forward"}),
    "RegionDuration": Stat(
        "Time Spent in Each Region", "Region",
        {"AttackDuration": "Attack", "MidfieldDuration": "Midfield",
         "DefenceDuration": "Defence"}),
    "PassDirection": Stat(
        "Direction of Passes", "Direction",
        {"totalBackPasses": "Back", "totalSidePasses": "Side",
         "totalFwdPasses": "Forward"}),
    "PassLength": Stat(
        "Length of Forward Passes", "Length",
        {"total10mPasses": "< 10m", "total10_20mPasses": "10 - 20m",
         "total20mPasses": "20m +"}),
    "RegionDistance": Stat(
        "Distance of Ball in Regions", "Region",
        {"attackDistance": "Attack", "midfieldDistance": "Midfield",
         "defenceDistance": "Defence"}),
    "RegionPass": Stat(
        "Number of Passes in Regions", "Region",
        {"attackPasses": "Attack", "midfieldPasses": "Midfield",
         "defencePasses": "Defence"}),
    "CrossfieldPlay": Stat(
        "Changes of Attack in Defence", "Number",
        {"crossfieldPlay": "CrossField"}, "count"),
    "ppm": Stat("Passes Per Minute", "Passes", {"ppm": "Passes Per Minute"}, "count"),
    "velocity": Stat(
        "Velocity of Ball in Possession", "Velocity", {"aveVelocity": "Velocity"},
        "count"),
    "backKeeper": Stat(
        "Number of Passes back to Keeper Box", "Passes",
        {"backKeeperPasses": "Back to Keeper"}, "count"),
    "RegionMoves": Stat(
        "Switch Between Regions", "Plays",
        {"MAPlay": "Mid - Att", "AMPlay": "Att - Mid", "MDPlay": "Mid - Def",
         "DMPlay": "Def - Mid"}),
    "goalRegion": Stat(
        "Zone Where Goals Start From", "Goals",
        {"goalAttack": "Attack", "goalMidfield": "Midfield",
         "goalDefence": "Defence"}),
    "goalTransition": Stat(
        "Play Where Goals Start From", "Goals",
        {"goalTurnover": "Turnover", "goalRestart": "Restart"}),
}
