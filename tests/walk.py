"""Row-by-row sequencing of one game, for checking the Spark cascade.

A state machine over one game's rows (dicts in order).  Missing next rows make
a condition false.
"""

from __future__ import annotations

FOULS = {"offside": "offside restart", "direct freekick": "direct restart",
         "indirect freekick": "indirect restart"}
RESTARTS = {"sideline out": "throw in", "sideline out defence": "throw in",
            "goalkick": "goal kick", "corner": "corner kick",
            "penalty": "penalty kick"}
OUTS = ("sideline out", "corner", "goalkick")
ENDS = ("change ends", "finish")
KEEPS_PLAYER = (*OUTS, "shot", "rebound", "goal", "sideline out defence")
PASSERS = ("throw in", "dribble", "kick off", "first touch", "goal kick",
           "keeper punt", "corner kick", *FOULS.values())


def start_name(row):
    if row["eventName"] != "dribble":
        return row["eventName"]
    metres, seconds = row["distanceToNextEventMetres"], row["duration"]
    if metres is None:
        return "dribble"
    fast = seconds is not None and metres > 8 * seconds
    return "first touch" if fast or metres > 15 else "dribble"


def beyond_box(row):
    l, w = row["lengthMetres"], row["widthMetres"]
    return l > 16.5 or w > 75 - 17.34 or w < 17.34


class Walk:
    def __init__(self, rows):
        self.rows = rows
        self.names = [start_name(r) for r in rows]
        self.out = []
        self.pseudo = []
        self.plays = 0
        self.half = 1
        self.started = False

    def opened(self, row, name, phases=None):
        self.plays += 1
        default = ("BP", "BPO") if row["byUs"] == "true" else ("BPO", "BP")
        return dict(playNumber=self.plays, sequenceNumber=1, player=1,
                    phases=default if phases is None else phases, name=name)

    def continued(self, last, name, step, phases=None):
        return dict(playNumber=self.plays, sequenceNumber=last["sequenceNumber"] + 1,
                    player=last["player"] + step,
                    phases=last["phases"] if phases is None else phases, name=name)

    def state(self, i):
        row, name = self.rows[i], self.names[i]
        idle = dict(playNumber=0, sequenceNumber=0, player=0, phases=("", ""), name=name)
        if not self.started:
            if name == "first touch":
                self.started = True
                return self.opened(row, "kick off")
            return idle
        last, before = self.out[-1], self.out[-1]["name"]
        after = self.names[i + 1] if i + 1 < len(self.rows) else None
        following = self.rows[i + 1] if after else None
        swapped = row["byUs"] != self.rows[i - 1]["byUs"]
        touch = name == "first touch"
        if name in ENDS:
            return idle
        if touch and before in RESTARTS:
            return self.opened(row, RESTARTS[before])
        if name == "keeper":
            if after and after not in ENDS and beyond_box(following):
                return self.opened(row, "keeper punt")
            return idle
        if after == "keeper":
            return self.continued(last, "keeper catch", 1)
        if before == "keeper" and not beyond_box(row):
            return self.opened(row, "keeper punt")
        if name in FOULS:
            return self.continued(last, name, 0, ("", ""))
        if before in FOULS:
            return self.opened(row, FOULS[before])
        if touch and before == "change ends":
            return self.opened(row, "kick off", None if row["byUs"] == "true" else ("", ""))
        if touch and before == "goal":
            return self.opened(row, "kick off")
        if after in OUTS and swapped:
            if after == "sideline out":
                self.names[i + 1] = "sideline out defence"
            return self.continued(last, name, 1)
        if not swapped:
            runs_on = name == "dribble" and before in ("first touch", "dribble", "clearance")
            return self.continued(last, name, 0 if runs_on or name in KEEPS_PLAYER else 1)
        self.pseudo.append(dict(
            ord=row["ord"], playNumber=self.plays, name="turnover",
            sequenceNumber=last["sequenceNumber"] + 1, player=last["player"] + 1,
            phases=last["phases"]))
        cleared = (
            following is not None and row["byUs"] != following["byUs"]
            and row["distance"] is not None and row["distance"] >= 10
            and row["lengthChangeMetres"] > 3 and row["lengthFraction"] <= 0.33)
        us = row["byUs"] == "true"
        phases = ("BPO > BP", "BP > BPO") if us else ("BP > BPO", "BPO > BP")
        return self.opened(row, "clearance" if cleared else name, phases)

    def run(self):
        for i, row in enumerate(self.rows):
            half = self.half
            live = self.started
            now = self.state(i)
            now.update(ord=row["ord"], half=half)
            if live and now["name"] == "change ends":
                self.half += 1
            self.out.append(now)
        for i, (row, now) in enumerate(zip(self.rows, self.out)):
            nxt = self.rows[i + 1] if i + 1 < len(self.rows) else None
            kept = now["playNumber"] > 0 and nxt is not None and row["byUs"] == nxt["byUs"]
            l, w = row["lengthMetres"], row["widthMetres"]
            raw_next = start_name(nxt) if nxt else None
            now["adjPass"] = int(kept and now["name"] in PASSERS and raw_next == "first touch")
            now["attackIncursion"] = int(kept and row["lengthFraction"] >= 0.66666667)
            now["penaltyIncursion"] = int(
                kept and l >= 93.5 and 17.34 <= w <= 75 - 17.34)
        return self.out, self.pseudo


def walk(rows):
    """``(real rows, pseudo rows)`` as lists of dicts."""
    return Walk(rows).run()
