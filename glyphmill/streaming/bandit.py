"""Bandits over profiles and sources: one value at a time is tried beside what is in use, and kept if its rewards are better.

The state of a bucket is plain JSON of bounded size, so that a state store or a table keeps it. Draws are hashes of the bucket and a
counter, so that a rerun takes the same way.
"""

from __future__ import annotations

import json
import zlib

from glyphmill.functions.score import KNOBS, KNOBS_OF

#: Chance to try, samples needed of the tried and of the one in use, lift, strike level, strikes, rewards of the baseline, samples of a bucket
#: before anything is tried, and what a reward that was told or was inferred weighs.
EPSILON, NEED, BASE_NEED, LIFT, STRIKE, STRIKES, BASELINE, SAMPLE_FLOOR = 0.10, 20, 5, 0.05, 0.30, 3, 50, 20
EXPLICIT_WEIGHT, IMPLICIT_WEIGHT = 1.0, 0.5


def new_trial(**what) -> dict:
    """Of each side the number and sum of weighted rewards; strikes in a row of the tried one."""
    return {"tried": [0, 0.0], "base": [0, 0.0], "strikes": 0, **what}


def settle(trial: dict, tried: bool, adjusted: float, weight: float = EXPLICIT_WEIGHT) -> str:
    """Takes one reward: rollback after strikes in a row, promote or discard once both sides have their samples, else the side it went to."""
    side = trial["tried" if tried else "base"]
    side[0] += 1
    side[1] += adjusted * weight
    if tried:
        trial["strikes"] = trial["strikes"] + 1 if adjusted < STRIKE else 0
        if trial["strikes"] >= STRIKES:
            return "rollback"
    (n, x), (m, y) = trial["tried"], trial["base"]
    if n >= NEED and m >= BASE_NEED:
        return "promote" if x / n > y / m + LIFT else "discard"
    return "try" if tried else "base"


class Bucket:
    """State and draws of one bucket. first: its state where none is saved."""

    def __init__(self, key: str, saved: str | None, first: dict):
        self.key, self.s = key, json.loads(saved) if saved else {"n": 0, "recent": [], "live": None, **first}

    def saved(self) -> str:
        return json.dumps(self.s)

    def draw(self, use: str) -> float:
        return zlib.crc32(f"{self.key}/{self.s['n']}/{use}".encode()) / 2**32

    def less_baseline(self, raw: float) -> float:
        """The reward less the mean of those before it."""
        recent = self.s["recent"]
        out = raw - (sum(recent) / len(recent) if recent else 0.0)
        self.s["recent"] = [*recent, raw][-BASELINE:]
        return out


class ProfileBandit(Bucket):
    """Knobs of a profile, one step of one knob at a time. Queries are served by serve(), rewards of served profiles come later by reward()."""

    def __init__(self, intent: str, key: str, saved: str | None = None, floor: int = SAMPLE_FLOOR):
        super().__init__(key, saved, {"samples": 0, "knobs": {k: KNOBS_OF.get(intent, {}).get(k, default) for k, default, _, _ in KNOBS}})
        self.floor = floor

    @staticmethod
    def id_of(knobs: dict[str, int]) -> str:
        return ",".join(f"{k}={v}" for k, v in sorted(knobs.items()))

    def serve(self) -> tuple[str, str]:
        """(profile, action): the profile in use, but in one of ten queries the one under test; where none is, a new one in one of ten."""
        s = self.s
        s["n"] += 1
        base = self.id_of(s["knobs"])
        if s["samples"] < self.floor:
            return base, "cold"
        if self.draw("serve") >= EPSILON:
            return base, "base"
        if s["live"] is None:
            name, _, least, most = KNOBS[int(self.draw("knob") * len(KNOBS))]
            now = s["knobs"][name]
            value = min(most, max(least, now + (-1 if self.draw("side") < 0.5 else 1)))
            if value == now:  # a step that a bound takes back is none
                return base, "base"
            s["live"] = new_trial(knobs=s["knobs"] | {name: value}, base_id=base, id=self.id_of(s["knobs"] | {name: value}))
            return s["live"]["id"], "explore"
        return s["live"]["id"], "try"

    def reward(self, profile: str | None, adjusted: float, weight: float = EXPLICIT_WEIGHT) -> str:
        """What a reward of a served profile does. Of a profile that is neither under test nor what it is tested against, nothing."""
        s = self.s
        s["samples"] += 1
        live = s["live"]
        if live is None:
            return "none"
        if profile not in (live["id"], live["base_id"]):
            return "stale"
        action = settle(live, profile == live["id"], adjusted, weight)
        if action in ("promote", "discard", "rollback"):
            s["live"] = None
        if action == "promote":
            s["knobs"] = live["knobs"]
        return action


class SourceBandit(Bucket):
    """How many documents each source of a bucket gives: at most one source is tried at a time, one step up or down."""

    #: sources' first breadth and bounds.
    START, LEAST, MOST = 5, 2, 15

    def __init__(self, key: str, sources: tuple[str, ...], saved: str | None = None):
        super().__init__(key, saved, {"breadth": dict.fromkeys(sources, self.START)})

    def add(self, raw: float) -> tuple[str, str | None, int | None]:
        """(action, source, served breadth) of the next query, whose reward is raw. The query that starts a trial is served by it."""
        s = self.s
        s["n"] += 1
        adjusted = self.less_baseline(raw)
        fresh = s["live"] is None and self.explore()
        if s["live"] is None:
            return "current", None, None
        live = s["live"]
        tried = fresh or self.draw("serve") < EPSILON
        action = settle(live, tried, adjusted)
        if action in ("promote", "discard", "rollback"):
            s["live"] = None
        if action == "promote":
            s["breadth"][live["source"]] = live["value"]
        return action, live["source"], live["value"] if tried else live["from"]

    def explore(self) -> bool:
        if self.draw("explore") >= EPSILON:
            return False
        names = sorted(self.s["breadth"])
        source = names[int(self.draw("source") * len(names))]
        now = self.s["breadth"][source]
        value = min(self.MOST, max(self.LEAST, now + (-1 if self.draw("side") < 0.5 else 1)))
        if value == now:
            return False
        self.s["live"] = new_trial(source=source, value=value, **{"from": now})
        return True
