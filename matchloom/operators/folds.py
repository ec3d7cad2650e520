"""What depends on the order of one match's readings, as small folds over that order.

Each fold sees the records of a match one by one, in order of the time at which they are *due*; the batch jobs feed it
a sorted group (``matching.settle``), the streams feed it what the watermark has passed (``streaming.ordered``). So a
stream gives what the batch gives. A fold's state is a dictionary of numbers, strings and lists; it holds what later
records can still ask for, and no more.
"""

from __future__ import annotations

from typing import Any

LATE_ROW_MS, LATE_ELIM_MS, COUNTER_AFTER_MS = 8000, 15_000, 1000
AFTER_MS, LAG_MS, LATE_LAG_MS, BACKLOG_MS, TIMELY_MS = 1000, 12_000, 25_000, 3500, 1500
LEAD_MS, SLOT_LAG_MS = 500, 1500
DEDUPE_MS = 5000


class LateRows:
    """The round of a row: the latest one that had started, or the one before where the row is late.

    Rows are due ``COUNTER_AFTER_MS`` after their time, when every death that may speak for their round is known.
    State: the start of each round and the time of its first death.
    """

    def __init__(self, state: dict[str, Any] | None = None) -> None:
        self.state = state or {"starts": [], "deaths": {}}

    def start(self, t_ms: int, round_no: int) -> None:
        self.state["starts"].append([t_ms, round_no])

    def death(self, t_ms: int, round_no: int) -> None:
        first = self.state["deaths"]
        first[str(round_no)] = min(t_ms, first.get(str(round_no), t_ms))

    def row(self, t_ms: int, is_elimination: bool) -> tuple[int, bool]:
        """Its round, and whether it came late."""
        begun = max(((no, s) for s, no in self.state["starts"] if s <= t_ms), default=None)
        if begun is None:
            return 1, False
        no, since = begun[0], t_ms - begun[1]
        died = self.state["deaths"].get(str(no), t_ms + COUNTER_AFTER_MS + 1) <= t_ms + COUNTER_AFTER_MS
        late = no >= 2 and (since <= LATE_ROW_MS or (is_elimination and since <= LATE_ELIM_MS and not died))
        return no - late, late


def teams_of(deaths: list[tuple[int, int]], slots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """deaths and slots that went grey, (t_ms, id) each: (death, slot) where a slot, in order of time, takes the earliest free death from 1.5 s before to 0.5 s after it."""
    free, pairs = sorted(deaths), []
    for t, slot in sorted(slots):
        at = next((k for k, (d, _) in enumerate(free) if -LEAD_MS <= t - d <= SLOT_LAG_MS), None)
        if at is not None:
            pairs.append((free.pop(at)[1], slot))
    return pairs


class Pairing:
    """One-to-one pairs of eliminations and deaths of a round.

    A row takes the oldest free death of its round that is not too old and not of the other team; but where that one is
    too old to be its own and another has just happened, that one. It learns the victim's team by it. What finds none
    waits until no row can claim a death within its reach any more, and then takes the oldest one left there.

    Deaths are due at their time and rows ``AFTER_MS`` after theirs. Results are (kind, event, death, t_ms): kind is
    ``pair`` or ``settled`` (a death found at once, or at the end), ``no_drop`` (a row without one), ``no_row`` (a death
    without one). State: deaths of the last 53 s, rows of the last 27 s, one team per player.
    """

    SETTLE_MS = LATE_LAG_MS + AFTER_MS + AFTER_MS

    def __init__(self, state: dict[str, Any] | None = None) -> None:
        self.state = state or {"free": [], "waiting": [], "teams": {}}

    def death(self, t_ms: int, death_id: int, round_no: int, team: str | None) -> None:
        """In order of (t_ms, death_id)."""
        self.state["free"].append([t_ms, death_id, round_no, team])

    def row(self, t_ms: int, event_id: int, round_no: int, victim: int | None, named: bool, late: bool) -> list[tuple]:
        """In order of (t_ms, event_id)."""
        team = self.state["teams"].get(str(victim)) if victim is not None else None
        most = LATE_LAG_MS if late else LAG_MS
        fits = [d for d in self.state["free"] if d[2] == round_no and -AFTER_MS <= t_ms - d[0] <= most and not (team and d[3] and d[3] != team)] if named else []
        if not fits:
            self.state["waiting"].append([t_ms, event_id, round_no])
            return []
        pick = fits[0]
        timely = [d for d in fits if t_ms - d[0] <= TIMELY_MS] if t_ms - pick[0] > BACKLOG_MS else []
        if timely:
            pick = max(timely, key=lambda d: (d[0] <= t_ms, d[0]))
        self.state["free"].remove(pick)
        if victim is not None and pick[3]:
            self.state["teams"].setdefault(str(victim), pick[3])
        return [("pair", event_id, pick[1], pick[0])]

    def passed(self, now_ms: float) -> list[tuple]:
        """What is decided once all that is due by now is known: rows that waited, deaths that nobody can claim any more."""
        out = []
        waiting, free = self.state["waiting"], self.state["free"]
        while waiting and waiting[0][0] + self.SETTLE_MS < now_ms:
            t, event_id, round_no = waiting.pop(0)
            death = next((d for d in free if d[2] == round_no and -AFTER_MS <= t - d[0] <= LATE_LAG_MS), None)
            if death:
                free.remove(death)
            out.append(("settled", event_id, death[1], death[0]) if death else ("no_drop", event_id, None, None))
        # a row up to LATE_LAG_MS after it may still wait for this one
        gone = [d for d in free if d[0] + LATE_LAG_MS + self.SETTLE_MS < now_ms]
        for d in gone:
            free.remove(d)
            out.append(("no_row", None, d[1], d[0]))
        return out

    def next_ms(self) -> int | None:
        """When something will be decided without a new record."""
        due = [w[0] + self.SETTLE_MS + 1 for w in self.state["waiting"][:1]] + [d[0] + LATE_LAG_MS + self.SETTLE_MS + 1 for d in self.state["free"][:1]]
        return min(due, default=None)


class Kept:
    """Rows less those within 5 s of the last KEPT one of their key. State: the last one kept of each key, for 5 s."""

    def __init__(self, state: dict[str, Any] | None = None) -> None:
        self.state = state or {}

    def row(self, t_ms: int, key: str) -> bool:
        last = self.state.get(key)
        if last is not None and t_ms - last <= DEDUPE_MS:
            return False
        self.state[key] = t_ms
        return True

    def passed(self, now_ms: int) -> None:
        for key in [k for k, last in self.state.items() if now_ms - last > DEDUPE_MS]:
            del self.state[key]


class Counter:
    """Two equal readings in a row confirm a value; it counts from the first reading that left the value before. State: four numbers."""

    def __init__(self, state: dict[str, Any] | None = None) -> None:
        self.state = state or {"value": None, "left": None, "pending": None, "since": None}

    def reading(self, t_ms: int, value: int) -> tuple | None:
        """(t_ms, was, value, deaths) where a change is confirmed."""
        s, out = self.state, None
        if value != s["value"] and s["left"] is None:
            s["left"] = t_ms
        twice = s["pending"] == value
        s["pending"], s["since"] = value, s["since"] if twice else t_ms
        if value == s["value"]:
            s["left"] = None
        elif twice:
            out = (s["since"] if s["value"] is None else s["left"], s["value"], value, 0 if s["value"] is None else max(s["value"] - value, 0))
            s["value"], s["left"] = value, None
        return out
