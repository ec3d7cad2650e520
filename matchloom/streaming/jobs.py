"""The incremental side of the match history as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchloom.functions.match_rules import ELIMINATIONS
from matchloom.operators import folds
from matchloom.streaming.ordered import IDLE_MS, ORIGIN_MS, Fold, folded_stream, records

#: A row may come this much after its round has ended, and a death be claimed this late.
LATE = "25 seconds"


def dedupe_stream(events: DataFrame) -> DataFrame:
    """Drops rows of the same match, killer, victim and type within 5 s of the first; ts is the feed's time."""
    return events.withWatermark("ts", "5 seconds").dropDuplicatesWithinWatermark(["match_id", "killer_id", "victim_id", "event_type"])


def sighting_stream(sightings: DataFrame) -> DataFrame:
    """One line per burst of sightings of a key with gaps up to a second: match_id, line, first, last, seen."""
    bursts = sightings.withWatermark("ts", LATE).groupBy("match_id", "line", F.session_window("ts", "1 second")).agg(F.count("*").alias("seen"), F.max("ts").alias("last"))
    return bursts.select("match_id", "line", F.col("session_window.start").alias("first"), "last", "seen")


class _Kept(Fold):
    def __init__(self, state: Any = None) -> None:
        self.inner = folds.Kept(state)
        self.state = self.inner.state

    def step(self, due_ms: int, rank: int, record_id: int, body: dict) -> Iterator[tuple]:
        if self.inner.row(due_ms, f"{body['killer_id']} {body['victim_id']} {body['event_type']}"):
            yield (record_id,)

    def passed(self, now_ms: int) -> Iterator[tuple]:
        self.inner.passed(now_ms)
        return iter(())

    def next_ms(self) -> int | None:
        return min((t + folds.DEDUPE_MS + 1 for t in self.state.values()), default=None)

    def done(self) -> bool:
        return not self.state


def anchored_dedupe_records(events: DataFrame) -> DataFrame:
    """Rows with both names as records of their match."""
    return records(events.filter("killer_id is not null and victim_id is not null"), "match_id", "feed_ms", 0, "event_id", "killer_id", "victim_id", "event_type")


def anchored_dedupe_stream(stream: DataFrame, delay: str = LATE) -> DataFrame:
    """stream: ``anchored_dedupe_records``. match_id, event_id: rows less those within 5 s of the last KEPT one of the same killer, victim and type.

    What the batch job keeps, for rows that arrive up to ``delay`` out of order; later ones are dropped. A match's state is gone 5 s of event time after its last row.
    """
    return folded_stream(stream, _Kept, "match_id", "event_id long", delay)


class _LateRows(Fold):
    START, DEATH, ROW = range(3)

    def __init__(self, state: Any = None) -> None:
        self.inner = folds.LateRows(state)
        self.state = self.inner.state

    def step(self, due_ms: int, rank: int, record_id: int, body: dict) -> Iterator[tuple]:
        if rank == self.ROW:
            yield record_id, *self.inner.row(due_ms - folds.COUNTER_AFTER_MS, body["event_type"] in ELIMINATIONS)
        else:
            (self.inner.death if rank == self.DEATH else self.inner.start)(due_ms, body["round_no"])


def late_row_records(events: DataFrame, rounds: DataFrame, deaths: DataFrame) -> list[DataFrame]:
    """Rows, starts of rounds and deaths as records. A row is due a second after its time: then the deaths that may speak for its round are known."""
    rows = records(events, "match_id", f"feed_ms + {folds.COUNTER_AFTER_MS}", _LateRows.ROW, "event_id", "event_type")
    starts = records(rounds, "match_id", "start_ms", _LateRows.START, "round_no", "round_no")
    return [rows, starts, records(deaths, "match_id", "t_ms", _LateRows.DEATH, "death_id", "round_no")]


def late_row_stream(stream: DataFrame, delay: str = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """stream: ``late_row_records``. match_id, event_id, found_round, late: what ``late_row_round`` gives, each row once its timer has run out.

    State of a match: a start and the time of a first death per round, and the rows of the last moments; it goes when the match has been idle for idle_ms.
    """
    return folded_stream(stream, _LateRows, "match_id", "event_id long, found_round long, late boolean", delay, idle_ms)


class _Pairs(Fold):
    DEATH, ROW = range(2)

    def __init__(self, state: Any = None) -> None:
        self.inner = folds.Pairing(state)
        self.state = self.inner.state

    def step(self, due_ms: int, rank: int, record_id: int, body: dict) -> Iterator[tuple]:
        if rank == self.DEATH:
            self.inner.death(due_ms, record_id, body["round_no"], body.get("team"))
            return
        victim = body.get("victim_id")
        yield from self.inner.row(due_ms - folds.AFTER_MS, record_id, body["round_no"], victim, victim is not None or "killer_id" in body, body["late"])

    def passed(self, now_ms: int) -> Iterator[tuple]:
        return iter(self.inner.passed(now_ms))

    def next_ms(self) -> int | None:
        return self.inner.next_ms()


def pair_records(rows: DataFrame, deaths: DataFrame) -> list[DataFrame]:
    """rows: match_id, event_id, feed_ms, round_no, event_type, killer_id, victim_id, late; deaths: match_id, death_id, t_ms, round_no, team."""
    asked = rows.filter(F.col("event_type").isin(*ELIMINATIONS) & F.col("round_no").isNotNull())
    asked = records(asked, "match_id", f"feed_ms + {folds.AFTER_MS}", _Pairs.ROW, "event_id", "round_no", "killer_id", "victim_id", "late")
    return [asked, records(deaths, "match_id", "t_ms", _Pairs.DEATH, "death_id", "round_no", "team")]


def pair_stream(stream: DataFrame, delay: str = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """stream: ``pair_records``. match_id, kind, event_id, death_id, t_ms: what ``align_elims`` pairs (kind pair; settled, where it took until no other row could claim the death), and what is left: no_drop, no_row.

    State of a match: free deaths of 53 s, rows of 27 s, a team per player; it goes when the match has been idle for idle_ms.
    """
    return folded_stream(stream, _Pairs, "match_id", "kind string, event_id long, death_id long, t_ms long", delay, idle_ms)


COUNTER_OUT = "match_id long, t_ms long, was long, value long, deaths long"
COUNTER_STATE = "value long, left_ms long, pending long, since_ms long, last_ms long"


def _counter(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Two equal readings in a row confirm a value; it counts from the first reading that left the value before."""
    if state.hasTimedOut:
        state.remove()
        return
    value, left, pending, since, last = state.get if state.exists else (None, None, None, None, -1)
    rows = pd.concat(list(batches)).sort_values("t_ms")
    out = []
    for t, v in zip(rows.t_ms, rows.value, strict=True):
        if pd.isna(v) or t <= last:  # unread, or too late for its place in the order
            continue
        v, t, last = int(v), int(t), int(t)
        if v != value and left is None:
            left = t
        twice = pending == v
        pending, since = v, since if twice else t
        if v == value:
            left = None
        elif twice:
            out.append((key[0], since if value is None else left, value, v, max((value or v) - v, 0)))
            value, left = v, None
    state.update((value, left, pending, since, last))
    state.setTimeoutTimestamp(max(last + ORIGIN_MS + IDLE_MS, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame(out, columns=["match_id", "t_ms", "was", "value", "deaths"]).astype({"was": "Int64"})


def counter_stream(reads: DataFrame) -> DataFrame:
    """Confirmed changes of a counter, match by match, told at once; the state of a match is five numbers and goes after IDLE_MS without a reading.

    Readings of a delivery are sorted; one that is older than another of an earlier delivery is left out, as an unread one.
    """
    timed = reads.withColumn("ts", F.timestamp_millis(F.col("t_ms") + ORIGIN_MS)).withWatermark("ts", LATE)
    return timed.groupBy("match_id").applyInPandasWithState(_counter, COUNTER_OUT, COUNTER_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def align_stream(rows: DataFrame, deaths: DataFrame) -> DataFrame:
    """Candidate pairs of elimination rows and deaths of one match and round, from a second before to 12 s after the death."""
    a = rows.withWatermark("ts", LATE).alias("e")
    b = deaths.withColumnsRenamed({"match_id": "of_match", "round_no": "of_round", "ts": "death_ts"}).withWatermark("death_ts", LATE).alias("d")
    near = F.expr("death_ts >= ts - interval 12 seconds and death_ts <= ts + interval 1 second")
    return a.join(b, (F.col("match_id") == F.col("of_match")) & (F.col("round_no") == F.col("of_round")) & near).select("match_id", "round_no", "event_id", "death_id", "ts", "death_ts")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last version of each row."""
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in key)), order).alias("x"))
    return best.select(*key, "x.*").select(*rows.columns)


def match_upserts(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last version of each row under ``path``.

    Every batch writes its own folder, replacing what an earlier try of the same batch left, so repeats change
    nothing; ``read_upserts`` merges the folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_upserts(spark, path: str, key: list[str], order: str) -> DataFrame:
    return latest(spark.read.parquet(path).drop("batch"), key, order)


END_OUT = "match_id long, last_sign timestamp"


def _end(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        (last,) = state.get
        state.remove()
        yield pd.DataFrame({"match_id": [key[0]], "last_sign": [pd.Timestamp(last, unit="us", tz="UTC")]})
        return
    seen = max(int(rows.ts.max().value // 1000) for rows in batches)
    last = max(seen, state.get[0]) if state.exists else seen
    state.update((last,))
    state.setTimeoutTimestamp(last // 1000 + 25_000)
    yield pd.DataFrame({"match_id": pd.Series([], dtype="int64"), "last_sign": pd.Series([], dtype="datetime64[us, UTC]")})


def match_end_stream(signs: DataFrame) -> DataFrame:
    """Matches without a sign of life for 25 s of event time."""
    watched = signs.withWatermark("ts", "0 seconds")
    return watched.groupBy("match_id").applyInPandasWithState(_end, END_OUT, "last long", "append", GroupStateTimeout.EventTimeTimeout)
