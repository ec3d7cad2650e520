"""Records of a key through a fold, in order of event time, whatever the order in which they arrive.

A record waits in the state of its key until the watermark has passed the time at which it is due; then it is folded
with all others that are due, in order of (due_ms, rank, id). So results do not depend on how the stream was cut into
batches, and are those of a batch job that sorts each key. What arrives after the watermark has passed its due time is late
and is dropped by Spark.

State of a key: the records that wait, and what the fold keeps. Timers wake it when something is due; it goes when the
fold says that it is done, or when the key has been idle for a while. The state lives in Spark's RocksDB store.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RECORD = "due_ms long, rank int, id long, body string"
#: A key without a record for so long is over.
IDLE_MS = 30 * 60_000
#: Times count from a day after the epoch, since Spark's first watermark is the epoch and would make a record due at 0 a late one.
ORIGIN_MS = 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Fold:
    """What a job does with the records of a key. ``state`` can be written as JSON."""

    def __init__(self, state: Any = None) -> None:
        self.state = state

    def step(self, due_ms: int, rank: int, record_id: int, body: dict) -> Iterator[tuple]:
        """Results of one record."""
        raise NotImplementedError

    def passed(self, now_ms: int) -> Iterator[tuple]:
        """Results that time alone brings: nothing due before now_ms is still to come."""
        return iter(())

    def next_ms(self) -> int | None:
        """When ``passed`` has something to do."""
        return None

    def done(self) -> bool:
        """Whether a key without waiting records can be forgotten."""
        return False


class _Ordered(StatefulProcessor):
    def __init__(self, fold: Callable[[Any], Fold], columns: list[str], idle_ms: int) -> None:
        self.fold, self.columns, self.idle_ms = fold, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", RECORD)
        self.kept = handle.getValueState("kept", "state string, last_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.due_ms), int(r.rank), int(r.id), r.body) for frame in rows for r in frame.itertuples()]
        if new:
            self.ahead.appendList(new)
            self.handle.registerTimer(min(new)[0] + ORIGIN_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() - ORIGIN_MS
        waiting = sorted(tuple(r) for r in self.ahead.get()) if self.ahead.exists() else []
        state, last = self.kept.get() if self.kept.exists() else (None, None)
        fold = self.fold(None if state is None else json.loads(state))
        out = []
        due = [r for r in waiting if r[0] <= now]
        for due_ms, rank, record_id, body in due:
            out += fold.passed(due_ms)
            out += fold.step(due_ms, rank, record_id, json.loads(body))
            last = due_ms
        out += fold.passed(now + 1)
        rest = waiting[len(due) :]
        over = not rest and (fold.done() or (fold.next_ms() is None and last is not None and last + self.idle_ms <= now))
        if rest:
            self.ahead.put(rest)
        else:
            self.ahead.clear()
        if over:
            self.kept.clear()
        else:
            self.kept.update((json.dumps(fold.state), last))
            wake = [r[0] for r in rest[:1]] + [t for t in (fold.next_ms(),) if t is not None]
            self.handle.registerTimer((min(wake) if wake else (last or now) + self.idle_ms) + ORIGIN_MS)
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=self.columns).convert_dtypes()

    def close(self) -> None:
        pass


def records(rows: DataFrame, key: str, due_ms: str, rank: int, record_id: str, *body: str) -> DataFrame:
    """key, due_ms, rank, id, body (the named columns as JSON), ts (due_ms as a time, from ``ORIGIN_MS`` on): rows in the form that folds take."""
    packed = F.to_json(F.struct(*body)) if body else F.lit("{}")
    return rows.select(F.col(key).alias("key"), F.expr(due_ms).cast("long").alias("due_ms"), F.lit(rank).alias("rank"), F.col(record_id).cast("long").alias("id"), packed.alias("body")).withColumn("ts", F.timestamp_millis(F.col("due_ms") + ORIGIN_MS))


def folded_stream(stream: DataFrame, fold: Callable[[Any], Fold], key: str, out: str, delay: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """stream: columns of ``records``. Gives the key, under the name ``key``, and the columns ``out`` (DDL) of the fold's results.

    A record may arrive up to ``delay`` after others that are due later. Negative keys only move the watermark.
    """
    kind = dict(stream.dtypes)["key"]
    schema = f"{key} {kind}, {out}"
    # the filter names the event time, so that it stays above the watermark
    known = stream.withWatermark("ts", delay).filter("key >= 0 or ts is null")
    columns = [c.split()[0] for c in schema.split(", ")]
    return known.groupBy("key").transformWithStateInPandas(_Ordered(fold, columns, idle_ms), schema, "Append", "EventTime")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that timers need; what was set before is set again at the end."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
