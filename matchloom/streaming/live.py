"""A match written while it is played: a log of changes folded into five tables that are published together.

A change has a number (``seq``) that rises within its match. What a row's fields are is decided by the latest change of
each (the first one, for the start of a round), so tables are maxima of (seq, fields): folding changes in any order, or
twice, gives the same tables. A batch rewrites only the buckets of matches that it touches, in all five tables, and
publishes them in one version (``sources.store``). The folder holds the matches being played; finished ones are imported
into the history (``jobs.ingest``).

ops: begin (recorded_at, source_file); player (player_id, team, slot); start_round, end_round (round_no, start_ms / end_ms,
winner_team, blue_score, red_score); event (event_id, ...); time (event_id, true_ms, time_source); move (event_id,
round_no); flag (event_id, flag); stat (round_no, null for the end-of-match board, player_id, stat_name, value: all cells
of one board have one seq); finish (status, or null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchloom.sources.store import TableStore, values_of

CHANGE = (
    "match_id long, seq long, op string, recorded_at string, source_file string, player_id long, team string, slot long, round_no long, start_ms long, end_ms long, winner_team string, "
    "blue_score long, red_score long, event_id long, true_ms long, feed_ms long, time_source string, event_type string, killer_id long, victim_id long, weapon string, victim_team string, "
    "confidence double, flag string, stat_name string, value double, status string"
)
WRITER, BUCKETS = "live", 16
_EVENT = ("feed_ms", "event_type", "killer_id", "victim_id", "weapon", "victim_team", "confidence")


def _said(*ops: str, fields: tuple[str, ...], when: Column | None = None) -> Column:
    """(seq, fields) of the changes of some kinds."""
    asked = F.col("op").isin(*ops) if when is None else F.col("op").isin(*ops) & when
    return F.when(asked, F.struct("seq", *fields))


#: Per table: its key, the kinds of change that name its rows, and its fields: what says them, and whether the first or the last word holds.
TABLES: dict[str, tuple[tuple[str, ...], tuple[str, ...], dict[str, tuple[Column, Callable[[str], Column]]]]] = {}


def _tables() -> dict:
    """The tables, once there is a session for their columns."""
    if not TABLES:
        TABLES.update(
            matches=(("match_id",), ("begin", "finish"), {"begun": (_said("begin", fields=("recorded_at", "source_file")), F.max), "finished": (_said("finish", fields=("status",)), F.max)}),
            match_players=(("match_id", "player_id"), ("player",), {"side": (_said("player", fields=("team",)), F.max), "place": (_said("player", fields=("slot",), when=F.col("slot").isNotNull()), F.max)}),
            rounds=(("match_id", "round_no"), ("start_round", "end_round"), {"started": (_said("start_round", fields=("start_ms",)), F.min), "ended": (_said("end_round", fields=("end_ms", "winner_team", "blue_score", "red_score")), F.max)}),
            events=(
                ("match_id", "event_id"), ("event", "time", "move", "flag"),
                {"row": (_said("event", fields=_EVENT), F.max), "timed": (_said("event", "time", fields=("true_ms", "time_source")), F.max), "placed": (_said("event", "move", fields=("round_no",)), F.max), "marked": (_said("event", "flag", fields=("flag",)), F.max)},
            ),
            scoreboard=(("match_id", "round_no", "player_id", "stat_name"), ("stat",), {"cell": (_said("stat", fields=("value",)), F.max)}),
        )
    return TABLES


def folded(changes: DataFrame, table: str, before: DataFrame | None = None) -> DataFrame:
    """The rows of a table after some changes, and after those already folded into ``before``."""
    key, ops, fields = _tables()[table]
    rows = changes.filter(F.col("op").isin(*ops)).select(*key, *(said.alias(name) for name, (said, _) in fields.items()))
    rows = rows if before is None else rows.unionByName(before)
    now = rows.groupBy(*key).agg(*(word(name).alias(name) for name, (_, word) in fields.items()))
    if table == "scoreboard":  # a later end-of-match board replaces the earlier one whole
        last = F.max(F.when(F.col("round_no").isNull(), F.col("cell.seq"))).over(Window.partitionBy("match_id"))
        now = now.withColumn("last", last).filter("round_no is not null or cell.seq = last").drop("last")
    return now


def bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.hash("match_id"), F.lit(buckets))


def applied(store: TableStore, batch: DataFrame, batch_id: int, buckets: int = BUCKETS) -> bool:
    """Folds a batch of changes into the store's tables; a batch that is there already changes nothing."""
    kept = batch.persist()
    try:
        touched = values_of(kept, bucket(buckets))
        if not touched:
            return False
        now = store.snapshot()
        tables = {}
        for name in _tables():
            schema = folded(kept.limit(0), name).schema
            tables[name] = folded(kept, name, store.read(name, schema, touched, now))
        return store.publish(WRITER, batch_id, tables, bucket(buckets), touched)
    finally:
        kept.unpersist()


def live_sink(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for a stream of changes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        applied(TableStore(batch.sparkSession, path), batch, batch_id, buckets)

    return write


def live_tables(store: TableStore) -> dict[str, DataFrame]:
    """The five tables of one version, as the history has them; what is known of a row in part only (a time before its event) is left out."""
    now = store.snapshot()
    empty = store.spark.createDataFrame([], CHANGE)
    raw = {name: store.read(name, StructType.fromJson(folded(empty, name).schema.jsonValue()), None, now) for name in _tables()}
    events = raw["events"].filter("row is not null").select("match_id", "event_id", "placed.round_no", "timed.true_ms", "timed.time_source", *(f"row.{c}" for c in _EVENT), "marked.flag")
    rounds = raw["rounds"].select("match_id", "round_no", "started.start_ms", "ended.end_ms", "ended.winner_team", "ended.blue_score", "ended.red_score")
    flagged = events.groupBy("match_id").agg(F.max(F.col("flag").isNotNull()).alias("flagged"))
    played = rounds.groupBy("match_id").agg(F.count("*").alias("n"))
    over = F.col("finished").isNotNull()
    status = F.when(over, F.coalesce("finished.status", F.when(F.coalesce("flagged", F.lit(False)), "needs_review").otherwise("processed"))).otherwise("live")
    matches = raw["matches"].filter("begun is not null").join(flagged, "match_id", "left").join(played, "match_id", "left")
    return {
        "matches": matches.select("match_id", "begun.recorded_at", "begun.source_file", status.alias("status"), F.when(over, F.coalesce("n", F.lit(0))).alias("rounds_played")),
        "match_players": raw["match_players"].select("match_id", "player_id", "side.team", "place.slot"),
        "rounds": rounds, "events": events,
        "scoreboard": raw["scoreboard"].select("match_id", "round_no", "player_id", "stat_name", "cell.value"),
    }
