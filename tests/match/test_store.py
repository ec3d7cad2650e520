"""Tables published together, the live match, and imports by day."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.jobs import ingest
from matchloom.sources.store import TableStore
from matchloom.streaming import live

KEYS = [c.split()[0] for c in live.CHANGE.split(", ")]


def change(match_id, seq, op, **fields):
    return tuple({"match_id": match_id, "seq": seq, "op": op, **fields}.get(k) for k in KEYS)


LOG = [
    change(1, 1, "begin", recorded_at="2024-01-01 10:00:00", source_file="a.mkv"), change(2, 1, "begin", recorded_at="2024-01-01 11:00:00", source_file="b.mkv"), change(3, 1, "begin", recorded_at="2024-01-02 11:00:00", source_file="c.mkv"),
    change(1, 2, "player", player_id=7, team="blue", slot=3), change(1, 9, "player", player_id=7, team="red"),
    change(1, 3, "start_round", round_no=1, start_ms=100), change(1, 4, "start_round", round_no=1, start_ms=999), change(1, 8, "end_round", round_no=1, end_ms=500, winner_team="blue", blue_score=1, red_score=0),
    change(1, 5, "event", event_id=50, round_no=1, true_ms=200, feed_ms=200, time_source="feed", event_type="kill", killer_id=7, victim_id=8, confidence=0.5),
    change(1, 6, "time", event_id=50, true_ms=150, time_source="counter"), change(1, 7, "move", event_id=50, round_no=2), change(1, 10, "start_round", round_no=2, start_ms=140),
    change(2, 5, "event", event_id=60, true_ms=20, feed_ms=20, time_source="feed", event_type="knock", flag="UNRESOLVED"), change(2, 4, "time", event_id=61, true_ms=5, time_source="counter"),
    change(1, 20, "stat", player_id=7, stat_name="eliminations", value=1.0), change(1, 20, "stat", player_id=8, stat_name="eliminations", value=2.0), change(1, 30, "stat", player_id=7, stat_name="eliminations", value=3.0),
    change(1, 21, "stat", round_no=1, player_id=8, stat_name="eliminations", value=4.0), change(1, 22, "stat", round_no=1, player_id=8, stat_name="eliminations", value=5.0),
    change(1, 40, "finish"), change(2, 40, "finish"), change(3, 40, "finish", status="failed"),
]
WANT = {
    "matches": {(1, "2024-01-01 10:00:00", "a.mkv", "processed", 2), (2, "2024-01-01 11:00:00", "b.mkv", "needs_review", 0), (3, "2024-01-02 11:00:00", "c.mkv", "failed", 0)},
    "match_players": {(1, 7, "red", 3)},
    "rounds": {(1, 1, 100, 500, "blue", 1, 0), (1, 2, 140, None, None, None, None)},
    "events": {(1, 50, 2, 150, "counter", 200, "kill", 7, 8, None, None, 0.5, None), (2, 60, None, 20, "feed", 20, "knock", None, None, None, None, None, "UNRESOLVED")},
    "scoreboard": {(1, None, 7, "eliminations", 3.0), (1, 1, 8, "eliminations", 5.0)},
}


def state(store):
    return {name: {tuple(r) for r in rows.collect()} for name, rows in live.live_tables(store).items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_in_any_order_and_again(spark, tmp_path, seed):
    store, log = TableStore(spark, str(tmp_path)), LOG[:]
    random.Random(seed).shuffle(log)
    batches = [log[:9], log[9:], log[4:12]]
    for k, part in enumerate(batches):
        assert live.applied(store, spark.createDataFrame(part, live.CHANGE), k, buckets=2)
    assert state(store) == WANT
    assert not live.applied(store, spark.createDataFrame(log[:3], live.CHANGE), 1, buckets=2) and store.versions() == [1, 2, 3]
    assert store.compact() > 0 and store.versions() == [3] and state(store) == WANT and store.compact() == 0


def test_a_crash_between_two_tables_changes_nothing(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path))
    live.applied(store, spark.createDataFrame(LOG[:12], live.CHANGE), 0, buckets=2)
    before, plain = state(store), live.folded
    broken = F.udf(lambda x: 1 / 0, "long")
    monkeypatch.setattr(live, "folded", lambda c, t, b=None: plain(c, t, b).withColumn("match_id", broken("match_id")) if t == "events" and b is not None else plain(c, t, b))
    with pytest.raises(Exception):  # noqa: B017
        live.applied(store, spark.createDataFrame(LOG[12:], live.CHANGE), 1, buckets=2)
    monkeypatch.undo()
    assert store.versions() == [1] and state(store) == before
    assert live.applied(store, spark.createDataFrame(LOG[12:], live.CHANGE), 1, buckets=2) and state(store) == WANT


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(x, "day string, n long")
    store.publish("w", 0, {"t": rows(("a", 1), ("b", 2))}, F.col("day"), ["a", "b"])
    first = store.snapshot()["tables"]["t"]["parts"]
    store.publish("w", 1, {"t": rows(("b", 3))}, F.col("day"), ["b", "c"])
    then = store.snapshot()["tables"]["t"]["parts"]
    assert then["a"] == first["a"] and then["b"] != first["b"]
    assert {tuple(r) for r in store.read("t").collect()} == {("a", 1), ("b", 3)} and [tuple(r) for r in store.read("t", parts=["b"]).collect()] == [("b", 3)]
    store.publish("w", 2, {"t": rows(("b", 3)).limit(0)}, F.col("day"), ["b"])
    assert {tuple(r) for r in store.read("t").collect()} == {("a", 1)}
    with pytest.raises(ValueError):
        store.publish("w", 3, {"t": rows(("z", 3))}, F.col("day"), ["b"])


def test_import_twice_and_replace(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))

    def tables(matches, events):
        return {"matches": spark.createDataFrame(matches, "match_id long, source_file string, recorded_at string, status string"), "events": spark.createDataFrame(events, "match_id long, event_id long, flag string")}

    first = tables([(1, "a", "2024-01-01 10:00:00", None), (2, "b", "2024-01-01 11:00:00", "processed"), (3, "c", "2024-01-02 11:00:00", None), (4, "c", "2024-01-02 11:00:00", None)], [(1, 10, "X"), (2, 20, "X"), (3, 30, None), (4, 40, None)])
    assert ingest.import_matches(store, 1, first)
    want = {(1, "a", "needs_review"), (2, "b", "processed"), (3, "c", "processed")}
    shape = lambda: ({(r.match_id, r.source_file, r.status) for r in ingest.history(store)["matches"].collect()}, {(r.match_id, r.event_id) for r in ingest.history(store)["events"].collect()})
    assert shape() == (want, {(1, 10), (2, 20), (3, 30)})
    again = tables([(7, "a", "2024-01-01 10:00:00", "failed"), (8, "d", "2024-01-03 00:00:00", None)], [(7, 70, None), (8, 80, None)])
    assert not ingest.import_matches(store, 1, again) and ingest.import_matches(store, 2, again)
    assert shape() == (want | {(8, "d", "processed")}, {(1, 10), (2, 20), (3, 30), (8, 80)})
    assert ingest.import_matches(store, 3, again, replace=True)
    assert shape() == ({(7, "a", "failed"), (2, "b", "processed"), (3, "c", "processed"), (8, "d", "processed")}, {(7, 70), (2, 20), (3, 30), (8, 80)})


def test_large_partitions_are_split_among_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from matchloom.sources.store import TableStore

    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        store = TableStore(spark, str(tmp_path))
        store.publish("w", 1, {"t": spark.range(0, 200_000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))}, F.lit(0), [0])
    finally:
        spark.conf.set(size, before)
    assert store.read("t").count() == 200_000 and len(list(tmp_path.glob("data/t/*/part_of=0/*.parquet"))) > 1
