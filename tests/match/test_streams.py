"""Folds over event time: any order of arrival gives the batch's results, and state goes away."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import folds, matching, rounds
from matchloom.streaming import jobs
from matchloom.streaming.ordered import records, state_store

DELAY = 25_000


def end_of(spark):
    return records(spark.range(1).selectExpr("-1L as m", "1000000000L as at", "0L as id"), "m", "at", 0, "id")


def run(spark, tmp_path, parts, job):
    """Delivers the parts one by one; gives the rows, and the state rows after each batch."""
    sizes = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with state_store(spark):
            query = job(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet")
            query = query.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out"))
            query.awaitTermination()
        sizes += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.parquet(str(tmp_path / "out")).collect(), sizes


def shuffled(frame, spark, n=3):
    """Deliveries in which a record comes up to DELAY later than others due later."""
    rows, r = [tuple(x) for x in frame.collect()], random.Random(7)
    late = sorted((row[1] + r.randrange(DELAY), row) for row in rows)
    size = len(late) // n + 1
    out = []
    for k in range(n):
        part = [row for _, row in late[k * size : (k + 1) * size]]
        r.shuffle(part)
        out.append(spark.createDataFrame(part, frame.schema))
    return out


def match_rows(seed, n=120):
    r = random.Random(seed)
    rows = sorted((m, i + 1000 * m, r.randrange(0, 200_000), r.choice(["kill", "kill", "knock", "eliminated_knocked"]), r.choice([None, 1, 2]), r.choice([None, 3, 4, 5])) for m in (1, 2) for i in range(n))
    starts = [(m, k + 1, k * 40_000, k * 40_000 + 39_000) for m in (1, 2) for k in range(5)]
    deaths = [(m, 10_000 * m + i, t, t // 40_000 + 1) for m in (1, 2) for i, t in enumerate(sorted(r.randrange(0, 200_000) for _ in range(70)))]
    return rows, starts, deaths


@pytest.fixture(scope="module")
def match(spark):
    rows, starts, deaths = match_rows(3)
    return (
        spark.createDataFrame(rows, "match_id long, event_id long, feed_ms long, event_type string, killer_id long, victim_id long"),
        spark.createDataFrame(starts, "match_id long, round_no long, start_ms long, end_ms long"),
        spark.createDataFrame(deaths, "match_id long, death_id long, t_ms long, round_no long"),
    )


def test_late_rows_streamed_are_the_batch(spark, tmp_path, match):
    events, starts, deaths = match
    parts = jobs.late_row_records(events, starts, deaths)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    got, sizes = run(spark, tmp_path, [*shuffled(whole, spark), end_of(spark), end_of(spark)], jobs.late_row_stream)
    want = rounds.late_row_round(events, starts, deaths).collect()
    assert {(r.event_id, r.found_round, r.late) for r in got} == {(r.event_id, r.found_round, r.late) for r in want} and len(got) == len(want)
    assert any(r.late for r in want) and sizes[-1] == 0


def test_pairs_streamed_are_the_batch(spark, tmp_path, match):
    events, starts, deaths = match
    team = F.when(F.col("death_id") % 3 == 0, "blue").when(F.col("death_id") % 3 == 1, "red")
    teamed = deaths.withColumn("team", team)
    placed = events.join(rounds.late_row_round(events, starts, deaths).withColumnRenamed("found_round", "round_no"), "event_id")
    parts = jobs.pair_records(placed, teamed)
    got, sizes = run(spark, tmp_path, [*shuffled(parts[0].unionByName(parts[1]), spark), end_of(spark), end_of(spark)], jobs.pair_stream)
    aligned = matching.align_elims(placed, teamed)
    assert {(r.event_id, r.death_id, r.kind == "settled") for r in got if r.kind in ("pair", "settled")} == {(r.event_id, r.death_id, r.settled) for r in aligned.collect()}
    assert {r.event_id for r in got if r.kind == "no_drop"} == {r.event_id for r in matching.unpaired_flags(placed, aligned).collect()}
    assert {r.death_id for r in got if r.kind == "no_row"} == {r.death_id for r in matching.unclaimed_deaths(teamed, aligned).collect()}
    assert {r.kind for r in got} == {"pair", "settled", "no_drop", "no_row"} and sizes[-1] == 0


def test_pairing_state_is_bounded():
    """Free deaths of 53 s and waiting rows of 27 s, however long the match."""
    fold, r, most = folds.Pairing(), random.Random(1), 0
    line = sorted([(r.randrange(0, 4_000_000), 0, i) for i in range(4000)] + [(r.randrange(0, 4_000_000), 1, i) for i in range(4000)])
    told = []
    for due, is_row, i in line:
        told += fold.passed(due)
        told += fold.row(due - folds.AFTER_MS, i, 1, i % 10, i % 4 > 0, False) if is_row else fold.death(due, i, 1, "blue") or []
        assert all(due - d[0] <= 53_000 for d in fold.state["free"]) and all(due - w[0] <= 28_000 for w in fold.state["waiting"])
        most = max(most, len(fold.state["free"]) + len(fold.state["waiting"]))
    told += fold.passed(float("inf"))
    assert most < 250 and len(fold.state["teams"]) <= 10
    assert sorted(e for kind, e, _, _ in told if kind != "no_row") == list(range(4000)) and sorted(d for kind, _, d, _ in told if kind != "no_drop") == list(range(4000))


def test_anchored_dedupe_forgets(spark, tmp_path):
    rows = [(1, k, 3000 * k, 5, 6, "kill") for k in range(40)] + [(2, 100 + k, 1000 * k, 5, None, "kill") for k in range(5)]
    events = spark.createDataFrame(rows, "match_id long, event_id long, feed_ms long, killer_id long, victim_id long, event_type string")
    whole = jobs.anchored_dedupe_records(events)
    far = records(spark.createDataFrame([(1, 99, 900_000, 5, 6, "kill")], events.schema), "match_id", "feed_ms", 0, "event_id", "killer_id", "victim_id", "event_type")
    old = records(spark.createDataFrame([(1, 98, 1_000, 5, 6, "kill")], events.schema), "match_id", "feed_ms", 0, "event_id", "killer_id", "victim_id", "event_type")
    # the anchor of the last row is gone after 5 s of event time; what comes after the watermark has passed it is dropped
    got, sizes = run(spark, tmp_path, [*shuffled(whole, spark), far, far.limit(0).unionByName(old), end_of(spark), end_of(spark)], jobs.anchored_dedupe_stream)
    assert sorted(r.event_id for r in got) == sorted([*(r.event_id for r in rounds.dedupe_events(events).collect()), 99])
    assert sizes[-1] == 0 and max(sizes) > 0


def test_counter_state_expires(spark, tmp_path):
    def reads(rows):
        return spark.createDataFrame(rows, "match_id long, t_ms long, value long")

    parts = [reads([(m, t * 500, 15 - t // 10) for m in (1, 2) for t in range(60)]), reads([(3, 10_000_000, 9)]), reads([(3, 10_000_500, 9)]), reads([(3, 10_001_000, 8)])]
    sizes = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = jobs.counter_stream(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet")
        query = query.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        sizes += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sizes[0] == 2 and sizes[-1] == 1
    assert sorted(r.value for r in got if r.match_id == 1) == list(range(10, 16)) and [r.t_ms for r in got if r.match_id == 3] == [10_000_000]


def test_deliveries_are_written_in_as_many_files_as_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from matchloom.streaming import queries

    rows = spark.range(0, 400, 1, 8).withColumn(queries.DELIVERY, F.col("id") % 2)
    schema = queries._deliver(rows, str(tmp_path / "in"))
    assert schema.names == ["id"] and all(len(list((tmp_path / "in" / f"delivery={k}").glob("*.parquet"))) == 8 for k in (0, 1))
    assert queries.run_to_end(spark, rows, 2, lambda stream: stream).count() == 400
