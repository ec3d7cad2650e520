import random

import pandas as pd
from pyspark.sql import functions as F

from matchloom.functions import names
from matchloom.operators import matching, readings
from matchloom.streaming import jobs

#: Intervals of the counter in a recording: start, end (s), value.
TRUTH = [(0, 10, 12), (10, 20, 11), (20, 30, 9), (30, 40, 6), (40, 52, 3), (52, 70, 12), (70, 80, 10), (80, 90, 6), (90, 100, 12)]


def counter_rows(step_ms, noise=0, seed=0):
    r = random.Random(seed)
    out = []
    for t in range(0, 100_000, step_ms):
        value = next(v for a, b, v in TRUTH if a * 1000 <= t < b * 1000)
        x = r.random()
        out.append((1, t, None if x < noise else value + 1 if x < 1.2 * noise and out and out[-1][2] == value else value))
    return out


def naive(rows):
    """The debounce as a loop."""
    value, left, last, out, first = None, None, None, [], None
    for _, t, v in rows:
        if v is None:
            continue
        if value is None:
            if last == v:
                value = v
                out.append((first, None, v))
            last, first = v, t if last != v else first
            continue
        if v != value and left is None:
            left = t
        if v == last and v != value:
            out.append((left, value, v))
            value, left = v, None
        elif v == value:
            left = None
        last = v
    return out


def test_counter_against_a_loop(spark):
    for seed in range(4):
        rows = counter_rows(250, 0.15, seed)
        got = readings.counter_changes(spark.createDataFrame(rows, "match_id long, t_ms long, value long").repartition(5)).orderBy("t_ms").collect()
        assert [(r.t_ms, r.was, r.value) for r in got] == naive(rows)


def test_counter_deaths_at_any_rate(spark):
    for step in (42, 83, 250):
        df = spark.createDataFrame(counter_rows(step), "match_id long, t_ms long, value long")
        changes = readings.counter_changes(df)
        assert changes.agg(F.sum("deaths")).first()[0] == 9 + 6
        assert sorted(r.t_ms // 1000 for r in changes.filter("is_reset").collect()) == [52, 90]


def test_streamed_counter_is_the_batch(spark, tmp_path):
    rows = counter_rows(250, 0.1, 9)
    whole = spark.createDataFrame(rows, "match_id long, t_ms long, value long")
    for k in range(3):
        whole.filter((F.col("t_ms") >= k * 34_000) & (F.col("t_ms") < (k + 1) * 34_000)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.counter_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = sorted((r.t_ms, r.was, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(r.t_ms, r.was, r.value) for r in readings.counter_changes(whole).orderBy("t_ms").collect()]


def stream(spark, tmp_path, name, df):
    df.coalesce(1).write.parquet(str(tmp_path / f"in-{name}"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / f"in-{name}"))


def finish(df, tmp_path, spark):
    df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_other_streams(spark, tmp_path):
    at = lambda s: F.timestamp_millis((F.col(s) * 1000).cast("long"))
    ev = spark.createDataFrame([(1, 1.0, 5, 6, "kill"), (1, 3.0, 5, 6, "kill"), (1, 9.0, 5, 6, "kill"), (1, 3.0, 5, 6, "knock")], "match_id long, s double, killer_id long, victim_id long, event_type string").withColumn("ts", at("s"))
    got = finish(jobs.dedupe_stream(stream(spark, tmp_path, "a", ev)), tmp_path / "a", spark)
    assert sorted((r.s, r.event_type) for r in got)[0] == (1.0, "kill") and ("knock" in {r.event_type for r in got}) and len(got) <= 3
    seen = spark.createDataFrame([(1, 7, s) for s in (0.0, 0.5, 1.0, 5.0, 5.2, 60.0, 200.0)], "match_id long, line long, s double").withColumn("ts", at("s"))
    bursts = finish(jobs.sighting_stream(stream(spark, tmp_path, "b", seen)), tmp_path / "b", spark)
    assert sorted(r.seen for r in bursts)[-2:] == [2, 3]
    rows = spark.createDataFrame([(1, 1, 10, 20.0), (1, 1, 11, 50.0)], "match_id long, round_no long, event_id long, s double").withColumn("ts", at("s")).drop("s")
    deaths = spark.createDataFrame([(1, 1, 90, 12.0), (1, 1, 91, 20.9), (1, 2, 92, 20.0), (1, 1, 93, 30.0)], "match_id long, round_no long, death_id long, s double").withColumn("ts", at("s")).drop("s")
    pairs = finish(jobs.align_stream(stream(spark, tmp_path, "c", rows), stream(spark, tmp_path, "d", deaths)), tmp_path / "c", spark)
    assert {(r.event_id, r.death_id) for r in pairs} == {(10, 90), (10, 91)}


def test_sessions_and_votes(spark):
    s = spark.createDataFrame([(1, 1, t, e, None) for t, e in ((0, "kill"), (300, "knock"), (600, "knock"), (900, "kill"), (5000, "kill"))], "match_id long, line long, t_ms long, etype string, weapon string")
    assert [(r.first_ms, r.last_ms, r.seen) for r in readings.sighting_sessions(s, ("match_id", "line")).collect()] == [(0, 900, 4)]
    assert [r.etype for r in readings.majority_type(s.filter("t_ms < 2000")).collect()] == ["knock"]
    assert sorted(r.t_ms for r in readings.sample_readings(s).collect()) == [0, 300, 600]


ROSTER = ["ROGUExEMPRESSO", "Paradyne15up", "TheNightjar", "OmarKestrelo", "BG696969"]


def test_names(spark):
    reads = spark.createDataFrame([(1, x) for x in ("ROGUExENPRE5SO", "ParadynelSup", "BGGSESE9", "zzz", "", "TheN1ghtjar")], "roster_id long, raw string")
    rosters = spark.createDataFrame([(1, n) for n in ROSTER], "roster_id long, name string")
    got = {r.raw: r.name for r in matching.roster_match(reads, rosters).collect()}
    assert got == {"ROGUExENPRE5SO": "ROGUExEMPRESSO", "ParadynelSup": "Paradyne15up", "BGGSESE9": "BG696969", "zzz": None, "": None, "TheN1ghtjar": "TheNightjar"}
    folded = spark.createDataFrame([("ROGUExEMPRESSØ",), ("ROGUExEMPRESSO",), ("g",), ("q",), ("D",), ("d",), (None,)], "name string").select("name", names.fold_name("name").alias("f")).collect()
    f = {r.name: r.f for r in folded}
    assert f["ROGUExEMPRESSØ"] == f["ROGUExEMPRESSO"] and f["g"] == f["q"] and f["D"] == f["d"] and f[None] == ""


def test_pairing_prefers_the_timely_death(spark):
    rows = "match_id long, event_id long, feed_ms long, round_no long, event_type string, killer_id long, victim_id long, late boolean"
    deaths = "match_id long, death_id long, t_ms long, round_no long, team string"
    r = spark.createDataFrame([(1, 1, 28_500, 1, "kill", 5, 6, False), (1, 2, 37_800, 1, "kill", 5, 7, False), (1, 3, 90_000, 1, "kill", 5, 8, False), (1, 4, 45_000, 1, "kill", None, None, False), (2, 5, 1000, 1, "knock", 1, 2, False)], rows)
    d = spark.createDataFrame([(1, 10, 28_300, 1, "red"), (1, 11, 30_000, 1, None), (1, 12, 37_500, 1, None), (1, 13, 20_000, 2, None)], deaths)
    out = matching.align_elims(r, d)
    got = {x.event_id: (x.death_id, x.settled) for x in out.collect()}
    assert got == {1: (10, False), 2: (12, False), 4: (11, True)}
    assert {x.event_id for x in matching.unpaired_flags(r, out).collect()} == {3}
    assert {x.death_id for x in matching.unclaimed_deaths(d, out).collect()} == {13}


def test_small_functions(spark):
    df = spark.createDataFrame([("clip 2026-10-01 20-27-36.mkv", 75.5), ("2026-10-01_00-00-01", 0.0), ("none", 3599.999)], "name string, s double")
    rows = df.select(names.recorded_at_from_name("name").alias("at"), names.mmss("s").alias("m")).collect()
    assert [r.at for r in rows] == ["2026-10-01 20:27:36", "2026-10-01 00:00:01", None]
    assert rows[0].m == "01:15.50" and rows[1].m == "00:00.00"
    assert isinstance(pd.__version__, str)


def test_row_names(spark):
    reads = spark.createDataFrame(
        [(1, 1, "ROGUExENPRE5SO y= => ParadynelSup"), (1, 2, "ine =P' TheNightjar"), (1, 3, "ROGUExEMPRESSO =P ~~"), (1, 4, "ROGUExEMPRESSO =P a1"), (1, 5, "OmarKestrelo"), (1, 6, "x1 OmarKestrelo J"), (1, 7, "BG696969 a BG696969"), (1, 8, "")],
        "roster_id long, read_id long, raw string",
    )
    rosters = spark.createDataFrame([(1, n) for n in ROSTER], "roster_id long, name string")
    got = {r.read_id: (r.killer, r.victim) for r in matching.row_names(reads, rosters).collect()}
    assert got[1] == ("ROGUExEMPRESSO", "Paradyne15up") and got[2] == (None, "TheNightjar") and got[4] == ("ROGUExEMPRESSO", None)
    assert got[5] == got[6] == got[7] == got[8] == (None, None)


def test_name_consensus(spark):
    rows = [(1, "Wolf"), (1, "W0lf"), (1, "Wolf"), (2, "abcd"), (2, "abce"), (2, "xbcd"), (3, " ")]
    got = {r.key: (r.name, r.share) for r in matching.name_consensus(spark.createDataFrame(rows, "key long, raw string")).collect()}
    assert got[1] == ("Wolf", 0.67) and got[2][0] == "abcd" and got[3] == ("", 0.0)


def test_death_team(spark):
    d = [(58_125, 1), (58_667, 2), (58_667, 3), (70_250, 4), (80_000, 5), (91_000, 6), (100_000, 7)]
    s = [(59_167, 11), (59_167, 12), (59_167, 13), (70_000, 14), (82_000, 15), (90_000, 16), (100_400, 17)]
    got = matching.death_team(spark.createDataFrame([(1, i, t) for t, i in d], "match_id long, death_id long, t_ms long"), spark.createDataFrame([(1, i, t) for t, i in s], "match_id long, slot_id long, t_ms long"))
    assert {(r.death_id, r.slot_id) for r in got.collect()} == {(1, 11), (2, 12), (3, 13), (4, 14), (7, 17)}


def feed(rate, rows):
    """rows: (from s, to s, y, icons, flicker): sightings at a rate; where flicker, every fifth without icons."""
    out = []
    for a, b, y, icons, flicker in rows:
        frames = range(int(a * rate + 0.999), int(b * rate) + 1)
        out += [(1, int(f * 1000 / rate), y, 34, [] if flicker and k % 5 == 3 else icons) for k, f in enumerate(frames)]
    return out


def test_tracking_at_any_rate(spark):
    from matchloom.operators import tracking

    schema = "match_id long, t_ms long, y int, h int, icons array<string>"
    for rate in (4, 12, 24, 30):
        one = tracking.track_lines(spark.createDataFrame(feed(rate, [(0.2, 3.7, 438, ["knock", "AKM"], True)]), schema)).collect()
        assert [(r.icons, r.short) for r in one] == [("AKM+knock", False)]
        two = tracking.track_lines(spark.createDataFrame(feed(rate, [(0.0, 2.0, 438, ["knock"], False), (2.3, 4.0, 438, ["AKM"], False)]), schema)).collect()
        assert [r.icons for r in two] == ["knock", "AKM"]
    short = tracking.track_lines(spark.createDataFrame(feed(24, [(1.0, 1.2, 438, ["knock"], False)]), schema)).collect()
    assert [r.short for r in short] == [True]
    assert tracking.track_lines(spark.createDataFrame(feed(24, [(1.0, 1.2, 438, [], False)]), schema)).count() == 0
    moved = feed(12, [(0.0, 1.0, 438, ["AKM"], False)]) + feed(12, [(1.08, 2.0, 386, ["AKM"], False)])
    assert [r.seen for r in tracking.track_lines(spark.createDataFrame(moved, schema)).collect()] == [len(moved)]


def test_files(spark, tmp_path):
    from matchloom.sources import files

    (tmp_path / "names.txt").write_text("# roster\n\nA one\n B two \n")
    (tmp_path / "names.md").write_text("| # | name |\n|---|---|\n| 1 | `Alpha` |\n| x | `Beta` |\n| 12 | `Gamma x` |\n")
    (tmp_path / "truth.csv").write_text("start_s,end_s,value\n0.5,2,12\n2,3.25,11\n")
    assert [r.name for r in files.roster_list(spark, str(tmp_path / "names.txt")).collect()] == ["A one", "B two"]
    assert [r.name for r in files.roster_table(spark, str(tmp_path / "names.md")).collect()] == ["Alpha", "Gamma x"]
    assert [tuple(r) for r in files.truth_csv(spark, str(tmp_path / "truth.csv")).collect()] == [(0.5, 2.0, 12), (2.0, 3.25, 11)]
    (tmp_path / "clips").mkdir()
    (tmp_path / "clips" / "2026-10-01 20-27-36.mkv").write_text("x")
    assert files.recordings(spark, str(tmp_path / "clips")).first().recorded_at == "2026-10-01 20:27:36"


def test_roster_match_is_that_of_all_pairs(spark):
    r = random.Random(4)
    rosters = [(k, "".join(r.choice("abcdeox0l1Z") for _ in range(r.randint(3, 12)))) for k in (1, 2, 3) for _ in range(40)]
    garbled = lambda n: "".join(c if r.random() < 0.8 else r.choice("abqz0") for c in n if r.random() < 0.9)
    reads = [(k, garbled(n)) for k, n in rosters for _ in range(3)] + [(9, "nobody"), (1, ""), (1, None), (2, "??")]
    a, b = spark.createDataFrame(reads, "roster_id long, raw string"), spark.createDataFrame(rosters, "roster_id long, name string")
    want, ratios = {}, 0
    for k, raw in set(reads):
        form, names_of = names.folded(raw), {n for j, n in rosters if j == k}
        scored = sorted(((names.similarity(form, names.folded(n)), n) for n in names_of), reverse=True) if form else []
        ratios += len(scored)
        clear = scored and scored[0][0] >= matching.LEAST and (len(scored) < 2 or scored[0][0] - scored[1][0] >= matching.AHEAD)
        want[k, raw] = (scored[0][1], round(scored[0][0], 2)) if clear else (None, 0.0)
    got = {(x.roster_id, x.raw): (x.name, x.score) for x in matching.roster_match(a, b).collect()}
    assert got == want and sum(n is not None for n, _ in want.values()) > 50
    # ratios worked out, of those of all pairs
    assert matching.scored_pairs(a, b).count() < ratios / 3


def test_rosters_are_not_broadcast(spark):
    reads = spark.createDataFrame([(1, 1, "Nightjar => Kestrel"), (2, 2, "Nightjar => Kestrel")], "roster_id long, read_id long, raw string")
    rosters = spark.createDataFrame([(1, "Nightjar"), (1, "Kestrel"), (2, "Kestrel")], "roster_id long, name string")
    found = matching.row_names(reads, rosters)
    assert {tuple(r) for r in found.collect()} == {(1, "Nightjar", "Kestrel"), (2, None, "Kestrel")}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_letters_of_a_kind_keep_the_bound(spark):
    reads = spark.createDataFrame([(1, "aaaaaaaab")], "roster_id long, raw string")
    rosters = spark.createDataFrame([(1, "aaaaaaaa"), (1, "ccc")], "roster_id long, name string")
    assert [(r.name, r.bound) for r in matching.bounded_pairs(reads, rosters).collect()] == [("aaaaaaaa", 16 / 17)]


def test_death_team_of_slots_with_one_id(spark):
    deaths = spark.createDataFrame([(1, 1, 1000), (1, 2, 1000)], "match_id long, death_id long, t_ms long")
    slots = spark.createDataFrame([(1, 7, 1200), (1, 7, 1200)], "match_id long, slot_id long, t_ms long")
    assert sorted((r.death_id, r.slot_id) for r in matching.death_team(deaths, slots).collect()) == [(1, 7), (2, 7)]


def test_name_consensus_of_two_agreed_spellings(spark):
    rows = [(1, n) for n in ("axxx", "axxx", "plate", "plate", "plat")]
    got = [tuple(r) for r in matching.name_consensus(spark.createDataFrame(rows, "key long, raw string")).collect()]
    assert got == [(1, "plate", 0.4)]


def test_layout_gate_samples_evenly_in_dealt_tasks(spark):
    from matchloom.operators import rows

    reads = [(n, "a", t, (t * 7 + n) % 5 < 2) for n in range(1, 47) for t in range(n)]
    limits = spark.createDataFrame([("a", 40, True)], "landmark string, least int, critical boolean")
    found = rows.layout_gate(spark.createDataFrame(reads, "match_id long, landmark string, t_ms long, hit boolean"), limits)
    for r in found.collect():
        n, k = r.match_id, min(r.match_id, 20)
        first = [i * (n // k) + min(i, n % k) for i in range(k)]  # of ntile(20)
        assert r.ok == (100 * sum((t * 7 + n) % 5 < 2 for t in first) / k >= 40)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_counter_grid_is_dealt_before_it_grows(spark):
    from matchloom.sources import mapping
    from matchloom.sources import readings as bronze

    t = mapping.load(spark, "/root/testdata/sf0.001")
    grid = bronze.match_grid(t)
    assert grid.count() == t.matches.count() * 2161
    assert "REPARTITION_BY_NUM" in grid._jdf.queryExecution().executedPlan().toString()
