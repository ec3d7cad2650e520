from collections import Counter

import pytest

from matchloom.operators import awards, dims, players, rounds

EVENTS = "event_id long, match_id long, round_no long, true_ms long, feed_ms long, event_type string, killer_id long, victim_id long, weapon string, victim_team string, confidence double, flag string, reviewed int"
A, B, X, Y, Z, W = 1, 2, 101, 102, 103, 104  # ids below 100 are blue


def events(spark, rows):
    """rows: (s, type, killer, victim, round[, weapon[, flag[, team]]])."""
    out = []
    for i, r in enumerate(rows):
        s, kind, k, v, rnd, weapon, flag, team = (*r, None, None, None)[:8]
        out.append((i, 1, rnd, int(s * 1000), int(s * 1000), kind, k, v, weapon, team, None, flag, 0))
    return spark.createDataFrame(out, EVENTS)


def members(spark, *ids):
    return spark.createDataFrame([(1, i, "blue" if i < 100 else "red", None) for i in ids], "match_id long, player_id long, team string, slot long")


KNOCKS = [
    (10, "knock", A, X, 1), (14, "knock", B, X, 1), (16, "kill", B, X, 1), (20, "knock", A, Y, 1), (80, "knock", A, X, 2), (85, "knock", X, B, 2),
    (90, "knock", Z, W, 2), (92, "knock", Y, Z, 2), (93, "eliminated_knocked", Z, W, 2),
]


def test_knock_outcomes(spark):
    got = {r.knock_id: r.outcome for r in players.knock_outcomes(events(spark, KNOCKS)).collect()}
    assert got == {0: "revived", 1: "eliminated", 3: "unresolved", 4: "revived", 5: "unresolved", 6: "eliminated", 7: "unresolved"}


def test_player_counts(spark):
    got = {r.player_id: r for r in players.player_counts(events(spark, KNOCKS)).collect()}
    assert (got[X].times_knocked, got[X].revives_inferred, got[X].deaths) == (3, 2, 1)
    assert (got[Z].revives_inferred, got[Z].eliminations) == (0, 1)


@pytest.mark.parametrize(
    ("rows", "credited"),
    [
        ([(1, "knock", A, X, 1), (2, "kill", B, X, 1)], {A}),
        ([(1, "knock", None, X, 1), (2, "kill", B, X, 1)], {B}),
        ([(1, "knock", A, X, 1), (2, "kill", B, X, 1, None, "NO_DROP")], set()),
        ([(1, "knock", A, X, 1), (2, "knock", B, X, 1), (3, "kill", A, X, 1)], {B}),
        ([(1, "knock", A, X, 1), (1, "kill", B, X, 1)], {B}),
        ([(1, "knock", A, X, 1), (2, "kill", B, X, 2)], {B}),
        ([(1, "knock", A, X, None), (2, "kill", B, X, None)], {A}),
        ([(2, "kill", None, None, 1, None, "NO_FEED_ROW")], {None}),
    ],
)
def test_credit(spark, rows, credited):
    assert {r.credited_id for r in players.elim_credit(events(spark, rows)).collect()} == credited


def test_no_drop_kill_still_proves_its_killer_alive(spark):
    rows = [(1, "knock", A, X, 1), (2, "kill", X, B, 1, None, "NO_DROP")]
    assert [r.outcome for r in players.knock_outcomes(events(spark, rows)).collect()] == ["revived"]


def test_hidden_death_makes_a_knock_unclear(spark):
    for team, want in (("red", (0, 1)), ("blue", (1, 0)), (None, (0, 1))):
        ev = events(spark, [(110, "knock", A, X, 1), (125, "kill", None, None, 1, None, "NO_FEED_ROW", team)])
        line = {r.player_id: r for r in players.player_knock_lines(ev, members(spark, A, X)).collect()}[X]
        assert (line.revived, line.revived_unclear) == want


def test_order_and_partitions_do_not_matter(spark):
    a = Counter(players.player_counts(events(spark, KNOCKS)).collect())
    b = Counter(players.player_counts(events(spark, KNOCKS).repartition(7)).collect())
    assert a == b


def usable(spark, rows, *ids):
    return players.usable_knocks(events(spark, rows), members(spark, *ids))


def knocks(k, v, n, start=0, weapon=None, rnd=1):
    return [(start + i, "knock", k, v, rnd, weapon) for i in range(n)]


TEAM = (*range(1, 7), *range(101, 107))


def names(spark):
    """Names that order the other way round than the ids do."""
    return spark.createDataFrame([(i, f"p{500 - i}") for i in TEAM], "player_id long, ign string")


def test_ties_go_by_name(spark):
    rows = [r for k in (1, 2, 3, 4) for r in knocks(k, 100 + k, 2) + knocks(100 + k, k, 2, 50)]
    assert {r.x for r in awards.rival_pairs(usable(spark, rows, *TEAM), names(spark)).collect()} == {4, 3, 2}
    rows = [r for k in (1, 2) for r in knocks(k, 101, 4, weapon="AKM")]
    assert [r.player_id for r in awards.weapon_class_leaders(usable(spark, rows, *TEAM), names(spark)).collect()] == [2]


def test_rivals_and_dominating(spark):
    rows = knocks(1, 101, 9) + knocks(2, 102, 7) + knocks(3, 103, 5) + knocks(4, 104, 2) + knocks(6, 106, 3) + knocks(106, 6, 3, 50) + knocks(5, 105, 4) + knocks(105, 5, 4, 50)
    u = usable(spark, rows, *TEAM)
    assert {r.player_id for r in awards.dominating(u, names(spark)).collect()} == {1, 2, 3}
    assert {(r.share, r.back) for r in awards.dominating(u, names(spark)).collect()} == {(100, 0)}
    assert {r.player_id for r in awards.rivals(u, names(spark)).collect()} == {5, 105, 6, 106}


def test_top_three_pairs_only(spark):
    rows = knocks(1, 101, 10) + knocks(101, 1, 1, 90) + knocks(2, 102, 3) + knocks(102, 2, 3, 90) + knocks(3, 103, 1) + knocks(103, 3, 1, 90)
    assert {(r.x, r.y) for r in awards.rival_pairs(usable(spark, rows, *TEAM), names(spark)).collect()} == {(1, 101), (2, 102), (3, 103)}
    assert awards.dominating(usable(spark, rows, *TEAM), names(spark)).count() == 0
    rows += knocks(4, 104, 2) + knocks(104, 4, 1, 90)
    assert {(r.x, r.y) for r in awards.rival_pairs(usable(spark, rows, *TEAM), names(spark)).collect()} == {(1, 101), (2, 102), (4, 104)}


def test_weapon_roles(spark):
    rows = knocks(1, 101, 3, weapon="Grenade") + knocks(2, 101, 2, weapon="Grenade") + knocks(103, 1, 2, weapon="Molotov") + knocks(104, 1, 1, weapon="Molotov") + knocks(1, 102, 2, weapon="Car")
    got = {(r.player_id, r.role, r.n) for r in awards.throwable_leaders(usable(spark, rows, *TEAM)).collect()}
    assert got == {(1, "Grenadier", 3), (103, "Molotov specialist", 2), (1, "Driver", 2)}
    rows = knocks(1, 101, 6, weapon="AKM") + knocks(1, 101, 1, weapon="P90") + knocks(6, 101, 9, weapon="M416") + knocks(6, 101, 11, weapon="UMP45") + knocks(5, 101, 3, weapon="P90") + knocks(3, 101, 3, weapon="DBS") + knocks(4, 101, 2, weapon="AWM")
    got = {(r.player_id, r.role, r.share) for r in awards.weapon_class_leaders(usable(spark, rows, *TEAM), names(spark)).collect()}
    assert got == {(6, "AR player", 45), (6, "SMG player", 55), (3, "Shotgun specialist", 100)}


def test_only_usable_knocks(spark):
    rows = [(i, "kill", 1, 101, 1) for i in range(6)] + [(10, "knock", 1, 101, 1), (11, "knock", None, 101, 1), (12, "knock", 1, None, 1), (13, "knock", 1, 1, 1), (14, "knock", 1, 2, 1), (15, "knock", 1, 101, 1, "Zone")]
    assert usable(spark, rows, *TEAM).count() == 1


def clutch(spark, rows, size):
    ids = (*range(1, 1 + 6), *range(101, 107))
    mp, ev = members(spark, *ids), events(spark, rows)
    ma = spark.createDataFrame([(1, size)], "match_id long, team_size int")
    return [(r.player_id, r.enemies, r.own_alive) for r in awards.clutch(awards.clutch_moments(ev, players.usable_knocks(ev, mp), mp, ma), names(spark)).collect()]


def test_clutch(spark):
    assert clutch(spark, [(10, "knock", 1, 101, 1), (12, "knock", 1, 102, 1)], 2) == [(1, 2, 2)]
    down = [(1, "kill", 101, 2, 1), (1, "kill", 101, 3, 1)]
    three = [(10, "knock", 1, 101, 1), (11, "knock", 1, 102, 1), (12, "knock", 1, 103, 1)]
    assert clutch(spark, down + three, 3) == [(1, 3, 1)]
    assert clutch(spark, down + three[:2], 3) == []
    assert clutch(spark, [(1, "kill", 1, 103, 1)] + three[:2], 3) == []
    assert clutch(spark, [(10, "knock", 1, 101, 1), (12, "knock", 1, 101, 1)], 2) == []
    assert clutch(spark, [(10, "knock", 1, 101, 1), (12, "knock", 1, 102, 2)], 2) == []


def test_dedupe_is_anchored_at_the_last_kept(spark):
    rows = [(0, "knock", A, X, 1), (4, "knock", A, X, 1), (6, "knock", A, X, 1), (10, "knock", A, X, 1), (10, "kill", A, X, 1), (12, "knock", None, X, 1)]
    assert {r.event_id for r in rounds.dedupe_events(events(spark, rows)).collect()} == {0, 2, 4}


def test_late_rows(spark):
    ro = spark.createDataFrame([(1, 1, 0, 50_000), (1, 2, 60_000, 120_000)], "match_id long, round_no long, start_ms long, end_ms long")
    deaths = spark.createDataFrame([(1, 2, 80_000)], "match_id long, round_no long, t_ms long")
    ev = events(spark, [(5, "kill", A, X, 1), (65, "knock", A, X, 2), (70, "knock", A, X, 2), (72, "kill", A, X, 2), (76, "kill", A, X, 2), (81, "kill", A, X, 2)])
    got = {r.event_id: (r.found_round, r.late) for r in rounds.late_row_round(ev, ro, deaths).collect()}
    assert got == {0: (1, False), 1: (1, True), 2: (2, False), 3: (1, True), 4: (2, False), 5: (2, False)}


def test_upserts_and_corrections(spark):
    ev = events(spark, KNOCKS)
    fixes = spark.createDataFrame([(0, 1, 7, None, None, None), (0, 2, None, None, "kill", None)], "event_id long, at int, killer_id long, victim_id long, event_type string, weapon string")
    row = dims.apply_corrections(ev, fixes).filter("event_id = 0").first()
    assert (row.event_type, row.killer_id, row.reviewed) == ("kill", A, 1)
    rows = spark.createDataFrame([(1, None, 5, "eliminations", 1.0, 1), (1, None, 6, "eliminations", 2.0, 1), (1, None, 5, "eliminations", 3.0, 2), (1, 1, 5, "eliminations", 9.0, 1)], "match_id long, round_no long, player_id long, stat_name string, value double, batch int")
    assert {(r.round_no, r.player_id, r.value) for r in dims.upsert_stats(rows).collect()} == {(None, 5, 3.0), (1, 5, 9.0)}
