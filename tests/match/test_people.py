"""New players, renames, and the checked reader."""

import pytest

from matchloom.operators import dims
from matchloom.sources import silver

PLAYERS = [(1, "Ann", None), (2, "Bob", "b"), (3, "Cy", None), (4, "Dee", None), (9, "Eve", None)]


@pytest.fixture(scope="module")
def tables(spark):
    frame = spark.createDataFrame
    return {
        "players": frame(PLAYERS, "player_id long, ign string, nickname string"), "aliases": frame([("Annie", 1), ("Bobby", 2)], "alias string, player_id long"),
        "events": frame([(1, 1, 2), (2, 3, None), (3, 4, 1)], "event_id long, killer_id long, victim_id long"),
        "scoreboard": frame([(1, None, 1, "e", 1.0), (1, None, 2, "e", 2.0), (1, 1, 1, "e", 3.0)], "match_id long, round_no long, player_id long, stat_name string, value double"),
        "match_players": frame([(1, 1, "blue"), (1, 2, "red"), (2, 1, "red")], "match_id long, player_id long, team string"),
    }


def rename(spark, tables, *pairs):
    found = dims.rename_players(spark.createDataFrame(list(pairs), "old string, new string"), tables)
    return {name: {tuple(r) for r in rows.collect()} for name, rows in found.items()}


def test_a_chain_of_renames_ends_at_one_player(spark, tables):
    got = rename(spark, tables, ("Ann", "Bob"), ("Bob", "Cy"), ("Cy", "Zed"), ("Zed", "Dee"))
    assert got["players"] == {(4, "Dee", None), (9, "Eve", None)} and got["refused"] == set()
    assert got["aliases"] == {("Annie", 4), ("Bobby", 4), ("Ann", 4), ("Bob", 4), ("Cy", 4), ("Zed", 4)}
    assert got["events"] == {(1, 4, 4), (2, 4, None), (3, 4, 4)}
    # of rows that meet, those of the smaller id stay where the target had none
    assert got["scoreboard"] == {(1, None, 4, "e", 1.0), (1, 1, 4, "e", 3.0)} and got["match_players"] == {(1, 4, "blue"), (2, 4, "red")}


def test_a_plain_rename_keeps_the_player(spark, tables):
    got = rename(spark, tables, ("Ann", "Mid"), ("Mid", "New"), ("Bob", "New"))
    # Bob is one rename away, Ann two: Bob's player takes the name
    assert (2, "New", "b") in got["players"] and len(got["players"]) == 4
    assert got["aliases"] == {("Annie", 2), ("Bobby", 2), ("Ann", 2), ("Mid", 2), ("Bob", 2)} and got["match_players"] == {(1, 2, "red"), (2, 2, "red")}


def test_renames_that_are_refused(spark, tables):
    got = rename(spark, tables, ("Ann", "Bob"), ("Bob", "Ann"), ("Cy", "Ann"), ("Dee", "Dee"), ("Nobody", "Eve"), ("Eve", "E2"), ("Eve", "E1"))
    assert got["refused"] == {("Ann", "Bob", "circle"), ("Bob", "Ann", "circle"), ("Cy", "Ann", "circle"), ("Dee", "Dee", "circle"), ("Nobody", "Eve", "unknown"), ("Eve", "E2", "renamed twice")}
    assert (9, "E1", None) in got["players"] and len(got["players"]) == 5 and ("Eve", 9) in got["aliases"]


def test_new_players_once(spark, tables):
    names = spark.createDataFrame([(n,) for n in ("Ann", "Annie", "ANN", "zo e", "Zoe", "Z0E", "new", None, "", "Bobby")], "name string")
    players, aliases, placed = dims.admit_players(names, tables["players"], tables["aliases"])
    ids = {r.name: (r.player_id, r.tier) for r in placed.collect()}
    assert ids["Ann"] == (1, "name") and ids["Annie"] == (1, "alias") and ids["ANN"] == (1, "norm") and ids["Bobby"] == (2, "alias") and len(ids) == 8
    assert ids["Z0E"][0] == ids["Zoe"][0] == ids["zo e"][0] and {ids["Z0E"][0], ids["new"][0]} == {10, 11} and ids["new"][1] == "new"
    assert {(r.player_id, r.ign) for r in players.filter("player_id > 9").collect()} == {(ids["Z0E"][0], "Z0E"), (ids["new"][0], "new")}
    assert {r.alias for r in aliases.collect()} == {"Annie", "Bobby", "ANN", "Zoe", "zo e"}
    again = dims.admit_players(names, players, aliases)
    assert again[0].count() == players.count() and again[1].count() == aliases.count() and {r.name: r.player_id for r in again[2].collect()} == {n: i for n, (i, _) in ids.items()}
    first = dims.admit_players(names, tables["players"].limit(0), tables["aliases"].limit(0))
    assert sorted(r.player_id for r in first[0].collect()) == list(range(1, first[0].count() + 1))


def test_broken_rows(spark, tmp_path):
    good = {name: spark.createDataFrame([], schema) for name, schema in silver.SCHEMAS.items()}
    silver.write_tables(good, str(tmp_path / "a"))
    assert silver.broken_rows(silver.read_tables(spark, str(tmp_path / "a"))).count() == 0
    bad = good | {
        "matches": spark.createDataFrame([(1, "t", "f", None, None, None, "live"), (1, "t", "g", None, None, None, "gone")], silver.SCHEMAS["matches"]),
        "rounds": spark.createDataFrame([(1, None, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)], silver.SCHEMAS["rounds"]),
        "scoreboard_stats": spark.createDataFrame([(1, None, 5, "e", 1.0), (1, None, 5, "e", 2.0)], silver.SCHEMAS["scoreboard_stats"]),
    }
    silver.write_tables(bad, str(tmp_path / "b"))
    got = {tuple(r) for r in silver.broken_rows(silver.read_tables(spark, str(tmp_path / "b"))).collect()}
    assert got == {
        ("matches", "1", "match_id not unique"), ("matches", "1", "unknown status"), ("rounds", "1/-", "no round_no"), ("rounds", "2/1", "match_id is not in matches"),
        ("scoreboard_stats", "1/-/5/e", "match_id and round_no and player_id and stat_name not unique"), ("scoreboard_stats", "1/-/5/e", "player_id is not in players"),
    }
