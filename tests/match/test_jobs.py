import os

import pytest

from matchloom.jobs import export
from matchloom.operators import dims, rows
from matchloom.sources.mapping import load

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no given tables")
def test_exports(spark, tmp_path):
    t = load(spark, FOLDER)
    sheets = export.range_sheets(t, "2024-01-01", "2024-01-12")
    assert set(sheets) == {"matches", "player_totals", "player_per_match", "all_events"}
    export.write({k: sheets[k] for k in ("matches", "player_totals")}, str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "matches"))
    assert back.count() == sheets["matches"].count() > 0 and "day" in back.columns
    assert spark.read.parquet(str(tmp_path / "player_totals")).count() == sheets["player_totals"].count()
    assert set(export.match_sheets(t)) == {"scoreboard", "highlights", "players", "head_to_head", "events"}


def test_board_checks_in_words(spark):
    per = spark.createDataFrame([(1, 1, 0, 2, True), (1, 2, 3, 1, True), (1, 3, 1, 1, True)], "match_id long, player_id long, eliminations long, knocks long, has_match_board boolean")
    board = spark.createDataFrame([(1, None, 1, "eliminations", 0.0), (1, None, 1, "knock_outs", None), (1, None, 3, "eliminations", 2.0), (1, None, 3, "knock_outs", 1.0), (1, None, 9, "eliminations", 3.0)], "match_id long, round_no long, player_id long, stat_name string, value double")
    got = {r.player_id: r.check for r in dims.board_vs_feed(per, board).collect()}
    assert got == {1: "Knock outs unreadable on the board", 2: "not on the board", 3: "elims 1 vs board 2", 9: "on the board, but not in this match's player list"}


def test_pending_rows(spark):
    pending = spark.createDataFrame([(1, 5, None, "UNRESOLVED"), (2, None, None, "UNRESOLVED"), (3, None, 7, "UNRESOLVED"), (4, 5, None, None)], "event_id long, killer_id long, victim_id long, flag string")
    read = spark.createDataFrame([(1, None, 6), (2, 8, None), (3, 7, None)], "event_id long, killer long, victim long")
    play = {r.event_id: (r.killer_id, r.victim_id, r.flag) for r in rows.resolve_pending(pending, read).collect()}
    assert play == {1: (5, 6, None), 2: (None, None, "UNRESOLVED"), 3: (None, 7, "UNRESOLVED"), 4: (5, None, None)}
    end = {r.event_id: (r.killer_id, r.victim_id, r.flag) for r in rows.resolve_pending(pending, read, final=True).collect()}
    assert end[2] == (8, None, "UNRESOLVED") and end[3] == (None, 7, "UNRESOLVED")


def test_votes_for_names(spark):
    reads = [(1, 5, 90, 6, 70), (1, 5, 80, 6, 80), (1, 9, 99, 6, 99), (2, 5, 60, None, 0), (2, None, 0, 6, 70), (3, 5, 60, None, 0), (3, None, 0, 5, 70)]
    got = {r.line: (r.killer_id, r.victim_id) for r in rows.pair_vote(spark.createDataFrame(reads, "line long, killer_id long, killer_score long, victim_id long, victim_score long")).collect()}
    assert got == {1: (5, 6), 2: (5, 6), 3: (None, None)}
