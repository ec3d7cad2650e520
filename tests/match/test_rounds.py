"""Rounds that only their boards tell of."""

from matchloom.operators import rounds

ROUNDS = [(1, 1, 0, 90, 5), (1, 2, 500, 590, 6), (2, 1, 0, 50, 7), (3, 1, 900, 950, 8)]
# match 1: a board after round 1, then two of rounds nobody saw start (the second after a reset), one of round 2, and the match board
BOARDS = [(1, 100, 110, "round"), (1, 200, 210, "round"), (1, 400, 410, "round"), (1, 600, 610, "round"), (1, 700, 800, "match"), (2, 60, 61, "round"), (3, 300, 310, "round")]
RESETS = [(1, 5), (1, 250), (1, 260), (1, 420), (2, 1)]


def numbered(spark):
    boards = spark.createDataFrame(BOARDS, "match_id long, start_ms long, end_ms long, kind string")
    resets = spark.createDataFrame(RESETS, "match_id long, t_ms long")
    known = spark.createDataFrame(ROUNDS, "match_id long, round_no long, start_ms long, end_ms long, blue_score long")
    return rounds.with_unseen_rounds(known, rounds.unseen_rounds(boards, resets, known))


def test_two_unseen_rounds_in_one_match(spark):
    got = {(r.match_id, r.round_no, r.start_ms, r.end_ms, r.blue_score, r.by_board, r.was) for r in numbered(spark).collect()}
    assert got == {
        (1, 1, 0, 90, 5, False, 1), (1, 2, 110, 200, None, True, None), (1, 3, 260, 400, None, True, None), (1, 4, 500, 590, 6, False, 2),
        (2, 1, 0, 50, 7, False, 1), (3, 1, 0, 300, None, True, None), (3, 2, 900, 950, 8, False, 1),
    }


def test_rows_move_into_unseen_rounds(spark):
    rows = [(1, 1, 50), (1, 1, 109), (1, 1, 110), (1, None, 150), (1, 1, 259), (1, 1, 260), (1, 1, 499), (1, 2, 500), (1, 1, 505), (1, None, 510), (2, 1, 70), (3, None, 0), (3, 1, 899), (3, 1, 900), (4, 1, 5)]
    at = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "match_id long, round_no long, feed_ms long, event_id long")
    moved = {r.event_id: r.round_no for r in rounds.moved_rows(at, "feed_ms", numbered(spark)).collect()}
    # the row of time 505 came late for round 1 when nobody knew of the rounds between: it is late for the last of these
    assert [moved[k] for k in range(len(rows))] == [1, 1, 2, 2, 2, 3, 3, 4, 3, None, 1, 1, 1, 2, 1]
