from collections import Counter

from matchloom.functions.names import folded, similarity
from matchloom.operators import boards
from matchloom.sources import row_inputs
from matchloom.sources.mapping import load

SCHEMA = "match_id long, board long, at long, raw string, name string, conf int, team long, stats array<struct<stat_name: string, value: double>>"


def mode(values):
    n = Counter(values)
    return min(n, key=lambda v: (-n[v], v)) if n else None


def by_loop(reads):
    """Boards one reading after the other, as plain dictionaries: players, cells."""
    players, cells = {}, {}
    for where in {(r.match_id, r.board) for r in reads}:
        entries = {}
        mine = [r for r in reads if (r.match_id, r.board) == where]
        for r in sorted(mine, key=lambda r: (r.at, (r.conf or 0) >= 75, r.raw or "")):
            sure = r.name is not None and r.conf >= 75
            key = r.name if sure else folded(r.raw)
            if not sure:
                key = next((k for k in entries if similarity(key, folded(k)) >= 0.75), key)
            if key:
                entries.setdefault(key, []).append((r, sure))
        for key, rows in entries.items():
            values = {}
            for r, _ in rows:
                for s in r.stats:
                    if s.value is not None:
                        values.setdefault(s.stat_name, []).append(s.value)
            listed = any(sure for _, sure in rows)
            for name, v in values.items():
                cells[(*where, key, name)] = (mode(v), round(v.count(mode(v)) / len(v), 2))
            if listed or len(rows) > 1 or values:
                players[(*where, key)] = (listed, mode([r.team for r, _ in rows if r.team is not None]), len(rows))
    return players, cells


def held(entries, reads):
    players, cells = by_loop(reads)
    assert {(r.match_id, r.board, r.entry): (r.on_roster, r.team, r.seen) for r in boards.board_players(entries).collect()} == players
    assert {(r.match_id, r.board, r.entry, r.stat_name): (r.value, r.share) for r in boards.board_stats(entries).collect()} == cells


def test_small_board(spark):
    one, none = [("eliminations", 3.0)], [("eliminations", None)]
    rows = [
        (1, 0, 0, "Wolf_King", "WolfKing", 90, 0, one), (1, 0, 1, "W0lf_King", None, 0, 1, [("eliminations", 4.0)]), (1, 0, 2, "Wolf_King", "WolfKing", 80, 0, one),
        (1, 0, 3, "xQzr77", None, 0, None, none), (1, 0, 4, "xQzr77", None, 0, 1, none), (1, 0, 5, "xQzr7", None, 0, 1, none),
        (1, 0, 6, "nvh", None, 0, None, none), (1, 0, 7, "Ukt", "Uktor", 60, 1, one), (1, 0, 8, "*/", None, 0, None, one), (1, 0, 9, None, None, 0, 1, one), (2, 1, 0, "Solo", None, 0, None, one),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    entries = boards.board_entries(df)
    held(entries, df.collect())
    got = {r.ign: (r.on_roster, r.name_agree, r.team, r.seen) for r in boards.board_players(entries).collect()}
    assert got == {"WolfKing": (True, 1.0, 0, 3), "xQzr77": (False, 1.0, 1, 2), "Ukt": (False, 1.0, 1, 1), "Solo": (False, 1.0, None, 1)}
    assert {(r.match_id, r.ign, r.best) for r in boards.off_roster(boards.board_players(entries)).collect()} == {(1, "xQzr77", 1.0), (1, "Ukt", 1.0), (2, "Solo", 1.0)}
    assert boards.off_roster(boards.board_players(boards.board_entries(df.limit(0)))).count() == 0


def test_given_boards(spark):
    reads = row_inputs.board_reads(load(spark, "/root/testdata/sf0.001"))
    rows = reads.collect()
    assert len(rows) > 100
    held(boards.board_entries(reads), rows)
