"""Exports: the datasets behind a match's sheets and behind a range of days, as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import awards, dims, players
from matchloom.sources.mapping import Tables


def match_sheets(t: Tables) -> dict[str, DataFrame]:
    """scoreboard, highlights, players, head_to_head, events; every one with match_id."""
    per_match = players.player_match(t.events, t.match_players, t.players, t.matches, t.scoreboard)
    usable = players.usable_knocks(t.events, t.match_players)
    roles = awards.role_order(awards.all_roles(t.events, usable, t.match_players, t.matches, t.players), t.match_players, t.players)
    return {
        "scoreboard": dims.board_vs_feed(per_match, t.scoreboard),
        "highlights": roles,
        "players": players.player_knock_lines(t.events, t.match_players),
        "head_to_head": players.head_to_head(players.knock_matrix(usable), t.match_players),
        "events": dims.v_events(t.events, t.matches, t.players),
    }


def range_sheets(t: Tables, first_day: str, last_day: str) -> dict[str, DataFrame]:
    """matches, player_totals, player_per_match, all_events of some days, both included."""
    day = F.substring("recorded_at", 1, 10)
    inside = lambda rows: rows.filter((day >= first_day) & (day <= last_day))
    per_match = players.player_match(t.events, t.match_players, t.players, t.matches, t.scoreboard)
    return {
        "matches": inside(dims.match_list(t.matches, t.events, t.match_players)),
        "player_totals": players.range_player_totals(per_match, first_day, last_day),
        "player_per_match": inside(per_match),
        "all_events": inside(dims.v_events(t.events, t.matches, t.players)),
    }


def write(sheets: dict[str, DataFrame], path: str) -> None:
    """One folder per dataset, partitioned by day where there is one; few files per day, not one per match."""
    for name, rows in sheets.items():
        if "recorded_at" in rows.columns:
            rows.withColumn("day", F.substring("recorded_at", 1, 10)).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/{name}")
        else:
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
