"""Inputs of the dimension jobs, derived from the silver tables by plain rules (see ``oracles.BASE_DIMS``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.sources.mapping import Tables

_ID = F.col
_TEXT = "cast(player_id as string)"


def readings(t: Tables) -> DataFrame:
    """name: spellings as a run would bring them."""
    p = t.players
    return p.select("ign").union(p.filter("player_id % 3 = 0").selectExpr(f"concat('playor_', {_TEXT})")).union(p.filter("player_id % 5 = 1").selectExpr(f"concat('PLAYER _', {_TEXT})")).union(
        p.filter("player_id % 7 = 2").selectExpr(f"concat('ghost_', {_TEXT})")
    ).toDF("name")


def roster(t: Tables) -> DataFrame:
    return t.players.filter("player_id % 6 = 0").selectExpr(f"concat('playor_', {_TEXT}) as name").union(t.players.filter("player_id % 10 = 3").selectExpr(f"concat('new_', {_TEXT})"))


def renames(t: Tables) -> DataFrame:
    return t.players.filter("player_id % 15 = 14").selectExpr("player_id as old_id", "player_id - 1 as new_id")


def corrections(t: Tables) -> DataFrame:
    e = t.events
    first = e.filter("event_id % 50 = 0").selectExpr("event_id", "1 as at", "cast(null as bigint) as killer_id", "cast(null as bigint) as victim_id", "cast(null as string) as event_type", "'AKM' as weapon")
    then = e.filter("event_id % 100 = 0").selectExpr("event_id", "2", "match_id % 1000 * 15", "cast(null as bigint)", "'kill'", "cast(null as string)")
    return first.union(then)


def stat_batches(t: Tables) -> DataFrame:
    s = t.scoreboard
    again = s.filter("match_id % 3 = 0 and player_id % 2 = 0").selectExpr("match_id", "round_no", "player_id", "stat_name", "value + 1", "2")
    return s.selectExpr("match_id", "round_no", "player_id", "stat_name", "value", "1 as batch").union(again)


def player_batches(t: Tables) -> DataFrame:
    m = t.match_players
    again = m.filter("player_id % 7 = 0").selectExpr("match_id", "player_id", "case when team = 'blue' then 'red' else 'blue' end", "cast(null as bigint)", "2")
    return m.selectExpr("match_id", "player_id", "team", "slot", "1 as batch").union(again)


def match_batch(t: Tables) -> DataFrame:
    m = t.matches.filter("match_id % 2 = 0").selectExpr("match_id", "source_file", "recorded_at", "case when match_id % 3 <> 0 then status end as status")
    return m.union(m.filter("match_id % 10 = 0").selectExpr("match_id + 1000000", "source_file", "recorded_at", "status"))


def match_history(t: Tables) -> DataFrame:
    return t.matches.filter("match_id % 4 = 0").select("match_id", "source_file", "recorded_at", "status")


def new_readings(t: Tables) -> DataFrame:
    """name: the readings, and others that are like the new ones among them but for case and spaces; one is blank."""
    p = t.players
    return readings(t).union(p.filter("player_id % 14 = 2").selectExpr(f"concat('GHOST _', {_TEXT})")).union(p.filter("player_id % 20 = 1").selectExpr(f"concat('fresh_', {_TEXT})")).union(p.filter("player_id % 40 = 1").selectExpr("''"))


def name_changes(t: Tables) -> DataFrame:
    """old, new: chains of two, plain renames, circles, names that nobody has."""
    p = t.players
    named = lambda stem, back=0: f"concat('{stem}_', cast(player_id - {back} as string))"
    rules = ((14, named("player"), named("player", 1)), (13, named("player"), named("champ")), (5, named("player"), named("loop")), (5, named("loop"), named("player")), (2, named("nobody"), named("player")))
    out = p.limit(0).selectExpr("ign as old", "ign as new")
    for slot, old, new in rules:
        out = out.union(p.filter(f"player_id % 15 = {slot}").selectExpr(old, new))
    return out


def faulty(t: Tables) -> dict[str, DataFrame]:
    """The silver tables with rows that break a rule of each kind."""
    e = t.events
    wrong = {"event_type": "case when event_id % 40 = 0 then 'knocked' else event_type end", "killer_id": "case when event_id % 60 = 0 then killer_id + 1000000 else killer_id end", "match_id": "case when event_id % 70 = 0 then null when event_id % 71 = 0 then -1 else match_id end"}
    events = e.withColumns({c: F.expr(x) for c, x in wrong.items()})
    matches = t.matches.withColumn("status", F.expr("case when match_id % 6 = 0 then 'done' when match_id % 10 = 3 then null else status end"))
    return {
        "matches": matches.union(matches.filter("match_id % 8 = 0").withColumn("match_id", F.col("match_id") + 5_000_000)), "players": t.players.union(t.players.filter("player_id % 30 = 7").withColumn("player_id", F.col("player_id") + 7_000_000)),
        "player_aliases": t.aliases.union(t.aliases.filter("player_id % 9 = 0").withColumn("player_id", F.lit(-5).cast("long"))), "match_players": t.match_players.union(t.match_players.filter("player_id % 44 = 0")),
        "rounds": t.rounds.union(t.rounds.filter("round_no = 1 and match_id % 4 = 0")), "events": events.union(events.filter("event_id % 50 = 0")), "scoreboard_stats": t.scoreboard.union(t.scoreboard.filter("player_id % 33 = 0 and stat_name = 'knock_outs'")),
    }


def nicknames(t: Tables) -> DataFrame:
    """player_id, nickname, batch: some players are told twice, some with a blank first."""
    p = t.players.filter("player_id % 3 = 1")
    return p.selectExpr("player_id", "case when player_id % 2 = 0 then '' else concat('first_', player_id) end", "1").union(p.selectExpr("player_id", "concat('then_', player_id)", "2")).toDF("player_id", "nickname", "batch")
