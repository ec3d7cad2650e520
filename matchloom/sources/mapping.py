"""Match tables derived from the ``events`` table.

The given data holds user events, no matches. One deterministic, integer-only mapping turns them into the
tables of a match history: 15 players share a room, five days of a room are a match of 15 rounds. The same
mapping in SQL is ``matchloom.oracles.BASE``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.weapons import GUNS

DAY_US, ROUND_US = 86_400_000_000, 28_800_000_000
PLAYERS_PER_ROOM, BLUE = 15, 8


def _div(a: str | Column, b: int) -> Column:
    return F.floor((F.col(a) if isinstance(a, str) else a) / b).cast("long")


def events(raw: DataFrame) -> DataFrame:
    """Silver events: event_id, match_id, round_no, true_ms, feed_ms, event_type, killer_id, victim_id, weapon, victim_team, confidence, flag, reviewed."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    base = raw.select(
        "event_id", "user_id", F.col("event_type").alias("src"), "value", us.alias("us"), F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k")
    ).withColumns({"slot": F.col("user_id") % PLAYERS_PER_ROOM, "room": _div("user_id", PLAYERS_PER_ROOM), "day": F.expr(f"us div {DAY_US}"), "uod": F.col("us") % DAY_US})
    part, error = F.col("event_id") % 4, F.col("src") == "error"
    kind = F.when(F.col("src").isin("click", "purchase"), "knock").when(F.col("src") == "view", "kill").when(F.col("src") == "signup", "eliminated_knocked")
    kind = kind.when(part < 2, "kill").when(part == 2, "knock").otherwise("other")
    flag = F.when(error & (part == 0), "NO_FEED_ROW").when(error & (part == 1), "NO_DROP")
    vslot = F.when(F.col("event_id") % 20 == 0, (F.col("slot") + 1) % PLAYERS_PER_ROOM).when(F.col("slot") < BLUE, BLUE + F.col("k") % 7).otherwise(F.col("k") % BLUE)
    feed = (F.col("day") % 5) * 216_000 + F.expr("uod div 400000")
    placed = base.withColumns({"kind": kind, "flag": flag, "vslot": vslot, "feed_ms": feed, "unseen": error & (part == 0), "zone": error & (part == 2)})
    gun = F.get(F.array(*(F.lit(g) for g in GUNS)), (F.floor("value") % 30).cast("int"))
    lagged = F.col("kind").isin("kill", "eliminated_knocked") & ~F.col("unseen")
    return placed.select(
        "event_id",
        (F.expr("day div 5") * 1000 + F.col("room")).alias("match_id"),
        F.when(F.col("event_id") % 97 != 0, (F.col("day") % 5) * 3 + 1 + F.expr(f"uod div {ROUND_US}")).alias("round_no"),
        F.when(lagged, F.greatest(F.col("feed_ms") - (F.col("k") % 35) * 100, F.lit(0))).otherwise(F.col("feed_ms")).alias("true_ms"),
        "feed_ms",
        F.col("kind").alias("event_type"),
        F.when(~F.col("unseen") & ~F.col("zone"), F.col("user_id")).alias("killer_id"),
        F.when(~F.col("unseen"), F.col("room") * PLAYERS_PER_ROOM + F.col("vslot")).alias("victim_id"),
        F.when(F.col("zone"), "Zone").otherwise(gun).alias("weapon"),
        F.when(~(F.col("unseen") & (F.col("event_id") % 3 == 0)), F.when(F.col("vslot") < BLUE, "blue").otherwise("red")).alias("victim_team"),
        F.when(~F.col("unseen"), F.round((50 + F.col("k") % 50) / 100, 2)).alias("confidence"),
        "flag",
        (F.col("event_id") % 5 == 0).cast("int").alias("reviewed"),
    )


def team_of(player: str) -> Column:
    return F.when(F.col(player) % PLAYERS_PER_ROOM < BLUE, "blue").otherwise("red")


def match_players(ev: DataFrame) -> DataFrame:
    """match_id, player_id, team, slot: everyone named in a match."""
    named = ev.select("match_id", F.explode(F.array_compact(F.array("killer_id", "victim_id"))).alias("player_id")).distinct()
    return named.select("match_id", "player_id", team_of("player_id").alias("team"), (F.col("player_id") % PLAYERS_PER_ROOM).alias("slot"))


def players(mp: DataFrame) -> DataFrame:
    """player_id, ign, nickname."""
    nick = F.when(F.col("player_id") % 4 == 0, F.concat(F.lit("nick_"), (F.col("player_id") % 100).cast("string")))
    return mp.select("player_id").distinct().select("player_id", F.concat(F.lit("player_"), F.col("player_id").cast("string")).alias("ign"), nick.alias("nickname"))


def aliases(pl: DataFrame) -> DataFrame:
    """alias, player_id: the spellings under which some players were read before."""
    return pl.filter("player_id % 3 = 0").select(F.concat(F.lit("playor_"), F.col("player_id").cast("string")).alias("alias"), "player_id")


def matches(ev: DataFrame) -> DataFrame:
    """match_id, recorded_at, source_file, team_size, rounds_played, pipeline_version, status."""
    room, block = F.col("match_id") % 1000, F.expr("match_id div 1000")
    found = ev.groupBy("match_id").agg(F.countDistinct("round_no").alias("rounds_played"))
    minutes = block * 7200 + room
    return found.select(
        "match_id",
        F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + minutes * 60), "yyyy-MM-dd HH:mm:ss").alias("recorded_at"),
        F.concat(F.lit("room_"), room.cast("string"), F.lit("_"), block.cast("string"), F.lit(".mkv")).alias("source_file"),
        F.lit(3).alias("team_size"),
        "rounds_played",
        F.when(F.col("match_id") % 11 == 0, "0.1.4").otherwise("1.2.0").alias("pipeline_version"),
        F.when(F.col("match_id") % 9 == 0, "live").otherwise("processed").alias("status"),
    )


def rounds(ev: DataFrame) -> DataFrame:
    """match_id, round_no, start_ms, end_ms, blue_score, red_score: a round spans its events; a side scores by the other's deaths."""
    died = F.col("event_type").isin("kill", "eliminated_knocked") & F.coalesce(F.col("flag") != "NO_DROP", F.lit(True))
    return ev.filter("round_no is not null").groupBy("match_id", "round_no").agg(
        F.min("feed_ms").alias("start_ms"),
        F.max("feed_ms").alias("end_ms"),
        F.sum(F.when(died & (F.col("victim_team") == "red"), 1).otherwise(0)).alias("blue_score"),
        F.sum(F.when(died & (F.col("victim_team") == "blue"), 1).otherwise(0)).alias("red_score"),
    )


def scoreboard(ev: DataFrame) -> DataFrame:
    """match_id, round_no (null: end-of-match board), player_id, stat_name, value: counts with reading errors.

    Every seventh match has round boards only.
    """
    counted = F.col("event_type").isin("kill", "eliminated_knocked") & F.coalesce(F.col("flag") != "NO_DROP", F.lit(True))
    one = ev.filter("killer_id is not null").withColumn("round_no", F.when(F.col("match_id") % 7 == 0, F.coalesce("round_no", F.lit(1))))
    tally = one.groupBy("match_id", "round_no", F.col("killer_id").alias("player_id")).agg(
        F.sum(F.when(counted, 1).otherwise(0)).alias("eliminations"), F.sum(F.when(F.col("event_type") == "knock", 1).otherwise(0)).alias("knock_outs")
    )
    tally = tally.filter((F.col("match_id") + F.col("player_id")) % 17 != 0)
    off = F.when((F.col("match_id") + F.col("player_id")) % 10 == 0, 1).otherwise(0)
    stat = lambda name, value: F.struct(F.lit(name).alias("stat_name"), value.cast("double").alias("value"))
    unread = (F.col("match_id") + F.col("player_id")) % 13 == 0
    stats = F.array(
        stat("eliminations", F.when(~unread, F.col("eliminations") + off)),
        stat("knock_outs", F.when(~unread, F.col("knock_outs"))),
        stat("damage_dealt", F.col("eliminations") * 100 + F.col("knock_outs") * 37),
    )
    return tally.select("match_id", "round_no", "player_id", F.explode(stats).alias("x")).select("match_id", "round_no", "player_id", "x.*")


@dataclass
class Tables:
    """The silver tables of one data folder."""

    events: DataFrame
    match_players: DataFrame
    players: DataFrame
    aliases: DataFrame
    matches: DataFrame
    rounds: DataFrame
    scoreboard: DataFrame


def load(spark: SparkSession, sf_dir: str) -> Tables:
    ev = events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    mp = match_players(ev)
    pl = players(mp)
    return Tables(ev, mp, pl, aliases(pl), matches(ev), rounds(ev), scoreboard(ev))
