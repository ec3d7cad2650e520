"""Readings of rows, slots, scores, boards and landmarks derived from the silver tables by plain rules (see ``oracles.ROW_SELECTS``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.match_rules import counted_elimination
from matchloom.functions.weapons import GUNS
from matchloom.sources.mapping import Tables
from matchloom.sources.readings import STEP_MS, match_grid


def icons(t: Tables) -> DataFrame:
    e = F.col("event_type")
    return t.events.select("event_id", F.array_compact(F.array(F.when((e == "knock") | (F.col("event_id") % 10 == 0), "knock"), F.when(e == "eliminated_knocked", "tombstone"), F.col("weapon"))).alias("icons"))


def gun_scores(t: Tables) -> DataFrame:
    known = t.events.filter("weapon is not null and weapon <> 'Zone'")
    guns = F.array(*(F.lit(g) for g in GUNS))
    other = F.element_at(guns, (F.array_position(guns, F.col("weapon")) % len(GUNS) + 1).cast("int"))
    pair = F.array(F.struct(F.col("weapon").alias("gun"), (75 + F.col("event_id") % 25).alias("score")), F.struct(other.alias("gun"), (70 + F.col("event_id") % 19).alias("score")))
    return known.select("event_id", F.explode(pair).alias("x")).select("event_id", "x.*")


def scored_rows(t: Tables) -> DataFrame:
    return t.events.select("event_id", "killer_id", "victim_id", (F.col("event_id") % 100 / 100).alias("killer_score"), (F.col("event_id") * 7 % 100 / 100).alias("victim_score"))


def lines(t: Tables) -> DataFrame:
    n = F.col("event_id") % 8
    return t.events.select("event_id", F.col("feed_ms").alias("first_ms"), (F.col("feed_ms") + n * 250).alias("last_ms"), (n + 1).alias("seen"), (F.col("event_id") % 3).alias("n_icons"), "killer_id", "victim_id").withColumnRenamed("event_id", "line")


def slot_reads(t: Tables) -> DataFrame:
    dead = t.events.filter(F.col("victim_id").isNotNull() & F.col("event_type").isin("kill", "eliminated_knocked")).select("match_id", "round_no", F.col("victim_id").alias("slot"), "feed_ms", "event_id", F.lit("dead").alias("state"))
    alive = t.events.filter("killer_id is not null").select("match_id", "round_no", F.col("killer_id").alias("slot"), "feed_ms", "event_id", F.lit("alive").alias("state"))
    both = dead.union(alive).filter("round_no is not null")
    # one reading per slot and time: the one of the latest event
    return both.groupBy("match_id", "round_no", "slot", F.col("feed_ms").alias("t_ms")).agg(F.max(F.struct("event_id", "state")).alias("x")).select("match_id", "round_no", "slot", "t_ms", "x.state")


def score_reads(t: Tables) -> DataFrame:
    step = F.expr("(feed_ms - start_ms) div 9000")
    rows = t.events.filter("round_no is not null").join(t.rounds.select("match_id", "round_no", "start_ms"), ["match_id", "round_no"])
    blue = F.when(F.col("event_id") % 13 != 0, F.col("round_no") + F.when(F.col("match_id") % 2 == 0, F.when(step >= 5, 1).otherwise(0)).otherwise(0))
    red = F.when(F.col("event_id") % 11 != 0, F.col("round_no") + F.when(F.col("match_id") % 3 == 0, F.when(step >= 4, 1).otherwise(0)).otherwise(0))
    return rows.groupBy("match_id", "round_no", F.col("feed_ms").alias("t_ms")).agg(F.max(blue).alias("blue"), F.max(red).alias("red"))


def landmark_reads(t: Tables) -> DataFrame:
    grid = match_grid(t).withColumn("t_ms", F.col("t_ms").cast("long"))
    n = F.expr(f"t_ms div {STEP_MS}")
    hits = F.array(*(F.struct(F.lit(k).alias("landmark"), v.alias("hit")) for k, v in (("counter", n % 37 != 0), ("score", (n + F.col("match_id")) % 3 != 0), ("board", (n * 7 + F.col("match_id")) % 10 < 4))))
    return grid.select("match_id", "t_ms", F.explode(hits).alias("x")).select("match_id", "t_ms", "x.*")


def landmark_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("counter", 95, True), ("score", 60, False), ("board", 50, False)], "landmark string, least int, critical boolean")


def name_votes(t: Tables) -> DataFrame:
    seen = t.events.filter("killer_id is not null and victim_id is not null").select("*", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 6).cast("int"))).alias("i"))
    odd = F.col("event_id") + F.col("i")
    killer = F.when(odd % 2 == 0, F.when(odd % 7 == 0, F.col("victim_id")).otherwise(F.col("killer_id")))
    return seen.select(F.col("event_id").alias("line"), killer.alias("killer_id"), (60 + odd % 40).alias("killer_score"), F.when(odd % 3 != 0, F.col("victim_id")).alias("victim_id"), (60 + odd * 3 % 40).alias("victim_score"))


def board_cells(t: Tables) -> DataFrame:
    seen = t.scoreboard.filter("round_no is null").select("*", F.explode(F.sequence(F.lit(0), (F.col("player_id") % 4).cast("int"))).alias("at"))
    return seen.select("match_id", "player_id", "stat_name", "at", (F.col("value") + F.when((F.col("player_id") + F.col("at")) % 3 == 0, 1).otherwise(0)).alias("value"))


def board_reads(t: Tables) -> DataFrame:
    """Rows of boards as read at one to four scroll positions: two thirds of the players are listed, some not surely; names are misread by position."""
    one = t.scoreboard.groupBy("match_id", F.coalesce("round_no", F.lit(0)).cast("long").alias("board"), "player_id").agg(F.sort_array(F.collect_list(F.struct("stat_name", "value"))).alias("stats"))
    seen = one.select("*", F.substring(F.md5(F.col("player_id").cast("string")), 1, 8).alias("true"), F.explode(F.sequence(F.lit(0), (F.col("player_id") % 4).cast("int"))).alias("p"))
    odd = (F.col("player_id") + F.col("p")) % 3
    raw = F.when(odd == 0, F.col("true")).when(odd == 1, F.translate("true", "60b", "bo8")).otherwise(F.expr("substring(true, 2)"))
    listed = F.col("player_id") % 3 != 0
    return seen.select(
        "match_id", "board", (F.col("p") * 1000 + F.col("player_id") % 1000).cast("long").alias("at"), raw.alias("raw"), F.when(listed, F.col("true")).alias("name"),
        F.when(listed, 70 + (F.col("player_id") * 7 + F.col("p") * 11) % 30).otherwise(0).cast("int").alias("conf"), F.when(odd != 2, F.col("player_id") % 2).alias("team"), "stats",
    )


def screen_rows(t: Tables) -> DataFrame:
    n = F.col("event_id") % 4
    return t.events.filter("event_type <> 'other'").select(
        "event_id", "match_id", F.expr("killer_id - killer_id % 15").alias("killer_id"), F.expr("victim_id - victim_id % 3").alias("victim_id"), "event_type", "feed_ms", (n == 0).alias("short"),
        F.transform(F.sequence(F.lit(0), n), lambda i: F.expr("feed_ms div 1000") + i).alias("seen"),
    )


def counter_misses(t: Tables) -> DataFrame:
    return t.events.filter(counted_elimination() & (F.col("event_id") % 7 == 0)).select("match_id", "feed_ms")


def board_rows(t: Tables) -> DataFrame:
    """match_id, frame, player_id, y: the players of a match down a board, on two scroll positions."""
    rows = t.match_players.select("match_id", "player_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("frame"), "slot")
    return rows.filter("frame = 0 or slot >= 5").select("match_id", "frame", "player_id", (100 + F.col("slot") * 80 + F.col("slot") % 3 - F.col("frame") * 400).alias("y"))


def board_badges(t: Tables) -> DataFrame:
    marks = F.array(*(F.struct(F.lit(f).alias("frame"), F.lit(y).alias("y"), F.lit(n).alias("number")) for f, y, n in ((0, 380, 1), (0, 980, 2), (1, 580, 2))))
    return t.matches.select("match_id", F.explode(marks).alias("x")).select("match_id", "x.*")


def pending_rows(t: Tables) -> DataFrame:
    e = F.col("event_id")
    k, v = F.when(e % 3 != 0, F.col("killer_id")), F.when(e % 4 != 0, F.col("victim_id"))
    return t.events.select("event_id", k.alias("killer_id"), v.alias("victim_id"), F.when(k.isNull() | v.isNull(), "UNRESOLVED").alias("flag"))


def read_again(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.filter("event_id % 2 = 0").select("event_id", F.when(e % 5 != 0, F.col("killer_id")).alias("killer"), F.when(e % 14 == 0, F.col("killer_id")).otherwise(F.col("victim_id")).alias("victim"))


def side_reads(t: Tables) -> DataFrame:
    """match_id, t_ms, blue, red: a side count at every third event: right at first, then one short."""
    n = F.when(F.col("event_id") % 5 == 0, F.lit(14)).otherwise(F.lit(15))
    blue = F.lit(8)
    return t.events.filter("event_id % 3 <> 0").groupBy("match_id", F.col("feed_ms").alias("t_ms")).agg(F.max(blue).alias("blue"), F.max(n - blue).alias("red"))


def feed_sightings(t: Tables) -> DataFrame:
    """match_id, t_ms, y, h, icons: each event's row seen up to 8 times, moving up after three, at times without its icons."""
    seen = t.events.filter("event_type <> 'other'").select("*", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 8).cast("int"))).alias("i"))
    kind = F.when(F.col("event_type") == "knock", "knock").when(F.col("event_type") == "eliminated_knocked", "tombstone")
    icons = F.when((F.col("event_id") + F.col("i")) % 6 == 5, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(kind, F.col("weapon"))))
    y = 438 - 52 * F.floor(F.col("i") / 3) - F.col("event_id") % 3 * 150
    return seen.select("match_id", (F.col("feed_ms") + 200 * F.col("i")).alias("t_ms"), y.cast("int").alias("y"), F.lit(34).alias("h"), icons.alias("icons"))


def feed_icons(t: Tables) -> DataFrame:
    """event_id, icons, scores (hundredths by icon), knock_weapon: rows with up to two gun icons, some with a knock icon before or after them."""
    e, known = F.col("event_id"), F.col("weapon").isNotNull() & (F.col("weapon") != "Zone")
    gun = F.when(known, F.concat(F.lit("weapon_"), F.col("weapon")))
    icons = F.array_compact(F.array(F.when(e % 9 == 0, "icon_knock"), F.when(e % 2 == 0, "tombstone"), gun, F.when(e % 3 == 0, "weapon_Car"), F.when(e % 7 == 0, "icon_knock")))
    # a list of pairs first: one icon may stand twice in a row, the score of its first place counts
    pairs = F.transform(F.array_distinct(icons), lambda i: F.struct(i, (70 + (e + F.length(i)) % 25).cast("int")))
    return t.events.select("event_id", icons.alias("icons"), F.map_from_entries(pairs).alias("scores"), F.when(e % 4 != 0, F.col("weapon")).alias("knock_weapon"))
