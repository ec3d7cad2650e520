"""Judging single rows and their repeated readings: types, guns, flags, gates, votes, slots, layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SURE, AHEAD = 80, 5  # hundredths of a template's score
SHORT_MS, BOARD_OVER_MS = 500, 25_000


def row_type(icons: Column) -> Column:
    """A knock icon makes a knock, else a tombstone an elimination of one knocked, else it is a kill."""
    return F.when(F.array_contains(icons, "knock"), "knock").when(F.array_contains(icons, "tombstone"), "eliminated_knocked").otherwise("kill")


def weapon_pick(scores: DataFrame) -> DataFrame:
    """scores: event_id, gun, score (hundredths). The best gun if sure and clearly ahead of the second; else null."""
    order = Window.partitionBy("event_id").orderBy(F.desc("score"), "gun")
    two = scores.withColumns({"place": F.row_number().over(order), "second": F.lead("score").over(order)}).filter("place = 1")
    ok = (F.col("score") >= SURE) & (F.col("score") - F.coalesce("second", F.lit(0)) >= AHEAD)
    return two.select("event_id", F.when(ok, F.col("gun")).alias("weapon"))


def row_weapon(icons: Column, icon_scores: Column, knock_weapon: Column) -> Column:
    """The gun of a feed row: of a knock row the one that the gun library named, else its first gun icon (``weapon_...``) if that is sure; a later one does not stand in."""
    first = F.get(F.filter(icons, lambda i: i.startswith("weapon_")), F.lit(0))
    sure = F.coalesce(F.try_element_at(icon_scores, first), F.lit(0)) >= SURE
    return F.when(F.array_contains(icons, "icon_knock"), knock_weapon).when(sure, F.substring(first, 8, 1000))


def row_flag(rows: DataFrame) -> DataFrame:
    """rows: event_id, killer_id, victim_id, killer_score, victim_score. A row needs two different names; its confidence is the lower score, or the only one."""
    both = F.col("killer_id").isNotNull() & F.col("victim_id").isNotNull()
    open_ = ~both | (F.col("killer_id") == F.col("victim_id"))
    sure = F.when(both, F.least("killer_score", "victim_score")).otherwise(F.greatest("killer_score", "victim_score"))
    return rows.select("event_id", F.when(open_, "UNRESOLVED").alias("flag"), F.round(sure, 2).alias("confidence"))


def short_row_gate(lines: DataFrame) -> DataFrame:
    """lines: line, first_ms, last_ms, seen, n_icons, killer_id, victim_id. Short ones need two different names, an icon and two sightings."""
    named = F.coalesce(F.col("killer_id") != F.col("victim_id"), F.lit(False))
    return lines.filter((F.col("last_ms") - F.col("first_ms") >= SHORT_MS) | (named & (F.col("n_icons") >= 1) & (F.col("seen") >= 2)))


def slot_deaths(reads: DataFrame) -> DataFrame:
    """reads: match_id, round_no, slot, t_ms, state (alive, dead, null). A slot dies at the first of two dead reads after an alive one, or at a last single one."""
    line = Window.partitionBy("match_id", "round_no", "slot").orderBy("t_ms")
    seen = reads.filter("state is not null").withColumn("turn", F.coalesce((F.col("state") != F.lag("state").over(line)).cast("int"), F.lit(1)))
    runs = seen.withColumn("run", F.sum("turn").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy("match_id", "round_no", "slot", "run").agg(F.first("state").alias("state"), F.min("t_ms").alias("t_ms"), F.count("*").alias("n"))
    last = F.max("run").over(Window.partitionBy("match_id", "round_no", "slot"))
    return each.withColumn("last", last).filter("state = 'dead' and run > 1 and (n >= 2 or run = last)").select("match_id", "round_no", "slot", "t_ms")


def round_winner(scores: DataFrame) -> DataFrame:
    """scores: match_id, round_no, t_ms, blue, red. The first side above its score at the round's start, and when; blue if both at once."""
    line = Window.partitionBy("match_id", "round_no").orderBy("t_ms")
    rows = scores.withColumns({"b0": F.first("blue", ignorenulls=True).over(line), "r0": F.first("red", ignorenulls=True).over(line)})
    ups = rows.groupBy("match_id", "round_no").agg(F.min(F.when(F.col("blue") > F.col("b0"), F.col("t_ms"))).alias("b"), F.min(F.when(F.col("red") > F.col("r0"), F.col("t_ms"))).alias("r"))
    side = F.when(F.col("b").isNotNull() & (F.col("r").isNull() | (F.col("b") <= F.col("r"))), "blue").when(F.col("r").isNotNull(), "red")
    return ups.select("match_id", "round_no", side.alias("winner"), F.least("b", "r").alias("end_ms"))


def room_size(changes: DataFrame, starts: DataFrame) -> DataFrame:
    """The most players that the settled counter shows at a round's start, and half of them as team size (2 at least).

    changes: match_id, t_ms, value; starts: match_id, start_ms. As-of on one time line per match.
    """
    known = changes.select("match_id", "t_ms", F.struct("t_ms", "value").alias("v"), F.lit(0).alias("asks"))
    both = known.unionByName(starts.select("match_id", F.col("start_ms").alias("t_ms"), F.lit(1).alias("asks")), allowMissingColumns=True)
    line = Window.partitionBy("match_id").orderBy("t_ms", "asks").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = both.withColumn("now", F.max("v").over(line)["value"]).filter("asks = 1").groupBy("match_id").agg(F.max("now").alias("players"))
    return at.withColumn("team_size", F.greatest(F.lit(2), F.floor(F.col("players") / 2)).cast("long"))


def layout_gate(reads: DataFrame, limits: DataFrame, samples: int = 20) -> DataFrame:
    """reads: match_id, landmark, t_ms, hit; limits: landmark, least (percent), critical. Evenly sampled; at most one landmark may fail, and no critical one."""
    # as many tasks as the session asks for: readings are small on the wire and large in a sort, so few tasks must not be given many of them
    dealt = reads.repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "match_id", "landmark")
    group = Window.partitionBy("match_id", "landmark")
    placed = dealt.withColumns({"place": F.row_number().over(group.orderBy("t_ms")) - 1, "n": F.count("*").over(group)})
    # the first reading of each of as many even parts as there are samples, the first n % samples of them one longer (ntile)
    size, longer = F.floor(F.col("n") / samples), F.col("n") % samples
    at = F.col("place") - longer * (size + 1)
    chosen = placed.filter(F.when(at < 0, F.col("place") % (size + 1) == 0).otherwise(F.pmod(at, F.greatest(size, F.lit(1))) == 0))
    share = chosen.groupBy("match_id", "landmark").agg((100 * F.sum(F.col("hit").cast("int")) / F.count("*")).alias("share"))
    judged = share.join(limits, "landmark").withColumn("fails", F.col("share") < F.col("least"))
    return judged.groupBy("match_id").agg(F.sum(F.col("fails").cast("int")).alias("failures"), ((F.sum(F.col("fails").cast("int")) <= 1) & (F.sum((F.col("fails") & F.col("critical")).cast("int")) == 0)).alias("ok"))


def near_miss_seconds(misses: DataFrame, per_second: float, least: float = 1.5) -> DataFrame:
    """Matches whose rejected readings add up to 1.5 s or more."""
    return misses.groupBy("match_id").agg((F.count("*") / per_second).alias("seconds")).filter(F.col("seconds") >= least)


def match_end(rows: DataFrame, boards: DataFrame, signs: DataFrame) -> DataFrame:
    """event_id of rows more than 25 s after the last board with no sign of life since: not read any more."""
    line = Window.partitionBy("match_id").orderBy("t_ms").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    none = F.lit(None).cast("long")
    marks = boards.select("match_id", F.col("end_ms").alias("t_ms"), F.col("end_ms").alias("board"), none.alias("sign"), none.alias("event_id"))
    marks = marks.unionByName(signs.select("match_id", "t_ms", none.alias("board"), F.col("t_ms").alias("sign"), none.alias("event_id")))
    all_rows = marks.unionByName(rows.select("match_id", F.col("feed_ms").alias("t_ms"), none.alias("board"), none.alias("sign"), "event_id"))
    seen = all_rows.withColumns({"board": F.max("board").over(line), "sign": F.max("sign").over(line)}).filter("event_id is not null")
    over = (F.col("t_ms") - F.col("board") > BOARD_OVER_MS) & F.coalesce(F.col("sign") < F.col("board"), F.lit(True))
    return seen.filter(over).select("event_id")


def pair_vote(reads: DataFrame) -> DataFrame:
    """reads: line, killer_id, killer_score, victim_id, victim_score (hundredths; null names unread). One pair of names per line.

    Readings with both names vote for the pair with the lower score; without any, each name is voted for on its
    own, and one name on both sides counts for neither. Ties go to the smaller id.
    """
    both = reads.filter("killer_id is not null and victim_id is not null").groupBy("line", "killer_id", "victim_id").agg(F.sum(F.least("killer_score", "victim_score")).alias("weight"))
    order = Window.partitionBy("line").orderBy(F.desc("weight"), "killer_id", "victim_id")
    pairs = both.withColumn("place", F.row_number().over(order)).filter("place = 1").select("line", "killer_id", "victim_id")

    def alone(who: str) -> DataFrame:
        tally = reads.filter(F.col(f"{who}_id").isNotNull()).groupBy("line", f"{who}_id").agg(F.sum(f"{who}_score").alias("weight"))
        first = Window.partitionBy("line").orderBy(F.desc("weight"), f"{who}_id")
        return tally.withColumn("place", F.row_number().over(first)).filter("place = 1").select("line", f"{who}_id")

    single = alone("killer").join(alone("victim"), "line", "full_outer").join(pairs, "line", "left_anti")
    same = F.coalesce(F.col("killer_id") == F.col("victim_id"), F.lit(False))
    apart = single.select("line", *(F.when(~same, F.col(c)).alias(c) for c in ("killer_id", "victim_id")))
    return pairs.unionByName(apart)


def stitch_board(cells: DataFrame) -> DataFrame:
    """cells: match_id, player_id, stat_name, at, value (one reading per scroll position). The value read most often, and its share of the readings."""
    counts = cells.groupBy("match_id", "player_id", "stat_name", "value").agg(F.count("*").alias("n"))
    cell = Window.partitionBy("match_id", "player_id", "stat_name")
    order = cell.orderBy(F.desc("n"), F.asc_nulls_last("value"))
    best = counts.withColumns({"place": F.row_number().over(order), "reads": F.sum("n").over(cell)}).filter("place = 1")
    return best.select("match_id", "player_id", "stat_name", "value", F.round(F.col("n") / F.col("reads"), 2).alias("share"))


def board_vs_truth(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """Per statistic: cells that are right, blank and wrong against true ones (match_id, player_id, stat_name, true_value)."""
    both = cells.join(truth, ["match_id", "player_id", "stat_name"])
    verdict = F.when(F.col("value").isNull(), "blank").when(F.col("value") == F.col("true_value"), "correct").otherwise("wrong")
    told = both.select("stat_name", verdict.alias("v"))
    return told.groupBy("stat_name").agg(*(F.coalesce(F.sum(F.when(F.col("v") == x, 1)), F.lit(0)).cast("long").alias(x) for x in ("correct", "blank", "wrong")))


def seen_together_dedupe(rows: DataFrame, within_ms: int = 5000) -> DataFrame:
    """rows: event_id, match_id, killer_id, victim_id, event_type, feed_ms, short, seen (array of times). event_id of short rows that repeat another.

    A short row repeats a longer one of the same pair within 5 s, unless their types differ and both were on screen at one moment.
    """
    named = rows.filter("killer_id is not null and victim_id is not null")
    a = named.filter("short")
    b = named.filter("not short").select("match_id", "killer_id", "victim_id", F.col("event_type").alias("other_type"), F.col("feed_ms").alias("other_ms"), F.col("seen").alias("other_seen"))
    near = a.join(b, ["match_id", "killer_id", "victim_id"]).filter(F.abs(F.col("feed_ms") - F.col("other_ms")) <= within_ms)
    return near.filter((F.col("event_type") == F.col("other_type")) | ~F.arrays_overlap("seen", "other_seen")).select("event_id").distinct()


def badge_team(rows: DataFrame, badges: DataFrame, team_size: int, usual_pitch: float = 82.0) -> DataFrame:
    """rows: match_id, frame, player_id, y; badges: match_id, frame, y, number. Each row's team: that of the nearest badge of its frame within half a team's rows.

    The pitch of the rows is the median step between neighbours; a row out of reach has no team. Badge 1 is blue, 2 red.
    """
    down = Window.partitionBy("match_id", "frame").orderBy("y")
    steps = rows.withColumn("step", F.col("y") - F.lag("y").over(down)).groupBy("match_id", "frame").agg(F.median("step").alias("pitch"))
    marks = badges.select("match_id", "frame", F.col("y").alias("badge_y"), "number")
    near = rows.join(marks, ["match_id", "frame"], "left").withColumn("away", F.abs(F.col("y") - F.col("badge_y")))
    first = Window.partitionBy("match_id", "frame", "player_id").orderBy(F.asc_nulls_last("away"), "badge_y")
    best = near.withColumn("place", F.row_number().over(first)).filter("place = 1").join(steps, ["match_id", "frame"])
    held = F.col("away") <= team_size / 2 * F.coalesce("pitch", F.lit(usual_pitch))
    team = F.when(held & (F.col("number") == 1), "blue").when(held & (F.col("number") == 2), "red")
    return best.select("match_id", "frame", "player_id", team.alias("team"))


def resolve_pending(rows: DataFrame, read: DataFrame, final: bool = False) -> DataFrame:
    """rows: event_id, killer_id, victim_id, flag; read: event_id, killer, victim (ids read anew against the roster).

    During play only a full pair fills what is missing, at the end single names do too; a row is never made a
    self-kill; with both names the flag goes.
    """
    both = rows.join(read, "event_id", "left")
    k, v = F.coalesce("killer_id", "killer"), F.coalesce("victim_id", "victim")
    fits = ~F.coalesce(k == v, F.lit(False)) & (F.lit(final) | (k.isNotNull() & v.isNotNull()))
    new_k, new_v = F.when(fits, k).otherwise(F.col("killer_id")), F.when(fits, v).otherwise(F.col("victim_id"))
    done = new_k.isNotNull() & new_v.isNotNull() & (new_k != new_v)
    flag = F.when((F.col("flag") == "UNRESOLVED") & done, F.lit(None)).otherwise(F.col("flag"))
    return both.select("event_id", new_k.alias("killer_id"), new_v.alias("victim_id"), flag.alias("flag"))


def round_sides(sides: DataFrame, changes: DataFrame, starts: DataFrame) -> DataFrame:
    """Players per side of a round: the first reading of both sides that adds up to the settled counter while no one has died in the round.

    sides: match_id, t_ms, blue, red; changes: match_id, t_ms, value, deaths (of the counter); starts: match_id, round_no, start_ms, end_ms.
    One time line per match: the counter's value, the deaths and the starts so far are carried along to each reading.
    """
    none = F.lit(None).cast("long")
    line = Window.partitionBy("match_id").orderBy("t_ms").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    values = changes.select("match_id", "t_ms", F.struct("t_ms", "value").alias("v"), F.when(F.col("deaths") > 0, F.col("t_ms")).alias("died"))
    begun = starts.select("match_id", F.col("start_ms").alias("t_ms"), F.struct("start_ms", "round_no", "end_ms").alias("s"))
    asked = sides.select("match_id", "t_ms", F.col("blue").cast("long").alias("blue"), F.col("red").cast("long").alias("red"), F.lit(1).alias("asks"))
    rows = asked.unionByName(values, allowMissingColumns=True).unionByName(begun, allowMissingColumns=True)
    known = rows.withColumns({"now": F.max("v").over(line)["value"], "last_death": F.coalesce(F.max("died").over(line), none), "round": F.max("s").over(line)}).filter("asks = 1")
    fits = (F.col("blue") + F.col("red") == F.col("now")) & (F.col("t_ms") <= F.col("round.end_ms")) & ~F.coalesce(F.col("last_death") >= F.col("round.start_ms"), F.lit(False))
    return known.filter(fits).groupBy("match_id", F.col("round.round_no").alias("round_no")).agg(F.min_by("blue", "t_ms").alias("blue"), F.min_by("red", "t_ms").alias("red"))
