"""From noisy readings to settled values: debouncing, sessions, votes, sampling. Windows inside a match only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOARD_GAP_MS, MATCH_BOARD_MS = 2000, 5000
LINE_GAP_MS, LINE_LEAST_MS, LINE_LEAST_SEEN = 1000, 500, 3


def counter_changes(reads: DataFrame) -> DataFrame:
    """Confirmed values of a counter: match_id, t_ms, was (null at first), value, deaths, is_reset.

    A value counts once two consecutive readings show it; it is stamped with the first reading that left the
    value before. Unread ones are skipped. Gaps and islands: a run of equal readings confirms by its second row.
    """
    line = Window.partitionBy("match_id").orderBy("t_ms")
    runs = reads.filter("value is not null").withColumn("prev", F.lag("value").over(line)).withColumn("new_run", F.coalesce((F.col("value") != F.col("prev")).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new_run").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy("match_id", "run").agg(F.min("t_ms").alias("first_ms"), F.first("value").alias("value"), F.count("*").alias("n"))
    by_run = Window.partitionBy("match_id").orderBy("run")
    # the settled value before a run, and whether the run leaves it
    settled = F.last(F.when(F.col("n") >= 2, F.col("value")), ignorenulls=True).over(by_run.rowsBetween(Window.unboundedPreceding, -1))
    left = each.withColumn("was", settled)
    away = left.withColumn("away", F.col("was").isNotNull() & (F.col("value") != F.col("was")))
    # stamp: the first run away since the last run that was at the settled value or settled itself
    home = F.last(F.when(~F.col("away") | (F.col("n") >= 2), F.col("run")), ignorenulls=True).over(by_run.rowsBetween(Window.unboundedPreceding, -1))
    stretch = Window.partitionBy("match_id", "home").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    stamped = away.withColumn("home", F.coalesce(home, F.lit(0))).withColumn("left_ms", F.min(F.when(F.col("away"), F.col("first_ms"))).over(stretch))
    changed = stamped.filter((F.col("n") >= 2) & (F.col("was").isNull() | F.col("away")))
    top = F.max("value").over(by_run.rowsBetween(Window.unboundedPreceding, -1))
    out = changed.withColumn("top", top)
    return out.select(
        "match_id", F.coalesce(F.when(F.col("was").isNotNull(), F.col("left_ms")), F.col("first_ms")).alias("t_ms"), "was", "value",
        F.coalesce(F.greatest(F.col("was") - F.col("value"), F.lit(0)), F.lit(0)).alias("deaths"), F.coalesce((F.col("value") > F.col("was")) & (F.col("value") >= F.col("top")), F.lit(False)).alias("is_reset"),
    )


def counter_deaths(reads: DataFrame) -> DataFrame:
    """match_id, t_ms, death_no (1, 2, ... of deaths at one time)."""
    return counter_changes(reads).filter("deaths > 0").select("match_id", "t_ms", F.explode(F.sequence(F.lit(1).cast("long"), F.col("deaths").cast("long"))).alias("death_no"))


def board_sessions(detected: DataFrame, gap_ms: int = BOARD_GAP_MS, whole_ms: int = MATCH_BOARD_MS) -> DataFrame:
    """Detections at most 2 s apart are one board; one that stays 5 s, or is the last thing seen, is the end-of-match board."""
    line = Window.partitionBy("match_id").orderBy("t_ms")
    opened = detected.withColumn("opens", F.coalesce((F.col("t_ms") - F.lag("t_ms").over(line) > gap_ms).cast("int"), F.lit(1)))
    numbered = opened.withColumn("board_no", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    boards = numbered.groupBy("match_id", "board_no").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.count("*").alias("reads"))
    last = F.max("board_no").over(Window.partitionBy("match_id"))
    kind = F.when((F.col("end_ms") - F.col("start_ms") >= whole_ms) | (F.col("board_no") == last), "match").otherwise("round")
    return boards.withColumn("kind", kind)


def sighting_sessions(sightings: DataFrame, key: tuple[str, ...], gap_ms: int = LINE_GAP_MS) -> DataFrame:
    """One line per burst of sightings of a key with gaps up to 1 s; bursts under 0.5 s or 3 sightings are dropped."""
    line = Window.partitionBy(*key).orderBy("t_ms")
    opened = sightings.withColumn("opens", F.coalesce((F.col("t_ms") - F.lag("t_ms").over(line) > gap_ms).cast("int"), F.lit(1)))
    numbered = opened.withColumn("session", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(*key, "session").agg(F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), F.count("*").alias("seen"))
    return found.filter((F.col("last_ms") - F.col("first_ms") >= LINE_LEAST_MS) & (F.col("seen") >= LINE_LEAST_SEEN))


def majority_type(sightings: DataFrame) -> DataFrame:
    """Per line the type of most sightings; a tie goes to a type other than kill, then by name."""
    counts = sightings.groupBy("match_id", "line", "etype").agg(F.count("*").alias("n"))
    order = Window.partitionBy("match_id", "line").orderBy(F.desc("n"), F.col("etype") == "kill", "etype")
    return counts.withColumn("place", F.row_number().over(order)).filter("place = 1").select("match_id", "line", "etype")


def majority_weapon(sightings: DataFrame) -> DataFrame:
    """Per line the weapon of most readings, then by name; lines without a reading are left out."""
    counts = sightings.filter("weapon is not null").groupBy("match_id", "line", "weapon").agg(F.count("*").alias("n"))
    order = Window.partitionBy("match_id", "line").orderBy(F.desc("n"), "weapon")
    return counts.withColumn("place", F.row_number().over(order)).filter("place = 1").select("match_id", "line", "weapon")


def resample(reads: DataFrame, step_ms: int) -> DataFrame:
    """The first reading at or after each multiple k of a step."""
    bucket = F.ceil(F.col("t_ms") / F.lit(step_ms)).cast("long")
    first = Window.partitionBy("match_id", "k").orderBy("t_ms")
    return reads.withColumn("k", bucket).withColumn("place", F.row_number().over(first)).filter("place = 1").select("match_id", "k", "t_ms", "value")


def sample_readings(sightings: DataFrame, most: int = 3, apart_ms: int = 250) -> DataFrame:
    """At most three readings of a line, each at least 0.25 s after the last one taken."""
    rows = sightings.groupBy("match_id", "line").agg(F.sort_array(F.collect_set("t_ms")).alias("ts"))
    start = F.expr("cast(array() as array<bigint>)")
    free = lambda acc, t: (F.size(acc) < most) & ((F.size(acc) == 0) | (t - F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) >= apart_ms))
    taken = F.aggregate("ts", start, lambda acc, t: F.when(free(acc, t), F.concat(acc, F.array(t))).otherwise(acc))
    return rows.select("match_id", "line", F.explode(taken).alias("t_ms"))


def skipped_spans(times: DataFrame, gap_ms: int = 1000) -> DataFrame:
    """Times at most 1 s apart merged into spans, with their length."""
    line = Window.partitionBy("match_id").orderBy("t_ms")
    opened = times.withColumn("opens", F.coalesce((F.col("t_ms") - F.lag("t_ms").over(line) > gap_ms).cast("int"), F.lit(1)))
    numbered = opened.withColumn("span", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("match_id", "span").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms")).withColumn("length_ms", F.col("end_ms") - F.col("start_ms"))


def skipped_summary(spans: DataFrame, last_seen: DataFrame, slack_ms: int = 1000) -> DataFrame:
    """spans: ``skipped_spans``; last_seen: match_id, last_ms (of the recording). match_id, spans, skipped_ms, reaches_end: one span that goes on to the end of the recording means that the match was over; else rows are missing."""
    each = spans.groupBy("match_id").agg(F.count("*").alias("spans"), F.sum("length_ms").alias("skipped_ms"), F.max("end_ms").alias("end_ms"))
    reaches = (F.col("spans") == 1) & (F.col("end_ms") >= F.col("last_ms") - slack_ms)
    return each.join(last_seen, "match_id").select("match_id", "spans", "skipped_ms", reaches.alias("reaches_end"))


def reads_vs_truth(reads: DataFrame, truth: DataFrame) -> DataFrame:
    """Readings inside intervals of known value (match_id, start_ms, end_ms, value): correct, blank, wrong per match."""
    inside = reads.alias("r").join(truth.alias("t"), (F.col("r.match_id") == F.col("t.match_id")) & (F.col("r.t_ms") >= F.col("t.start_ms")) & (F.col("r.t_ms") < F.col("t.end_ms")))
    verdict = F.when(F.col("r.value").isNull(), "blank").when(F.col("r.value") == F.col("t.value"), "correct").otherwise("wrong")
    told = inside.select(F.col("r.match_id").alias("match_id"), verdict.alias("v"))
    return told.groupBy("match_id").agg(*(F.coalesce(F.sum(F.when(F.col("v") == x, 1)), F.lit(0)).cast("long").alias(x) for x in ("correct", "blank", "wrong")))
