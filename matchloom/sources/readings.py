"""Bronze readings derived from the given tables by plain rules (see ``oracles.BASE_READS``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions.match_rules import counted_elimination
from matchloom.sources.mapping import Tables

STEP_MS, MATCH_MS, ROUND_MS, ROOM = 500, 1_080_000, 72_000, 15


def match_grid(t: Tables) -> DataFrame:
    """match_id, t_ms (int): two moments a second of each match. Matches are few bytes and become thousands of rows each, so they are dealt to all tasks first."""
    # by a hash of its own: matches come dealt by match_id, a second deal by it would be left out
    dealt = t.matches.select("match_id").repartition(int(t.events.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("match_id"))
    return dealt.select("match_id", F.explode(F.sequence(F.lit(0), F.lit(MATCH_MS), F.lit(STEP_MS))).alias("t_ms"))


def counter_reads(t: Tables) -> DataFrame:
    """match_id, t_ms, value: two readings a second of the players alive in each round of 72 s; some unread, some off by one."""
    grid = match_grid(t).withColumn("died", F.lit(0))
    died = t.events.filter(counted_elimination()).select("match_id", F.col("feed_ms").alias("t_ms"), F.lit(1).alias("died"))
    line = grid.select("match_id", F.col("t_ms").cast("long").alias("t_ms"), "died").unionByName(died).withColumn("part", F.expr(f"t_ms div {ROUND_MS}"))
    so_far = F.sum("died").over(Window.partitionBy("match_id", "part").orderBy("t_ms").rangeBetween(Window.unboundedPreceding, 0))
    alive = line.withColumn("so_far", so_far).filter("died = 0")
    n = F.expr(f"t_ms div {STEP_MS}")
    value = F.greatest(F.lit(ROOM) - F.col("so_far"), F.lit(0)) + F.when(n % 41 == 0, 1).otherwise(0)
    return alive.select("match_id", "t_ms", F.when(n % 37 != 0, value).alias("value"))


def screen_reads(t: Tables) -> DataFrame:
    """match_id, t_ms when a board was detected: at each event of a flagged or cut row, as a stand-in for detections."""
    return t.events.filter("event_id % 3 = 0").select("match_id", F.col("feed_ms").alias("t_ms")).distinct()


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")


def roster(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("p_name").alias("name")).distinct()


def name_reads(parts: DataFrame) -> DataFrame:
    """read_id, raw: part names as a weak reader would give them."""
    p, n = F.col("p_partkey") % 3, F.col("p_name")
    raw = F.when(p == 0, F.translate(n, "ois", "015")).when(p == 1, F.translate(F.expr("substring(p_name, 2)"), "o", "0")).otherwise(F.translate(F.expr("substring(p_name, 3, length(p_name) - 3)"), "e", "x"))
    return parts.select(F.col("p_partkey").alias("read_id"), raw.alias("raw"))


def sightings(t: Tables) -> DataFrame:
    """match_id, line (the row behind it), t_ms, etype, weapon_read: each event is seen up to 8 times, 250 ms apart, sometimes misread."""
    e = t.events.filter("event_type <> 'other'")
    seen = e.select("*", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 8).cast("int"))).alias("i"))
    etype = F.when((F.col("event_id") + F.col("i")) % 5 == 0, "kill").otherwise(F.col("event_type"))
    return seen.select("match_id", F.col("event_id").alias("line"), (F.col("feed_ms") + 250 * F.col("i")).alias("t_ms"), etype.alias("etype"), F.when(F.col("i") % 3 != 1, F.col("weapon")).alias("weapon"))
