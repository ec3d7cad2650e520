"""Streaming jobs run to the end of the given tables (available-now), so that their results can be queried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchloom import oracles
from matchloom.operators.matching import death_team, pairs
from matchloom.operators.readings import counter_deaths
from matchloom.operators.rounds import late_row_round
from matchloom.operators.rows import slot_deaths
from matchloom.sources import mapping, row_inputs
from matchloom.sources import readings as bronze
from matchloom.sources.scratch import new_folder
from matchloom.sources.store import TableStore
from matchloom.streaming import jobs, live
from matchloom.streaming.ordered import records, state_store


#: Number of the delivery in which a row comes.
DELIVERY = "delivery"


def _deliver(rows: DataFrame, at: str) -> StructType:
    """Writes rows by delivery, each in as many files as it has tasks: what they are made of is worked out once. Gives their schema without the number."""
    rows.write.partitionBy(DELIVERY).parquet(at)
    return rows.drop(DELIVERY).schema


def _so_far(spark: SparkSession, at: str, schema: StructType, k: int) -> DataFrame:
    """The stream of all deliveries up to k."""
    return spark.readStream.schema(schema).parquet(f"{at}/{DELIVERY}={{{','.join(str(n) for n in range(k + 1))}}}")


def run_to_end(spark: SparkSession, rows: DataFrame, deliveries: int, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Delivers rows by their number of delivery, streams what is there through job after each, and reads what it wrote."""
    at = new_folder(spark)
    schema = _deliver(rows, f"{at}/in")
    for k in range(deliveries):
        result = job(_so_far(spark, f"{at}/in", schema, k))
        result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{at}/out")


def stream_counter_deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed counter changes, read as a stream in three deliveries: match_id, t_ms, was, value, deaths."""
    reads = bronze.counter_reads(mapping.load(spark, sf_dir)).withColumn("value", F.col("value").cast("long"))
    third = F.floor(F.col("t_ms") * 3 / (bronze.MATCH_MS + 1))
    return run_to_end(spark, reads.withColumn(DELIVERY, third), 3, jobs.counter_stream)


def stream_match_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written live and improved later: the last version of each. event_id, match_id, true_ms, version."""
    ev = mapping.load(spark, sf_dir).events
    versions = ev.select("event_id", "match_id", F.col("feed_ms").alias("true_ms"), F.lit(1).alias("version")).union(ev.select("event_id", "match_id", "true_ms", F.lit(2)))
    at = new_folder(spark)
    versions.repartition(4).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(versions.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    stream.writeStream.foreachBatch(jobs.match_upserts(f"{at}/out", ["event_id"], "version")).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return jobs.read_upserts(spark, f"{at}/out", ["event_id"], "version")


def _in_thirds(rows: DataFrame, t_ms: str, end: DataFrame | None = None) -> DataFrame:
    """Rows in three deliveries by time; end: rows of a later time that move the watermark past all others, in two more."""
    dealt = rows.withColumn(DELIVERY, F.floor(F.col(t_ms) * 3 / (bronze.MATCH_MS + 10_000)))
    return dealt if end is None else dealt.unionByName(end.withColumn(DELIVERY, F.explode(F.array(F.lit(3).cast("long"), F.lit(4).cast("long")))))


def stream_sighting_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of sightings, read as a stream: match_id, line, first_ms, last_ms, seen."""
    seen = bronze.sightings(mapping.load(spark, sf_dir)).select("match_id", "line", "t_ms", F.timestamp_millis("t_ms").alias("ts"))
    after = spark.range(1).select(F.lit(-1).cast("long").alias("match_id"), F.lit(-1).cast("long").alias("line"), F.lit(10**9).cast("long").alias("t_ms"), F.timestamp_millis(F.lit(10**9)).alias("ts"))
    found = run_to_end(spark, _in_thirds(seen, "t_ms", after), 5, jobs.sighting_stream)
    return found.filter("match_id >= 0").select("match_id", "line", F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"), "seen")


def stream_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eliminations and deaths near each other in one round, joined as two streams: match_id, round_no, event_id, death_id."""
    t = mapping.load(spark, sf_dir)
    round_ = lambda c: F.expr(f"{c} div {bronze.ROUND_MS} + 1").alias("round_no")
    rows = t.events.filter(F.col("event_type").isin("kill", "eliminated_knocked")).select("match_id", round_("feed_ms"), "event_id", F.col("feed_ms").alias("t_ms"), F.timestamp_millis("feed_ms").alias("ts"))
    died = counter_deaths(bronze.counter_reads(t))
    deaths = died.select("match_id", round_("t_ms"), (F.col("t_ms") * 100 + F.col("death_no")).alias("death_id"), "t_ms", F.timestamp_millis("t_ms").alias("ts"))
    at = new_folder(spark)
    of_rows, of_deaths = _deliver(_in_thirds(rows, "t_ms").drop("t_ms"), f"{at}/rows"), _deliver(_in_thirds(deaths, "t_ms").drop("t_ms"), f"{at}/deaths")
    for k in range(3):
        pairs = jobs.align_stream(_so_far(spark, f"{at}/rows", of_rows, k), _so_far(spark, f"{at}/deaths", of_deaths, k))
        pairs.writeStream.format("parquet").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(pairs.schema).parquet(f"{at}/out").select("match_id", "round_no", "event_id", "death_id")


def _delivered(parts: list[DataFrame]) -> DataFrame:
    """Records in three deliveries; each comes up to 16 s late, so they are out of order within deliveries and across them."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    late = whole.withColumn("comes", F.col("due_ms") + F.pmod(F.xxhash64("key", "id", "rank"), F.lit(3)) * 8000)
    dealt = late.select(*whole.columns, F.floor(F.col("comes") * 3 / (bronze.MATCH_MS + 30_000)).alias(DELIVERY))
    end = records(whole.sparkSession.range(1).selectExpr("-1L as match_id", "1000000000L as at", "0L as id"), "match_id", "at", 0, "id").select(*whole.columns)
    return dealt.unionByName(end.withColumn(DELIVERY, F.explode(F.array(F.lit(3).cast("long"), F.lit(4).cast("long")))))


def run_folds(spark: SparkSession, parts: list[DataFrame], job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    with state_store(spark):
        return run_to_end(spark, _delivered(parts), 5, job)


def _death_rows(t: mapping.Tables) -> DataFrame:
    return counter_deaths(bronze.counter_reads(t)).select("match_id", (F.col("t_ms") * 100 + F.col("death_no")).alias("death_id"), "t_ms", F.expr(f"t_ms div {bronze.ROUND_MS} + 1").alias("round_no"))


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round of each row, told a second after it: event_id, found_round, late."""
    t = mapping.load(spark, sf_dir)
    found = run_folds(spark, jobs.late_row_records(t.events, t.rounds, _death_rows(t)), jobs.late_row_stream)
    return found.select("event_id", F.col("found_round").cast("int").alias("found_round"), "late")


def stream_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eliminations and deaths of a round paired one to one as they come: match_id, event_id, death_id, t_ms, settled."""
    t = mapping.load(spark, sf_dir)
    deaths = _death_rows(t)
    greys = slot_deaths(row_inputs.slot_reads(t)).select("match_id", (F.col("t_ms") * 1000 + F.col("slot") % 15).alias("slot_id"), "t_ms")
    side = F.when(F.col("slot_id") % 1000 < 8, "blue").otherwise("red").alias("team")
    teamed = deaths.join(death_team(deaths, greys).select("match_id", "death_id", side), ["match_id", "death_id"], "left")
    placed = t.events.drop("round_no").join(late_row_round(t.events, t.rounds, deaths).withColumnRenamed("found_round", "round_no"), "event_id")
    return pairs(run_folds(spark, jobs.pair_records(placed, teamed), jobs.pair_stream))


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events less those within 5 s of the last kept one of their key, read as a stream: event_id."""
    return run_folds(spark, [jobs.anchored_dedupe_records(mapping.load(spark, sf_dir).events)], jobs.anchored_dedupe_stream).select("event_id")


def stream_match_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sign of life of each match, once it has been silent for 25 s of event time: match_id, last_ms."""
    signs = mapping.load(spark, sf_dir).events.select("match_id", "feed_ms", F.timestamp_millis("feed_ms").alias("ts"))
    after = spark.range(1).select(F.lit(-1).cast("long").alias("match_id"), F.lit(10**9).cast("long").alias("feed_ms"), F.timestamp_millis(F.lit(10**9)).alias("ts"))
    found = run_to_end(spark, _in_thirds(signs, "feed_ms", after), 5, jobs.match_end_stream)
    # a match that was silent for long in between is told more than once
    return found.filter("match_id >= 0").groupBy("match_id").agg(F.max(F.unix_millis("last_sign")).alias("last_ms"))


def _changes(t: mapping.Tables) -> DataFrame:
    """The given matches as a log of changes: rounds started twice, times improved, rows moved and flagged, boards read twice, players told again."""
    def said(rows: DataFrame, op: str, seq: str, **fields: str) -> DataFrame:
        return rows.select("match_id", F.expr(seq).cast("long").alias("seq"), F.lit(op).alias("op"), *(F.expr(e).alias(c) for c, e in fields.items()))

    by_name = lambda *names: {n: n for n in names}
    m, r, e, p, b = t.matches, t.rounds, t.events, t.match_players, t.scoreboard
    log = [
        said(m, "begin", "1", **by_name("recorded_at", "source_file")), said(m.filter("match_id % 9 <> 0"), "finish", "3000000", status="case when match_id % 4 = 1 then 'failed' end"),
        said(p, "player", "2", **by_name("player_id", "team", "slot")), said(p.filter("player_id % 7 = 0"), "player", "3", player_id="player_id", team="case when team = 'blue' then 'red' else 'blue' end"),
        said(r, "start_round", "10 + round_no", **by_name("round_no", "start_ms")), said(r, "start_round", "40 + round_no", round_no="round_no", start_ms="start_ms + 5"),
        said(r, "end_round", "70 + round_no", **by_name("round_no", "end_ms", "blue_score", "red_score")),
        said(e, "event", "1000 + feed_ms", true_ms="feed_ms", time_source="'feed'", **by_name("event_id", "round_no", "feed_ms", "event_type", "killer_id", "victim_id", "weapon", "victim_team", "confidence", "flag")),
        said(e.filter("true_ms <> feed_ms"), "time", "1500 + feed_ms", event_id="event_id", true_ms="true_ms", time_source="'counter'"),
        said(e.filter("event_id % 10 = 0"), "move", "2000000", event_id="event_id", round_no="coalesce(round_no, 0) + 1"), said(e.filter("event_id % 31 = 0"), "flag", "2100000", event_id="event_id", flag="'NO_DROP'"),
        said(b.filter("round_no is not null"), "stat", "2200000 + round_no", **by_name("round_no", "player_id", "stat_name", "value")),
        said(b.filter("round_no is null"), "stat", "2300000", player_id="player_id", stat_name="stat_name", value="value + 1"),
        said(b.filter("round_no is null and match_id % 5 = 0 and player_id % 2 = 0"), "stat", "2400000", **by_name("player_id", "stat_name", "value")),
    ]
    whole = empty = t.events.sparkSession.createDataFrame([], live.CHANGE)
    for part in log:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.select(*empty.columns)


def _live(table: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = new_folder(spark)
        # in four deliveries of any order, one a batch: what was said late may come first
        number = F.pmod(F.xxhash64("seq", "event_id", "player_id"), F.lit(4))
        schema = _deliver(_changes(mapping.load(spark, sf_dir)).withColumn(DELIVERY, number), f"{at}/in")
        for k in range(4):
            stream = _so_far(spark, f"{at}/in", schema, k)
            stream.writeStream.foreachBatch(live.live_sink(f"{at}/live")).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
        store = TableStore(spark, f"{at}/live")
        store.compact()
        return live.live_tables(store)[table].select(*columns) if columns else live.live_tables(store)[table]

    return query


QUERIES = {"stream_counter_deaths": stream_counter_deaths, "stream_match_upserts": stream_match_upserts, "stream_sighting_sessions": stream_sighting_sessions, "stream_align": stream_align, "stream_candidate_pairs": stream_candidate_pairs, "stream_late_rows": stream_late_rows, "stream_dedupe": stream_dedupe, "stream_match_end": stream_match_end}
QUERIES |= {"live_match_matches": _live("matches"), "live_match_rounds": _live("rounds", "match_id", "round_no", "start_ms", "end_ms", "blue_score", "red_score"), "live_match_players": _live("match_players"), "live_match_events": _live("events"), "live_match_boards": _live("scoreboard")}
SELECTS = {
    "stream_match_upserts": "SELECT event_id, match_id, true_ms, 2 AS version FROM ev",
    "stream_match_end": "SELECT match_id, max(feed_ms) AS last_ms FROM ev GROUP BY match_id",
}
SELECTS |= {
    "live_match_matches": """SELECT match_id, recorded_at, source_file, CASE WHEN match_id % 9 = 0 THEN 'live' WHEN match_id % 4 = 1 THEN 'failed'
        WHEN match_id IN (SELECT match_id FROM ev WHERE flag IS NOT NULL OR event_id % 31 = 0) THEN 'needs_review' ELSE 'processed' END AS status,
        CASE WHEN match_id % 9 <> 0 THEN (SELECT count(*) FROM ro WHERE ro.match_id = ma.match_id) END AS rounds_played FROM ma""",
    "live_match_rounds": "SELECT match_id, round_no, start_ms, end_ms, blue_score, red_score FROM ro",
    "live_match_players": "SELECT match_id, player_id, CASE WHEN player_id % 7 <> 0 THEN team WHEN team = 'blue' THEN 'red' ELSE 'blue' END AS team, slot FROM mp",
    "live_match_events": """SELECT match_id, event_id, CASE WHEN event_id % 10 = 0 THEN coalesce(round_no, 0) + 1 ELSE round_no END AS round_no, true_ms, CASE WHEN true_ms <> feed_ms THEN 'counter' ELSE 'feed' END AS time_source,
        feed_ms, event_type, killer_id, victim_id, weapon, victim_team, confidence, CASE WHEN event_id % 31 = 0 THEN 'NO_DROP' ELSE flag END AS flag FROM ev""",
    "live_match_boards": """SELECT match_id, round_no, player_id, stat_name, value FROM bo WHERE round_no IS NOT NULL OR (match_id % 5 = 0 AND player_id % 2 = 0)
        UNION ALL SELECT match_id, round_no, player_id, stat_name, value + 1 FROM bo o WHERE round_no IS NULL AND NOT (match_id % 5 = 0 AND EXISTS (SELECT 1 FROM bo x WHERE x.match_id = o.match_id AND x.round_no IS NULL AND x.player_id % 2 = 0))""",
}
READ_SELECTS = {
    "stream_late_rows": oracles.READ_SELECTS["late_row_round"],
    "stream_counter_deaths": "SELECT match_id, t_ms, was, value, deaths FROM cc",
    "stream_sighting_sessions": "SELECT match_id, line, min(t_ms) AS first_ms, max(t_ms) AS last_ms, count(*) AS seen FROM si GROUP BY match_id, line",
    "stream_candidate_pairs": """, dt AS (SELECT match_id, t_ms // 72000 + 1 AS round_no, t_ms, unnest(range(1, deaths + 1)) AS n FROM cc WHERE deaths > 0)
        SELECT ev.match_id, dt.round_no, event_id, dt.t_ms * 100 + n AS death_id FROM ev JOIN dt ON dt.match_id = ev.match_id AND dt.round_no = ev.feed_ms // 72000 + 1
        WHERE event_type IN ('kill', 'eliminated_knocked') AND dt.t_ms BETWEEN ev.feed_ms - 12000 AND ev.feed_ms + 1000""",
}
