"""The seven tables of a match history on disk: their schema, and the rows that break its rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "matches": "match_id long, recorded_at string, source_file string, team_size int, rounds_played long, pipeline_version string, status string",
    "players": "player_id long, ign string, nickname string",
    "player_aliases": "alias string, player_id long",
    "match_players": "match_id long, player_id long, team string, slot long",
    "rounds": "match_id long, round_no long, start_ms long, end_ms long, blue_score long, red_score long",
    "events": "event_id long, match_id long, round_no long, true_ms long, feed_ms long, event_type string, killer_id long, victim_id long, weapon string, victim_team string, confidence double, flag string, reviewed int",
    "scoreboard_stats": "match_id long, round_no long, player_id long, stat_name string, value double",
}
#: Columns that no two rows may share; all but round_no must be there.
UNIQUE = {
    "matches": [("match_id",), ("source_file", "recorded_at")], "players": [("player_id",), ("ign",)], "player_aliases": [("alias",)], "match_players": [("match_id", "player_id")],
    "rounds": [("match_id", "round_no")], "events": [("event_id",)], "scoreboard_stats": [("match_id", "round_no", "player_id", "stat_name")],
}
REQUIRED = {
    "matches": ("match_id", "recorded_at", "source_file", "status"), "players": ("player_id", "ign"), "player_aliases": ("alias", "player_id"), "match_players": ("match_id", "player_id"),
    "rounds": ("match_id", "round_no"), "events": ("event_id", "match_id", "true_ms", "feed_ms", "event_type"), "scoreboard_stats": ("match_id", "player_id", "stat_name"),
}
ALLOWED = {"events": ("event_type", ("knock", "kill", "eliminated_knocked", "other")), "matches": ("status", ("live", "processed", "needs_review", "interrupted", "failed"))}
#: (table, its column) -> (table, column) where the value must be, if there is one.
REFERENCES = {
    ("player_aliases", "player_id"): ("players", "player_id"), ("match_players", "match_id"): ("matches", "match_id"), ("match_players", "player_id"): ("players", "player_id"),
    ("rounds", "match_id"): ("matches", "match_id"), ("events", "match_id"): ("matches", "match_id"), ("events", "killer_id"): ("players", "player_id"), ("events", "victim_id"): ("players", "player_id"),
    ("scoreboard_stats", "match_id"): ("matches", "match_id"), ("scoreboard_stats", "player_id"): ("players", "player_id"),
}


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Writes tables, by their names in ``SCHEMAS``, as Parquet; columns are cast, others left out."""
    for name, rows in tables.items():
        rows.select(*(F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(SCHEMAS[name]))).write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()}


def _key(name: str) -> Column:
    return F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in UNIQUE[name][0]))


def broken_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """table, key, reason: a row for each rule that a row breaks; keys that several rows share come once.

    One aggregation per key that must be unique, one anti-join per reference, and a single pass for the rest.
    """
    found = []
    for name, rows in tables.items():
        tests = [(F.col(c).isNull(), f"no {c}") for c in REQUIRED[name]]
        if name in ALLOWED:
            column, values = ALLOWED[name]
            tests.append((F.col(column).isNotNull() & ~F.col(column).isin(*values), f"unknown {column}"))
        reasons = F.array_compact(F.array(*(F.when(bad, text) for bad, text in tests)))
        found.append(rows.select(F.lit(name).alias("table"), _key(name).alias("key"), F.explode(reasons).alias("reason")))
        for columns in UNIQUE[name]:
            whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns if c != "round_no"))
            twice = rows.filter(whole).groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")
            key = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
            found.append(twice.select(F.lit(name).alias("table"), key.alias("key"), F.lit(f"{' and '.join(columns)} not unique").alias("reason")))
    for (name, column), (other, target) in REFERENCES.items():
        if name in tables and other in tables:
            there = tables[other].select(F.col(target).alias(column)).distinct()
            lost = tables[name].filter(F.col(column).isNotNull()).join(there, column, "left_anti")
            found.append(lost.select(F.lit(name).alias("table"), _key(name).alias("key"), F.lit(f"{column} is not in {other}").alias("reason")))
    return reduce(DataFrame.unionByName, found)
