"""All queries of the match jobs, and their SQL. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import oracles
from matchloom.functions import names
from matchloom.jobs import export, ingest
from matchloom.operators import awards, boards, dims, matching, players, readings, rounds, rows, tracking, wording
from matchloom.sources import dim_inputs, row_inputs, silver
from matchloom.sources import readings as bronze
from matchloom.sources.mapping import Tables, load
from matchloom.sources.scratch import new_folder, written
from matchloom.sources.store import TableStore
from matchloom.streaming import queries as streaming

FIRST_DAY, LAST_DAY = "2024-01-03", "2024-01-20"


def _usable(t: Tables) -> DataFrame:
    return players.usable_knocks(t.events, t.match_players)


def _kept_usable(t: Tables) -> DataFrame:
    """Usable knocks that nine award rules read: written once."""
    return written(_usable(t))


def _roles(t: Tables) -> DataFrame:
    return awards.role_order(awards.all_roles(t.events, _kept_usable(t), t.match_players, t.matches, t.players), t.match_players, t.players)


def _per_match(t: Tables) -> DataFrame:
    return players.player_match(t.events, t.match_players, t.players, t.matches, t.scoreboard)


def _matrix(t: Tables) -> DataFrame:
    return players.knock_matrix(_usable(t))


def _pruned(t: Tables) -> DataFrame:
    gone = t.matches.filter("match_id % 1000 % 3 = 0")
    events, board, members = dims.delete_matches(gone, t.events, t.scoreboard, t.match_players)
    keep = dim_inputs.roster(t).union(t.players.filter("player_id % 25 = 0").select("ign"))
    return dims.prune_players(t.players, events, board, members, keep)


ON_TABLES: dict[str, Callable[[Tables], DataFrame]] = {
    "knock_outcomes": lambda t: players.knock_outcomes(t.events),
    "elim_credit": lambda t: players.elim_credit(t.events),
    "player_match": _per_match,
    "player_career": lambda t: players.player_career(_per_match(t)),
    "range_player_totals": lambda t: players.range_player_totals(_per_match(t), FIRST_DAY, LAST_DAY),
    "board_or_rounds": lambda t: players.board_values(t.scoreboard),
    "player_check": lambda t: players.player_check(_per_match(t)),
    "usable_knocks": lambda t: _usable(t).select("event_id", "match_id", "killer_id", "victim_id", "killer_team", "victim_team"),
    "knock_matrix": _matrix,
    "pair_reverse": lambda t: players.pair_reverse(_matrix(t)),
    "head_to_head": lambda t: players.head_to_head(_matrix(t), t.match_players),
    "opponent_rankings": lambda t: players.opponent_rankings(_matrix(t), t.players),
    "hidden_death_doubt": lambda t: players.hidden_death_doubt(t.events, players.knock_outcomes(t.events), t.match_players),
    "player_knock_lines": lambda t: players.player_knock_lines(t.events, t.match_players),
    "rivals": lambda t: awards.rivals(_usable(t), t.players),
    "dominating": lambda t: awards.dominating(_usable(t), t.players),
    "throwable_leaders": lambda t: awards.throwable_leaders(_usable(t)),
    "weapon_class_counts": lambda t: awards.weapon_class_counts(_usable(t)),
    "weapon_class_leaders": lambda t: awards.weapon_class_leaders(_usable(t), t.players),
    "clutch": lambda t: awards.clutch(awards.clutch_moments(t.events, _usable(t), t.match_players, t.matches), t.players),
    "knock_basis": lambda t: awards.knock_basis(t.events, _usable(t), t.match_players, t.scoreboard),
    "role_details": lambda t: wording.role_details(t.events, _kept_usable(t), t.match_players, t.matches, t.players),
    "basis_text": lambda t: wording.basis_text(awards.knock_basis(t.events, _usable(t), t.match_players, t.scoreboard)),
    "known_names": lambda t: dims.known_names(t.players, t.aliases),
    "players_list": lambda t: dims.players_list(t.players, t.aliases),
    "resolve_player": lambda t: dims.resolve_player(dim_inputs.readings(t), t.players, t.aliases),
    "canonical_name": lambda t: dims.canonical_name(dim_inputs.readings(t), t.players, t.aliases),
    "roster_expand": lambda t: dims.roster_expand(dim_inputs.roster(t), t.players, t.aliases),
    "rename_merge_events": lambda t: dims.rename_merge(dim_inputs.renames(t), t.events, t.scoreboard, t.match_players)[0].select("event_id", "killer_id", "victim_id"),
    "rename_merge_boards": lambda t: dims.rename_merge(dim_inputs.renames(t), t.events, t.scoreboard, t.match_players)[1],
    "rename_merge_players": lambda t: dims.rename_merge(dim_inputs.renames(t), t.events, t.scoreboard, t.match_players)[2],
    "delete_match": lambda t: dims.delete_matches(t.matches.filter("match_id % 5 = 0"), t.events)[0].select("event_id", "match_id"),
    "drop_old_pipeline": lambda t: dims.delete_matches(dims.old_pipeline(t.matches), t.events)[0].select("event_id", "match_id"),
    "prune_players": _pruned,
    "apply_corrections": lambda t: dims.apply_corrections(t.events, dim_inputs.corrections(t)).select("event_id", "killer_id", "victim_id", "event_type", "weapon", "reviewed"),
    "backfill_victim_team": lambda t: dims.backfill_victim_team(t.events.withColumn("victim_team", F.expr("case when event_id % 3 <> 0 then victim_team end")), t.match_players).select("event_id", "victim_team"),
    "ingest_matches": lambda t: dims.ingest_matches(dim_inputs.match_batch(t), dim_inputs.match_history(t), t.events),
    "replace_match": lambda t: dims.replace_match(dim_inputs.match_batch(t), dim_inputs.match_history(t)),
    "upsert_stats": lambda t: dims.upsert_stats(dim_inputs.stat_batches(t)),
    "upsert_match_players": lambda t: dims.upsert_match_players(dim_inputs.player_batches(t)),
    "recover_interrupted": lambda t: dims.recover_interrupted(t.matches).select("match_id", "status"),
    "v_events": lambda t: dims.v_events(t.events, t.matches, t.players),
    "match_counts": lambda t: dims.match_counts(t.events, t.rounds, t.scoreboard),
    "match_list": lambda t: dims.match_list(t.matches, t.events, t.match_players),
    "match_list_filter": lambda t: dims.match_list_filter(t.matches, t.match_players, t.players, FIRST_DAY, LAST_DAY, "R_2"),
    "to_review": lambda t: dims.to_review(t.events).select("event_id"),
    "board_wide": lambda t: dims.board_wide(t.scoreboard),
    "board_vs_feed": lambda t: dims.board_vs_feed(_per_match(t), t.scoreboard),
    "matches_newest_first": lambda t: dims.in_total_order(t.matches.select("match_id", "recorded_at"), [F.desc("recorded_at"), "match_id"], F.substring("recorded_at", 1, 10), down=True),
    "match_timeline": lambda t: dims.in_order(t.events, ["true_ms", "feed_ms", "event_id"], within=("match_id",)).select("match_id", "event_id", "place"),
    "scoreboard_order": lambda t: dims.in_order(t.scoreboard.join(t.players, "player_id"), [F.asc_nulls_first("round_no"), "ign", "stat_name"], within=("match_id",)).select("match_id", "round_no", "player_id", "stat_name", "place"),
    "rounds_order": lambda t: dims.in_order(t.rounds, ["round_no"], within=("match_id",)).select("match_id", "round_no", "place"),
    "roster_by_team": lambda t: dims.in_order(_per_match(t), ["team", F.desc("eliminations"), "ign"], within=("match_id",)).select("match_id", "player_id", "place"),
    "round_summary": lambda t: rounds.round_summary(t.rounds),
    "round_reconcile": lambda t: rounds.round_reconcile(t.events, t.rounds),
    "run_notes": lambda t: rounds.run_notes(t.events),
    "board_progress": lambda t: rounds.board_progress(t.match_players, t.scoreboard),
    "round_for_event": lambda t: rounds.round_for_event(t.events, t.rounds),
    "round_asof": lambda t: rounds.round_asof(t.events.select("match_id", "event_id", "feed_ms"), t.rounds).select("event_id", "found_round"),
    "role_order": _roles,
}


def _deaths(t: Tables) -> DataFrame:
    """Deaths on the counter, with the round of their time: match_id, death_id, t_ms, round_no, team (not known from the counter)."""
    found = readings.counter_deaths(bronze.counter_reads(t))
    return found.select("match_id", (F.col("t_ms") * 100 + F.col("death_no")).alias("death_id"), "t_ms", F.expr(f"t_ms div {bronze.ROUND_MS} + 1").alias("round_no"), F.lit(None).cast("string").alias("team"))


def _settled(t: Tables) -> DataFrame:
    """Rows, rounds, deaths and grey slots of each match in one pass."""
    return matching.settle(t.events, t.rounds, _deaths(t).drop("team"), _grey_slots(t).withColumn("team", F.when(F.col("slot_id") % 1000 < 8, "blue").otherwise("red")))


def _truth(t: Tables) -> DataFrame:
    return t.rounds.select("match_id", "start_ms", (F.col("start_ms") + 10_000).alias("end_ms"), (15 - F.col("blue_score") % 5).alias("value"))


ON_READS: dict[str, Callable[[Tables], DataFrame]] = {
    "counter_debounce": lambda t: readings.counter_changes(bronze.counter_reads(t)),
    "counter_deaths": lambda t: readings.counter_deaths(bronze.counter_reads(t)),
    "board_sessions": lambda t: readings.board_sessions(bronze.screen_reads(t)),
    "sighting_sessions": lambda t: readings.sighting_sessions(bronze.sightings(t), ("match_id", "line")),
    "majority_type": lambda t: readings.majority_type(bronze.sightings(t)),
    "majority_weapon": lambda t: readings.majority_weapon(bronze.sightings(t)),
    "resample": lambda t: readings.resample(bronze.counter_reads(t).withColumn("value", F.coalesce("value", F.lit(-1))), 1500),
    "sample_readings": lambda t: readings.sample_readings(bronze.sightings(t)),
    "skipped_spans": lambda t: readings.skipped_spans(bronze.screen_reads(t)),
    "reads_vs_truth": lambda t: readings.reads_vs_truth(bronze.counter_reads(t), _truth(t)),
    "late_row_round": lambda t: rounds.late_row_round(t.events, t.rounds, _deaths(t)),
    "dedupe_events": lambda t: rounds.dedupe_events(t.events),
    "align_elims": lambda t: matching.pairs(_settled(t)),
    "settle_elims": lambda t: matching.no_drop(_settled(t)),
    "unclaimed_deaths": lambda t: matching.no_feed_row(_settled(t)),
}


def _true_cells(t: Tables) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(stat).alias("stat_name"), F.col(c).alias("true_value")) for stat, c in (("eliminations", "finishes"), ("knock_outs", "knocks"))))
    return _per_match(t).select("match_id", "player_id", F.explode(cells).alias("x")).select("match_id", "player_id", "x.*")


def _segments(t: Tables) -> DataFrame:
    at = lambda df: df.select("match_id", F.col("feed_ms").alias("t_ms"))
    changes = readings.counter_changes(bronze.counter_reads(t))
    boards = readings.board_sessions(bronze.screen_reads(t))
    rises = t.rounds.select("match_id", F.col("end_ms").alias("t_ms"))
    return rounds.round_segments(at(t.events.filter("event_id % 3 = 1")), boards, changes.filter("is_reset"), changes.filter("deaths > 0"), at(t.events), rises)


def _rounds_found(t: Tables) -> DataFrame:
    resets = readings.counter_changes(bronze.counter_reads(t)).filter("is_reset").select("match_id", "t_ms")
    return rounds.with_unseen_rounds(t.rounds, rounds.unseen_rounds(readings.board_sessions(bronze.screen_reads(t)), resets, t.rounds))


def _grey_slots(t: Tables) -> DataFrame:
    return rows.slot_deaths(row_inputs.slot_reads(t)).select("match_id", (F.col("t_ms") * 1000 + F.col("slot") % 15).alias("slot_id"), "t_ms")


def _scalars(t: Tables) -> DataFrame:
    stamp = F.translate(names.recorded_at_from_name(F.concat(F.lit("run 2024-01-05_10-00-00 "), "ign")), ":", "-")
    seconds = (F.col("player_id") * 37 + 0.25).cast("double")
    return t.players.select("player_id", names.simple_norm("ign").alias("norm"), names.clean_reading(F.concat(F.lit("*"), "ign", F.lit("!"))).alias("clean"), names.mmss(seconds).alias("mmss"), stamp.alias("stamp"))


ON_ROWS: dict[str, Callable[[Tables], DataFrame]] = {
    "row_type": lambda t: row_inputs.icons(t).select("event_id", rows.row_type(F.col("icons")).alias("event_type")),
    "weapon_pick": lambda t: rows.weapon_pick(row_inputs.gun_scores(t)),
    "row_flag": lambda t: rows.row_flag(row_inputs.scored_rows(t)),
    "short_row_gate": lambda t: rows.short_row_gate(row_inputs.lines(t)).select("line", "first_ms", "last_ms"),
    "slot_debounce": lambda t: rows.slot_deaths(row_inputs.slot_reads(t)),
    "round_winner": lambda t: rows.round_winner(row_inputs.score_reads(t)),
    "room_size": lambda t: rows.room_size(readings.counter_changes(bronze.counter_reads(t)), t.rounds),
    "layout_gate": lambda t: rows.layout_gate(row_inputs.landmark_reads(t), row_inputs.landmark_limits(t.events.sparkSession)),
    "near_miss_seconds": lambda t: rows.near_miss_seconds(row_inputs.counter_misses(t), 2.0),
    "match_end": lambda t: rows.match_end(t.events, readings.board_sessions(bronze.screen_reads(t)), readings.counter_deaths(bronze.counter_reads(t))),
    "pair_vote": lambda t: rows.pair_vote(row_inputs.name_votes(t)),
    "stitch_board": lambda t: rows.stitch_board(row_inputs.board_cells(t)),
    "board_vs_truth": lambda t: rows.board_vs_truth(t.scoreboard.filter("round_no is null"), _true_cells(t)),
    "seen_together_dedupe": lambda t: rows.seen_together_dedupe(row_inputs.screen_rows(t)),
    "all_board_names": lambda t: t.match_players.select("match_id", "player_id").union(t.scoreboard.filter("round_no is null").select("match_id", "player_id")).distinct(),
    "board_without_alias": lambda t: t.scoreboard.filter("round_no is null").join(t.aliases, "player_id", "left_anti").groupBy("match_id", "player_id").agg(F.max("value").alias("best")),
    "board_players": lambda t: boards.board_players(boards.board_entries(row_inputs.board_reads(t))),
    "board_stats": lambda t: boards.board_stats(boards.board_entries(row_inputs.board_reads(t))),
    "off_roster": lambda t: boards.off_roster(boards.board_players(boards.board_entries(row_inputs.board_reads(t)))),
    "export_all_events": lambda t: export.range_sheets(t, FIRST_DAY, LAST_DAY)["all_events"].select("event_id", F.substring("recorded_at", 1, 10).alias("day")),
    "export_matches": lambda t: export.range_sheets(t, FIRST_DAY, LAST_DAY)["matches"].select("match_id", "recorded_at", "eliminations", "to_review", "players"),
    "export_player_per_match": lambda t: export.range_sheets(t, FIRST_DAY, LAST_DAY)["player_per_match"].select("match_id", "player_id", "eliminations", "knocks", "deaths"),
    "export_player_totals": lambda t: export.range_sheets(t, FIRST_DAY, LAST_DAY)["player_totals"],
    "export_match_events": lambda t: export.match_sheets(t)["events"],
    "export_match_players": lambda t: export.match_sheets(t)["players"],
    "export_match_scoreboard": lambda t: export.match_sheets(t)["scoreboard"],
    "export_match_highlights": lambda t: export.match_sheets(t)["highlights"],
    "export_match_head_to_head": lambda t: export.match_sheets(t)["head_to_head"],
    "delete_match_children": lambda t: dims.delete_matches(t.matches.filter("match_id % 5 = 0"), t.match_players)[0].select("match_id", "player_id"),
    "delete_match_boards": lambda t: dims.delete_matches(t.matches.filter("match_id % 5 = 0"), t.scoreboard)[0].select("match_id", "round_no", "player_id", "stat_name", "value"),
    "scalar_functions": _scalars,
    "badge_team": lambda t: rows.badge_team(row_inputs.board_rows(t), row_inputs.board_badges(t), 8),
    "resolve_pending": lambda t: rows.resolve_pending(row_inputs.pending_rows(t), row_inputs.read_again(t)),
    "round_sides": lambda t: rows.round_sides(row_inputs.side_reads(t), readings.counter_changes(bronze.counter_reads(t)), t.rounds),
    "player_lines_order": lambda t: dims.in_order(players.player_knock_lines(t.events, t.match_players).join(t.players.select("player_id", "ign"), "player_id"), ["team", F.desc("knocks"), F.lower("ign")], within=("match_id",)).select("match_id", "player_id", "place"),
    "round_segments": _segments,
    "missed_round": lambda t: rounds.missed_rounds(readings.board_sessions(bronze.screen_reads(t)), t.rounds),
    "missed_round_rounds": lambda t: _rounds_found(t).select("match_id", "round_no", "start_ms", "end_ms", "by_board", "blue_score", "red_score"),
    "missed_round_events": lambda t: rounds.moved_rows(t.events, "feed_ms", _rounds_found(t)).select("event_id", "match_id", "round_no"),
    "missed_round_deaths": lambda t: rounds.moved_rows(_deaths(t), "t_ms", _rounds_found(t)).select("match_id", "death_id", "t_ms", "round_no"),
    "death_team": lambda t: matching.death_teams(_settled(t)),
    "track_lines": lambda t: tracking.track_lines(row_inputs.feed_sightings(t)),
}


#: Names of a room's roster; readings belong to the room of their part.
ROOM = 40


def _name_reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Readings and rosters by room: part keys are dealt to rooms of ROOM parts, so a roster stays small at any size."""
    parts = bronze.part_names(spark, sf_dir)
    room = F.expr(f"p_partkey div {ROOM}")
    reads = bronze.name_reads(parts).withColumn("roster_id", F.expr(f"read_id div {ROOM}"))
    return reads, parts.select(F.col("p_name").alias("name"), room.alias("roster_id")).distinct()


def _roster_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.roster_match(*_name_reads(spark, sf_dir))


def _row_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, roster = _name_reads(spark, sf_dir)
    pair = F.concat(F.translate("raw", " ", ""), F.lit(" => "), F.translate(F.reverse("raw"), " ", ""))
    return matching.row_names(reads.select("roster_id", "read_id", pair.alias("raw")), roster.select("roster_id", F.translate("name", " ", "").alias("name")).distinct())


def _name_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, _ = _name_reads(spark, sf_dir)
    return matching.name_consensus(reads.select(F.expr("read_id div 5").alias("key"), "raw"))


def _roster_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.roster_collisions(_name_reads(spark, sf_dir)[0].select(F.col("raw").alias("name")))
    return found.select("folded", F.array_join("names", "|").alias("names"))


def _fold_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_reads(spark, sf_dir)[0].select("read_id", "raw", names.fold_name("raw").alias("folded"))


def _ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading against the name that it is a reading of."""
    known = bronze.part_names(spark, sf_dir).select(F.col("p_partkey").alias("read_id"), names.fold_name("p_name").alias("name_folded"))
    reads = _name_reads(spark, sf_dir)[0].select("read_id", names.fold_name("raw").alias("folded"))
    return reads.join(known, "read_id").withColumn("score", names.seq_ratio("folded", "name_folded"))


def _renamed(table: str, *columns: str) -> Callable[[Tables], DataFrame]:
    def query(t: Tables) -> DataFrame:
        tables = {"players": t.players, "aliases": t.aliases, "events": t.events, "scoreboard": t.scoreboard, "match_players": t.match_players}
        found = dims.rename_players(dim_inputs.name_changes(t), tables)[table]
        return found.select(*columns) if columns else found

    return query


def _broken(t: Tables) -> DataFrame:
    """Tables with faults, written, read back and checked."""
    spark = t.events.sparkSession
    at = new_folder(spark)
    silver.write_tables(dim_inputs.faulty(t), at)
    return silver.broken_rows(silver.read_tables(spark, at))


def _sizes(t: Tables) -> DataFrame:
    """Rows of the seven tables after writing and reading."""
    spark = t.events.sparkSession
    at = new_folder(spark)
    silver.write_tables(dim_inputs.faulty(t), at)
    counts = [rows.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, rows in silver.read_tables(spark, at).items()]
    return reduce(DataFrame.unionByName, counts)


def _without_old(t: Tables) -> dict[str, DataFrame]:
    return dims.drop_old_matches({"matches": t.matches, "events": t.events, "rounds": t.rounds, "scoreboard": t.scoreboard, "match_players": t.match_players, "players": t.players, "aliases": t.aliases})


def _last_seen(t: Tables) -> DataFrame:
    return t.events.groupBy("match_id").agg(F.max("feed_ms").alias("last_ms"))


ON_DIMS: dict[str, Callable[[Tables], DataFrame]] = {
    "admit_players_players": lambda t: dims.admit_players(dim_inputs.new_readings(t), t.players, t.aliases)[0],
    "admit_players_aliases": lambda t: dims.admit_players(dim_inputs.new_readings(t), t.players, t.aliases)[1],
    "admit_players_names": lambda t: dims.admit_players(dim_inputs.new_readings(t), t.players, t.aliases)[2],
    "rename_players_players": _renamed("players"),
    "rename_players_aliases": _renamed("aliases"),
    "rename_players_events": _renamed("events", "event_id", "killer_id", "victim_id"),
    "rename_players_boards": _renamed("scoreboard"),
    "rename_players_members": _renamed("match_players"),
    "rename_players_refused": _renamed("refused"),
    "drop_old_members": lambda t: _without_old(t)["match_players"].select("match_id", "player_id"),
    "drop_old_boards": lambda t: _without_old(t)["scoreboard"],
    "drop_old_rounds": lambda t: _without_old(t)["rounds"].select("match_id", "round_no"),
    "drop_old_players": lambda t: _without_old(t)["players"],
    "drop_old_aliases": lambda t: _without_old(t)["aliases"],
    "upsert_nicknames": lambda t: dims.upsert_nicknames(t.players, dim_inputs.nicknames(t)),
    "row_weapon": lambda t: row_inputs.feed_icons(t).select("event_id", rows.row_weapon(F.col("icons"), F.col("scores"), F.col("knock_weapon")).alias("weapon")),
    "skipped_summary": lambda t: readings.skipped_summary(readings.skipped_spans(bronze.screen_reads(t), 60_000), _last_seen(t)),
    "read_tables": _sizes,
    "read_tables_broken": _broken,
}


def _imported(table: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """A table of a history on disk after three imports: even matches; known recordings again (left alone) with new ones; some replaced by a new reading under a new id."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = load(spark, sf_dir)
        store = TableStore(spark, new_folder(spark))
        given = t.matches.select("match_id", "source_file", "recorded_at", F.when(F.col("match_id") % 3 != 0, F.col("status")).alias("status"))
        events = t.events.select("event_id", "match_id", "feed_ms", "event_type", "flag")

        def some(rule: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
            return {"matches": given.filter(rule), "events": change(events.filter(rule)), "match_players": t.match_players.filter(rule)}

        ingest.import_matches(store, 1, some("match_id % 2 = 0"))
        ingest.import_matches(store, 1, some("match_id % 2 = 1"))  # the batch is there already
        ingest.import_matches(store, 2, some("match_id % 4 = 0 or match_id % 5 = 0", lambda df: df.withColumn("flag", F.lit("AGAIN"))))
        again = some("match_id % 6 = 0", lambda df: df.filter("event_id % 2 = 0"))
        ingest.import_matches(store, 3, {n: df.withColumn("match_id", F.col("match_id") + 1_000_000) for n, df in again.items()}, replace=True)
        return ingest.history(store)[table].select(*columns)

    return query


def _on_folder(job: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: job(load(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _on_folder(job) for name, job in (ON_TABLES | ON_READS | ON_ROWS | ON_DIMS).items()} | {"roster_match": _roster_match, "roster_collisions": _roster_collisions, "row_names": _row_names, "name_consensus": _name_consensus, "fold_name": _fold_name, "ratio": _ratio}
ORACLE_SQL: dict[str, str] = {name: oracles.BASE + select for name, select in oracles.SELECTS.items()} | {name: oracles.BASE + oracles.BASE_DIMS + select for name, select in oracles.DIM_SELECTS.items()}
ORACLE_SQL |= {name: oracles.BASE + oracles.BASE_READS + select for name, select in (oracles.READ_SELECTS | oracles.ROW_SELECTS).items()}
ORACLE_SQL |= {name: oracles.BASE.replace("WITH", "WITH RECURSIVE", 1) + select for name, select in oracles.RECURSIVE_SELECTS.items()}
ORACLE_SQL |= {name: (oracles.BASE + oracles.BASE_READS).replace("WITH", "WITH RECURSIVE", 1) + select for name, select in oracles.GREEDY_SELECTS.items()}
ORACLE_SQL |= oracles.NAME_SELECTS
QUERIES |= {"ingest_history_matches": _imported("matches", "match_id", "source_file", "recorded_at", "status"), "ingest_history_events": _imported("events", "event_id", "match_id", "flag"), "ingest_history_players": _imported("match_players", "match_id", "player_id", "team")}
QUERIES |= streaming.QUERIES
ORACLE_SQL |= {name: oracles.BASE + select for name, select in streaming.SELECTS.items()} | {name: oracles.BASE + oracles.BASE_READS + select for name, select in streaming.READ_SELECTS.items()}
