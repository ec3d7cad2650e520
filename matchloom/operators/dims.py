"""Dimension jobs: names, aliases, corrections, boards and the life of a match in the history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.match_rules import counted_elimination, is_knock, ones
from matchloom.functions.names import simple_norm
from matchloom.sources.scratch import written


#: Tables whose rows belong to a match.
MATCH_TABLES = ("matches", "events", "rounds", "scoreboard", "match_players")


def known_names(players: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every spelling that is known."""
    return players.select(F.col("ign").alias("name")).union(aliases.select(F.col("alias").alias("name"))).distinct()


def players_list(players: DataFrame, aliases: DataFrame) -> DataFrame:
    """player_id, ign, nickname, aliases joined by a comma, in order."""
    joined = aliases.groupBy("player_id").agg(F.array_join(F.sort_array(F.collect_list("alias")), ", ").alias("aliases"))
    return players.join(joined, "player_id", "left").select("player_id", "ign", "nickname", F.coalesce("aliases", F.lit("")).alias("aliases"))


def resolve_player(names: DataFrame, players: DataFrame, aliases: DataFrame) -> DataFrame:
    """name -> player_id by exact name, else alias, else normalised name (lowest id); tier tells which, 'new' if none."""
    exact = players.groupBy(F.col("ign").alias("name")).agg(F.min("player_id").alias("by_name"))
    alias = aliases.groupBy(F.col("alias").alias("name")).agg(F.min("player_id").alias("by_alias"))
    norm = players.groupBy(simple_norm("ign").alias("norm")).agg(F.min("player_id").alias("by_norm"))
    found = names.select("name").distinct().withColumn("norm", simple_norm("name")).join(exact, "name", "left").join(alias, "name", "left").join(norm, "norm", "left")
    tier = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_norm").isNotNull(), "norm").otherwise("new")
    return found.select("name", F.coalesce("by_name", "by_alias", "by_norm").alias("player_id"), tier.alias("tier"))


def admit_players(names: DataFrame, players: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """players and aliases with what some names add, and name, player_id, tier for each name that is not blank.

    Names that nobody has become players; of several that are alike but for white space, case and 0 the smallest one does and the others become its
    aliases, as does every name that was found by likeness. New ids follow the highest one without gaps, in order of a hash of the name: ids inside
    one value of a 12-bit hash are counted in one task, and what the values before hold is added, so no task numbers all. A second run finds all names.
    """
    found = resolve_player(names.filter("name <> ''"), players, aliases)
    new = found.filter("tier = 'new'").select("name", simple_norm("name").alias("norm"))
    firsts = new.groupBy("norm").agg(F.min("name").alias("ign"))
    numbered = in_total_order(firsts, ["ign"], F.substring(F.md5("ign"), 1, 3))
    top = players.agg(F.coalesce(F.max("player_id"), F.lit(0))).scalar()
    admitted = numbered.select((top + F.col("place")).alias("player_id"), "ign", "norm")
    ids = new.join(admitted, "norm").select("name", F.col("player_id").alias("new_id"), (F.col("name") != F.col("ign")).alias("also"))
    placed = found.join(ids, "name", "left").select("name", F.coalesce("player_id", "new_id").alias("player_id"), "tier", ((F.col("tier") == "norm") | F.coalesce("also", F.lit(False))).alias("is_alias"))
    nickname = [F.lit(None).cast(t).alias(c) for c, t in players.dtypes if c not in ("player_id", "ign")]
    everyone = players.unionByName(admitted.select(F.col("player_id").cast(dict(players.dtypes)["player_id"]).alias("player_id"), "ign", *nickname))
    spellings = aliases.select("alias", "player_id").union(placed.filter("is_alias").select("name", "player_id"))
    return everyone, spellings, placed.select("name", "player_id", "tier")


def canonical_name(names: DataFrame, players: DataFrame, aliases: DataFrame) -> DataFrame:
    """name -> the player's own name where it is an alias, else itself."""
    known = aliases.join(players.select("player_id", "ign"), "player_id").select(F.col("alias").alias("name"), "ign")
    return names.select("name").distinct().join(known, "name", "left").select("name", F.coalesce("ign", "name").alias("canonical"))


def roster_expand(roster: DataFrame, players: DataFrame, aliases: DataFrame) -> DataFrame:
    """A roster's names, and the names and aliases of its players, but of no other."""
    ids = resolve_player(roster, players, aliases).filter("player_id is not null").select("player_id").distinct()
    mine = ids.join(players.select("player_id", F.col("ign").alias("name")), "player_id").select("name")
    also = ids.join(aliases.select("player_id", F.col("alias").alias("name")), "player_id").select("name")
    return roster.select("name").union(mine).union(also).distinct()


def rename_merge(renames: DataFrame, events: DataFrame, scoreboard: DataFrame, match_players: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """renames: old_id, new_id. Repoints events, boards and match rows; where both have a row, the new player's own stays."""
    ids = lambda c: renames.select(F.col("old_id").alias(c), F.col("new_id").alias(f"new_{c}"))
    moved = events
    for c in ("killer_id", "victim_id"):
        moved = moved.join(ids(c), c, "left").withColumn(c, F.coalesce(f"new_{c}", c)).drop(f"new_{c}")

    def merged(rows: DataFrame, *key: str) -> DataFrame:
        named = rows.join(ids("player_id"), "player_id", "left").withColumns({"own": F.col("new_player_id").isNull(), "was": F.col("player_id"), "player_id": F.coalesce("new_player_id", "player_id")})
        first = Window.partitionBy(*key, "player_id").orderBy(F.col("own").desc(), "was")
        return named.withColumn("place", F.row_number().over(first)).filter("place = 1").select(*rows.columns)

    return moved.select(*events.columns), merged(scoreboard, "match_id", "round_no", "stat_name"), merged(match_players, "match_id")


def _last_names(renames: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """renames: old, new, one row per old; held: old, names that somebody has. Where each old name that somebody has, or gets on the way, ends (old, new, steps), and the old names that run into a circle.

    Each round looks up where the new names lead by then, so a chain of n renames takes log n rounds; what still leads on after that goes round in circles.
    """
    reach = written(renames.select("old", "new", F.lit(1).cast("long").alias("steps")))
    met = held.select("old")
    for _ in range(reach.count().bit_length() + 1):
        met = written(met.union(reach.join(met, "old", "left_semi").select("new")).distinct())
        further = reach.select(F.col("old").alias("new"), F.col("new").alias("last"), F.col("steps").alias("more"))
        joined = reach.join(further, "new", "left")
        if joined.filter("last is not null").isEmpty():
            break
        reach = written(joined.select("old", F.coalesce("last", "new").alias("new"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    circles = reach.join(reach.select(F.col("old").alias("new")), "new", "left_semi").select("old")
    return reach.join(circles, "old", "left_anti").join(met, "old", "left_semi"), circles


def rename_players(renames: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """renames: old, new (names). tables: players, aliases, events, scoreboard, match_players; gives them after the renames, and ``refused``: old, new, reason.

    A chain of renames leads to its last name. If a player has that name, those renamed to it are merged into it, else the one fewest renames away
    (then of smallest id) takes the name and the others are merged into it. Rows move along; where both have a row, the one that was there stays. The
    old names become aliases, aliases of merged players move, and merged players go. Refused: circles, a second new name of one old name (the
    smallest one holds), and names that no player has nor gets by a rename.
    """
    asked = renames.filter("old is not null and new is not null").select("old", "new").distinct()
    one = asked.groupBy("old").agg(F.min("new").alias("new"))
    players = tables["players"]
    holders = players.select(F.col("ign").alias("old"), "player_id")
    ends, circles = _last_names(one, holders)
    moving = ends.join(holders, "old").select("player_id", "old", "new", "steps")
    # names on the way of a player's renames are nobody's by now, but become aliases as well
    owner = players.select(F.col("ign").alias("new"), F.col("player_id").alias("owner"))
    nearest = moving.groupBy("new").agg(F.min(F.struct("steps", "player_id")).alias("x")).select("new", F.col("x.player_id").alias("heir"))
    target = nearest.join(owner, "new", "left").select("new", F.coalesce("owner", "heir").alias("to_id"), F.col("owner").isNull().alias("plain"))
    goals = written(ends.join(target, "new").select("old", "new", "to_id", "plain"))
    ids = written(moving.join(target, "new").filter("player_id <> to_id").select(F.col("player_id").alias("old_id"), F.col("to_id").alias("new_id")))
    events, scoreboard, match_players = rename_merge(ids, tables["events"], tables["scoreboard"], tables["match_players"])
    named = goals.filter("plain").select(F.col("to_id").alias("player_id"), F.col("new").alias("name")).distinct()
    left = players.join(ids.select(F.col("old_id").alias("player_id")), "player_id", "left_anti").join(named, "player_id", "left").withColumn("ign", F.coalesce("name", "ign")).select(*players.columns)
    known = tables["aliases"]
    kept = known.join(ids.withColumnRenamed("old_id", "player_id"), "player_id", "left").select("alias", F.coalesce("new_id", "player_id").alias("player_id"))
    added = goals.select(F.col("old").alias("alias"), F.col("to_id").alias("player_id")).join(known.select("alias"), "alias", "left_anti")
    reasons = [
        asked.join(one, ["old", "new"], "left_anti").withColumn("reason", F.lit("renamed twice")),
        one.join(circles, "old", "left_semi").withColumn("reason", F.lit("circle")),
        one.join(circles, "old", "left_anti").join(ends.select("old"), "old", "left_anti").withColumn("reason", F.lit("unknown")),
    ]
    refused = reasons[0].unionByName(reasons[1]).unionByName(reasons[2])
    return {"players": left, "aliases": kept.union(added), "events": events, "scoreboard": scoreboard, "match_players": match_players, "refused": refused}


def prune_players(players: DataFrame, events: DataFrame, scoreboard: DataFrame, match_players: DataFrame, keep: DataFrame) -> DataFrame:
    """players that an event, a board or a match refers to, or whose ign is in keep."""
    used = events.select(F.explode(F.array("killer_id", "victim_id")).alias("player_id")).union(scoreboard.select("player_id")).union(match_players.select("player_id"))
    used = used.union(players.join(keep.select(F.col("name").alias("ign")), "ign", "left_semi").select("player_id")).distinct()
    return players.join(used, "player_id", "left_semi")


def prune_aliases(aliases: DataFrame, players: DataFrame) -> DataFrame:
    """Aliases of the players that are left."""
    return aliases.join(players.select("player_id"), "player_id", "left_semi").select(*aliases.columns)


def drop_old_matches(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """matches, events, rounds, scoreboard, match_players, players, aliases without what a 0.1 version made: its matches, all that hangs off them, and the names that nothing else refers to."""
    gone = old_pipeline(tables["matches"])
    left = dict(zip(MATCH_TABLES, delete_matches(gone, *(tables[n] for n in MATCH_TABLES)), strict=True))
    nobody = tables["players"].limit(0).select(F.col("ign").alias("name"))
    players = prune_players(tables["players"], left["events"], left["scoreboard"], left["match_players"], nobody)
    return left | {"players": players, "aliases": prune_aliases(tables["aliases"], players)}


def upsert_nicknames(players: DataFrame, told: DataFrame) -> DataFrame:
    """told: player_id, nickname, batch. A player's nickname is the first one told, where they have none."""
    first = told.filter("nickname <> ''").groupBy("player_id").agg(F.min_by("nickname", F.struct("batch", "nickname")).alias("told"))
    return players.join(first, "player_id", "left").withColumn("nickname", F.coalesce("nickname", "told")).select(*players.columns)


def delete_matches(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables without the rows of the matches in gone (match_id)."""
    return [t.join(gone.select("match_id").distinct(), "match_id", "left_anti") for t in tables]


def old_pipeline(matches: DataFrame) -> DataFrame:
    """Matches made by a 0.1 version."""
    return matches.filter(F.col("pipeline_version").startswith("0.1")).select("match_id")


def apply_corrections(events: DataFrame, corrections: DataFrame) -> DataFrame:
    """corrections: event_id, at, killer_id, victim_id, event_type, weapon (null: as it is). The latest of an event holds; it is then reviewed."""
    fields = ("killer_id", "victim_id", "event_type", "weapon")
    last = corrections.groupBy("event_id").agg(F.max_by(F.struct(*fields), "at").alias("fix"))
    rows = events.join(last, "event_id", "left")
    new = {c: F.coalesce(F.col(f"fix.{c}"), F.col(c)) for c in fields} | {"reviewed": F.when(F.col("fix").isNotNull(), 1).otherwise(F.col("reviewed"))}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in events.columns))


def backfill_victim_team(events: DataFrame, match_players: DataFrame) -> DataFrame:
    """Events with the team of their named victim where none was read."""
    teams = match_players.select("match_id", F.col("player_id").alias("victim_id"), F.col("team").alias("known"))
    return events.join(teams, ["match_id", "victim_id"], "left").withColumn("victim_team", F.coalesce("victim_team", "known")).select(*events.columns)


def ingest_matches(batch: DataFrame, history: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of batch that are new by (source_file, recorded_at), once each; needs_review where an event is flagged and no status was given."""
    key = ["source_file", "recorded_at"]
    fresh = batch.join(history.select(*key), key, "left_anti").withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("match_id"))).filter("place = 1").drop("place")
    flagged = events.groupBy("match_id").agg(F.max(F.col("flag").isNotNull()).alias("flagged"))
    status = F.coalesce("status", F.when(F.coalesce("flagged", F.lit(False)), "needs_review").otherwise("processed"))
    return fresh.join(flagged, "match_id", "left").withColumn("status", status).select(*batch.columns)


def replace_match(batch: DataFrame, history: DataFrame) -> DataFrame:
    """The history with the matches of batch in place of earlier ones of the same (source_file, recorded_at)."""
    return history.join(batch.select("source_file", "recorded_at").distinct(), ["source_file", "recorded_at"], "left_anti").select(*history.columns).unionByName(batch.select(*history.columns))


def upsert_stats(rows: DataFrame) -> DataFrame:
    """rows: match_id, round_no, player_id, stat_name, value, batch. The latest batch of a cell holds; a later end-of-match board replaces the earlier one whole."""
    last = F.max(F.when(F.col("round_no").isNull(), F.col("batch"))).over(Window.partitionBy("match_id"))
    cell = Window.partitionBy("match_id", "round_no", "player_id", "stat_name").orderBy(F.col("batch").desc())
    now = rows.withColumn("last", last).filter("round_no is not null or batch = last")
    return now.withColumn("place", F.row_number().over(cell)).filter("place = 1").select("match_id", "round_no", "player_id", "stat_name", "value")


def upsert_match_players(rows: DataFrame) -> DataFrame:
    """rows: match_id, player_id, team, slot, batch. The last team holds, and the last slot that was given."""
    return rows.groupBy("match_id", "player_id").agg(F.max_by("team", "batch").alias("team"), F.max_by("slot", F.when(F.col("slot").isNotNull(), F.col("batch"))).alias("slot"))


def recover_interrupted(matches: DataFrame) -> DataFrame:
    """Matches that are still live when nothing runs were interrupted."""
    return matches.withColumn("status", F.when(F.col("status") == "live", "interrupted").otherwise(F.col("status")))


def v_events(events: DataFrame, matches: DataFrame, players: DataFrame) -> DataFrame:
    """Events with names and the delay of the feed in seconds."""
    name = lambda who: players.select(F.col("player_id").alias(f"{who}_id"), F.col("ign").alias(who))
    rows = events.join(matches.select("match_id", "recorded_at"), "match_id").join(name("killer"), "killer_id", "left").join(name("victim"), "victim_id", "left")
    delay = F.round((F.col("feed_ms") - F.col("true_ms")) / 1000, 2).alias("feed_delay_s")
    return rows.select("event_id", "match_id", "recorded_at", "round_no", "true_ms", "feed_ms", delay, "event_type", "killer", "victim", "weapon", "victim_team", "confidence", "flag", "reviewed")


def match_counts(events: DataFrame, rounds: DataFrame, scoreboard: DataFrame) -> DataFrame:
    """Nine headline counts of a match."""
    e = events.groupBy("match_id").agg(
        ones(counted_elimination()).alias("eliminations"),
        ones(counted_elimination() & F.col("killer_id").isNotNull() & F.col("victim_id").isNotNull() & F.col("flag").isNull()).alias("named"),
        ones(F.col("flag") == "NO_FEED_ROW").alias("no_feed_row"), ones(F.col("flag") == "NO_DROP").alias("no_drop"), ones(is_knock()).alias("knocks"),
        ones(F.col("flag").isNotNull() & (F.col("reviewed") == 0)).alias("to_review"),
    )
    r = rounds.groupBy("match_id").agg(F.count("*").alias("rounds"))
    b = scoreboard.filter("round_no is null").groupBy("match_id").agg(F.countDistinct("player_id").alias("board_players"), ones(F.col("value").isNull()).alias("blank_cells"))
    rows = e.join(r, "match_id", "left").join(b, "match_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rounds", "board_players", "blank_cells")})


def match_list(matches: DataFrame, events: DataFrame, match_players: DataFrame) -> DataFrame:
    """Matches with counted eliminations, rows to review, players."""
    e = events.groupBy("match_id").agg(ones(counted_elimination()).alias("eliminations"), ones(F.col("flag").isNotNull() & (F.col("reviewed") == 0)).alias("to_review"))
    p = match_players.groupBy("match_id").agg(F.count("*").alias("players"))
    rows = matches.select("match_id", "recorded_at", "source_file", "status").join(e, "match_id", "left").join(p, "match_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("eliminations", "to_review", "players")})


def match_list_filter(matches: DataFrame, match_players: DataFrame, players: DataFrame, first_day: str, last_day: str, who: str) -> DataFrame:
    """Matches of some days (both included) with a player whose name or nickname contains ``who``, in any case."""
    pattern = "%" + who.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    named = players.filter(F.col("ign").ilike(pattern) | F.coalesce(F.col("nickname").ilike(pattern), F.lit(False))).select("player_id")
    day = F.substring("recorded_at", 1, 10)
    return matches.filter((day >= first_day) & (day <= last_day)).join(match_players.join(named, "player_id", "left_semi"), "match_id", "left_semi").select("match_id", "recorded_at")


def to_review(events: DataFrame) -> DataFrame:
    """Flagged events nobody has looked at."""
    return events.filter(F.col("flag").isNotNull() & (F.col("reviewed") == 0))


def board_wide(scoreboard: DataFrame, stats: tuple[str, ...] = ("eliminations", "assists", "damage_dealt", "damage_taken", "knock_outs")) -> DataFrame:
    """End-of-match boards with a column per statistic."""
    return scoreboard.filter("round_no is null").groupBy("match_id", "player_id").pivot("stat_name", list(stats)).agg(F.max("value"))


def board_vs_feed(per_match: DataFrame, scoreboard: DataFrame) -> DataFrame:
    """Board rows against the counts of the feed, with a check in words, for everyone on either."""
    board = board_wide(scoreboard, ("eliminations", "knock_outs")).select("match_id", "player_id", F.col("eliminations").alias("be"), F.col("knock_outs").alias("bk"), F.lit(True).alias("on_board"))
    own = per_match.select("match_id", "player_id", "eliminations", "knocks", "has_match_board", F.lit(True).alias("in_match"))
    rows = own.join(board, ["match_id", "player_id"], "full_outer")
    differs = lambda what, b, n: F.when(F.col(b).isNotNull() & (F.col(b).cast("long") != F.col(n)), F.format_string(f"{what} %d vs board %d", F.col(n), F.col(b).cast("long")))
    diffs = F.concat_ws("; ", differs("elims", "be", "eliminations"), differs("knocks", "bk", "knocks"))
    unread = F.concat_ws(" and ", F.when(F.col("be").isNull(), "Eliminations"), F.when(F.col("bk").isNull(), "Knock outs"))
    judged = F.when(unread == "", F.when(diffs == "", "OK").otherwise(diffs)).otherwise(F.when(diffs == "", F.concat(unread, F.lit(" unreadable on the board"))).otherwise(F.concat(diffs, F.lit(" ("), unread, F.lit(" unreadable)"))))
    check = F.when(F.col("in_match").isNull(), "on the board, but not in this match's player list").when(~F.col("has_match_board"), "").when(F.col("on_board").isNull(), "not on the board").otherwise(judged)
    return rows.select("match_id", "player_id", "be", "bk", "eliminations", "knocks", check.alias("check"))


def in_order(rows: DataFrame, by: list, place: str = "place", within: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their place in an order inside a key; the place survives where row order does not."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*within).orderBy(*by)).cast("long"))


def in_total_order(rows: DataFrame, by: list, coarse: Column, down: bool = False, place: str = "place") -> DataFrame:
    """Rows with their place in one order of all. coarse rises (or falls, ``down``) along that order: rows are ranked inside
    one value of it, and what all values before hold is added, so only one count per value meets in a task."""
    value, ahead = _free(rows, "coarse"), _free(rows, "before")
    ranged = rows.withColumn(value, coarse)
    order = F.col(value).desc() if down else F.col(value).asc()
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(value).agg(F.count("*").alias("n")).select(value, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(ahead))
    ranked = in_order(ranged, by, place, (value,)).join(starts, value)
    return ranked.withColumn(place, F.col(place) + F.col(ahead)).drop(value, ahead)


def _free(rows: DataFrame, stem: str) -> str:
    """A column name that rows have not."""
    name = f"_{stem}"
    while name in rows.columns:
        name += "_"
    return name
