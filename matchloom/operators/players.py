"""Player statistics: what followed each knock, who is credited, and the player tables.

Everything is keyed by match (then round, player); a match has at most a few hundred events, so no window
partition grows with the data. Rows without a player stay out of the windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.match_rules import FEED_LAG_MS, counted_elimination, is_knock, ones, round_key


def knock_outcomes(events: DataFrame) -> DataFrame:
    """Per knock: revived, eliminated or unresolved, and the feed time of the first later sign of life.

    A player is up again when knocked again, or when knocking or killing someone; finishing a knocked player
    proves nothing. Strictly later only: equal times don't follow each other. One shuffle.
    """
    keyed = events.withColumn("rnd", round_key())
    knock, elim = is_knock(), counted_elimination()
    seen = F.array(
        F.struct(F.col("victim_id").alias("player_id"), elim.alias("dies"), knock.alias("lives"), knock.alias("asks")),
        F.struct(F.col("killer_id").alias("player_id"), F.lit(False).alias("dies"), F.col("event_type").isin("knock", "kill").alias("lives"), F.lit(False).alias("asks")),
    )
    shown = keyed.select("event_id", "match_id", "round_no", "rnd", "killer_id", "feed_ms", F.explode(seen).alias("x")).select("*", "x.*").filter("player_id is not null and (dies or lives)")
    later = Window.partitionBy("match_id", "rnd", "player_id").orderBy("feed_ms").rangeBetween(1, Window.unboundedFollowing)
    ahead = shown.withColumns({"dies_ms": F.min(F.when(F.col("dies"), F.col("feed_ms"))).over(later), "lives_ms": F.min(F.when(F.col("lives"), F.col("feed_ms"))).over(later)})
    up = F.col("lives_ms").isNotNull() & (F.col("dies_ms").isNull() | (F.col("lives_ms") < F.col("dies_ms")))
    told = ahead.filter("asks").select(
        F.col("event_id").alias("knock_id"), "match_id", "round_no", F.col("player_id").alias("victim_id"), F.col("killer_id").alias("knocker_id"), "feed_ms",
        F.when(up, "revived").when(F.col("dies_ms").isNotNull(), "eliminated").otherwise("unresolved").alias("outcome"), F.when(up, F.col("lives_ms")).alias("revived_before_ms"),
    )
    unnamed = events.filter(knock & F.col("victim_id").isNull()).select(
        F.col("event_id").alias("knock_id"), "match_id", "round_no", "victim_id", F.col("killer_id").alias("knocker_id"), "feed_ms", F.lit("unresolved").alias("outcome"), F.lit(None).cast("long").alias("revived_before_ms")
    )
    return told.unionByName(unnamed)


def elim_credit(events: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Per counted elimination: finisher and credited player.

    Credit goes to the latest earlier knocker whose knock ended in elimination; where that knocker was not
    read, or there was none, to the finisher. As-of by a window, no join of events with events.
    """
    outcomes = knock_outcomes(events) if outcomes is None else outcomes
    claim = F.struct("feed_ms", F.col("knock_id").alias("id"), F.col("knocker_id").alias("knocker"))
    claims = outcomes.filter("outcome = 'eliminated' and victim_id is not null").select("match_id", "round_no", "victim_id", "feed_ms", claim.alias("claim"), F.lit(None).cast("struct<event_id:bigint,finisher_id:bigint>").alias("elim"))
    elims = events.filter(counted_elimination()).select("match_id", "round_no", "victim_id", "feed_ms", F.struct("event_id", F.col("killer_id").alias("finisher_id")).alias("elim"))
    both = claims.unionByName(elims.filter("victim_id is not null"), allowMissingColumns=True).withColumn("rnd", round_key())
    earlier = Window.partitionBy("match_id", "rnd", "victim_id").orderBy("feed_ms").rangeBetween(Window.unboundedPreceding, -1)
    named = both.withColumn("claim", F.max("claim").over(earlier)).filter("elim is not null")
    unnamed = elims.filter("victim_id is null").withColumn("claim", F.lit(None).cast(named.schema["claim"].dataType))
    done = named.drop("rnd").unionByName(unnamed)
    return done.select(F.col("elim.event_id").alias("event_id"), "match_id", "round_no", "victim_id", F.col("elim.finisher_id").alias("finisher_id"), F.coalesce("claim.knocker", "elim.finisher_id").alias("credited_id"))


def board_values(scoreboard: DataFrame) -> DataFrame:
    """Per match and player: end-of-match board values, or for eliminations and damage the sum over round boards."""
    whole = lambda stat: F.max(F.when((F.col("stat_name") == stat) & F.col("round_no").isNull(), F.col("value")))
    parts = lambda stat: F.sum(F.when((F.col("stat_name") == stat) & F.col("round_no").isNotNull(), F.col("value")))
    return scoreboard.groupBy("match_id", "player_id").agg(
        F.coalesce(whole("damage_dealt"), parts("damage_dealt")).alias("damage_dealt"),
        F.coalesce(whole("eliminations"), parts("eliminations")).alias("scoreboard_eliminations"),
        whole("knock_outs").alias("scoreboard_knock_outs"),
    )


def player_counts(events: DataFrame) -> DataFrame:
    """Per match and player: all counts from the feed, by one aggregation over (player, metric) rows."""
    outcomes = knock_outcomes(events)
    credit = elim_credit(events, outcomes)
    row = lambda player, metric: F.struct(F.col(player).alias("player_id"), metric.alias("metric"))
    feed = events.select("match_id", F.explode(F.array(row("killer_id", F.when(is_knock(), "knocks")), row("victim_id", F.when(is_knock(), "times_knocked").when(counted_elimination(), "deaths")))).alias("x"))
    given = credit.select("match_id", F.explode(F.array(row("credited_id", F.lit("eliminations")), row("finisher_id", F.lit("finishes")))).alias("x"))
    up = outcomes.filter("outcome = 'revived'").select("match_id", F.struct(F.col("victim_id").alias("player_id"), F.lit("revives_inferred").alias("metric")).alias("x"))
    rows = feed.union(given).union(up).select("match_id", "x.*").filter("player_id is not null and metric is not null")
    names = ("eliminations", "finishes", "knocks", "deaths", "times_knocked", "revives_inferred")
    return rows.groupBy("match_id", "player_id").agg(*(ones(F.col("metric") == n).alias(n) for n in names))


COUNTS = ("eliminations", "finishes", "knocks", "deaths", "times_knocked", "revives_inferred")


def player_match(events: DataFrame, match_players: DataFrame, players: DataFrame, matches: DataFrame, scoreboard: DataFrame) -> DataFrame:
    """One row per match and player of the match."""
    boards = scoreboard.filter("round_no is null").select("match_id").distinct().withColumn("has_match_board", F.lit(True))
    rows = match_players.select("match_id", "player_id", "team").join(player_counts(events), ["match_id", "player_id"], "left").join(board_values(scoreboard), ["match_id", "player_id"], "left")
    rows = rows.join(boards, "match_id", "left").join(matches.select("match_id", "recorded_at"), "match_id").join(players, "player_id")
    return rows.select(
        "match_id", "recorded_at", "player_id", "ign", "nickname", "team", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS),
        "damage_dealt", "scoreboard_eliminations", "scoreboard_knock_outs", F.coalesce("has_match_board", F.lit(False)).alias("has_match_board"),
    )


def player_career(per_match: DataFrame) -> DataFrame:
    """Totals of a player over all matches; aggregated after player_match, so a regular player is no hot key."""
    total = per_match.groupBy("player_id", "ign", "nickname").agg(
        F.countDistinct("match_id").alias("matches"), *(F.sum(c).alias(c) for c in COUNTS if c != "finishes"), F.sum("damage_dealt").alias("damage_dealt")
    )
    return total.withColumn("elim_death_ratio", F.round(F.col("eliminations") / F.greatest(F.col("deaths"), F.lit(1)), 2))


def range_player_totals(per_match: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """player_career over the matches of some days, both included."""
    day = F.substring("recorded_at", 1, 10)
    return player_career(per_match.filter((day >= first_day) & (day <= last_day)))


def player_check(per_match: DataFrame) -> DataFrame:
    """Where the board and the feed disagree, in words; OK, or empty without a board."""
    e, k = F.col("scoreboard_eliminations"), F.col("scoreboard_knock_outs")
    differs = lambda what, board, own: F.when(board.isNotNull() & (board.cast("long") != F.col(own)), F.format_string(what + " %d vs board %d", F.col(own), board.cast("long")))
    text = F.concat_ws("; ", differs("elims", e, "eliminations"), differs("knocks", k, "knocks"))
    return per_match.select("match_id", "player_id", F.when(e.isNull() & k.isNull(), "").when(text == "", "OK").otherwise(text).alias("check"))


def usable_knocks(events: DataFrame, match_players: DataFrame) -> DataFrame:
    """Knocks with both names, of another team's player, not by the zone; with both teams."""
    team = lambda who: match_players.select("match_id", F.col("player_id").alias(f"{who}_id"), F.col("team").alias(f"{who}_team"))
    named = events.drop("victim_team").filter(is_knock() & F.col("killer_id").isNotNull() & F.col("victim_id").isNotNull() & (F.col("killer_id") != F.col("victim_id")) & ~F.col("weapon").eqNullSafe("Zone"))
    both = named.join(team("killer"), ["match_id", "killer_id"], "left").join(team("victim"), ["match_id", "victim_id"], "left")
    return both.filter(~F.coalesce(F.col("killer_team") == F.col("victim_team"), F.lit(False)))


def knock_matrix(usable: DataFrame) -> DataFrame:
    """match_id, killer_id, victim_id, n."""
    return usable.groupBy("match_id", "killer_id", "victim_id").agg(F.count("*").alias("n"))


def pair_reverse(matrix: DataFrame) -> DataFrame:
    """The matrix with the number of knocks the other way."""
    other = matrix.select("match_id", F.col("victim_id").alias("killer_id"), F.col("killer_id").alias("victim_id"), F.col("n").alias("back"))
    return matrix.join(other, ["match_id", "killer_id", "victim_id"], "left").withColumn("back", F.coalesce("back", F.lit(0)))


def head_to_head(matrix: DataFrame, match_players: DataFrame) -> DataFrame:
    """match_id, player_id, opponent_id, opponent_team, knocked_them, knocked_by_them; one aggregation over both directions."""
    ways = F.array(
        F.struct(F.col("killer_id").alias("player_id"), F.col("victim_id").alias("opponent_id"), F.col("n").alias("them"), F.lit(0).alias("by_them")),
        F.struct(F.col("victim_id").alias("player_id"), F.col("killer_id").alias("opponent_id"), F.lit(0).alias("them"), F.col("n").alias("by_them")),
    )
    pairs = matrix.select("match_id", F.explode(ways).alias("x")).select("match_id", "x.*").groupBy("match_id", "player_id", "opponent_id").agg(F.sum("them").alias("knocked_them"), F.sum("by_them").alias("knocked_by_them"))
    teams = match_players.select("match_id", F.col("player_id").alias("opponent_id"), F.col("team").alias("opponent_team"))
    return pairs.join(teams, ["match_id", "opponent_id"], "left").select("match_id", "player_id", "opponent_id", "opponent_team", "knocked_them", "knocked_by_them")


def opponent_rankings(matrix: DataFrame, players: DataFrame) -> DataFrame:
    """Per match and knocker: opponents as text, most first, then by lower name."""
    named = matrix.join(players.select(F.col("player_id").alias("victim_id"), "ign"), "victim_id")
    ranked = named.groupBy("match_id", F.col("killer_id").alias("player_id")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.lower("ign").alias("l"), "ign", "n"))).alias("r"))
    return ranked.select("match_id", "player_id", F.array_join(F.transform("r", lambda x: F.concat_ws(" ", x["ign"], x["n"].cast("string"))), " · ").alias("ranking"))


def hidden_death_doubt(events: DataFrame, outcomes: DataFrame, match_players: DataFrame) -> DataFrame:
    """knock_id, doubt for unresolved knocks of a named victim: may a death without a row in the feed be the victim's?

    The latest such death per (match, round, team) decides, so this is an equi-join, no range join.
    """
    hidden = events.filter("flag = 'NO_FEED_ROW'").groupBy("match_id", round_key().alias("rnd")).agg(
        *(F.max(F.when(test, F.col("true_ms"))).alias(name) for name, test in (("any_ms", F.col("victim_team").isNull()), ("blue_ms", F.col("victim_team") == "blue"), ("red_ms", F.col("victim_team") == "red")))
    )
    true = events.select(F.col("event_id").alias("knock_id"), "true_ms")
    teams = match_players.select("match_id", F.col("player_id").alias("victim_id"), "team")
    open_ = outcomes.filter("outcome = 'unresolved' and victim_id is not null").withColumn("rnd", round_key()).join(true, "knock_id").join(teams, ["match_id", "victim_id"], "left").join(hidden, ["match_id", "rnd"], "left")
    last = F.greatest("any_ms", F.when(F.col("team") == "blue", F.col("blue_ms")).when(F.col("team") == "red", F.col("red_ms")))
    return open_.select("knock_id", F.coalesce(last >= F.col("true_ms") - FEED_LAG_MS, F.lit(False)).alias("doubt"))


def player_knock_lines(events: DataFrame, match_players: DataFrame) -> DataFrame:
    """Per match and player: knocks, times_knocked, revived, revived_confirmed, revived_unclear, finished."""
    outcomes = knock_outcomes(events)
    doubt = hidden_death_doubt(events, outcomes, match_players)
    ended = outcomes.filter("victim_id is not null").join(doubt, "knock_id", "left")
    unsure = F.coalesce("doubt", F.lit(False))
    o = F.col("outcome")
    got = ended.groupBy("match_id", F.col("victim_id").alias("player_id")).agg(
        F.count("*").alias("times_knocked"), ones((o == "revived") | ((o == "unresolved") & ~unsure)).alias("revived"), ones(o == "revived").alias("revived_confirmed"),
        ones((o == "unresolved") & unsure).alias("revived_unclear"), ones(o == "eliminated").alias("finished"),
    )
    made = usable_knocks(events, match_players).groupBy("match_id", F.col("killer_id").alias("player_id")).agg(F.count("*").alias("knocks"))
    rows = match_players.select("match_id", "player_id", "team").join(made, ["match_id", "player_id"], "left").join(got, ["match_id", "player_id"], "left")
    return rows.select("match_id", "player_id", "team", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("knocks", "times_knocked", "revived", "revived_confirmed", "revived_unclear", "finished")))
