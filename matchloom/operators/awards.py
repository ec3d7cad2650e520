"""Match awards from usable knocks: ranked inside a match, so every window is small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.match_rules import FEED_LAG_MS, counted_elimination, is_knock
from matchloom.functions.weapons import CLASSES
from matchloom.operators.players import pair_reverse

#: How many pairs are named, and the fewest knocks that earn a role.
TOP_PAIRS = 3
THROWN = {"Grenade": ("Grenadier", 2), "Molotov": ("Molotov specialist", 2), "Car": ("Driver", 1)}
CLASS_ROLES = {"AR": "AR player", "SMG": "SMG player", "LMG": "LMG player", "Sniper": "Sniper player", "Shotgun": "Shotgun specialist"}
CLASS_LEAST = 3
CLUTCH_LEAST = 2
ROLES = ("Dominating", "Rival", "Grenadier", "Molotov specialist", "Driver", "Shotgun specialist", "AR player", "SMG player", "LMG player", "Sniper player", "Clutch")


def _named(rows: DataFrame, players: DataFrame, *ids: str) -> DataFrame:
    """rows with the name of each of these players as <column>_name; ties are ordered by it ('' if unknown)."""
    for c in ids:
        names = players.select(F.col("player_id").alias(c), F.col("ign").alias(f"{c}_name"))
        rows = rows.join(names, c, "left").withColumn(f"{c}_name", F.coalesce(f"{c}_name", F.lit("")))
    return rows


def _first_times(usable: DataFrame) -> DataFrame:
    return usable.groupBy("match_id", "killer_id", "victim_id").agg(F.count("*").alias("n"), F.min(F.struct("true_ms", "feed_ms", "event_id")).alias("first"))


def rival_pairs(usable: DataFrame, players: DataFrame) -> DataFrame:
    """Per match the three pairs that traded knocks most evenly: x knocked y a times, y knocked x b times; x knocked first. Ties go by name."""
    pairs = _first_times(usable)
    other = pairs.select("match_id", F.col("victim_id").alias("killer_id"), F.col("killer_id").alias("victim_id"), F.col("n").alias("b"), F.col("first").alias("answer"))
    traded = _named(pairs.join(other, ["match_id", "killer_id", "victim_id"]).filter("first < answer"), players, "killer_id", "victim_id")
    order = Window.partitionBy("match_id").orderBy(F.least("n", "b").desc(), (F.col("n") + F.col("b")).desc(), "killer_id_name", "victim_id_name", "killer_id", "victim_id")
    return traded.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TOP_PAIRS).select("match_id", F.col("killer_id").alias("x"), F.col("victim_id").alias("y"), F.col("n").alias("a"), "b", "place")


def rivals(usable: DataFrame, players: DataFrame) -> DataFrame:
    """Both sides of each rival pair: match_id, player_id, opponent_id, knocked, knocked_by."""
    sides = F.array(
        F.struct(F.col("x").alias("player_id"), F.col("y").alias("opponent_id"), F.col("a").alias("knocked"), F.col("b").alias("knocked_by")),
        F.struct(F.col("y").alias("player_id"), F.col("x").alias("opponent_id"), F.col("b").alias("knocked"), F.col("a").alias("knocked_by")),
    )
    return rival_pairs(usable, players).select("match_id", F.explode(sides).alias("s")).select("match_id", "s.*")


def dominating(usable: DataFrame, players: DataFrame) -> DataFrame:
    """Per match the three greatest leads, rival pairs left out: match_id, player_id, opponent_id, n, back, share (percent of the victim's knockdowns)."""
    matrix = pair_reverse(usable.groupBy("match_id", "killer_id", "victim_id").agg(F.count("*").alias("n")))
    # every direction of a matched pair, and all knocks on the victim, from the same grouping key
    downs = Window.partitionBy("match_id", "victim_id")
    counted = matrix.withColumn("downs", F.sum("n").over(downs))
    apart = rivals(usable, players).select("match_id", F.col("player_id").alias("killer_id"), F.col("opponent_id").alias("victim_id"))
    leads = _named(counted.filter("n > back").join(apart, ["match_id", "killer_id", "victim_id"], "left_anti"), players, "killer_id", "victim_id")
    order = Window.partitionBy("match_id").orderBy((F.col("n") - F.col("back")).desc(), F.col("n").desc(), "killer_id_name", "victim_id_name", "killer_id", "victim_id")
    share = F.bround(100 * F.col("n") / F.col("downs"), 0).cast("long")
    return leads.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TOP_PAIRS).select(
        "match_id", F.col("killer_id").alias("player_id"), F.col("victim_id").alias("opponent_id"), "n", "back", share.alias("share")
    )


def throwable_leaders(usable: DataFrame) -> DataFrame:
    """Everyone tied at the most knocks with a grenade, a molotov, a car: match_id, player_id, role, n, joint."""
    counts = usable.filter(F.col("weapon").isin(*THROWN)).groupBy("match_id", "weapon", F.col("killer_id").alias("player_id")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("match_id", "weapon")
    top = counts.withColumn("place", F.rank().over(of.orderBy(F.col("n").desc()))).filter("place = 1").withColumn("joint", F.count("*").over(of) > 1)
    spec = F.create_map(*(F.lit(x) for w, (role, _) in THROWN.items() for x in (w, role)))
    least = F.create_map(*(F.lit(x) for w, (_, n) in THROWN.items() for x in (w, n)))
    return top.filter(F.col("n") >= least[F.col("weapon")]).select("match_id", "player_id", spec[F.col("weapon")].alias("role"), "n", "joint")


def _classed(usable: DataFrame) -> DataFrame:
    classes = F.create_map(*(F.lit(x) for c, guns in CLASSES.items() for g in guns for x in (g, c)))
    return usable.withColumn("class", F.try_element_at(classes, F.coalesce("weapon", F.lit("")))).filter("class is not null")


def weapon_class_counts(usable: DataFrame) -> DataFrame:
    """match_id, player_id, class, n, read (knocks of the player with a gun read)."""
    n = _classed(usable).groupBy("match_id", F.col("killer_id").alias("player_id"), "class").agg(F.count("*").alias("n"))
    return n.withColumn("read", F.sum("n").over(Window.partitionBy("match_id", "player_id")))


def weapon_class_leaders(usable: DataFrame, players: DataFrame) -> DataFrame:
    """Per match and class one player with the most knocks, then the greater share, then the name: match_id, player_id, role, n, share."""
    counts = _named(weapon_class_counts(usable).filter(F.col("class").isin(*CLASS_ROLES) & (F.col("n") >= CLASS_LEAST)), players, "player_id")
    order = Window.partitionBy("match_id", "class").orderBy(F.col("n").desc(), (F.col("n") / F.col("read")).desc(), "player_id_name", "player_id")
    roles = F.create_map(*(F.lit(x) for pair in CLASS_ROLES.items() for x in pair))
    share = F.bround(100 * F.col("n") / F.col("read"), 0).cast("long")
    return counts.withColumn("place", F.row_number().over(order)).filter("place = 1").select("match_id", "player_id", roles[F.col("class")].alias("role"), "n", share.alias("share"))


def clutch_moments(events: DataFrame, usable: DataFrame, match_players: DataFrame, matches: DataFrame) -> DataFrame:
    """Per match, round and player the greatest clutch: enemies knocked, own side alive (null where a death has no team).

    Deaths and knocks of a round are one time line; running counts of deaths with a lag of 3.5 s and without
    are range windows on integer milliseconds, the knocks still to come a window of the player's.
    """
    teams = match_players.select("match_id", F.col("player_id").alias("victim_id"), F.col("team").alias("known_team"))
    deaths = events.filter(counted_elimination() & F.col("round_no").isNotNull()).join(teams, ["match_id", "victim_id"], "left")
    died = F.coalesce("known_team", "victim_team")
    line = deaths.select("match_id", "round_no", "true_ms", *((died == t).cast("int").alias(f"d_{t}") for t in ("blue", "red")), died.isNull().cast("int").alias("d_none"), F.lit(None).cast("long").alias("event_id"))
    zero = F.lit(0)
    knocks = usable.filter("round_no is not null and killer_team is not null")
    asked = knocks.select("match_id", "round_no", "true_ms", zero.alias("d_blue"), zero.alias("d_red"), zero.alias("d_none"), "event_id")
    of_round = Window.partitionBy("match_id", "round_no").orderBy("true_ms")
    count = lambda c, upto: F.coalesce(F.sum(c).over(of_round.rangeBetween(Window.unboundedPreceding, -upto)), F.lit(0))
    cols = {f"{c}_{tag}": count(c, lag) for c in ("d_blue", "d_red", "d_none") for tag, lag in (("old", FEED_LAG_MS), ("now", 0))}
    known = line.unionByName(asked).withColumns(cols).filter("event_id is not null").select("event_id", *cols)
    own = Window.partitionBy("match_id", "round_no", "killer_id").orderBy("true_ms", "feed_ms", "event_id").rowsBetween(0, Window.unboundedFollowing)
    ahead = knocks.withColumn("victims", F.size(F.collect_set(F.when(~F.col("victim_team").eqNullSafe(F.col("killer_team")), F.col("victim_id"))).over(own)))
    joined = ahead.select("event_id", "match_id", "round_no", "killer_id", "killer_team", "true_ms", "feed_ms", "victims").join(known, "event_id").join(matches.select("match_id", F.coalesce("team_size", F.lit(6)).alias("size")), "match_id")
    mine = lambda tag: F.when(F.col("killer_team") == "blue", F.col(f"d_blue_{tag}")).otherwise(F.col(f"d_red_{tag}"))
    theirs = lambda tag: F.when(F.col("killer_team") == "blue", F.col(f"d_red_{tag}")).otherwise(F.col(f"d_blue_{tag}"))
    sides = joined.withColumns({"own_max": F.col("size") - mine("old"), "enemy_min": F.col("size") - theirs("now") - F.col("d_none_now"), "enemy_max": F.col("size") - theirs("old")})
    held = sides.filter((F.col("enemy_max") >= CLUTCH_LEAST) & (F.col("own_max") <= F.col("enemy_min")) & (F.col("victims") >= F.col("enemy_max")))
    first = Window.partitionBy("match_id", "round_no", "killer_id").orderBy(F.col("enemy_max").desc(), "true_ms", "feed_ms", "event_id")
    best = held.withColumn("place", F.row_number().over(first)).filter("place = 1")
    return best.select("match_id", "round_no", F.col("killer_id").alias("player_id"), F.col("enemy_max").alias("enemies"), F.when(F.col("d_none_now") == 0, F.col("own_max")).alias("own_alive"), "size")


def clutch(moments: DataFrame, players: DataFrame) -> DataFrame:
    """One clutch per match: most enemies, then fewest of the own side, then the name; with the number of the player's clutch rounds."""
    # no one of the own side alive counts like an unknown number: as the whole side
    own = F.when(F.coalesce("own_alive", F.lit(0)) == 0, F.col("size")).otherwise(F.col("own_alive"))
    per_player = Window.partitionBy("match_id", "player_id")
    each = moments.withColumns({"own": own, "rounds": F.count("*").over(per_player)})
    each = each.withColumn("p", F.row_number().over(per_player.orderBy(F.col("enemies").desc(), "own", "round_no"))).filter("p = 1")
    order = Window.partitionBy("match_id").orderBy(F.col("enemies").desc(), "own", "player_id_name", "player_id")
    best = _named(each, players, "player_id").withColumn("q", F.row_number().over(order)).filter("q = 1")
    return best.select("match_id", "player_id", "round_no", "enemies", "own_alive", "rounds")


def knock_basis(events: DataFrame, usable: DataFrame, match_players: DataFrame, scoreboard: DataFrame) -> DataFrame:
    """Per match: knocks used, knocks seen, and where the latter number is from (board, board_partial, rows)."""
    used = usable.groupBy("match_id").agg(F.count("*").alias("used"))
    rows = events.groupBy("match_id").agg(F.coalesce(F.sum(F.when(is_knock(), 1)), F.lit(0)).alias("rows"))
    board = scoreboard.filter("round_no is null and stat_name = 'knock_outs' and value is not null").groupBy("match_id", "player_id").agg(F.max("value").alias("value"))
    total = board.groupBy("match_id").agg(F.sum("value").cast("long").alias("board"))
    missing = match_players.join(board, ["match_id", "player_id"], "left_anti").groupBy("match_id").agg(F.count("*").alias("missing"))
    joined = rows.join(used, "match_id", "left").join(total, "match_id", "left").join(missing, "match_id", "left")
    source = F.when(F.col("board").isNull(), "rows").when(F.coalesce("missing", F.lit(0)) > 0, "board_partial").otherwise("board")
    return joined.select("match_id", F.coalesce("used", F.lit(0)).alias("knocks_used"), F.coalesce("board", "rows").alias("knocks_seen"), source.alias("source"))


def all_roles(events: DataFrame, usable: DataFrame, match_players: DataFrame, matches: DataFrame, players: DataFrame) -> DataFrame:
    """match_id, player_id, role of every award."""
    parts = [
        rivals(usable, players).select("match_id", "player_id", F.lit("Rival").alias("role")),
        dominating(usable, players).select("match_id", "player_id", F.lit("Dominating").alias("role")),
        throwable_leaders(usable).select("match_id", "player_id", "role"),
        weapon_class_leaders(usable, players).select("match_id", "player_id", "role"),
        clutch(clutch_moments(events, usable, match_players, matches), players).select("match_id", "player_id", F.lit("Clutch").alias("role")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def role_order(roles: DataFrame, match_players: DataFrame, players: DataFrame) -> DataFrame:
    """All roles in their order, then the players without one ('-'): match_id, place, player_id, role, n."""
    place = F.create_map(*(F.lit(x) for i, r in enumerate(ROLES) for x in (r, i)))
    counted = roles.groupBy("match_id", "player_id", "role").agg(F.count("*").alias("n"))
    none = match_players.select("match_id", "player_id").join(roles, ["match_id", "player_id"], "left_anti").select("match_id", "player_id", F.lit("-").alias("role"), F.lit(0).cast("long").alias("n"))
    everyone = counted.unionByName(none).join(match_players.select("match_id", "player_id", "team"), ["match_id", "player_id"], "left").join(players.select("player_id", "ign"), "player_id")
    order = Window.partitionBy("match_id").orderBy(F.col("role") == "-", F.coalesce("team", F.lit("")), F.lower("ign"), F.coalesce(F.try_element_at(place, F.col("role")), F.lit(99)))
    return everyone.withColumn("place", F.row_number().over(order).cast("long")).select("match_id", "place", "player_id", "role", "n")
