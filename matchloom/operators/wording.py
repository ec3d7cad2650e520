"""The sentences that go with awards. Fixed formats: they are what a match sheet shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.weapons import CLASSES
from matchloom.operators import awards

CLASS_NOUNS = {"AR player": "an AR", "SMG player": "an SMG", "LMG player": "an LMG", "Sniper player": "a sniper rifle", "Shotgun specialist": "a shotgun"}
THROWN_NOUNS = {"Grenadier": "grenade knock", "Molotov specialist": "Molotov knock", "Driver": "car knock"}


def plural(n: str, word: str | Column) -> Column:
    word = F.lit(word) if isinstance(word, str) else word
    return F.concat(F.col(n).cast("string"), F.lit(" "), word, F.when(F.col(n) == 1, "").otherwise("s"))


def _lookup(texts: dict[str, str], key: str) -> Column:
    return F.create_map(*(F.lit(x) for pair in texts.items() for x in pair))[F.col(key)]


def rival_text(rivals: DataFrame, players: DataFrame) -> DataFrame:
    rows = rivals.join(players.select(F.col("player_id").alias("opponent_id"), F.col("ign").alias("o")), "opponent_id")
    text = F.concat(F.lit("Traded knocks with "), "o", F.lit(": knocked "), "o", F.lit(" "), plural("knocked", "time"), F.lit(", was knocked by "), "o", F.lit(" "), plural("knocked_by", "time"), F.lit("."))
    return rows.select("match_id", "player_id", F.lit("Rival").alias("role"), text.alias("detail"))


def dominating_text(leads: DataFrame, usable: DataFrame, players: DataFrame) -> DataFrame:
    downs = usable.groupBy("match_id", F.col("victim_id").alias("opponent_id")).agg(F.count("*").alias("downs"))
    rows = leads.join(downs, ["match_id", "opponent_id"]).join(players.select(F.col("player_id").alias("opponent_id"), F.col("ign").alias("o")), "opponent_id")
    back = F.when(F.col("back") > 0, F.concat(F.lit("; "), "o", F.lit(" knocked back "), F.col("back").cast("string"), F.lit("."))).otherwise("; never knocked back.")
    text = F.concat(F.lit("Knocked "), "o", F.lit(" "), plural("n", "time"), F.lit(" ("), F.col("share").cast("string"), F.lit("% of the "), F.col("downs").cast("string"), F.lit(" times "), "o", F.lit(" was knocked)"), back)
    return rows.select("match_id", "player_id", F.lit("Dominating").alias("role"), text.alias("detail"))


def throwable_text(leaders: DataFrame) -> DataFrame:
    tie = F.when(F.col("joint"), " (joint most)").otherwise(" (most in the match)")
    text = F.concat(plural("n", _lookup(THROWN_NOUNS, "role")), tie, F.when(F.col("role") == "Driver", ", credited to the driver").otherwise(""), F.lit("."))
    return leaders.select("match_id", "player_id", "role", text.alias("detail"))


def class_text(leaders: DataFrame, usable: DataFrame) -> DataFrame:
    """With the three guns of the class used most; ties by name."""
    role = F.create_map(*(F.lit(x) for c, r in awards.CLASS_ROLES.items() for g in CLASSES[c] for x in (g, r)))
    every = [g for guns in CLASSES.values() for g in guns]
    mine = usable.filter(F.col("weapon").isin(*every)).groupBy("match_id", F.col("killer_id").alias("player_id"), "weapon").agg(F.count("*").alias("c"))
    mine = mine.withColumns({"read": F.sum("c").over(Window.partitionBy("match_id", "player_id")), "role": F.try_element_at(role, F.col("weapon"))})
    top = mine.groupBy("match_id", "player_id", "role").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("k"), "weapon", "c"))), 1, 3).alias("guns"), F.first("read").alias("read"))
    guns = F.array_join(F.transform("guns", lambda x: F.concat(x["weapon"], F.lit(" x"), x["c"].cast("string"))), ", ")
    rows = leaders.join(top, ["match_id", "player_id", "role"])
    text = F.concat(F.col("n").cast("string"), F.lit(" knocks with "), _lookup(CLASS_NOUNS, "role"), F.lit(", "), F.col("share").cast("string"), F.lit("% of their "), F.col("read").cast("string"), F.lit(" with a gun read ("), guns, F.lit(")."))
    return rows.select("match_id", "player_id", "role", text.alias("detail"))


def clutch_text(best: DataFrame) -> DataFrame:
    size = F.when(F.col("own_alive").isNotNull(), F.concat(F.lit(" ("), F.col("own_alive").cast("string"), F.lit(" alive against "), F.col("enemies").cast("string"), F.lit(")"))).otherwise("")
    more = F.when(F.col("others") > 0, F.concat(F.lit(" Also in "), plural("others", "other round"), F.lit("."))).otherwise("")
    rows = best.withColumn("others", F.col("rounds") - 1)
    text = F.concat(F.lit("Round "), F.col("round_no").cast("string"), F.lit(": knocked all "), F.col("enemies").cast("string"), F.lit(" remaining enemies"), size, F.lit("."), more)
    return rows.select("match_id", "player_id", F.lit("Clutch").alias("role"), text.alias("detail"))


def role_details(events: DataFrame, usable: DataFrame, match_players: DataFrame, matches: DataFrame, players: DataFrame) -> DataFrame:
    """match_id, player_id, role, detail of every award."""
    parts = [
        rival_text(awards.rivals(usable, players), players),
        dominating_text(awards.dominating(usable, players), usable, players),
        throwable_text(awards.throwable_leaders(usable)),
        class_text(awards.weapon_class_leaders(usable, players), usable),
        clutch_text(awards.clutch(awards.clutch_moments(events, usable, match_players, matches), players)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def basis_text(basis: DataFrame) -> DataFrame:
    """What the awards of a match rest on, in a sentence."""
    n, m = F.col("knocks_used").cast("string"), F.col("knocks_seen").cast("string")
    whole = F.concat(F.lit("Based on "), n, F.lit(" of "), m, F.lit(" knocks read ("), m, F.lit(" = Knock Outs on the end-of-match board)."))
    over = F.concat(F.lit("Based on "), n, F.lit(" knock rows with both names read; the end-of-match board counts "), m, F.lit(" Knock Outs, so a few rows may be repeats or misreads."))
    part = F.concat(F.lit("Based on "), n, F.lit(" knock rows with both names read. The end-of-match board was only partly read (some players or Knock Outs cells missing), so its total of "), m, F.lit(" is a lower bound."))
    rows = F.concat(F.lit("Based on "), n, F.lit(" of "), m, F.lit(" knock rows seen (the end-of-match board was not read, so the true total is unknown)."))
    text = F.when(F.col("source") == "rows", rows).when(F.col("source") == "board_partial", part).when(F.col("knocks_used") > F.col("knocks_seen"), over).otherwise(whole)
    return basis.select("match_id", text.alias("basis"))
