"""Scoreboards read over scroll positions: which player a row belongs to, one line per player, names off the roster.

Which entry an unlisted spelling joins depends on the entries before it, so that one step is a small helper per board, run
on its distinct spellings only; a board holds one room. Votes on names, teams and cells are aggregations.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.names import folded, similarity
from matchloom.operators.matching import name_consensus
from matchloom.sources.scratch import written

SURE = 75  # hundredths, of a roster name's score and of the likeness of unlisted spellings
BOARD = ("match_id", "board")
ENTRY = (*BOARD, "entry")


def _listed() -> Column:
    return F.when(F.col("conf") >= SURE, F.col("name"))


def _spelling() -> Column:
    return F.struct(F.coalesce(_listed(), "raw", F.lit("")).alias("text"), _listed().isNotNull().alias("listed"))


def _assign(spellings: pd.DataFrame) -> pd.DataFrame:
    """Gives each spelling of one board its entry; entries are tried in the order in which they began."""
    forms: dict[str, str] = {}
    found = []
    for s in spellings.sort_values(["first", "listed", "text"]).itertuples():
        own = s.text if s.listed else folded(s.text)
        alike = None if s.listed else next((e for e, form in forms.items() if 100 * similarity(own, form) >= SURE), None)
        entry = alike or own
        if entry:
            forms.setdefault(entry, folded(entry))
        found.append((s.match_id, s.board, s.text, s.listed, entry or None))
    return pd.DataFrame(found, columns=["match_id", "board", "text", "listed", "entry"])


def board_entries(reads: DataFrame) -> DataFrame:
    """reads: match_id, board, at (order of reading), raw, name (of the roster; null if none), conf (hundredths), team, stats (array of stat_name, value).

    reads with ``entry``: the roster's name where it is sure, else the first entry whose folded form is like enough to the
    folded reading, else the folded reading. Entries of unlisted readings are folded a second time for this comparison, which
    seldom leaves them alike: these meet where the folded readings are equal. Readings without a letter or digit are left out. Null raw counts as empty.
    """
    told = reads.withColumn("spelling", _spelling())
    spellings = told.groupBy(*BOARD, "spelling").agg(F.min("at").alias("first")).select(*BOARD, "spelling.*", "first")
    entries = spellings.groupBy(*BOARD).applyInPandas(_assign, "match_id long, board long, text string, listed boolean, entry string")
    named = entries.filter("entry is not null").select(*BOARD, F.struct("text", "listed").alias("spelling"), "entry")
    return told.join(named, [*BOARD, "spelling"]).drop("spelling")


def _most(rows: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """The value found most often (nulls aside, the smaller of equals), and its share."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    best = counts.withColumns({"place": F.row_number().over(group.orderBy(F.desc("n"), value)), "reads": F.sum("n").over(group)}).filter("place = 1")
    return best.select(*by, value, F.round(F.col("n") / F.col("reads"), 2).alias("share"))


def board_stats(entries: DataFrame) -> DataFrame:
    """match_id, board, entry, stat_name, value, share: the value read most often per cell; cells never read are absent."""
    cells = entries.select(*ENTRY, F.explode("stats").alias("cell")).select(*ENTRY, "cell.*")
    return _most(cells, (*ENTRY, "stat_name"), "value")


def board_players(entries: DataFrame) -> DataFrame:
    """match_id, board, entry, ign, on_roster, name_agree, team, seen: one row per player of a board.

    An unlisted name is the consensus of its readings. What was seen once, is unlisted and has no readable number is not a player.
    """
    entries = written(entries)  # read for the players, their teams and their names
    seen = entries.groupBy(*ENTRY).agg(F.count("*").alias("seen"), F.max(_listed()).alias("listed"), F.max(F.exists("stats", lambda s: s["value"].isNotNull())).alias("read"))
    kept = seen.filter("listed is not null or seen > 1 or read")
    teams = _most(entries, ENTRY, "team").select(*ENTRY, "team")
    unlisted = entries.join(kept.filter("listed is null").select(*ENTRY), list(ENTRY), "left_semi")
    names = name_consensus(unlisted.select(F.struct(*ENTRY).alias("key"), "raw")).select("key.*", F.col("name").alias("settled"), "share")
    both = kept.join(names, list(ENTRY), "left").join(teams, list(ENTRY), "left")
    on = F.col("listed").isNotNull()
    return both.select(*ENTRY, F.coalesce("listed", "settled").alias("ign"), on.alias("on_roster"), F.when(on, 1.0).otherwise(F.col("share")).alias("name_agree"), "team", "seen")


def off_roster(board: DataFrame) -> DataFrame:
    """match_id, ign, best: names on the boards of a match that the roster has not, with their best agreement."""
    return board.filter("not on_roster").groupBy("match_id", "ign").agg(F.max("name_agree").alias("best"))
