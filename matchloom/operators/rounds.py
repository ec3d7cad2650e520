"""Placing rows in rounds, and rounds against counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.match_rules import ELIMINATIONS, counted_elimination

LATE_ROW_MS, LATE_ELIM_MS, COUNTER_AFTER_MS, AFTER_END_MS, DEDUPE_MS = 8000, 15_000, 1000, 6000, 5000


def round_for_event(events: DataFrame, rounds: DataFrame, slack_ms: int = AFTER_END_MS) -> DataFrame:
    """event_id, found_round: the first round whose span, and 6 s more, holds the event.

    A match has few rounds: they go to its events as one array, so no event is multiplied by them.
    """
    spans = rounds.groupBy("match_id").agg(F.collect_list(F.struct(F.col("round_no").alias("r"), "start_ms", "end_ms")).alias("spans"))
    inside = lambda x: (F.col("feed_ms") >= x["start_ms"]) & (F.col("feed_ms") <= x["end_ms"] + slack_ms)
    found = F.array_min(F.transform(F.filter("spans", inside), lambda x: x["r"]))
    return events.select("event_id", "match_id", "feed_ms").join(spans, "match_id", "left").select("event_id", found.alias("found_round"))


def round_asof(rows: DataFrame, rounds: DataFrame) -> DataFrame:
    """rows (match_id, event_id, feed_ms, ...) with found_round and round_start_ms: the latest round started by then; before the first start, round 1.

    Starts and rows are one time line per match, starts first among equals; no range join.
    """
    mark = F.struct(F.col("round_no").alias("r"), F.col("start_ms").alias("s"))
    starts = rounds.select("match_id", F.col("start_ms").alias("feed_ms"), mark.alias("mark"), F.lit(0).alias("is_row"))
    both = starts.unionByName(rows.withColumn("is_row", F.lit(1)), allowMissingColumns=True)
    line = Window.partitionBy("match_id").orderBy("feed_ms", "is_row").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("mark", F.max("mark").over(line)).filter("is_row = 1")
    return seen.withColumns({"found_round": F.coalesce("mark.r", F.lit(1)), "round_start_ms": F.col("mark.s")}).drop("mark", "is_row")


def late_row_round(events: DataFrame, rounds: DataFrame, deaths: DataFrame) -> DataFrame:
    """event_id, found_round, late: a row soon after a round's start is the last round's.

    Any row within 8 s; an elimination within 15 s while its round has had no death up to a second later. Never in round 1.
    deaths: match_id, round_no, t_ms.
    """
    placed = round_asof(events.select("match_id", "event_id", "feed_ms", "event_type"), rounds)
    first = deaths.groupBy("match_id", F.col("round_no").alias("found_round")).agg(F.min("t_ms").alias("first_death"))
    since = F.col("feed_ms") - F.col("round_start_ms")
    early = (since <= LATE_ELIM_MS) & F.col("event_type").isin(*ELIMINATIONS) & ~F.coalesce(F.col("first_death") <= F.col("feed_ms") + COUNTER_AFTER_MS, F.lit(False))
    late = F.coalesce((F.col("found_round") >= 2) & ((since <= LATE_ROW_MS) | early), F.lit(False))
    return placed.join(first, ["match_id", "found_round"], "left").select("event_id", (F.col("found_round") - late.cast("int")).alias("found_round"), late.alias("late"))


def dedupe_events(events: DataFrame, window_ms: int = DEDUPE_MS) -> DataFrame:
    """Events with both names, less those within 5 s of the last KEPT one of the same killer, victim and type.

    The last kept one is carried through the rows of a key in order (not a lag: a dropped row does not count).
    """
    key = ["match_id", "killer_id", "victim_id", "event_type"]
    groups = events.filter("killer_id is not null and victim_id is not null").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("feed_ms", "event_id"))).alias("rows"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.expr("cast(array() as array<bigint>)").alias("kept"))
    fresh = lambda acc, x: acc["last"].isNull() | (x["feed_ms"] - acc["last"] > window_ms)
    step = lambda acc, x: F.when(fresh(acc, x), F.struct(x["feed_ms"].alias("last"), F.concat(acc["kept"], F.array(x["event_id"])).alias("kept"))).otherwise(acc)
    return groups.select(F.explode(F.aggregate("rows", start, step)["kept"]).alias("event_id"))


def round_summary(rounds: DataFrame) -> DataFrame:
    lead = F.when(F.col("blue_score") > F.col("red_score"), "blue").when(F.col("red_score") > F.col("blue_score"), "red")
    return rounds.select("match_id", "round_no", "start_ms", "end_ms", "blue_score", "red_score", lead.alias("leader"))


def round_reconcile(events: DataFrame, rounds: DataFrame) -> DataFrame:
    """Counted eliminations against the deaths of each round."""
    counted = events.filter(counted_elimination() & F.col("round_no").isNotNull()).groupBy("match_id", "round_no").agg(F.count("*").alias("counted"))
    both = counted.join(rounds.select("match_id", "round_no", (F.col("blue_score") + F.col("red_score")).alias("deaths")), ["match_id", "round_no"], "full_outer")
    n, d = F.coalesce("counted", F.lit(0)), F.coalesce("deaths", F.lit(0))
    return both.select("match_id", "round_no", n.alias("counted"), d.alias("deaths"), (n - d).alias("difference"))


def run_notes(events: DataFrame) -> DataFrame:
    """Per match its notes, joined."""
    notes = events.filter("flag is not null").groupBy("match_id", "flag").agg(F.count("*").alias("n")).select("match_id", F.format_string("%d rows are flagged %s", "n", "flag").alias("note"))
    return notes.groupBy("match_id").agg(F.array_join(F.sort_array(F.collect_list("note")), "; ").alias("notes"))


def board_progress(match_players: DataFrame, scoreboard: DataFrame) -> DataFrame:
    """Players read on the end-of-match board, of those expected."""
    read = scoreboard.filter("round_no is null").select("match_id", "player_id").distinct().withColumn("on", F.lit(1))
    rows = match_players.join(read, ["match_id", "player_id"], "left").groupBy("match_id").agg(F.count("*").alias("expected"), F.count("on").alias("read"))
    return rows.withColumn("complete", F.col("expected") == F.col("read"))


def round_segments(live: DataFrame, boards: DataFrame, resets: DataFrame, deaths: DataFrame, rows: DataFrame, rises: DataFrame) -> DataFrame:
    """match_id, round_no, start_ms, end_ms. All inputs but boards (match_id, end_ms): match_id, t_ms.

    Between two boards' ends lies at most one round. It starts at the first live screen, or at a counter reset
    that a death, or a row 8 s later, shows to be the start of play, whichever is first; it ends when a score
    rises, else at the last live screen.
    """
    mark = lambda df, kind, t="t_ms": df.select("match_id", F.col(t).alias("t_ms"), F.lit(kind).alias("kind"))
    line = mark(boards, "board", "end_ms")
    for df, kind in ((live, "live"), (resets, "reset"), (deaths, "death"), (rows, "row"), (rises, "rise")):
        line = line.unionByName(mark(df, kind))
    so_far = Window.partitionBy("match_id").orderBy("t_ms").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    part = Window.partitionBy("match_id", "part")
    is_ = lambda kind: F.col("kind") == kind
    parts = line.withColumn("part", F.sum(is_("board").cast("int")).over(so_far)).filter("kind <> 'board'")
    parts = parts.withColumns({"live_ms": F.min(F.when(is_("live"), F.col("t_ms"))).over(part), "reset_ms": F.min(F.when(is_("reset"), F.col("t_ms"))).over(part)})
    shows = (is_("death") & (F.col("t_ms") >= F.col("reset_ms"))) | (is_("row") & (F.col("t_ms") >= F.col("reset_ms") + LATE_ROW_MS))
    proven = F.coalesce(F.max(shows).over(part), F.lit(False))
    begun = parts.withColumn("start_ms", F.when(proven, F.least("live_ms", "reset_ms")).otherwise(F.col("live_ms"))).filter("start_ms is not null")
    each = begun.groupBy("match_id", "part", "start_ms").agg(F.min(F.when(is_("rise") & (F.col("t_ms") >= F.col("start_ms")), F.col("t_ms"))).alias("rise"), F.max(F.when(is_("live"), F.col("t_ms"))).alias("gone"))
    number = F.row_number().over(Window.partitionBy("match_id").orderBy("part")).cast("long")
    return each.select("match_id", number.alias("round_no"), "start_ms", F.coalesce("rise", F.greatest("gone", "start_ms")).alias("end_ms"))


def missed_rounds(boards: DataFrame, rounds: DataFrame) -> DataFrame:
    """boards: match_id, board_no, start_ms, end_ms. Boards that no round belongs to: match_id, board_no, and the round they stand for (from the board before, or the start, to the board)."""
    line = Window.partitionBy("match_id").orderBy("board_no")
    spans = boards.select("match_id", "board_no", F.coalesce(F.lag("end_ms").over(line), F.lit(0)).alias("from_ms"), F.col("start_ms").alias("to_ms"))
    held = spans.join(rounds.select("match_id", "start_ms"), "match_id").filter("start_ms >= from_ms and start_ms < to_ms").select("match_id", "board_no").distinct()
    return spans.join(held, ["match_id", "board_no"], "left_anti").select("match_id", "board_no", F.col("from_ms").alias("start_ms"), F.col("to_ms").alias("end_ms"))


def unseen_rounds(boards: DataFrame, resets: DataFrame, rounds: DataFrame) -> DataFrame:
    """match_id, start_ms, end_ms: the rounds that only a board (match_id, start_ms, end_ms, kind) tells of.

    A round board before which no round has started since the board before stands for such a round. It runs from the
    last counter reset (match_id, t_ms) since that board, or where there is none from that board's end, to the board.
    What was last before each board is read off one time line per match.
    """
    line = Window.partitionBy("match_id").orderBy("t_ms")
    spans = boards.select("match_id", F.col("start_ms").alias("t_ms"), F.coalesce(F.lag("end_ms").over(Window.partitionBy("match_id").orderBy("start_ms")), F.lit(0)).alias("from_ms"), (F.col("kind") == "round").alias("asked"))
    marks = spans.unionByName(rounds.select("match_id", F.col("start_ms").alias("t_ms"), F.col("start_ms").alias("begun")), allowMissingColumns=True)
    marks = marks.unionByName(resets.select("match_id", "t_ms", F.col("t_ms").alias("reset")), allowMissingColumns=True)
    before = line.rangeBetween(Window.unboundedPreceding, -1)
    seen = marks.withColumns({"begun": F.max("begun").over(before), "reset": F.max("reset").over(before)}).filter("asked and coalesce(begun < from_ms, true)")
    return seen.select("match_id", F.greatest("from_ms", "reset").alias("start_ms"), F.col("t_ms").alias("end_ms"))


def with_unseen_rounds(rounds: DataFrame, unseen: DataFrame) -> DataFrame:
    """rounds and the unseen ones (as of ``unseen_rounds``) numbered anew in order of their starts; by_board tells which are which, was is the number before."""
    both = rounds.withColumn("by_board", F.lit(0)).unionByName(unseen.withColumn("by_board", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy("match_id").orderBy("start_ms", "by_board").rowsBetween(Window.unboundedPreceding, 0)
    number = F.coalesce(F.max("round_no").over(so_far), F.lit(0)) + F.sum("by_board").over(so_far)
    return both.withColumns({"was": F.col("round_no"), "round_no": number.cast("long"), "by_board": F.col("by_board") == 1})


def moved_rows(rows: DataFrame, at: str, numbered: DataFrame) -> DataFrame:
    """rows (match_id, round_no, the time column ``at``, ...) with round_no as the rounds are numbered anew.

    A range update: rows from the start of an unseen round to the next start go into it, also those without a round; the
    others keep their round under its new number. Starts and rows are one time line per match, starts first among equals.
    """
    marks = numbered.select("match_id", F.col("start_ms").alias(at), F.struct("start_ms", "by_board", "round_no").alias("_mark"), F.col("by_board").cast("int").alias("_shift"), F.lit(0).alias("_row"))
    line = Window.partitionBy("match_id").orderBy(at, "_row").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.withColumn("_row", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    seen = both.withColumns({"_mark": F.max("_mark").over(line), "_shift": F.coalesce(F.sum("_shift").over(line), F.lit(0))}).filter("_row = 1")
    placed = F.when(F.col("_mark.by_board"), F.col("_mark.round_no")).otherwise(F.col("round_no") + F.col("_shift"))
    return seen.withColumn("round_no", placed.cast("long")).select(*rows.columns)
