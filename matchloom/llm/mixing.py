"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each document of source s expects e_s = target_s / size_s copies. Within its source, documents stand
in order of (size, md5 of doc_id, doc_id); the expected copies are summed along that order, one offset
u_s in [0, 1) is added, and a document is emitted once per integer that its stretch of the sum crosses.
Order by size makes the sample even over sizes, so the words taken miss the target by a few documents.

The running sum is never taken over a whole source in one task: narrow rows (texts stay where they are) are
dealt by ranges of that order and stored with their range; each range sums its own rows, and the few sums of
ranges give what precedes a range. Equal keys have no part in this: the order ends with a number of the row, so
a range may begin between two equal rows, and a third of all rows may share a source, size, id and text.

Edge cases: a null text has size 0, a null source is a source of its own (last); a source without words
has target 0 and takes each document 0 times; rows with one doc_id and size stand next to each other, those of one
text together, and take their shares in turn; extra columns stay. Rows that differ in no column are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import fresh, stored, words

SEED = "mix-1"
MOST_COPIES = 3


def _unit(column: Column) -> Column:
    """32 bits of md5 as a number from 0 to 2**32 - 1; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """source, n_docs, source_size, target from one row per source (source, n_docs, source_size).

    Weights run 1, 2, 3, 1, ... over sources by name, null last. All sizes together are shared by weight; a
    target stops at ``most`` times its source's size and the excess goes to the others by weight. In
    order of cap / weight the capped sources come first, so running sums give the answer at once.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    capped = weighed.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = capped.select(
        "*",
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        ).alias("level"),
    )
    full = level.withColumns({"full": F.col("level") * F.col("weight") >= F.col("cap"), "place": F.row_number().over(order)})
    shared = full.withColumn("shared", F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(everything)["level"])
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("shared") * F.col("weight"))
    return shared.select("source", "n_docs", "source_size", target.alias("target"))


def copies(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """row, doc_id, size, source_size, target and n_copies (how often the mix takes the row) for stored rows (row, doc_id, source, size, same)."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))  # without nulls, so that joins need no null test
    keyed = rows.withColumns({"key": key, "turn": _unit(F.col("doc_id"))})
    sums = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    expected = targets(sums).select(
        key.alias("key"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("each"),
        (_unit(F.concat(F.lit(f"{seed}:"), key)) / F.lit(float(2**32))).alias("offset"),
    )
    order = ["size", "turn", "doc_id", "same", "row"]
    ranged = stored(keyed.select("key", *order).repartitionByRange("key", *order).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("key", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # a row per range and source; joined on both, so that no join is keyed by a source alone
    starts = stored(ranges.join(expected, "key"))
    rank = F.row_number().over(Window.partitionBy("key", "range").orderBy(*order))
    placed = ranged.withColumn("rank", rank).join(starts, ["key", "range"])
    upto = lambda n: F.floor(F.col("each") * n + F.col("offset"))
    place = F.col("before") + F.col("rank")
    return placed.select("row", "doc_id", "size", "source_size", "target", (upto(place) - upto(place - 1)).cast("long").alias("n_copies"))


def sized(docs: DataFrame, row: Column) -> DataFrame:
    """row, doc_id, source, size, same (hash of the text)."""
    return docs.select(row.alias("row"), "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("same"))


def mixed(docs: DataFrame, seed: str = SEED, into: str = "copy_no") -> DataFrame:
    """The mix itself: the columns of docs, one row for each copy taken, and ``into`` (1, 2, ...), which replaces a column of that name.

    Rows are stored with a number, by which the outcome of the sampling finds its text again.
    """
    row, taken = fresh(docs, "row"), fresh(docs, "taken")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    outcome = copies(stored(sized(rows, F.col(row))), seed).filter("n_copies > 0").select(F.col("row").alias(row), F.col("n_copies").alias(taken))
    return rows.join(outcome, row).withColumn(into, F.explode(F.sequence(F.lit(1), F.col(taken).cast("int")))).drop(row, taken)


def mix_report(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words)."""
    found = copies(stored(sized(docs, F.monotonically_increasing_id())), seed)
    return found.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {float(MOST_COPIES)} * sum(size) AS cap FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
total AS (SELECT sum(source_size) AS t FROM w),
-- shares again and again what is above the caps, until nothing is
fill(step, capped, level) AS (
  SELECT 0, CAST([] AS VARCHAR[]), (SELECT t FROM total) / (SELECT sum(weight) FROM w)
  UNION ALL
  SELECT step + 1, (SELECT list(coalesce('s' || source, 'null')) FROM w WHERE cap <= level * weight),
         ((SELECT t FROM total) - (SELECT coalesce(sum(cap), 0) FROM w WHERE cap <= level * weight))
         / (SELECT sum(weight) FROM w WHERE cap > level * weight)
  FROM fill WHERE step < 100 AND (SELECT count(*) FROM w WHERE cap <= level * weight) > len(capped)
    AND EXISTS (SELECT 1 FROM w WHERE cap > level * weight)),
lev AS (SELECT arg_max(level, step) AS level FROM fill),
g AS (SELECT source, source_size, least(cap, level * weight) AS target,
             CAST('0x' || substr(md5('{SEED}:' || coalesce('s' || source, 'null')), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM w, lev),
o AS (SELECT d.*, g.source_size, g.target, g.u, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS e,
             row_number() OVER (PARTITION BY d.source ORDER BY size, turn, doc_id) AS k
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST((floor(e * k + u) - floor(e * (k - 1) + u)) * size AS BIGINT) AS taken FROM o
"""
