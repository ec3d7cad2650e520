"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A line is one of the \\n-separated lines of a text; lines without a word are left out of account. From each
line starts a window: the fewest consecutive lines with at least ``MIN_WORDS`` words together (none, if the
document ends before). A line that is long enough is a window of its own. Every repeated run of that many
words holds whole windows, so it cannot escape.

1. Winnowing: each window selects the line of least hash in it (the first of equals) as its fingerprint, so
   equal windows select equal fingerprints, and neighbouring windows mostly share one. Windows are stored as
   narrow rows, so texts are read once here and once more to take the lines out.
2. The positions of the selected fingerprints are joined: windows whose fingerprint was selected at one place
   only are unique and go.
3. Around the others the match is extended both ways. Backward, a line before a match that agrees as well starts
   a window of its own that agrees, so windows are extended by themselves. Forward, up to the line that would
   complete the next window, lines are added one by one; each such run is compared by a hash of all its lines.
   Of the runs with equal lines the first by (doc_id, line) stays and the later ones are repeats. Each run meets
   the first one only, never all others, so a line that a third of all documents share costs a row per document.
4. Adjoining and overlapping repeats are one maximal run; its lines are deleted.

So a line is deleted just when it is in a run of lines of ``MIN_WORDS`` words or more, however long, that occurs
earlier in (doc_id, line) order.

Edge cases: a null text stays null and has no lines; the rows of one document (same doc_id and text) are one
place, so repeated rows lose the same lines; documents with one doc_id and different texts are ordered by
text hash; a null doc_id comes first; extra columns stay, but for one named as ``into``, which is replaced. Very
long documents are windowed in one sort each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import fresh, identified, keyed, stored

MIN_WORDS = 20


def _places(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line (number in the text), h, n (words): lines with a word, once per document."""
    # one row a document, so that its copies are put together where they lie and none but one per task travels
    hashed = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n")))
    whole = identified(docs).select("doc_id", "text_hash", F.filter(hashed, lambda x: x["n"] > 0).alias("lines"))
    return whole.groupBy("doc_id", "text_hash").agg(F.first("lines").alias("lines")).select("doc_id", "text_hash", F.inline("lines"))


def windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, line, last (line), whole (hash), anchor (fingerprint), place (hash of its place), tail (lines after, array<struct<line, h>>)."""
    document = Window.partitionBy("doc_id", "text_hash")
    placed = _places(docs).withColumn("x", F.sum("n").over(document.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    reach = document.orderBy("x").rangeBetween(0, min_words - 1)
    held = placed.select("doc_id", "text_hash", "line", "x", F.collect_list(F.struct("line", "h", "n")).over(reach).alias("w"))
    followed = held.withColumn("next", F.lead("w").over(document.orderBy("x")))
    words = F.aggregate("w", F.lit(0), lambda t, x: t + x["n"])
    least = F.array_min(F.transform("w", lambda x: F.struct(x["h"], x["line"])))
    last = F.element_at("w", -1)["line"]
    # lines of the next window that are beyond this one
    tail = F.transform(F.filter("next", lambda x: x["line"] > last), lambda x: F.struct(x["line"], x["h"]))
    return followed.filter(words >= min_words).select(
        "doc_id",
        "text_hash",
        "line",
        last.alias("last"),
        F.xxhash64(F.transform("w", lambda x: x["h"])).alias("whole"),
        least["h"].alias("anchor"),
        F.xxhash64("doc_id", "text_hash", least["line"]).alias("place"),
        tail.alias("tail"),
    )


def extended(found: DataFrame) -> DataFrame:
    """Each window alone and with one, two, ... lines of its tail: doc_id, text_hash, line, last, whole."""
    tail = F.coalesce("tail", F.array().cast("array<struct<line:int,h:bigint>>"))
    rows = found.withColumn("tail", tail).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("tail"))))
    part = F.slice("tail", F.lit(1), F.col("k"))
    whole = F.when(F.col("k") == 0, F.col("whole")).otherwise(F.xxhash64("whole", F.transform(part, lambda x: x["h"])))
    return rows.select("doc_id", "text_hash", "line", F.when(F.col("k") == 0, F.col("last")).otherwise(F.element_at(part, -1)["line"]).alias("last"), whole.alias("whole"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs that occur earlier: doc_id, text_hash, line, last."""
    all_windows = stored(windows(docs, min_words))
    # what is aggregated is stored before it is joined: the join then deals both sides anew, and a line that is everywhere can be split among tasks
    joined = stored(all_windows.groupBy("anchor").agg(F.min("place").alias("a"), F.max("place").alias("z")).filter("a <> z").select("anchor"))
    # both joins deal their sides by key at every size, so that nothing is broadcast that grows with the corpus
    candidates = stored(extended(all_windows.join(joined.hint("merge"), "anchor", "left_semi")))
    start = F.struct("doc_id", "text_hash", "line")
    firsts = stored(candidates.groupBy("whole").agg(F.min(start).alias("first"), F.max(start).alias("latest")).filter("first <> latest").select("whole", "first"))
    return candidates.join(firsts.hint("merge"), "whole").filter(start > F.col("first")).select("doc_id", "text_hash", "line", "last")


def runs(repeated: DataFrame) -> DataFrame:
    """Per document: its maximal runs, array<struct<line, last>> in order."""
    before = Window.partitionBy("doc_id", "text_hash").orderBy("line", "last").rowsBetween(Window.unboundedPreceding, -1)
    opened = repeated.withColumn("opens", (F.col("line") > F.coalesce(F.max("last").over(before), F.lit(-1))).cast("int"))
    numbered = opened.withColumn("run", F.sum("opens").over(Window.partitionBy("doc_id", "text_hash").orderBy("line", "last").rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "text_hash", "run").agg(F.min("line").alias("line"), F.max("last").alias("last"))
    return merged.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("line", "last"))).alias("runs"))


def _without(lines: Column, found: Column) -> Column:
    """lines less the runs; linear in the lines. Lines without a word inside a run go with it."""
    end = F.size(lines)
    begin = lambda i: F.when(i > 0, F.get(found, i - 1)["last"] + 1).otherwise(F.lit(0))
    gaps = F.transform(found, lambda r, i: F.slice(lines, begin(i) + 1, r["line"] - begin(i)))
    tail = F.element_at(found, -1)["last"] + 1
    return F.concat(F.flatten(gaps), F.slice(lines, tail + 1, end - tail))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, into: str = "line_dedup") -> DataFrame:
    """All columns of docs, text without later repeated runs, and the column ``into``: n_lines, n_removed (lines before, and less)."""
    found = runs(repeats(docs, min_words))
    rows, key = keyed(docs)
    gone = fresh(rows, "runs")
    # stored, so that a row which is repeated very often can be split among tasks; texts are dealt by key at every size, since the runs grow with them
    named = stored(found.select(F.struct("doc_id", "text_hash").alias(key), F.col("runs").alias(gone)))
    joined = rows.join(named.hint("merge"), key, "left")
    before, after = fresh(joined, "lines"), fresh(joined, "kept")
    split = joined.withColumn(before, F.split("text", "\n"))
    kept = split.withColumn(after, F.when(F.col(gone).isNull(), F.col(before)).otherwise(_without(F.col(before), F.col(gone))))
    count = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    outcome = F.struct(count(F.size(before)).alias("n_lines"), count(F.size(before) - F.size(after)).alias("n_removed"))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(after, "\n"))
    return kept.withColumn(into, outcome).withColumn("text", text).drop(key, gone, before, after)


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that stays)."""
    rows = line_dedup(docs.select("doc_id", "text"), into="found")
    return rows.select("doc_id", "found.n_lines", "found.n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(range(0, len(s))) AS line, unnest(s) AS value FROM (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM d)),
p AS (SELECT *, len(regexp_extract_all(value, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(value, '[^\x20\x09-\x0D]')),
x AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, text ORDER BY line) - n AS x FROM p),
-- all runs of lines of enough words that go no further than the line that completes the next window: longer ones are made of these
w AS (SELECT doc_id, text, line, n, list(line) OVER f AS lines, list(n) OVER f AS sizes, list(value) OVER f AS v
      FROM x WINDOW f AS (PARTITION BY doc_id, text ORDER BY x RANGE BETWEEN CURRENT ROW AND n + {MIN_WORDS - 1} FOLLOWING)),
e AS (SELECT doc_id, text, line, lines[k] AS last, v[1:k] AS whole FROM (SELECT *, unnest(range(1, len(v) + 1)) AS k FROM w) WHERE list_sum(sizes[1:k]) >= {MIN_WORDS}),
r AS (SELECT *, row_number() OVER (PARTITION BY whole ORDER BY doc_id, line) AS k FROM e),
gone AS (SELECT DISTINCT doc_id, text, unnest(range(line, last + 1)) AS line FROM r WHERE k > 1),
kept AS (SELECT l.doc_id, l.text, count(*) AS n, string_agg(value, chr(10) ORDER BY l.line) AS kept FROM l ANTI JOIN gone USING (doc_id, text, line) GROUP BY l.doc_id, l.text)
SELECT documents.doc_id, CAST(coalesce(len(string_split(documents.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(string_split(documents.text, chr(10))) - coalesce(kept.n, 0), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept ON documents.doc_id = kept.doc_id AND documents.text = kept.text
"""
