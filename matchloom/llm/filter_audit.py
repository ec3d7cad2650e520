"""Audit of how filters act on one another, for every order in which they may be applied.

What a filter removes depends only on the *set* of filters applied before it, not on their order. With n filters the
subsets are the corners of a lattice, and applying a filter next is an edge of it: n * 2^(n-1) edges (80 for five). Each
order is a path through the lattice, so its steps are edges.

1. Each document becomes a mask: which filters it fails. The four that look at one text are built-in expressions; the
   last one, "identical to the text of a smaller doc_id", is found by aggregation (below).
2. Documents are counted by (part, mask), at most 2^n rows a part, and each such row contributes its counts to all edges:
   what arrives there, is kept, is removed, was failing but gone already, and so on.
3. Edges, added up by part, are joined to the steps of all orders (600 rows for five, a fixed number, so they are
   broadcast). The Shapley sum of a filter weighs each of its edges by the number of paths through it.

Copies: rows are counted by (doc_id, text, part) first, then by (text, part), where the counts of the smallest doc_id are
carried along, then the parts of one text are compared. All three are aggregations that start where the rows lie, so a text
that a third of all documents share costs a row a task, and no task meets all its copies. Texts are compared by SHA-256.

Edge cases: a null text is an empty one; a null part is the empty string, as one with an empty one; a document of null
doc_id is no copy and makes none, and has no labels; rows of one doc_id and text are counted each, none is a copy of the
other; several labels of one doc_id count as one that has what any has; an empty table gives no parts and no rows; extra
columns are not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import NO_ID, stored, words

COPY = "E"
#: Orders grow as the factorial of the filters.
MOST_FILTERS = 7
_COUNTS = ("n", "good", "toxic")


def text_rules(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails: A, too few words; B, too few different ones; C, too many capitals; D, symbols."""
    found = words(text)
    n, different = F.size(found), F.size(F.array_distinct(found))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {"A": n < 200, "B": 100 * different.cast("long") < 50 * n, "C": 100 * capitals.cast("long") > 2 * F.char_length(text), "D": text.rlike(r"[#$%&*|]")}


def _masked(docs: DataFrame, labels: DataFrame, part: str, rules: list[Column]) -> DataFrame:
    """doc_id (NO_ID for null), part, digest, mask (of the rules on texts), n, good, toxic: rows counted by document, text and part."""
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(F.coalesce(fails, F.lit(False)), 1 << k).otherwise(0) for k, fails in enumerate(rules)]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    counted = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    has = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(has("quality").alias("is_good"), has("toxic").alias("is_toxic")).filter("is_good or is_toxic")
    # both are stored, so that the join deals both sides anew and a doc_id with very many texts can be split
    joined = stored(counted).join(stored(marks), "doc_id", "left")
    count = lambda c: F.when(F.col(c), F.col("n")).otherwise(0)
    return joined.select("doc_id", "part", "digest", "mask", "n", count("is_good").alias("good"), count("is_toxic").alias("toxic"))


def masks(docs: DataFrame, labels: DataFrame, part: str = "source", rules: list[Column] | None = None) -> DataFrame:
    """part, mask, n, good, toxic: documents by what they fail; the last bit is that of copies."""
    rules = list(text_rules(F.coalesce("text", F.lit(""))).values()) if rules is None else rules
    rows = _masked(docs, labels, part, rules)
    known = F.col("doc_id") != NO_ID
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    # the counts of the smallest doc_id of a text in a part, beside those of all that have one
    by_text = rows.groupBy("digest", "part", "mask").agg(
        F.min(F.when(known, F.struct("doc_id", *_COUNTS))).alias("first"), *(total(c, known).alias(c) for c in _COUNTS), *(total(c, ~known).alias(f"{c}_unnamed") for c in _COUNTS)
    )
    first = F.min("first.doc_id").over(Window.partitionBy("digest"))
    # a text has a row here for each part it occurs in
    placed = by_text.withColumn("stays", F.coalesce(F.col("first.doc_id") == first, F.lit(False)))
    kept = {c: F.when(F.col("stays"), F.col(f"first.{c}")).otherwise(0) for c in _COUNTS}
    once = F.struct("mask", *((kept[c] + F.col(f"{c}_unnamed")).alias(c) for c in _COUNTS))
    copy = F.struct((F.col("mask") + F.lit(1 << len(rules))).alias("mask"), *((F.col(c) - kept[c]).alias(c) for c in _COUNTS))
    both = placed.select("part", F.explode(F.array(once, copy)).alias("x")).select("part", "x.*").filter("n > 0")
    return both.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def edges(counted: DataFrame, n_filters: int) -> DataFrame:
    """part, applied (set of filters applied before, as bits), next (filter), and what happens to the documents at that edge."""
    lattice = [(s, f) for f in range(n_filters) for s in range(1 << n_filters) if not s >> f & 1]
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in lattice))).alias("edge")
    rows = counted.select("*", each).select("part", "mask", *_COUNTS, "edge.*")
    bit = F.expr("shiftleft(1, next)")
    fails, gone = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("applied")) != 0
    total = lambda when, c="n": F.sum(F.when(when, F.col(c)).otherwise(0))
    return rows.groupBy("part", "applied", "next").agg(
        total(~gone & ~fails).alias("kept"), total(~gone & fails).alias("removed"), total(gone & fails).alias("redundant"), total(F.col("mask") == bit).alias("unique_fails"),
        total(~gone & fails, "good").alias("good_lost"), total(~gone & fails, "toxic").alias("toxic_lost"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source", rules: dict[str, Column] | None = None, copies: str = COPY) -> DataFrame:
    """A row per part, order of the filters and step.

    rules: letter -> whether a row of docs fails; ``copies`` is the letter of the filter of identical texts. Gives part,
    filter_order, step, and counts of documents of the part: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    rules = text_rules(F.coalesce("text", F.lit(""))) if rules is None else rules
    letters = [*rules, copies]
    n = len(letters)
    if n > MOST_FILTERS or len(set(letters)) < n:
        raise ValueError(f"at most {MOST_FILTERS} filters, each with a letter of its own")
    found = edges(masks(docs, labels, part, list(rules.values())), n)
    orders = itertools.permutations(range(n))
    path = [("".join(letters[f] for f in order), k + 1, sum(1 << f for f in order[:k]), f) for order in orders for k, f in enumerate(order)]
    steps = docs.sparkSession.createDataFrame(path, "filter_order string, step int, applied int, next int")
    # so many orders lead through an edge: those of what is applied, times those of what is left
    size = F.bit_count("applied")
    weigh = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), size + 1)
    shared = found.withColumn("shapley", F.sum(F.col("removed") * weigh).over(Window.partitionBy("part", "next")))
    rows = shared.join(F.broadcast(steps), ["applied", "next"])
    return rows.select("part", "filter_order", "step", *(F.col(c).cast("long") for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
             CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
             CASE WHEN t.doc_id > first THEN 'E' ELSE '' END) AS fails
      FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, k AS step, filter_order[:k - 1] AS before, filter_order[k] AS x FROM (SELECT filter_order, unnest(range(1, 6)) AS k FROM o WHERE len(filter_order) = 5)),
r AS (SELECT part, filter_order, step, x, contains(fails, x) AS hit, translate(fails, before, '') <> fails AS gone, fails, n, good, toxic FROM c, s),
g AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, x, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM g
"""
