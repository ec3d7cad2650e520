"""Merkle fixity audit of archive replicas.

A record of a WARC file has a place (file, offset in the file) and a digest. Digests are hashed into trees of
fixed shape: records into offset ranges of ``RANGE`` bytes, ranges into spans of ``FAN`` ranges, spans into
files, files into groups of 64, 4096 and 262144 files, and these into the root. Every node hashes its children
in order, with their places, so no task ever sees more than the children of one node.

``audit`` compares the roots of two replicas and goes down one level at a time, only into branches whose
hashes differ; records are compared only inside ranges that differ.

Edge cases: a null payload is empty; a record that one replica lacks is reported as missing or extra; several
records at one place are hashed together (their number and sums of their hashes, so no list of them is ever gathered)
and reported as one; equal replicas, empty ones included, give no row; records without a page_id have files of
their own, below 0, by their digest, so these files stay small as well; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import stored

RECORDS_PER_FILE = 128
RANGE, FAN, FILES = 16 * 1024, 8, 64
HEADER = 120


def _parents() -> list[tuple[Column, Column]]:
    """From leaves to root: how a node's place (f, r) follows from its child's."""
    f, r, zero = F.col("f"), F.col("r"), F.lit(0).cast("long")
    up = F.floor(f / FILES)
    return [(f, F.floor(r / RANGE)), (f, F.floor(r / FAN)), (f, zero), (up, zero), (up, zero), (up, zero), (zero, zero)]


def _body() -> Column:
    return F.concat_ws("\n", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))


def digests(pages: DataFrame) -> DataFrame:
    """page (what tells records apart), f (file), page_id, length, digest."""
    p = F.col("page_id").cast("long")
    rows = pages.select(p.alias("page_id"), (F.octet_length(_body()) + HEADER).cast("long").alias("length"), F.sha2(_body().cast("binary"), 256).alias("digest"))
    spread = -1 - F.conv(F.substring("digest", 1, 6), 16, 10).cast("long")
    page = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("digest "), "digest"))
    return rows.select(page.alias("page"), F.coalesce(F.floor(F.col("page_id") / RECORDS_PER_FILE), spread).alias("f"), "page_id", "length", "digest")


def together() -> Column:
    """The hash of all records at a place: of one its digest, of several their number and sums, in any order."""
    half = lambda seed: F.sum(F.xxhash64(F.lit(seed), "digest").cast("decimal(38,0)")).cast("string")
    n = F.count("*")
    return F.when(n == 1, F.min("digest")).otherwise(F.sha2(F.concat_ws(",", n.cast("string"), half(1), half(2)).cast("binary"), 256))


def records(pages: DataFrame) -> DataFrame:
    """page, page_id, f (file), r (offset), hash: one row per place, which is where the archive was first written, in order of page_id."""
    once = digests(pages).groupBy("page", "f", "page_id").agg(F.sum("length").alias("length"), together().alias("hash"))
    before = Window.partitionBy("f").orderBy("page_id", "page").rowsBetween(Window.unboundedPreceding, -1)
    return once.select("page", "page_id", "f", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")).alias("r"), "hash")


def leaves(rows: DataFrame) -> DataFrame:
    """One row per replica and place: replica, f, r, hash, from rows (replica, f, r, digest)."""
    return rows.groupBy("replica", "f", "r").agg(together().alias("hash"))


def above(level: DataFrame, f: Column, r: Column) -> DataFrame:
    """The next level of the replicas' trees; a node gathers its own children only."""
    child = F.struct(F.col("f").alias("cf"), F.col("r").alias("cr"), "hash")
    nodes = level.select("replica", f.cast("long").alias("f"), r.cast("long").alias("r"), child.alias("child")).groupBy("replica", "f", "r").agg(F.sort_array(F.collect_list("child")).alias("children"))
    text = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["cf"].cast("string"), c["cr"].cast("string"), c["hash"])), ",")
    return nodes.select("replica", "f", "r", F.sha2(text.cast("binary"), 256).alias("hash"))


def trees(lowest: DataFrame) -> list[DataFrame]:
    """The levels of the trees of replicas a and b, leaves first, as tables of (replica, f, r, hash).

    Leaves and files are stored, so that the way down reads them instead of hashing again.
    """
    levels = [stored(lowest)]
    for k, (f, r) in enumerate(_parents()):
        up = above(levels[-1], f, r)
        levels.append(stored(up) if k == 2 else up)
    return levels


def differing(level: DataFrame) -> DataFrame:
    """Places whose hashes differ, or that one replica lacks: f, r, hash_a, hash_b."""
    of = lambda x: F.max(F.when(F.col("replica") == x, F.col("hash"))).alias(f"hash_{x}")
    return level.groupBy("f", "r").agg(of("a"), of("b")).filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def below(level: DataFrame, parents: DataFrame, step: tuple[Column, Column]) -> DataFrame:
    """The nodes of a level whose parent is among these."""
    placed = level.withColumns({"pf": step[0].cast("long"), "pr": step[1].cast("long")})
    return placed.join(parents.select(F.col("f").alias("pf"), F.col("r").alias("pr")), ["pf", "pr"], "left_semi")


def audit(lowest: DataFrame) -> DataFrame:
    """lowest: the leaves of replicas a and b, see ``leaves``. Gives f, r, kind (changed, missing from b, extra in b), hash_a, hash_b where b departs from a."""
    levels, steps = trees(lowest), _parents()
    bad = differing(levels[-1])
    for k in range(len(steps) - 1, -1, -1):
        bad = differing(below(levels[k], bad, steps[k]))
    kind = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return bad.select("f", "r", kind.alias("kind"), "hash_a", "hash_b")


def decayed(pages: DataFrame) -> DataFrame:
    """A replica of pages as years leave it: by page_id, some bodies are altered, some records lost."""
    html, p = F.col("html"), F.col("page_id")
    altered = F.when(p % 97 == 13, F.concat(F.expr("substring(html, 2)"), F.substring("html", 1, 1))).otherwise(html)
    return pages.select(p, "url", altered.alias("html")).filter(F.coalesce(p % 131 != 7, F.lit(True)))


def audit_report(pages: DataFrame) -> DataFrame:
    """Audits a decayed replica of pages against pages: page_id, file, start (offset), kind, digest_a, digest_b."""
    first = stored(records(pages))
    now = digests(decayed(pages)).groupBy("page").agg(together().alias("hash"))
    # the replica keeps the places under which its records were written; both sides have one row per page
    original = first.select(F.lit("a").alias("replica"), "f", "r", "hash")
    replica = now.join(first.select("page", "f", "r"), "page").select(F.lit("b").alias("replica"), "f", "r", "hash")
    found = audit(original.union(replica)).join(first.select("f", "r", "page_id"), ["f", "r"])
    return found.select("page_id", F.col("f").alias("file"), F.col("r").alias("start"), "kind", F.col("hash_a").alias("digest_a"), F.col("hash_b").alias("digest_b"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, page_id // {RECORDS_PER_FILE} AS file, coalesce(url, '') || chr(10) || coalesce(html, '') AS body, url, html FROM pages),
a AS (SELECT page_id, file, CAST(coalesce(sum(octet_length(encode(body)) + {HEADER}) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, sha256(body) AS digest FROM p),
b AS (SELECT page_id, sha256(coalesce(url, '') || chr(10) || coalesce(CASE WHEN page_id % 97 = 13 THEN substr(html, 2) || substr(html, 1, 1) ELSE html END, '')) AS digest FROM p WHERE page_id % 131 <> 7)
SELECT a.page_id, a.file, a.start, CASE WHEN b.digest IS NULL THEN 'missing' ELSE 'changed' END AS kind, a.digest AS digest_a, b.digest AS digest_b
FROM a LEFT JOIN b USING (page_id) WHERE a.digest IS DISTINCT FROM b.digest
"""
