"""Near-duplicates by SimHash, with a segment-popcount grid in front of the exact test.

1. ``fingerprints``: 64 bits per document from its 3-word shingles (mapInPandas, one pass, no shuffle).
2. Equal fingerprints become one node.
3. Grid range-join: a fingerprint is cut into 32 segments of 2 bits and mapped to their bit counts. The
   Manhattan distance of two such vectors is at most their Hamming distance. Vectors at distance 2 or less
   differ in two segments at most, so of 8 blocks of 4 segments they agree in 6: each fingerprint enters the 28
   cells that are left when two blocks are taken away. Cells of two fingerprints or more give the candidates.
4. Exact test by the bits that differ: the members of a cell against its smallest member, the hub. Where all are
   linked to the hub, or there is one other only, the cell is done.
5. Members of other cells: fingerprints differ in 2 bits or fewer just when some 64-bit word is within one bit
   of both. Each enters its 65 words of that kind, and all that meet in a word are linked to the smallest there.
   So a dense cell of n fingerprints makes 65 n rows, never n * n pairs, and components are exact.
6. Components over the links, named by the smallest doc_id of their rows.

Edge cases: a text without words (null, empty) has fingerprint zero and is linked like any other; fewer
than three words make one shingle; repeated rows share a node; rows are linked by their fingerprints only, so
neither a repeated doc_id nor a null one joins different texts; a component's id is null only if all its rows are
without one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import NO_ID, fresh, identified, keyed, real_id, scratch, stored
from matchloom.llm.components import components
from matchloom.llm.fingerprints import fingerprint, links
from matchloom.llm.near_copies import near_copies


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({"doc_id": rows.doc_id, "fp": np.array([fingerprint(t) for t in rows.text], dtype=np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp."""
    return identified(docs).select("doc_id", "text").mapInPandas(_fingerprints, "doc_id long, fp long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row; NO_ID stands for a null doc_id."""
    prints = stored(fingerprints(docs))
    # stored, so that the join below deals both sides anew and a fingerprint of very many copies can be split among tasks
    nodes = stored(prints.groupBy("fp").agg(F.min(F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).alias("least")))
    found = stored(components(links(nodes)).withColumnRenamed("node", "fp"))
    ids = found.join(nodes, "fp").groupBy("component").agg(F.min("least").alias("id"))
    named = stored(nodes.join(found.join(ids, "component").select("fp", "id"), "fp", "left").select("fp", F.coalesce("id", "least", F.lit(NO_ID)).alias("component_id")))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    rows = near_duplicates(docs)
    return rows.select(real_id(), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), real_id("component_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near copies one row, that of the smallest (doc_id, text_hash).

    Pairs whose fingerprints meet in the grid above are held against the exact test, a five-word similarity of 0.8 or more; what is as
    alike but further apart in its bits is added by the prefixes of its shingles (see near_copies), so no near copy is lost.

    Of rows that share both, the one whose other columns have the smallest hash stays.
    """
    rows, key = keyed(docs)
    turn = fresh(rows, "turn")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    # repeated rows are thinned out where they are, before they are dealt
    one = rows.withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col(turn) == 1).drop(turn)
    with scratch(docs.sparkSession) as keep:
        first = near_copies(docs).groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
        kept = keep(first.select(F.col("k").alias(key)))
    return one.join(kept.hint("merge"), key, "left_semi").drop(key)
