"""Connected components by alternating large-star and small-star steps.

Each step moves labels along the edges with one aggregation and one join, so a hub with very many
neighbours costs one row per neighbour; nothing is gathered in one task or on the driver. The edges
after each round are checkpointed to the shared folder. Rounds grow with the logarithm of the size
of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import shared_folder

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a checkpoint between aggregation and join lets the join split the neighbours of a hub among tasks
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).checkpoint()
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of the edges (a, b); component is the smallest node reachable."""
    shared_folder(edges.sparkSession)
    now = edges.select("a", "b").filter("a <> b").distinct().checkpoint()
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        now = _small_star(_large_star(now)).checkpoint()
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
