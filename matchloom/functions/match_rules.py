"""Predicates over events that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELIMINATIONS = ("kill", "eliminated_knocked")
#: A knock's line appears up to this much after the knock.
FEED_LAG_MS = 3500


def is_knock() -> Column:
    return F.col("event_type") == "knock"


def counted_elimination() -> Column:
    """An elimination that counts; one that the counter saw no death for (NO_DROP) does not."""
    return F.col("event_type").isin(*ELIMINATIONS) & ~F.col("flag").eqNullSafe("NO_DROP")


def round_key() -> Column:
    """Events without a round are one round of their own."""
    return F.coalesce("round_no", F.lit(-1))


def ones(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1)), F.lit(0)).cast("long")
