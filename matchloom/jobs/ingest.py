"""Import of processed matches into a history on disk: by day, all tables of a match together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.store import TableStore, day_of, values_of

KEY = ["source_file", "recorded_at"]
WRITER = "import"


def import_matches(store: TableStore, batch: int, tables: dict[str, DataFrame], replace: bool = False) -> bool:
    """Writes matches with all that hangs off them. tables: ``matches`` (match_id, source_file, recorded_at, status, ...), and others by match_id.

    A recording (source_file, recorded_at) that is there already is left as it is, or with ``replace`` its earlier match goes,
    with its rows in all tables, and the new one takes its place. Of several of one recording the smallest match_id counts.
    A match without a status needs review if an event of it is flagged. The days that matches of the batch are of are
    rewritten in all tables and published together; all other days are not read. ``batch`` counts the imports: one that was
    published already does nothing.
    """
    once = Window.partitionBy(*KEY).orderBy("match_id")
    matches = tables["matches"].withColumn("place", F.row_number().over(once)).filter("place = 1").drop("place")
    days = values_of(matches, day_of())
    now = store.snapshot()
    old = store.read("matches", matches.schema, days, now).drop("day")
    if replace:
        gone = old.join(matches.select(*KEY), KEY, "left_semi").select("match_id")
    else:
        matches = matches.join(old.select(*KEY), KEY, "left_anti")
        gone = old.limit(0).select("match_id")
    if "events" in tables:
        flagged = tables["events"].groupBy("match_id").agg(F.max(F.col("flag").isNotNull()).alias("flagged"))
        status = F.coalesce("status", F.when(F.coalesce("flagged", F.lit(False)), "needs_review").otherwise("processed"))
        matches = matches.join(flagged, "match_id", "left").withColumn("status", status).select(*tables["matches"].columns)
    day = matches.select("match_id", day_of().alias("day"))
    out = {}
    for name, rows in tables.items():
        new = (matches if name == "matches" else rows).join(day, "match_id")
        kept = store.read(name, new.schema, days, now).join(gone, "match_id", "left_anti")
        out[name] = new.unionByName(kept)
    return store.publish(WRITER, batch, out, F.col("day"), days)


def history(store: TableStore) -> dict[str, DataFrame]:
    """All tables of one version."""
    now = store.snapshot()
    return {name: store.read(name, snapshot=now).drop("day") for name in now["tables"]}
