"""SimHash fingerprints of texts, and the segment-popcount grid that links those within two bits (see simhash_dedup)."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import stored

SHINGLE, SEED, BITS = 3, 42, 64
#: Blocks of four segments of two bits; bits in which linked fingerprints differ at most.
BLOCKS, FAR = 8, 2
LOW_BITS = 0x5555555555555555


def fingerprint(text: str) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    w = text.encode().lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) < SHINGLE:
        hashes = [h(b" ".join(w), SEED)]
    else:
        hashes = [h(b"%b %b %b" % x, SEED) for x in zip(w, w[1:], w[2:], strict=False)]
    values = np.array(hashes, dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(values), 4096):
        part = np.unpackbits(values[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<i8")[0])


def _cells(fp: Column) -> Column:
    """The bit counts of the segments (two bits each) without two of the blocks, for any two; hashed with their number."""
    other = F.shiftrightunsigned(fp, 1)
    one, two = other.bitwiseXOR(fp).bitwiseAND(F.lit(LOW_BITS)), other.bitwiseAND(fp).bitwiseAND(F.lit(LOW_BITS))
    counts = one.bitwiseOR(F.shiftleft(two, 1))
    size = BITS // BLOCKS
    block = (1 << size) - 1
    away = [(i, j) for j in range(BLOCKS) for i in range(j)]
    masks = [((1 << BITS) - 1) & ~(block << size * i) & ~(block << size * j) for i, j in away]
    return F.array(*(F.xxhash64(F.lit(k), counts.bitwiseAND(_long(m))) for k, m in enumerate(masks)))


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def _words_within_one_bit(fp: Column) -> Column:
    return F.array(fp, *(fp.bitwiseXOR(_long(1 << b)) for b in range(BITS)))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints (fp distinct) that hold together all that differ in 2 bits or fewer."""
    # dealt out before each row becomes 28
    spread = nodes.select("fp").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    cells = spread.select("fp", F.explode(_cells(F.col("fp"))).alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("fp").alias("hub"), F.max("fp").alias("last")).filter("hub <> last").select("cell", "hub")
    # always a shuffle join: shared cells grow with the corpus, so a broadcast would only do for small ones
    members = stored(cells.join(stored(shared).hint("merge"), "cell").withColumn("apart", F.bit_count(F.col("fp").bitwiseXOR(F.col("hub")))))
    first = members.filter(F.col("apart").between(1, FAR)).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    undone = stored(members.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("most")).filter(F.col("n") > 2).filter(F.col("most") > FAR).select("cell"))
    left = stored(members.join(undone, "cell", "left_semi").select("fp").distinct())
    near = left.select("fp", F.explode(_words_within_one_bit(F.col("fp"))).alias("word"))
    hubs = stored(near.groupBy("word").agg(F.min("fp").alias("hub"), F.max("fp").alias("last")).filter("hub <> last").select("word", "hub"))
    second = near.join(hubs, "word").filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    return first.union(second)
