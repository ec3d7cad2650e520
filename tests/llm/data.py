"""Small documents with every awkward case, and helpers."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("label", T.StringType()), ("w", T.LongType()), ("fp", T.LongType()))]
)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def frame(spark, rows):
    """rows: (doc_id, text[, source]); other columns clash with names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or ""), "x", 1, 2) for r in rows], DOCS)


PASSAGE = words(60, 1)
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two"),
    (5, "Ünï \x85 code\x1fwords here and \x0bthere"),
    (6, words(120, 6)),
    (7, words(120, 6)),
    (8, words(120, 6)),
    (8, words(120, 6)),
    (None, words(50, 9)),
    (9, PASSAGE + "\n" + words(30, 10) + "\n" + words(25, 11)),
    (10, words(40, 12) + "\n" + PASSAGE + "\n\n" + words(25, 11)),
    (11, words(3, 13) + " " + PASSAGE + " " + words(3, 14)),
    (12, (words(7, 15) + " ") * 400),
    (13, words(20000, 16)),
    (14, "\n".join([words(8, 17)] * 5)),
    (8, "another text under a known id"),
]
