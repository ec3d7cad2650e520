"""Fill-in-the-middle transformation of documents, over ropes.

A text is cut into units (separators and the word after them). Two cut ranks, drawn from a hash of the seed and the
doc_id, split it into prefix, middle and suffix; a third and a fourth number choose whether it stays as it is and in
which order the parts go. The rope (``rope.py``) is split at the two ranks and the parts are joined with sentinels;
nothing is cut or counted again. The way back looks up the sentinels in the output, splits its rope at their places and
joins the parts in order.

Every document is transformed by itself, whole; there is no shuffle. A task holds one Arrow batch of texts.

Edge cases: a null text is an empty one, and plain; a text that holds a sentinel stays plain, so the way back is
unambiguous; a null doc_id draws from the hash of the seed alone; rows with one doc_id draw equal numbers; extra columns
stay, but for one named as ``into``, which is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.rope import EMPTY, Leaf, Rope, grown, joined, split, text_of

SEED, RATE, SPM_RATE = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def _chain(*parts: str | Rope) -> Rope:
    whole: Rope = EMPTY
    for part in parts:
        whole = joined(whole, Leaf(part, 0) if isinstance(part, str) else part)
    return whole


def transformed(doc_id: int | None, text: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """n (units), form, code points of prefix and middle (None if plain), output."""
    rope = grown(text)
    n = rope.units
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split(rope, last)
    prefix, middle = split(head, first)
    if h4 % 100 < spm_rate:
        form, out = "spm", _chain(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, out = "psm", _chain(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return n, form, prefix.chars, middle.chars, text_of(out)


def restored(output: str, form: str) -> str:
    """The text that was transformed, from the output and its form alone."""
    if form == "plain":
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    # no part holds a sentinel and none overlaps itself or another, so the first one found after the last is it
    places, at = [], 0
    for sentinel in order:
        places.append(output.index(sentinel, at))
        at = places[-1] + len(sentinel)
    rest, parts = grown(output), {}
    for sentinel, place in reversed(list(zip(order, places, strict=True))):
        rest, marked = split(rest, place, "chars")
        parts[sentinel] = split(marked, len(sentinel), "chars")[1]
    return text_of(_chain(parts[PREFIX], parts[MIDDLE], parts[SUFFIX]))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, into: str = "fim") -> DataFrame:
    """All columns of docs and the column ``into``: n, form (plain, psm or spm), prefix_chars, middle_chars, output."""

    @F.pandas_udf(OUT)
    def transform(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transformed(k and int(k), t, seed, rate, spm_rate) for k, t in zip(keys, texts, strict=True)]
        return pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"]).astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    # as text, since a series of numbers with a null among them would be floats
    return docs.withColumn(into, transform(F.col("doc_id").cast("long").cast("string"), F.coalesce("text", F.lit(""))))


def restore(output: str | Column, form: str | Column) -> Column:
    """The original texts of transformed ones."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else restored(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return back(output, form)


def fill_in_middle_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    rows = fill_in_middle(docs.select("doc_id", "text"), into="fim").select("doc_id", "fim.*")
    back = rows.withColumn("restored", restore("output", "form"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '{_UNITS}') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS z,
             CASE WHEN text = '' OR h3 % 100 >= {RATE} OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:z], '') AS m, array_to_string(u[z + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
