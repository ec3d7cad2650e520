"""Names as read from a feed: folding of look-alike glyphs and similarity. Small vectorised helpers."""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Glyphs that the feed's font confuses; a glyph in two classes belongs to the later one.
GLYPH_CLASSES = ("0oOQDØø", "1lIi|!jJ", "2zZ", "3", "4A", "5sS", "6GgbB8Ee", "79gq", "TtPF", "cC", "nmhM", "uvUV", "rR", "wW", "xX", "kK", "aA", "dD", "yY", "L")
#: Stylised letters that compatibility normalisation leaves alone, by the letter they stand for.
LOOK_ALIKES = {
    "O": "ØøΟОѲ", "A": "ΛΔ∆АΑ", "D": "ÐĐƉ", "E": "ΕЕЄ€Ξ", "B": "ΒВβ", "P": "ΡР", "C": "СϹ¢", "K": "ΚКκ", "M": "ΜМ", "H": "ΗН", "T": "ΤТ", "N": "Ν",
    "X": "ΧХ", "Y": "ΥУ", "I": "ΙІ|", "S": "Ѕ$", "Z": "Ζ", "U": "Ս", "R": "Ʀ", "G": "Ɠ", "L": "Ⅼ", "F": "Ϝ",
}
#: Small capitals, in the order of the letters below them.
SMALL_CAPITALS = ("ᴀᴃᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "ABCDEFGHIJKLMNOPRSTUVWYZ")

_GLYPHS = {glyph: "abcdefghijklmnopqrstuvwxyz"[i] for i, glyphs in enumerate(GLYPH_CLASSES) for glyph in glyphs}
_LETTERS = str.maketrans({x: letter for letter, glyphs in LOOK_ALIKES.items() for x in glyphs} | dict(zip(*SMALL_CAPITALS, strict=True)))
_OTHER = re.compile("[^A-Za-z0-9]+")


def folded(name: str | None) -> str:
    """A name with every confusable glyph replaced by its class."""
    plain = _OTHER.sub("", unicodedata.normalize("NFKC", name or "").translate(_LETTERS))
    return "".join(_GLYPHS.get(c) or c.lower() for c in plain)


def similarity(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@functools.lru_cache(maxsize=1 << 16)
def _known_similarity(a: str, b: str) -> float:
    """Rooms share names, so a task meets the same pairs again and again."""
    return similarity(a, b)


def fold_name(column: str | Column) -> Column:
    def fold(names: pd.Series) -> pd.Series:
        return names.map(folded)

    return F.pandas_udf(fold, "string")(column)


def seq_ratio(a: str | Column, b: str | Column) -> Column:
    """Similarity of two folded names, 0 to 1."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_known_similarity(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(ratio, "double")(a, b)


def simple_norm(column: str | Column) -> Column:
    """Without white space, lower case, o for ø and 0."""
    return F.translate(F.lower(F.regexp_replace(column, r"\s+", "")), "ø0", "oo")


def clean_reading(column: str | Column) -> Column:
    """Letters, digits and _-. only."""
    return F.regexp_replace(column, r"[^\p{L}\p{N}_.\-]", "")


def mmss(seconds: str | Column) -> Column:
    """Seconds as MM:SS.ss."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    whole = F.floor(s / 60)
    return F.format_string("%02d:%05.2f", whole.cast("long"), (s - whole * 60).cast("double"))


def recorded_at_from_name(file_name: str | Column) -> Column:
    """The time in a recording's name (YYYY-MM-DD HH-MM-SS, with a space or an underscore); null if there is none."""
    parts = F.regexp_extract(file_name, r"(\d{4}-\d{2}-\d{2})[ _](\d{2}-\d{2}-\d{2})", 0)
    day, time = F.substring(parts, 1, 10), F.translate(F.substring(parts, 12, 8), "-", ":")
    return F.when(parts != "", F.concat(day, F.lit(" "), time))
