"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every statistic is a built-in expression over one row, so the operator has no shuffle and its work
is linear (n log n for the repeated-window count) in the text.

Edge cases: a null or empty text has no words and fails the base rule; repeated rows are judged
alike, each on its own; extra columns are ignored by ``measure`` and kept by ``quality_rules``.
Windows of five words are compared by a 64-bit hash of the five words.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import words

#: Function words of the four languages; prose contains some of them.
STOP_WORDS = (
    *("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "as", "with", "be", "by", "this", "are", "at", "or"),
    *("der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine"),
    *("le", "la", "les", "de", "et", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au"),
    *("el", "los", "las", "y", "del", "se", "por", "con", "no", "una", "su", "para", "al", "lo", "como", "más", "o", "pero"),
)
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document keeps its place while low <= statistic <= high."""

    name: str
    statistic: Callable[[], Column]
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value = self.statistic()
        tests = [value >= self.low] if self.low is not None else []
        tests += [value <= self.high] if self.high is not None else []
        out = F.lit(True)
        for test in tests:
            out = out & test
        return F.coalesce(out, F.lit(False)).alias(f"ok_{self.name}")


def _per_word(column: str) -> Callable[[], Column]:
    return lambda: F.col(column) / F.greatest(F.col("n_words"), F.lit(1))


def _per_line(column: str) -> Callable[[], Column]:
    return lambda: F.col(column) / F.greatest(F.col("n_lines"), F.lit(1))


#: The threshold table. Documents under 50 words are too short to ask for stop words.
RULES = (
    Rule("word_length", _per_word("word_chars"), 2.0, 15.0),
    Rule("symbols", _per_word("n_symbols"), None, 0.1),
    Rule("stop_words", lambda: F.when(F.col("n_words") < 50, F.lit(1.0)).otherwise(F.col("n_stop_words") / F.col("n_words")), 0.01),
    Rule("bullet_lines", _per_line("n_bullet_lines"), None, 0.9),
    Rule("cut_lines", _per_line("n_cut_lines"), None, 0.3),
    Rule("repeated_lines", _per_line("n_dup_lines"), None, 0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body``."""
    return F.transform(F.array(value), body)[0]


def _covered(positions: Column) -> Column:
    """Words covered by windows that start at these sorted positions."""
    steps = F.transform(positions, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def _repeated(pairs: Column) -> Column:
    """Of (hash, position) pairs sorted by hash: words in windows whose hash occurs twice or more."""
    same = lambda x, i: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
    again = F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1))
    return let(F.sort_array(F.transform(again, lambda x: x["p"])), _covered)


def measure(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w, lines = F.col("_words"), F.col("_lines")
    split = docs.withColumns({"_words": words(F.col("text")), "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    grams = F.when(
        F.size(w) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    hashed = split.withColumn("_grams", grams)
    g = F.col("_grams")
    repeated = F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
        let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), _repeated)
    )
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")),
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated,
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))),
        "n_cut_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))),
    }
    return hashed.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("_words", "_lines", "_grams")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the statistics, base_failed, one ok_<rule> column per row of the table, and kept."""
    measured = measure(docs)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = measured.select("*", base.alias("base_failed"), *(r.holds() for r in rules))
    kept = ~F.col("base_failed")
    for r in rules:
        kept = kept & F.col(f"ok_{r.name}")
    return judged.withColumn("kept", kept)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 3)) AS p, w FROM t WHERE len(w) >= 5),
gg AS (SELECT r, p, array_to_string(w[p:p + 4], ' ') AS gram FROM g),
rep AS (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS c FROM gg),
cov AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM rep WHERE c > 1) GROUP BY r),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop,
             len(l) AS n_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) AS n_cut
      FROM t LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 15 AND n_symbols / greatest(n_words, 1) <= 0.1
       AND (n_words < 50 OR n_stop / n_words >= 0.01) AND n_bullet / greatest(n_lines, 1) <= 0.9
       AND n_cut / greatest(n_lines, 1) <= 0.3 AND n_dup_lines / greatest(n_lines, 1) <= 0.3 AS kept
FROM b
"""
