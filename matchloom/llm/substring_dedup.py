"""Substring dedup with suffix automata of reference shards.

A window is ``WINDOW`` consecutive words; every word covered by a window whose words also start anywhere else
in the corpus is removed. All documents are reference and stream at once, so shards cannot be sent to all
tasks (their size grows with the corpus, and each document would visit each shard). Instead each window is
routed to the one shard where all its equals go:

1. Each window selects the least hash among its ``ANCHOR``-word grams (the first of equals). Neighbouring
   windows that select the same place form a segment of at most 62 words; every window is in just one
   segment, and equal windows select equal anchors. Computed in numpy from 64-bit hashes of the words.
2. Anchors that were selected at one place only hold no repeat and go (aggregated before the shuffle).
3. Equal segments of an anchor are one class with a count; only one example of a class brings its words.
4. A shard is the classes of some anchors; per anchor a generalised suffix automaton of its classes is built,
   with occurrences weighted by class counts, and each class streams through it for matching statistics:
   at each word, the longest stretch ending there that occurs twice or more. Stretches of WINDOW words and
   more are the maximal repeated spans.
   Where an anchor has very many classes (a frequent phrase between ever-changing neighbours), no shard could
   hold them. Its segments are cut into single windows, and the windows' hashes are counted by a Spark
   aggregation, which adds up before it shuffles; so nothing grows with the frequency of a phrase.
5. The spans go back to the places of their class, and the words under them leave the documents.

Words are compared by a 64-bit hash, seeded apart from the hash of windows.

Edge cases: null and empty texts have no words; documents under WINDOW words lose nothing; a repeated row
(same doc_id and text) is a second occurrence, so all its windows go; extra columns stay, but for one named as
``into``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import fresh, identified, keyed, stored, words

WINDOW = 35
ANCHOR = 8
#: Classes of an anchor above which its windows are routed one by one.
MANY_CLASSES = 2000
#: Words of a document handled at a time; blocks overlap so that each window is in one.
BLOCK = 1 << 22
_PLACE_BITS = np.uint64(23)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every stretch of ``span`` values, over stretches of doubling length."""
    done = 1
    while done < span:
        step = min(done, span - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def segments(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of words, anchor hash and class hash of each segment of one block of hashed words (uint64)."""
    n, span = len(w), WINDOW - ANCHOR + 1
    with np.errstate(over="ignore"):
        powers, back = np.cumprod(np.full(n + 1, _BASE)), np.cumprod(np.full(n + 1, _INVERSE))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(w * powers[:n])))
        grams = _mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * back[: n + 1 - ANCHOR])
        # the upper bits of the hash, then the place: the minimum is the first of the least
        marked = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
        places = (_least(marked, span) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
        end = np.concatenate((start[1:], [len(places)])) - 1 + WINDOW
        place = places[start]
        # a class is told by its words, their number, and where its anchor is
        kind = _mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * _MIX + (place - start).astype(np.uint64) * _INVERSE)
    return start, end - start, grams[place], kind


PLACES = "doc_id long, text_hash long, s int, n int, anchor long, class long"


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        found: list[tuple] = []
        owner: list[int] = []
        for i, w in enumerate(rows.w):
            w = np.asarray(w, dtype=np.int64).view(np.uint64)
            for at in range(0, len(w) - WINDOW + 1, BLOCK):
                s, n, anchor, kind = segments(w[at : at + BLOCK + WINDOW - 1])
                found.append((s + at, n, anchor, kind))
                owner += [i] * len(s)
        if found:
            s, n, anchor, kind = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pd.DataFrame(
                {
                    "doc_id": rows.doc_id.to_numpy()[owner], "text_hash": rows.text_hash.to_numpy()[owner], "s": s.astype(np.int32), "n": n.astype(np.int32),
                    "anchor": anchor.view(np.int64), "class": kind.view(np.int64),
                }
            )


def hashed_words() -> Column:
    """Hashes of the words of the column text."""
    return F.transform(words(F.col("text")), lambda x: F.xxhash64(F.lit(WINDOW), x)).alias("w")


class Automaton:
    """Generalised suffix automaton of sequences with counts."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, sequence: list[int], count: int) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)
            self.count[last] += count

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # already there, from another sequence
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def close(self) -> None:
        """Counts of all states: a state occurs wherever those that it ends occur."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def repeated_ends(self, sequence: list[int], least: int) -> list[int]:
        """Matching statistics of a sequence in the automaton: ends where a stretch of ``least`` and more occurs twice or more."""
        state, out = 0, []
        for i, c in enumerate(sequence):
            state = self.next[state][c]  # the sequence is in the automaton
            at = state
            while at > 0 and self.count[at] < 2:
                at = self.link[at]
            if self.length[max(at, 0)] >= least:
                out.append(i + 1)
        return out


CUT = "anchor long, class long, offset int, count long, window long, w array<long>"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of the examples; of busy anchors the hash of each window instead."""
    seen: set[tuple[int, int]] = set()
    for rows in batches:
        out = []
        for key, w, wanted in zip(zip(rows.doc_id, rows.text_hash, strict=True), rows.w, rows.wanted, strict=True):
            if key in seen:  # a repeated row has the same examples
                continue
            seen.add(key)
            w = np.asarray(w, dtype=np.int64)
            for x in wanted:
                part = w[x["s"] : x["s"] + x["n"]]
                if x["busy"]:
                    out += [(x["anchor"], x["class"], i, x["count"], _hash(part[i : i + WINDOW]), None) for i in range(len(part) - WINDOW + 1)]
                else:
                    out.append((x["anchor"], x["class"], 0, x["count"], None, part))
        table = pd.DataFrame(out, columns=["anchor", "class", "offset", "count", "window", "w"])
        yield table.astype({"window": "Int64"})


def _hash(window: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(window.tobytes()) >> 1


def _repeated(members: list[tuple]) -> Iterator[tuple]:
    """(anchor, class, mask) of the classes (anchor, class, count, w) of one anchor."""
    automaton = Automaton()
    for _, _, count, w in members:
        automaton.add(w, count)
    automaton.close()
    for anchor, kind, _, w in members:
        ends = automaton.repeated_ends(w, WINDOW)
        if ends:
            yield anchor, kind, sum(1 << (e - WINDOW) for e in ends), None, None, None


FOUND_SPANS = "anchor long, class long, mask long, offset int, count long, window long"


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (anchor, class, offset): one automaton at a time; windows of busy anchors go through, once each."""
    here, last, members, out = None, None, [], []
    columns = ["anchor", "class", "mask", "offset", "count", "window"]
    table = lambda found: pd.DataFrame(found, columns=columns).astype({c: "Int64" for c in columns})
    for rows in batches:
        for anchor, kind, offset, count, window, w in zip(rows.anchor, rows["class"], rows.offset, rows["count"], rows.window.astype("Int64"), rows.w, strict=True):
            if anchor != here:
                out += _repeated(members)
                here, members = anchor, []
            if (anchor, kind, offset) == last:  # a repeated row brings the same example again
                continue
            last = anchor, kind, offset
            if w is None:
                out.append((anchor, kind, None, offset, count, window))
            else:
                members.append((anchor, kind, count, w.tolist()))
        yield table(out)
        out = []
    yield table(list(_repeated(members)))


def repeated_places(docs: DataFrame, many: int = MANY_CLASSES) -> DataFrame:
    """doc_id, text_hash, s, mask: segments with repeated windows; bit i of mask is the window at word s + i."""
    texts = identified(docs)
    places = texts.select("doc_id", "text_hash", hashed_words()).mapInPandas(_places, PLACES)
    # what is aggregated is stored before it is joined: the join then deals both sides anew, and a very frequent key can be split
    again = stored(places.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"))
    kept = stored(places.join(again, "anchor", "left_semi"))
    classes = stored(kept.groupBy("anchor", "class").agg(F.count("*").alias("count"), F.min(F.struct("doc_id", "text_hash", "s", "n")).alias("x")))
    busy = stored(classes.groupBy("anchor").agg(F.count("*").alias("c")).filter(F.col("c") > many).select("anchor", F.lit(True).alias("busy")))
    told = classes.join(busy, "anchor", "left").select("anchor", "class", "count", "x.*", F.coalesce("busy", F.lit(False)).alias("busy"))
    wanted = told.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("s", "n", "anchor", "class", "count", "busy")).alias("wanted"))
    # texts travel as they are: hashes of words hardly compress
    cut = texts.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text_hash", hashed_words(), "wanted").mapInPandas(_cut, CUT)
    # a busy anchor is dealt by its classes, any other goes to one task
    turn = F.when(F.col("w").isNull(), F.col("class")).otherwise(F.col("anchor"))
    shards = cut.withColumn("turn", turn).repartition("turn").sortWithinPartitions("turn", "anchor", "class", "offset").drop("turn")
    found = stored(shards.mapInPandas(_shards, FOUND_SPANS))
    windows = found.filter("window is not null")
    twice = stored(windows.groupBy("window").agg(F.sum("count").alias("c")).filter("c > 1").select("window"))
    of_windows = windows.join(twice, "window").select("anchor", "class", F.expr("shiftleft(1L, offset)").alias("mask"))
    masks = stored(found.filter("mask is not null").select("anchor", "class", "mask").union(of_windows).groupBy("anchor", "class").agg(F.bit_or("mask").alias("mask")))
    return kept.join(masks, ["anchor", "class"]).select("doc_id", "text_hash", "s", "mask")


def covered(s: np.ndarray, mask: np.ndarray, n_words: int) -> np.ndarray:
    """Which of a document's words are covered by the windows of its masks."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    for i in range(WINDOW - ANCHOR + 1):
        at = s[(mask >> i) & 1 == 1] + i
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


FOUND = "kept string, n_words long, n_removed long, spans array<struct<s:int,e:int>>"


def _without(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
    out = []
    for text, found in zip(texts, marks, strict=True):
        w = text.encode().split()  # on ASCII white space, as in the contract
        if found is None or not len(found):
            out.append((b" ".join(w).decode(), len(w), 0, []))
            continue
        gone = covered(np.array([x["s"] for x in found], dtype=np.int64), np.array([x["mask"] for x in found], dtype=np.int64), len(w))
        turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        spans = [{"s": int(a), "e": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)]
        out.append((b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), len(w), int(gone.sum()), spans))
    return pd.DataFrame(out, columns=["kept", "n_words", "n_removed", "spans"])


def substring_dedup(docs: DataFrame, many: int = MANY_CLASSES, into: str = "substring_dedup") -> DataFrame:
    """All columns of docs with ``into``: kept (words that stay, joined by a space), n_words, n_removed, spans (of words removed)."""
    rows, key = keyed(docs)
    marks = fresh(rows, "marks")
    # a set, since all copies of a row have the same places; stored, so that a row which is repeated very often can be split among tasks
    found = stored(repeated_places(docs, many).groupBy(F.struct("doc_id", "text_hash").alias(key)).agg(F.collect_set(F.struct("s", "mask")).alias(marks)))
    return rows.join(found, key, "left").withColumn(into, F.pandas_udf(_without, FOUND)(F.coalesce("text", F.lit("")), marks)).drop(key, marks)


def substring_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    rows = substring_dedup(docs.select("doc_id", "text"), into="found")
    return rows.select("doc_id", "found.n_words", "found.n_removed", F.sha2(F.col("found.kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, p, hash(w[p:p + {WINDOW - 1}]) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW})),
m AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + {WINDOW})) AS i FROM m),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
