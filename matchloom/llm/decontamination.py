r"""Benchmark decontamination by a distributed positional inverted index.

1. ``build_index`` cuts the corpus into segments (neighbouring documents of a task, up to ``SEGMENT`` words or one
   document) and stores for each the postings of all its terms: sorted hashes of the terms, and per term the
   sorted positions in the segment. Documents follow each other in one row of positions with a gap between
   them, so no match crosses a border. The index is a Parquet table in the shared folder, partitioned by
   document: building and searching it moves nothing between executors, and it serves any benchmark.
2. The benchmark's windows (WINDOW consecutive words; a shorter item is one window) go out in blocks. Items are
   cut into pieces of ``PIECE`` words (overlapping, so that each window is in one) and pieces are dealt to blocks of
   about ``BLOCK`` words, so what is sent has a bound whatever the benchmark's or an item's size.
3. ``frequencies`` counts the block's terms over the whole index. In each segment a window starts from its
   rarest term: its posting list, less the term's place in the window, gives the possible starts, and these are
   intersected with the offset-adjusted lists of the other terms, from rare to common, by binary search.
4. Proximity matches, for windows of WINDOW words: one of the three rarest terms stands at its place, and in all at
   least ``NEAR`` of the window's terms stand within ``SLOP`` words of theirs, in the same document, and the window
   is no phrase match from that start. (Where so many terms are near, one of the three is, so it is enough to
   begin from these.) Rarity is that of the corpus (ties: the earlier place), so no answer depends on segments.

Words: A-Z lower-cased, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``; they are compared by a 64-bit hash.

Edge cases: null texts and texts without words have no windows and no hits; items that are equal all
count; an item_id on several rows is one item with the windows of all its rows; windows of rows without an
item_id hit like any other but are no item; repeated documents are judged alike; an empty benchmark leaves every
document clean; extra columns are ignored by the report and stay in ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import identified, keyed, real_id, stored

WINDOW = 10
SLOP, NEAR, ANCHORS = 3, 8, 3
#: Words of the benchmark that are sent out together, and words of a piece of an item.
BLOCK, PIECE = 200_000, 5_000
SEGMENT = 200_000
#: Postings that are followed at a time.
SLICE = 1_000_000
GAP = WINDOW + SLOP + 2
WORDS_KEPT = 300_000

#: Bytes of UTF-8: A-Z lower-cased, all of ASCII but letters and digits a blank, the rest as it is.
_PLAIN = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def term(word: bytes) -> int:
    """The hash of a word, as a signed number."""
    x = xxhash.xxh64_intdigest(word)
    return x - (1 << 64) if x >= 1 << 63 else x


class Terms(dict):
    """Hashes of words, kept for the words a worker has seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = x = term(word)
        return x


INDEX = "doc_ids array<long>, text_hashes array<long>, n_words array<int>, bases array<long>, terms array<long>, ends array<int>, positions binary"


def _segment(docs: list[tuple[int, int, np.ndarray]]) -> dict:
    sizes = np.array([len(w) for _, _, w in docs], dtype=np.int64)
    bases = np.cumsum(sizes + GAP) - sizes - GAP
    stream = np.concatenate([w for _, _, w in docs])
    places = np.arange(len(stream)) + np.repeat(bases - (np.cumsum(sizes) - sizes), sizes)
    order = np.argsort(stream, kind="stable")
    first = np.flatnonzero(np.diff(stream[order], prepend=stream[order][:1] - 1)) if len(stream) else order
    found, ends = stream[order][first], np.append(first[1:], len(stream)) if len(stream) else first
    return {
        "doc_ids": [d for d, _, _ in docs], "text_hashes": [h for _, h, _ in docs], "n_words": sizes.astype(np.int32), "bases": bases,
        "terms": found, "ends": ends.astype(np.int32), "positions": places[order].astype("<i4").tobytes(),
    }


def build_index(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per segment, with the postings of all its terms; lazily, store it to search it."""

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held, n = Terms(), [], 0
        for rows in batches:
            for doc_id, text_hash, text in zip(rows.doc_id, rows.text_hash, rows.text, strict=True):
                w = tokens(text)
                if held and n + len(w) > segment:
                    yield pd.DataFrame([_segment(held)])
                    held, n = [], 0
                held.append((doc_id, text_hash, np.fromiter(map(known.__getitem__, w), dtype=np.int64, count=len(w))))
                n += len(w) + GAP
        if held:
            yield pd.DataFrame([_segment(held)])

    return identified(docs).mapInPandas(segments, INDEX)


@dataclass
class Windows:
    """A block of the benchmark: terms, and per window its terms by number (-1 beyond its length), item (-1: none) and order of places from rare to common."""

    terms: np.ndarray
    grid: np.ndarray
    item: np.ndarray
    names: list[str]
    order: np.ndarray = field(default_factory=lambda: np.zeros((0, WINDOW), dtype=np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    @property
    def length(self) -> np.ndarray:
        return (self.grid >= 0).sum(1)

    def rank(self, counts: np.ndarray) -> Windows:
        """With the terms' counts in the corpus."""
        of = np.where(self.grid >= 0, counts[np.maximum(self.grid, 0)] if len(counts) else 0, np.iinfo(np.int64).max)
        return Windows(self.terms, self.grid, self.item, self.names, np.argsort(of, axis=1, kind="stable"), counts)


def windows(items: list[tuple[str | None, list[bytes]]]) -> Windows:
    """Distinct windows of (item, words)."""
    numbers: dict[int, int] = {}
    names: dict[str, int] = {}
    rows: dict[tuple[int, tuple[int, ...]], None] = {}
    for name, words in items:
        n = -1 if name is None else names.setdefault(name, len(names))
        w = [numbers.setdefault(term(x), len(numbers)) for x in words]
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            rows[n, tuple(w[i : i + WINDOW])] = None
    grid = np.full((len(rows), WINDOW), -1, dtype=np.int64)
    for k, (_, w) in enumerate(rows):
        grid[k, : len(w)] = w
    return Windows(np.array(list(numbers), dtype=np.int64), grid, np.array([n for n, _ in rows], dtype=np.int64), list(names))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for item, text in zip(rows.item, rows.text, strict=True):
            w = tokens(text)
            for at in range(0, max(1, len(w) - WINDOW + 1) if w else 0, PIECE):
                out.append((item, at, w[at : at + PIECE + WINDOW - 1]))
        yield pd.DataFrame(out, columns=["item", "at", "words"])


def blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[Windows]:
    """The benchmark in blocks of about ``block`` words; at least one."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text is not null")
    pieces = stored(rows.mapInPandas(_pieces, "item string, at int, words array<binary>").withColumn("turn", F.xxhash64("item", "at", "words")))
    n = max(1, -(-int(pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]) // block))
    for k in range(n):
        part = pieces.filter(F.pmod("turn", F.lit(n)) == k).select("item", "words").distinct().collect()
        yield windows([(r["item"], [bytes(x) for x in r.words]) for r in part])


class Segment:
    """The postings that one segment has of a block's terms, ready for intersection."""

    def __init__(self, row: tuple, terms: np.ndarray) -> None:
        own, ends = np.asarray(row.terms, dtype=np.int64), np.asarray(row.ends, dtype=np.int64)
        at = np.minimum(np.searchsorted(own, terms), max(0, len(own) - 1))
        has = own[at] == terms if len(own) else np.zeros(len(terms), bool)
        begin = np.concatenate(([0], ends))[at]
        n = np.where(has, ends[at] - begin, 0) if len(own) else np.zeros(len(terms), dtype=np.int64)
        self.last = np.cumsum(n)
        self.first = self.last - n
        positions = np.frombuffer(row.positions, dtype="<i4")
        take = np.repeat(begin - self.first, n) + np.arange(n.sum()) if n.any() else np.zeros(0, dtype=np.int64)
        self.positions = positions[take].astype(np.int64)
        self.span = (int(self.positions.max()) if len(self.positions) else 0) + 4 * GAP
        # (term, position) as one sorted number: a binary search finds a position in any term's list
        self.keys = np.repeat(np.arange(len(terms)), n) * self.span + self.positions

    def within(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Does the term stand within slop of this place?"""
        if not len(self.keys):
            return np.zeros(len(term), bool)
        low = np.searchsorted(self.keys, term * self.span + np.maximum(place - slop, 0))
        return (low < len(self.keys)) & (place + slop >= 0) & (self.keys[np.minimum(low, len(self.keys) - 1)] <= term * self.span + np.minimum(place + slop, self.span - 1))

    def starts(self, q: Windows, rows: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position of its term at place ``at``) for all postings, a slice at a time."""
        term = q.grid[rows, at]
        n = np.where(term >= 0, self.last[term] - self.first[term], 0)
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        for begin in range(0, total, SLICE):
            x = np.arange(begin, min(begin + SLICE, total))
            k = np.searchsorted(upto, x, side="right")
            yield k, self.positions[self.first[term[k]] + x - (upto[k] - n[k])]


def phrases(segment: Segment, q: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Windows and starts of phrase matches."""
    found = [(np.zeros(0, dtype=np.int64),) * 2]
    rows = np.flatnonzero((segment.last > segment.first)[np.maximum(q.grid, 0)].all(1, where=q.grid >= 0)) if len(q.terms) else np.zeros(0, dtype=np.int64)
    for k, p in segment.starts(q, rows, q.order[rows, 0]):
        w = rows[k]
        start = p - q.order[w, 0]
        ok = start >= 0
        w, start = w[ok], start[ok]
        for j in range(1, WINDOW):
            at = q.order[w, j]
            t = q.grid[w, at]
            ok = (t < 0) | segment.within(np.maximum(t, 0), start + at, 0)
            w, start = w[ok], start[ok]
        found.append((w, start))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearby(segment: Segment, q: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Windows of proximity matches, and the position of the term they were found from."""
    found = [(np.zeros(0, dtype=np.int64),) * 2]
    present = (segment.last > segment.first)[np.maximum(q.grid, 0)].sum(1, where=q.grid >= 0) if len(q.terms) else np.zeros(len(q.grid))
    rows = np.flatnonzero((q.length == WINDOW) & (present >= NEAR))
    for a in range(ANCHORS):
        for k, p in segment.starts(q, rows, q.order[rows, a]):
            w = rows[k]
            start = p - q.order[w, a]
            score, exact = np.ones(len(w), dtype=np.int64), np.ones(len(w), bool)
            for j in range(WINDOW):
                if j == a:
                    continue
                at = q.order[w, j]
                t, place = q.grid[w, at], start + at
                score += segment.within(t, place, SLOP)
                exact &= segment.within(t, place, 0)
                # beyond hope of NEAR terms
                ok = score + WINDOW - 1 - j - (a > j) >= NEAR
                w, p, start, score, exact = w[ok], p[ok], start[ok], score[ok], exact[ok]
            found.append((w[~exact], p[~exact]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each term occurs in the corpus, from the lists' lengths alone."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def of_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(sent.value), dtype=np.int64)
        for rows in batches:
            for own, ends in zip(rows.terms, rows.ends, strict=True):
                own, ends = np.asarray(own), np.asarray(ends)
                if len(own):
                    at = np.minimum(np.searchsorted(own, sent.value), len(own) - 1)
                    total += np.where(own[at] == sent.value, np.diff(ends, prepend=0)[at], 0)
        has = np.flatnonzero(total)
        yield pd.DataFrame({"term": has, "n": total[has]})

    counts = np.zeros(len(terms), dtype=np.int64)
    for r in index.select("terms", "ends").mapInPandas(of_segments, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r.term] = r.n
    return counts


MATCHES = "part int, segment long, row long, doc_id long, text_hash long, n_words long, hits array<int>, items array<string>, near_items array<string>"


def search(index: DataFrame, q: Windows, proximity: bool = True, part: int = 0) -> DataFrame:
    """Per document: part (of the benchmark), segment and row (its place in the index), n_words, positions of words in phrase matches, items with phrase and with proximity matches."""
    sent = index.sparkSession.sparkContext.broadcast(q)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = sent.value
        for segments in batches:
            for row in segments.itertuples():
                own = Segment(row, block.terms)
                w, start = phrases(own, block)
                near_w, near_p = nearby(own, block) if proximity else (w[:0], start[:0])
                bases = np.asarray(row.bases)
                hits, items, near = {}, {}, {}
                for d, s, x in zip(np.searchsorted(bases, start, side="right") - 1, start, w, strict=True):
                    hits.setdefault(d, []).append(np.arange(s - bases[d], s - bases[d] + (block.grid[x] >= 0).sum()))
                    if block.item[x] >= 0:
                        items.setdefault(d, set()).add(block.names[block.item[x]])
                for d, x in set(zip((np.searchsorted(bases, near_p, side="right") - 1).tolist(), near_w.tolist(), strict=True)):
                    if block.item[x] >= 0:
                        near.setdefault(d, set()).add(block.names[block.item[x]])
                docs, none = range(len(bases)), np.zeros(0, dtype=np.int32)
                yield pd.DataFrame(
                    {
                        "part": part, "segment": row.segment, "row": np.arange(len(bases)), "doc_id": row.doc_ids, "text_hash": row.text_hashes, "n_words": np.asarray(row.n_words, dtype=np.int64),
                        "hits": [np.unique(np.concatenate(hits[d])).astype(np.int32) if d in hits else none for d in docs],
                        "items": [sorted(items.get(d, ())) for d in docs], "near_items": [sorted(near.get(d, ())) for d in docs],
                    }
                )

    return index.mapInPandas(found, MATCHES)


def matches(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, proximity: bool = True) -> DataFrame:
    """doc_id, text_hash, n_words, hits, items, near_items: one row per document, over all blocks of the benchmark."""
    index = stored(build_index(docs))
    # a document is known by its segment and its place in it: the number of a segment has that of its partition in its upper bits, so nothing is added to it
    index = index.withColumn("segment", F.monotonically_increasing_id())
    found = []
    for k, q in enumerate(blocks(benchmark, block)):
        counts = frequencies(index, q.terms) if len(q.terms) else np.zeros(0, dtype=np.int64)
        found.append(search(index, q.rank(counts), proximity, k))
    if len(found) == 1:
        return found[0].drop("part", "segment", "row")
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    # the rows of one document, one of each block
    merge = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return both.groupBy("segment", "row", "doc_id", "text_hash", "n_words").agg(merge("hits"), merge("items"), merge("near_items")).drop("segment", "row")


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; n_near, near_sha256 (items with proximity matches)."""
    n_hit = F.size("hits").cast("long")
    sha = lambda c: F.sha2(F.concat_ws(",", F.sort_array(c)), 256)
    return matches(docs, benchmark).select(
        real_id(), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha("items").alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"), sha("near_items").alias("near_sha256"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a phrase match of the benchmark."""
    rows, key = keyed(docs)
    dirty = matches(docs, benchmark, proximity=False).filter(F.size("hits") > 0).select(F.struct("doc_id", "text_hash").alias(key))
    return rows.join(dirty.distinct(), key, "left_anti").drop(key)


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bv AS (SELECT DISTINCT item_id, w[p:p + 9] AS v FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM b WHERE len(w) > 0)),
bw AS (SELECT item_id, len(v) AS n, array_to_string(v, ' ') AS gram FROM bv),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
m AS (SELECT r, p, n, item_id FROM dw JOIN bw USING (n, gram)),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY r),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM m)) GROUP BY r),
-- proximity: postings, windows of 10 words, and their three rarest terms
post AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM d),
df AS (SELECT t, count(*) AS c FROM post GROUP BY t),
wi AS (SELECT row_number() OVER () AS x, item_id, v FROM bv WHERE len(v) = {WINDOW}),
wt AS (SELECT x, unnest(range(1, {WINDOW + 1})) AS k, unnest(v) AS t FROM wi),
wr AS (SELECT x, k, t, row_number() OVER (PARTITION BY x ORDER BY coalesce(c, 0), k) AS rarity FROM wt LEFT JOIN df USING (t)),
cand AS (SELECT DISTINCT x, r, p - k AS s FROM wr JOIN post USING (t) WHERE rarity <= {ANCHORS}),
near AS (SELECT x, r, s, k, max(CASE WHEN p = s + k THEN 1 ELSE 0 END) AS exact
         FROM cand JOIN wt USING (x) JOIN post USING (r, t) WHERE p BETWEEN s + k - {SLOP} AND s + k + {SLOP} GROUP BY x, r, s, k),
nm AS (SELECT x, r, s FROM near GROUP BY x, r, s HAVING count(*) >= {NEAR} AND sum(exact) < {WINDOW}),
ni AS (SELECT r, count(DISTINCT item_id) AS n_near, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM nm JOIN wi USING (x) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(ni.items, '')) AS near_sha256
FROM d LEFT JOIN i USING (r) LEFT JOIN h USING (r) LEFT JOIN ni USING (r)
"""
