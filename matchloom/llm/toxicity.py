"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (and of itself), a window of words is the
mean of its words, and a linear softmax over two classes reads that mean. Misspellings and unseen
endings share n-grams with words that were seen. Vectors and softmax are trained jointly in numpy.
A document is as toxic as its most toxic window of ``WINDOW`` words, so length does not thin out an
insult; training picks windows of a document the same way (multiple-instance learning). In the same way a long run of
word characters (texts without spaces, joined words) is a row of overlapping stretches of ``STRETCH`` code points: each has
its n-grams of the word as it stands, and the vector of the whole word. Only the ends of the word itself are marked as ends.

The model is fitted on a bounded sample, by parameters of ``fit``: at most ``most_toxic`` and ``most_clean`` labelled
documents outside the held-out third, those with the smallest hash of doc_id, and of either kind as many of these, in
that order, as have ``most_chars`` characters together. It is calibrated on scores of models that did not see the
document (three folds). Scoring reads all documents in one pass without a shuffle; since the model is linear, a word's
share of the score is one number, which each worker keeps for the words it has seen (up to ``WORDS_KEPT``, then it starts anew).

Edge cases: a null or empty text gets the score of a window of no words; labels other than 0 and 1 and
labels that contradict each other are not used; of texts under one labelled doc_id the smallest is learnt; without
labels of both kinds every score is 0; extra columns stay, but for one named as ``into``, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import stored

MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 3000, 5000, 12_000_000
WINDOW = 2
BUCKET_BITS, DIM, GRAMS = 17, 8, (3, 4, 5, 6)
#: Code points of a stretch of a long word, and of its overlap with the next, which is longer than an n-gram.
STRETCH, OVERLAP = 32, 8
BUCKETS = 1 << BUCKET_BITS
ROUNDS, BATCH, RATE = 8, 64, 0.2
MORE_WINDOWS = 12_000
FOLDS = 3
WORDS_KEPT = 300_000
#: Words whose n-grams are worked out at a time.
PART = 20_000
THRESHOLD = 0.7

_WORD = re.compile(r"\w+")
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens(text: str | None) -> list[str]:
    """The words of a text with their ends marked; of a long word its stretches, each followed by the hash of the word."""
    found = [f"<{w}>" for w in _WORD.findall(text.lower())] if text else []
    if all(len(w) <= STRETCH for w in found):
        return found
    return [x for w in found for x in ((w,) if len(w) <= STRETCH else _stretches(w))]


def _stretches(word: str) -> list[str]:
    whole = f"\n{_hash(word):016x}"
    return [word[at : at + STRETCH] + whole for at in range(0, len(word) - OVERLAP, STRETCH - OVERLAP)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _hash(word: str) -> int:
    """The sum of code points by powers of the factor, a part at a time."""
    total, powers = 0, np.cumprod(np.full(min(len(word), PART), _FACTOR))
    for at in range(0, len(word), PART):
        points = _points(word[at : at + PART])
        total += int((points * powers[: len(points)]).sum()) * pow(int(_FACTOR), at, 1 << 64)
    return total % (1 << 64)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the words (as ``tokens`` gives them) and of the words themselves, and which word each belongs to.

    All words lie in one row of code points; a hash of n of these is that of n - 1 and one more, for all places at once.
    """
    parts = [w.partition("\n") for w in words]
    marked = [p[0] for p in parts]
    points = _points("".join(marked))
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(starts + sizes, sizes) - np.arange(len(points))  # code points from here to the end of the word
    with np.errstate(over="ignore"):
        h, found, of = points.copy(), [], []
        for n in range(2, GRAMS[-1] + 1):
            h = h[:-1] * _FACTOR + points[n - 1 :]
            if n >= GRAMS[0]:
                ok = room[: len(h)] >= n
                found.append(h[ok] + np.uint64(n))
                of.append(owner[: len(h)][ok])
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        whole = np.add.reduceat(points * np.cumprod(np.full(int(sizes.max()), _FACTOR))[place], starts)
        for i, p in enumerate(parts):
            if p[2]:
                whole[i] = int(p[2], 16)
        found.append(whole)
        of.append(np.arange(len(words)))
        mixed = np.concatenate(found) * _MIX
    return ((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), np.concatenate(of).astype(np.int32)


def grams_by_word(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' buckets, word after word, and how many each has; a part of the words at a time."""
    flat, sizes = [], []
    for at in range(0, len(words), PART):
        part = words[at : at + PART]
        buckets, of = grams(part)
        flat.append(buckets[np.argsort(of, kind="stable")])
        sizes.append(np.bincount(of, minlength=len(part)))
    return np.concatenate(flat), np.concatenate(sizes).astype(np.int64)


@dataclass
class Model:
    """shares: what a bucket adds to the log-odds; slope and offset: calibration of the best window."""

    shares: np.ndarray
    slope: float
    offset: float

    def word_shares(self, words: list[str]) -> np.ndarray:
        buckets, of = grams(words)
        return np.bincount(of, self.shares[buckets], len(words)) / np.bincount(of, minlength=len(words))

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -30, 30)))


def best_window(shares: np.ndarray) -> tuple[int, float]:
    """Start and mean of the window of WINDOW words (all, if fewer) with the greatest mean."""
    n = len(shares)
    if n <= WINDOW:
        return 0, float(shares.mean()) if n else 0.0
    sums = np.cumsum(np.concatenate(([0.0], shares)))
    means = (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW
    at = int(means.argmax())
    return at, float(means[at])


def _vectors(docs: list[np.ndarray], y: np.ndarray, use: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray, first: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Trains on the documents of use from a first share of each bucket; gives what each bucket adds to the log-odds, and each known word's share."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.02, (BUCKETS, DIM))
    softmax = rng.normal(0, 0.1, (DIM, 2))
    bias = np.zeros(2)
    dims = np.arange(DIM)
    seen_v, seen_s, seen_b = np.full(BUCKETS, 1e-3), np.full((DIM, 2), 1e-3), np.full(2, 1e-3)

    def word_shares() -> np.ndarray:
        per_bucket = vectors @ (softmax[:, 1] - softmax[:, 0])
        out = np.empty(len(sizes))
        for at in range(0, len(sizes), PART):
            s, n = starts[at : at + PART], sizes[at : at + PART]
            out[at : at + PART] = np.add.reduceat(per_bucket[flat[s[0] : s[-1] + n[-1]]], s - s[0]) / n
        return out

    def sums(place: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Sums of the rows of each place, in one count."""
        return np.bincount((place[:, None] * DIM + dims).ravel(), rows.ravel(), n * DIM).reshape(n, DIM)

    def step(picked: list[np.ndarray], truth: np.ndarray, weight: np.ndarray) -> None:
        nonlocal softmax, bias
        lengths = np.array([len(p) for p in picked])
        w = np.concatenate(picked)
        owner = np.repeat(np.arange(len(picked)), lengths)
        n = sizes[w]
        grams = np.repeat(starts[w] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
        ids, of = flat[grams], np.repeat(owner, n)
        each = np.repeat(1.0 / (n * lengths[owner]), n)
        mean = sums(of, vectors[ids] * each[:, None], len(picked))
        z = mean @ softmax + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - np.stack([1 - truth, truth], 1)) * weight[:, None] / len(truth)
        slope_s, slope_b, back_v = mean.T @ error, error.sum(0), error @ softmax.T
        distinct, inverse = np.unique(ids, return_inverse=True)
        slope_v = sums(inverse, back_v[of] * each[:, None], len(distinct))
        seen_v[distinct] += (slope_v**2).mean(1)
        vectors[distinct] -= RATE * slope_v / np.sqrt(seen_v[distinct])[:, None]
        seen_s.__iadd__(slope_s**2)
        seen_b.__iadd__(slope_b**2)
        softmax -= 0.1 * slope_s / np.sqrt(seen_s)
        bias -= 0.1 * slope_b / np.sqrt(seen_b)

    vectors[:, 0] = first / 2
    softmax[0] = -1, 1
    more = int(np.clip(MORE_WINDOWS / max(1, len(use)), 0, 10))
    for _ in range(ROUNDS):
        shares = word_shares()
        windows, of_doc = [], []
        for i in use:
            d = docs[i]
            # the worst window of each document, and some more of the clean ones
            at = [best_window(shares[d])[0]]
            at += rng.integers(max(1, len(d) - WINDOW + 1), size=more).tolist() if y[i] == 0 else []
            windows += [d[x : x + WINDOW] for x in at]
            of_doc += [i] * len(at)
        of_doc = np.array(of_doc)
        weight = np.where(y[of_doc] == 1, 0.5 / max(1, (y[of_doc] == 1).sum()), 0.5 / max(1, (y[of_doc] == 0).sum())) * len(of_doc)
        order = rng.permutation(len(windows))
        for b in range(0, len(order), BATCH):
            rows = order[b : b + BATCH]
            step([windows[i] for i in rows], y[of_doc[rows]], weight[rows])
    return vectors @ (softmax[:, 1] - softmax[:, 0]), word_shares()


def _holders(docs: list[np.ndarray], y: np.ndarray, fold: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """How many documents of each fold and label hold a bucket."""
    count = np.zeros((FOLDS, 2, BUCKETS))
    for d, label, k in zip(docs, y.astype(int), fold, strict=True):
        if len(d):
            w = np.unique(d)
            n = sizes[w]
            held = np.unique(flat[np.repeat(starts[w] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())])
            count[k, label, held] += 1
    return count


def _first_shares(count: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-odds over their standard error, by the number of documents of either label that hold a bucket: the start of the first dimension."""
    odds = np.log((count[1] + 0.5) / (y.sum() + 1)) - np.log((count[0] + 0.5) / ((1 - y).sum() + 1))
    return odds / np.sqrt(1 / (count[1] + 0.5) + 1 / (count[0] + 0.5)) * (count.sum(0) > 1)


def train(texts: Iterable[str], labels: Sequence[int], seed: int = 7) -> Model | None:
    """Fits the model to all, and calibrates it on the scores that models of the other folds give. The texts are read once, before the labels."""
    known: dict[str, int] = {}
    docs = [np.array([known.setdefault(w, len(known)) for w in tokens(t)], dtype=np.int32) for t in texts]
    if not known or len(set(labels)) < 2:
        return None
    flat, sizes = grams_by_word(list(known))
    starts = np.cumsum(sizes) - sizes
    del known
    y = np.array(labels, dtype=np.float64)
    fold = np.random.default_rng(seed).integers(FOLDS, size=len(docs))
    full = np.array([len(d) > 0 for d in docs])
    held = _holders(docs, y, fold, sizes, starts, flat)
    best = np.zeros(len(docs))

    def trained(use: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _vectors(docs, y, use, sizes, starts, flat, _first_shares(count, y[use]), seed)

    for k in range(FOLDS):
        _, shares = trained(np.flatnonzero(full & (fold != k)), held.sum(0) - held[k])
        for i in np.flatnonzero(fold == k):
            best[i] = best_window(shares[docs[i]])[1]
    buckets, _ = trained(np.flatnonzero(full), held.sum(0))
    return Model(buckets, *calibrate(best, y))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: Newton steps of a one-variable logistic fit with softened targets."""
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    middle, spread = x.mean(), x.std() + 1e-9
    u = np.stack([(x - middle) / spread, np.ones_like(x)], 1)
    a = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(u @ a, -30, 30)))
        h = (u * (p * (1 - p))[:, None]).T @ u + 1e-4 * np.eye(2)
        a = a - np.clip(np.linalg.solve(h, u.T @ (p - t) + 1e-4 * a), -2, 2)
    return max(float(a[0] / spread), 1e-6), float(a[1] - a[0] * middle / spread)


def held_out() -> Column:
    """True for the third of the documents whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def chosen(labels: DataFrame, column: str, most_of_1: int, most_of_0: int) -> DataFrame:
    """doc_id, label: at most so many labelled documents of either kind, outside the held-out third; few enough to be broadcast."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    given = given.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    agreed = given.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    return agreed.filter("label = 1").orderBy(*_turn()).limit(most_of_1).union(agreed.filter("label = 0").orderBy(*_turn()).limit(most_of_0))


def _turn() -> list[Column]:
    return [F.xxhash64(F.lit(11), F.col("doc_id")), F.col("doc_id")]


def _sample(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int, most_chars: int) -> DataFrame:
    """doc_id, text, label of the bounded sample."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    few = F.broadcast(chosen(labels, "toxic", most_toxic, most_clean))
    # texts stay where they are until the sample is known
    rows = stored(texts.join(few, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")))
    room, ids = {0: most_chars, 1: most_chars}, []
    for r in rows.select("doc_id", "label", F.length("text").alias("n")).orderBy(*_turn()).collect():
        if r.n <= room[r.label]:
            room[r.label] -= r.n
            ids.append((r.doc_id,))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(ids, "doc_id long")), "doc_id", "left_semi")


def sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_chars: int = MOST_CHARS) -> DataFrame:
    """text, label of the bounded sample; documents that would exceed most_chars are passed over."""
    return _sample(docs, labels, most_toxic, most_clean, most_chars).orderBy("doc_id").select("text", "label")


def _trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The model of all rows of one task; texts go as soon as their words are known."""
    labels: list[int] = []

    def texts() -> Iterator[str]:
        for rows in batches:
            labels.extend(rows.label.tolist())
            yield from rows.text

    model = train(texts(), labels)
    if model is not None:
        yield pd.DataFrame({"shares": [model.shares.astype("<f8").tobytes()], "slope": [model.slope], "offset": [model.offset]})


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_chars: int = MOST_CHARS) -> Model | None:
    """The model of the sample, which one task trains: texts and vectors never come to the driver, only BUCKETS numbers do."""
    rows = _sample(docs, labels, most_toxic, most_clean, most_chars).repartition(1).sortWithinPartitions("doc_id")
    found = rows.select("text", "label").mapInPandas(_trained, "shares binary, slope double, offset double").first()
    return Model(np.frombuffer(found.shares, dtype="<f8"), found.slope, found.offset) if found else None


def score(docs: DataFrame, model: Model | None, into: str = "score") -> DataFrame:
    """All columns of docs with the score."""
    if model is None:
        return docs.withColumn(into, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, known = sent.value, {}
        for texts in batches:
            best = np.empty(len(texts))
            for at in range(0, len(texts), 200):
                docs_words = [tokens(t) for t in texts.iloc[at : at + 200]]
                new = [w for w in {w for words in docs_words for w in words} if w not in known]
                for k in range(0, len(new), PART):
                    part = new[k : k + PART]
                    known.update(zip(part, m.word_shares(part).tolist(), strict=True))
                for i, words in enumerate(docs_words):
                    best[at + i] = best_window(np.fromiter(map(known.__getitem__, words), dtype=float, count=len(words)))[1] if words else 0.0
                if len(known) > WORDS_KEPT:
                    known = {}
            yield pd.Series(m.probability(best))

    return docs.withColumn(into, F.pandas_udf(scores, "double")("text"))


def toxicity(docs: DataFrame, labels: DataFrame, into: str = "toxicity") -> DataFrame:
    """All columns of docs with the score of a model fitted to the labels; documents of THRESHOLD and more are rejected."""
    return score(docs, fit(docs, labels), into)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = toxicity(docs.select("doc_id", "text"), labels, "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
