r"""Quality by co-training of a text view and a page-metadata view.

The text view weighs hashed tokens of the text by their log-odds between the classes; the metadata view is a linear
discriminant over source, language, length and layout. Both are functions of sums: documents of a class that hold a
token, and first and second moments of the metadata. So a round of co-training is one pass over the corpus: on the
executors each view scores every unlabelled document, and where it is sure (``SURE``) it hands the document with its
label to the other view, as one more summand. The sums come together by a Spark aggregation; their size does not depend
on the corpus. The pseudo-labelled documents of a class weigh as much as all labelled ones together and in their
proportion, so no class takes over, however many there are. After ``ROUNDS`` rounds a document's score is the mean of
the two calibrated log-odds.

Only labels are sampled: at most ``most_labelled`` (a parameter of ``fit``) labelled documents outside the held-out third,
those with the smallest hash of doc_id; a fifth of them is kept back to calibrate both views anew in each round. What
the views read of a document is worked out once and stored; every document takes part in every round.

Edge cases: null text, source or language count as empty; labels other than 0 and 1, and contradictory ones, are
not used; of texts under one labelled doc_id the smallest (text, source, language) is learnt, the other rows of that id
count as labelled too; documents without an id are unlabelled; without labels of both classes every score is 0.5 and
every document is kept; extra columns stay, but for one named as ``into``, which is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import fresh, stored
from matchloom.llm.toxicity import calibrate, chosen, held_out

MOST_LABELLED = 6000
ROUNDS, SURE = 3, 0.95
BUCKETS = 1 << 15
KEEP = 0.3
WORDS_KEPT = 400_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
LAYOUT = 10
SOURCES, LANGS = 32, 16
META = LAYOUT + SOURCES + LANGS
WIDE = META + LAYOUT + 1


def text_view(text: str, known: dict[str, int]) -> tuple[np.ndarray, int, int]:
    """Distinct buckets of the text's tokens, in order; number of tokens and of distinct tokens."""
    tokens = _TOKEN.findall(text.lower())
    distinct = set(tokens)
    for t in distinct:
        if t not in known:
            known[t] = zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS
    return np.array(sorted({known[t] for t in distinct}), dtype=np.int32), len(tokens), len(distinct)


def metadata_view(source: str, lang: str, text: str, n_tokens: int, n_distinct: int) -> np.ndarray:
    out = np.zeros(META, dtype=np.float32)
    n = max(1, len(text))
    lines = text.split("\n")
    spaces = text.count(" ") + len(lines) - 1
    symbols, digits = sum(text.count(c) for c in "|#$%&*<>"), sum(text.count(c) for c in "0123456789")
    out[:LAYOUT] = (
        np.log1p(len(text)) / 10, np.log1p(len(lines)) / 5, np.log1p(len(text) / len(lines)) / 10, np.log1p(n / (1 + spaces)) / 3, (len(text) - spaces - symbols - digits) / n, symbols / n * 5,
        digits / n * 5, n_distinct / max(1, n_tokens), len(set(lines)) / len(lines), text.count(".") / max(1, n_tokens) * 5,
    )
    out[LAYOUT + zlib.crc32(source.encode("utf-8", "replace")) % SOURCES] = 0.3
    out[LAYOUT + SOURCES + zlib.crc32(lang.encode("utf-8", "replace")) % LANGS] = 0.3
    return out


@dataclass
class Sums:
    """What a view needs to know of the documents of both classes."""

    docs: np.ndarray = field(default_factory=lambda: np.zeros(2))
    buckets: np.ndarray = field(default_factory=lambda: np.zeros((2, BUCKETS)))
    first: np.ndarray = field(default_factory=lambda: np.zeros((2, WIDE)))
    second: np.ndarray = field(default_factory=lambda: np.zeros((WIDE, WIDE)))

    def add_texts(self, bags: list[np.ndarray], y: np.ndarray) -> None:
        for label in (0, 1):
            own = [b for b, v in zip(bags, y, strict=True) if v == label]
            self.docs[label] += len(own)
            if own:
                self.buckets[label] += np.bincount(np.concatenate(own), minlength=BUCKETS)

    def add_metadata(self, x: np.ndarray, y: np.ndarray) -> None:
        for label in (0, 1):
            own = wide(x[y == label])
            self.docs[label] += len(own)
            self.first[label] += own.sum(0)
            self.second += own.T @ own

    def scaled(self, by: np.ndarray, parts: list[np.ndarray]) -> Sums:
        """Each class times its weight; parts are the second moments of the classes."""
        return Sums(self.docs * by, self.buckets * by[:, None], self.first * by[:, None], parts[0] * by[0] + parts[1] * by[1])

    def plus(self, other: Sums) -> Sums:
        return Sums(self.docs + other.docs, self.buckets + other.buckets, self.first + other.first, self.second + other.second)


def wide(x: np.ndarray) -> np.ndarray:
    """Metadata, the squares of the layout, and one."""
    x = np.asarray(x, dtype=np.float64).reshape(-1, META)
    return np.concatenate([x, x[:, :LAYOUT] ** 2, np.ones((len(x), 1))], 1)


@dataclass
class View:
    """A linear score, with its calibration."""

    w: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def log_odds(self, raw: np.ndarray) -> np.ndarray:
        return self.slope * raw + self.offset


def text_weights(sums: Sums) -> np.ndarray:
    """Smoothed log-odds of a bucket over its standard error where it is rare."""
    n = sums.docs[:, None] + 1
    c = sums.buckets + 0.5
    odds = np.log(c[1] / (n[1] - c[1] + 1)) - np.log(c[0] / (n[0] - c[0] + 1))
    return odds * (1 - 1 / (1 + sums.buckets.sum(0)))


def metadata_weights(sums: Sums) -> np.ndarray:
    """Linear discriminant: the difference of the classes' means over their common spread."""
    n = sums.docs
    mean = sums.first / np.maximum(n, 1e-9)[:, None]
    spread = (sums.second - sum(n[k] * np.outer(mean[k], mean[k]) for k in (0, 1))) / max(1.0, n.sum())
    return np.linalg.solve(spread + 1e-4 * np.eye(WIDE), mean[1] - mean[0])


def raw_texts(w: np.ndarray, bags: list[np.ndarray]) -> np.ndarray:
    return np.array([w[x].sum() / np.sqrt(max(1, len(x))) for x in bags])


@dataclass
class CoModel:
    text: View
    meta: View
    grown: list[tuple[int, int]]

    def log_odds(self, bags: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.text.log_odds(raw_texts(self.text.w, bags)), self.meta.log_odds(wide(x) @ self.meta.w)


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sure(z: np.ndarray) -> np.ndarray:
    """1 and 0 where the view is sure, else -1."""
    p = _probability(z)
    return np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1))


def _views(rows: pd.DataFrame, known: dict[str, int]) -> tuple[list[np.ndarray], np.ndarray]:
    bags, x = [], np.zeros((len(rows), META), dtype=np.float32)
    for i, (text, source, lang) in enumerate(zip(rows.text, rows.source, rows.lang, strict=True)):
        bag, n, distinct = text_view(text, known)
        bags.append(bag)
        x[i] = metadata_view(source, lang, text, n, distinct)
        if len(known) > WORDS_KEPT:
            known.clear()
    return bags, x


FEATURES = "bag binary, meta binary"


def _features(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}
    for text, source, lang in batches:
        bags, x = _views(pd.DataFrame({"text": text, "source": source, "lang": lang}), known)
        yield pd.DataFrame({"bag": [b.astype("<u2").tobytes() for b in bags], "meta": [r.astype("<f4").tobytes() for r in x]})


def _of_features(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.frombuffer(b, dtype="<u2").astype(np.int32) for b in rows.bag], np.frombuffer(b"".join(rows.meta), dtype="<f4").reshape(-1, META)


def featurised(docs: DataFrame, into: str) -> DataFrame:
    """All columns of docs, and what the views read of a document."""
    run = F.pandas_udf(_features, FEATURES)
    return docs.withColumn(into, run(*(F.coalesce(c, F.lit("")) for c in ("text", "source", "lang"))))


SUM = "view string, label int, at int, n double"


def _summed(model: CoModel):  # noqa: ANN202
    """A task's documents on which a view is sure, summed up for the other view, as sparse rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, meta, second = Sums(), Sums(), np.zeros((2, WIDE, WIDE))
        for rows in batches:
            bags, x = _of_features(rows)
            if not len(bags):
                continue
            of_text, of_meta = model.log_odds(bags, x)
            text.add_texts(bags, _sure(of_meta))
            label = _sure(of_text)
            for k in (0, 1):
                own = wide(x[label == k])
                meta.docs[k] += len(own)
                meta.first[k] += own.sum(0)
                second[k] += own.T @ own
        for view, table in (("text docs", text.docs[:, None]), ("meta docs", meta.docs[:, None]), ("buckets", text.buckets), ("first", meta.first), ("second", second.reshape(2, -1))):
            label, at = np.nonzero(table)
            yield pd.DataFrame({"view": view, "label": label, "at": at, "n": table[label, at]})

    return run


def exchange(features: DataFrame, model: CoModel) -> tuple[Sums, Sums, np.ndarray]:
    """Over all unlabelled documents: sums for the text view, sums for the metadata view, second moments by class."""
    rows = features.mapInPandas(_summed(model), SUM).groupBy("view", "label", "at").agg(F.sum("n").alias("n")).toPandas()
    text, meta, second = Sums(), Sums(), np.zeros((2, WIDE * WIDE))
    for view, table in (("text docs", text.docs[:, None]), ("meta docs", meta.docs[:, None]), ("buckets", text.buckets), ("first", meta.first), ("second", second)):
        own = rows[rows["view"] == view]
        table[own["label"], own["at"]] = own["n"]
    return text, meta, second.reshape(2, WIDE, WIDE)


def _fitted(seed_text: Sums, seed_meta: Sums, given: tuple[Sums, Sums, np.ndarray] | None, held: tuple[list[np.ndarray], np.ndarray, np.ndarray], grown: list[tuple[int, int]]) -> CoModel:
    if given is not None:
        text, meta, second = given
        weight = lambda seed, more: seed.docs / np.maximum(more.docs, seed.docs)  # noqa: E731  at most as much as the labelled ones
        seed_text = seed_text.plus(text.scaled(weight(seed_text, text), [text.second, text.second]))
        seed_meta = seed_meta.plus(meta.scaled(weight(seed_meta, meta), list(second)))
        grown = [*grown, (int(text.docs.sum()), int(meta.docs.sum()))]
    bags, x, y = held
    of_text, of_meta = View(text_weights(seed_text)), View(metadata_weights(seed_meta))
    of_text.slope, of_text.offset = calibrate(raw_texts(of_text.w, bags), y)
    of_meta.slope, of_meta.offset = calibrate(wide(x) @ of_meta.w, y)
    return CoModel(of_text, of_meta, grown)


def fit(features: DataFrame, into: str, labels: DataFrame, most_labelled: int = MOST_LABELLED, rounds: int = ROUNDS, seed: int = 3) -> CoModel | None:
    """features: stored rows with doc_id and the column of ``featurised``."""
    rows = features.select(F.col("doc_id").cast("long").alias("doc_id"), f"{into}.*")
    # half of the bound for either class, at least; few enough to be broadcast, so features stay where they are
    few = chosen(labels, "quality", most_labelled // 2, most_labelled - most_labelled // 2)
    known = rows.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.struct("bag", "meta")).alias("f"), F.first("label").alias("label"))
    given = known.orderBy("doc_id").select("f.*", "label").toPandas()
    if not len(given):
        return None
    bags, x = _of_features(given)
    y = given["label"].to_numpy()
    back = np.random.default_rng(seed).random(len(y)) < 0.2
    if len(set(y[~back].tolist())) < 2:
        return None
    use = np.flatnonzero(~back)
    held = np.flatnonzero(back) if len(set(y[back].tolist())) == 2 else np.arange(len(y))
    seed_text, seed_meta = Sums(), Sums()
    seed_text.add_texts([bags[i] for i in use], y[use])
    seed_meta.add_metadata(x[use], y[use])
    back_rows = [bags[i] for i in held], x[held], y[held].astype(float)
    model = _fitted(seed_text, seed_meta, None, back_rows, [])
    labelled = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # labels grow with the corpus: dealt by key at every size, never broadcast
    unlabelled = stored(rows.join(labelled.hint("merge"), "doc_id", "left_anti").select("bag", "meta"), "zstd")
    for _ in range(rounds):
        model = _fitted(seed_text, seed_meta, exchange(unlabelled, model), back_rows, model.grown)
    return model


def scored(features: DataFrame, into: str, model: CoModel | None) -> DataFrame:
    """All columns of features, ``into`` replaced by text_score, meta_score, score."""
    if model is None:
        half = F.lit(0.5)
        return features.withColumn(into, F.struct(half.alias("text_score"), half.alias("meta_score"), half.alias("score")))
    sent = features.sparkSession.sparkContext.broadcast(model)  # of one size, whatever the corpus

    def scores(rows: pd.DataFrame) -> pd.DataFrame:
        bags, x = _of_features(rows)
        a, b = sent.value.log_odds(bags, x)
        return pd.DataFrame({"text_score": _probability(a), "meta_score": _probability(b), "score": _probability((a + b) / 2)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(scores, batches)

    return features.withColumn(into, F.pandas_udf(run, "text_score double, meta_score double, score double")(into))


def co_training(docs: DataFrame, labels: DataFrame, into: str = "quality", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """All columns of docs with ``into``: text_score, meta_score, score (of quality 1)."""
    features = stored(featurised(docs, into), "zstd")
    return scored(features, into, fit(features, into, labels, most_labelled))


def co_training_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score (of quality 1), predicted, kept."""
    found = "found"
    # texts are not stored again: only their features are read from here on
    features = stored(featurised(docs.select("doc_id", "text", "source", "lang"), found).select("doc_id", found), "zstd")
    rows = scored(features, found, fit(features, found, labels)).select("doc_id", held_out().alias("held_out"), f"{found}.*")
    return rows.withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "kept": F.col("score") >= KEEP})
