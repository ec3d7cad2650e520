import random
import zlib

import numpy as np
import pandas as pd
import pytest

from matchloom.llm import co_training, toxicity
from matchloom.llm.common import stored
from tests.llm.data import AWKWARD, frame, words

BAD = ("grobnik", "fruzzle", "skamwort")


def held(d):
    return zlib.crc32(str(d).encode()) % 3 == 1


def toxic_rows(n=600, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        x = words(r.randint(5, 120), 1000 + i).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(r.randint(1, 3)):
                word = r.choice(BAD)
                k = r.randrange(2, len(word))
                x.insert(r.randrange(len(x)), word[:k] + r.choice("xyz") + word[k:] if held(i) else word)  # held-out ones are misspelt
        rows.append((i, " ".join(x)))
        labels.append((i, int(i % 10 != 0), int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = toxic_rows()
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_toxicity_finds_unseen_misspellings(toxic):
    docs, labels, rows, given = toxic
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    truth = {d: t for d, _, t in given}
    assert len(got) == len(rows) and all(got[d].held_out == held(d) for d in got)
    test = [d for d in got if held(d)]
    score = np.array([got[d].score for d in test])
    y = np.array([truth[d] for d in test])
    rank = score.argsort().argsort()
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    assert sum(got[d].predicted for d in test if not truth[d]) <= 0.03 * len(test)


def test_toxicity_ignores_held_out_labels(spark, toxic):
    docs, labels, rows, given = toxic
    twisted = spark.createDataFrame([(d, q, 1 - t if held(d) else t) for d, q, t in given], labels.schema)
    a = {r.doc_id: r.score for r in toxicity.toxicity_report(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity_report(docs, twisted).collect()}
    assert a == b


def test_toxicity_edge_cases(spark, toxic):
    _, labels, _, _ = toxic
    docs = frame(spark, AWKWARD)
    got = toxicity.toxicity_report(docs, labels).collect()
    assert len(got) == len(AWKWARD) and all(r.score is not None for r in got)
    for few in (labels.limit(0), labels.filter("toxic = 1")):
        assert {r.score for r in toxicity.toxicity_report(docs, few).collect()} == {0.0}
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (4, 1, 1), (4, 1, 0), (5, 1, 7)], labels.schema)
    assert toxicity.toxicity_report(docs, labels.union(odd)).count() == len(AWKWARD)
    assert toxicity.toxicity_report(frame(spark, []), labels).count() == 0


def test_toxicity_by_hand(spark, toxic):
    """The score is the model's, word by word and window by window; of long words all n-grams take part."""
    docs, labels, rows, _ = toxic
    model = toxicity.fit(docs, labels)

    def share(word):
        buckets, _ = toxicity.grams([word])
        return sum(model.shares[b] for b in buckets) / len(buckets)

    glued = "x" * 150 + "grobnik" + "y" * 500
    odd = [(1, "quiet words here"), (2, f"see {rows[0][1]} and " + "long" * 200), (3, glued), (4, "x" * 657), (5, None), (6, "one")]
    for r in toxicity.score(frame(spark, odd), model, "label").collect():
        w = toxicity.tokens(r.text)
        n = min(toxicity.WINDOW, len(w))
        best = max((sum(share(x) for x in w[i : i + n]) / n for i in range(len(w) - n + 1)), default=0.0) if w else 0.0
        assert abs(r.label - 1 / (1 + np.exp(-(model.slope * best + model.offset)))) < 1e-6
    assert "".join(toxicity.tokens(glued)).count("grobnik") >= 1
    found = {r.doc_id: r.label for r in toxicity.score(frame(spark, odd), model, "label").collect()}
    assert found[3] > 2 * found[4]
    few = toxicity.sample(docs, labels, most_toxic=5, most_clean=7, most_chars=1500).collect()
    assert 0 < sum(r.label for r in few) <= 5 and all(sum(len(r.text) for r in few if r.label == k) <= 1500 for k in (0, 1))


def _hash(points):
    h = 0
    for x in reversed(points):
        h = (h + x) * int(toxicity._FACTOR) % (1 << 64)
    return h


def test_stretches_of_a_long_word():
    """Of a long word every n-gram is in a stretch, none is added, and each stretch has the vector of the whole word."""

    def by_hand(marked):
        n_grams = {(n, marked[i : i + n]) for n in toxicity.GRAMS for i in range(len(marked) - n + 1)}
        return n_grams

    def bucket(h):
        m = h * int(toxicity._MIX) % (1 << 64)
        return ((m ^ (m >> 29)) * int(toxicity._MIX) % (1 << 64)) >> (64 - toxicity.BUCKET_BITS)

    def of_gram(n, g):
        h = ord(g[0])
        for x in g[1:]:
            h = (h * int(toxicity._FACTOR) + ord(x)) % (1 << 64)
        return bucket((h + n) % (1 << 64))

    r = random.Random(5)
    for size in (1, 2, 29, 30, 31, 32, 54, 55, 56, 57, 300, 70_000):
        word = "".join(r.choice("abcdefgh\u00e9\u4e2d") for _ in range(size))
        marked = f"<{word}>"
        found = toxicity.tokens(word)
        assert (len(found) == 1) == (size <= 30) and all(len(x) <= toxicity.STRETCH + 17 for x in found)
        buckets, of = toxicity.grams(found)
        whole = bucket(_hash([ord(c) for c in marked]))
        assert set(buckets.tolist()) == {of_gram(*x) for x in by_hand(marked)} | {whole}
        assert all(whole in buckets[of == k] for k in range(min(len(found), 50)))


def quality_rows():
    r = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        good = i % 5 != 0
        x = words(r.randint(20, 150), 5000 + i).split()
        rows.append((i, " ".join(x) if good else " | ".join(v + r.choice(("###", "$$$")) for v in x)))
        if i % 2 == 0 or i % 7 == 0:
            labels.append((i, int(good), 0))
    return rows, labels


def _by_hand(model, rows):
    bags, x = co_training._views(pd.DataFrame({"text": [t for _, t in rows], "source": "s0", "lang": "en"}), {})
    text = [sum(model.text.w[k] for k in b) / max(1, len(b)) ** 0.5 for b in bags]
    meta = [sum(w * v for w, v in zip(model.meta.w, [*r, *(v * v for v in r[: co_training.LAYOUT]), 1.0], strict=True)) for r in x.astype(float)]
    return (model.text, np.array(text)), (model.meta, np.array(meta))


def test_exchange_sums_all_unlabelled_documents(spark):
    """The sums that a round brings to a view are those of a plain loop over every document."""
    rows, given = quality_rows()
    docs, labels = frame(spark, rows).repartition(3), spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    features = stored(co_training.featurised(docs, "f"))
    model = co_training.fit(features, "f", labels)
    text, meta, second = co_training.exchange(features.select("f.*"), model)
    bags, x = co_training._views(pd.DataFrame({"text": [t for _, t in rows], "source": "s0", "lang": "en"}), {})
    want = np.zeros((2, co_training.BUCKETS)), np.zeros((2, co_training.WIDE))
    p = [1 / (1 + np.exp(-v.log_odds(raw))) for v, raw in _by_hand(model, rows)]
    for i in range(len(rows)):
        for k, q in ((1, p[1][i]), (0, 1 - p[1][i])):
            if q >= co_training.SURE:
                want[0][k][bags[i]] += 1
        for k, q in ((1, p[0][i]), (0, 1 - p[0][i])):
            if q >= co_training.SURE:
                want[1][k] += co_training.wide(x[i])[0]
    assert np.array_equal(text.buckets, want[0]) and np.allclose(meta.first, want[1]) and second.shape == (2, co_training.WIDE, co_training.WIDE)


def test_repeated_ids_do_not_change_the_model(spark):
    rows, given = quality_rows()
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    twice = rows + [(d, "z other text " + t) for d, t in rows[:40]]
    # sums of numbers differ in their last digits with the order of the tasks
    a, b = (sorted((r.doc_id, round(r.text_score, 9), round(r.meta_score, 9), r.kept) for r in co_training.co_training_report(frame(spark, twice).repartition(n), labels).collect()) for n in (2, 5))
    assert a == b


def test_co_training(spark):
    rows, given = quality_rows()
    docs, labels = frame(spark, rows), spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    got = co_training.co_training_report(docs, labels).collect()
    assert len(got) == len(rows)
    right = [r.predicted == int(r.doc_id % 5 != 0) for r in got if r.held_out]
    assert np.mean(right) > 0.97
    features = stored(co_training.featurised(docs, "f"))
    model = co_training.fit(features, "f", labels)
    assert len(model.grown) == co_training.ROUNDS and min(model.grown[-1]) > 0
    # the outcome is that of a plain loop over the documents
    z = [co_training.View.log_odds(v, raw) for v, raw in _by_hand(model, rows)]
    for r, a, b in zip(sorted(got), z[0], z[1], strict=True):
        assert abs(r.text_score - 1 / (1 + np.exp(-a))) < 1e-6 and abs(r.meta_score - 1 / (1 + np.exp(-b))) < 1e-6 and abs(r.score - 1 / (1 + np.exp(-(a + b) / 2))) < 1e-6
    odd = frame(spark, AWKWARD)
    assert co_training.co_training_report(odd, labels).count() == len(AWKWARD)
    empty = co_training.co_training_report(odd, labels.limit(0)).collect()
    assert {r.score for r in empty} == {0.5} and all(r.kept for r in empty)
    assert co_training.co_training_report(frame(spark, []), labels).count() == 0


def test_toxicity_is_trained_in_a_task(spark, toxic, monkeypatch):
    """Neither the texts of the sample nor the training come to the driver."""
    docs, labels, _, _ = toxic
    want = toxicity.train(*zip(*((r.text, r.label) for r in toxicity.sample(docs, labels).collect()), strict=True))
    monkeypatch.setattr(toxicity, "train", None)
    got = toxicity.fit(docs, labels)
    assert np.array_equal(got.shares, want.shares) and (got.slope, got.offset) == (want.slope, want.offset)


def test_labels_are_not_broadcast_to_the_features(spark, monkeypatch):
    rows, given = quality_rows()
    docs, labels = frame(spark, rows), spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    plans = []
    monkeypatch.setattr(co_training, "stored", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, *a))
    co_training.co_training_report(docs, labels).count()
    joins = [p for p in plans if "LeftAnti" in p]
    assert joins and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in joins)
