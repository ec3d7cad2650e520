import random

import numpy as np

from matchloom.llm import fingerprints, near_copies, simhash_dedup
from tests.llm.data import AWKWARD, frame, words


def shingle_set(text):
    x = (text or "").encode().lower().split()
    return frozenset(tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))) if x else frozenset()


def edited(text, n, seed):
    r, x = random.Random(seed), text.split()
    for i in r.sample(range(len(x)), n):
        x[i] = f"edit{seed}x{i}"
    return " ".join(x)


def planted():
    """Copies of texts with 1 to 8 words changed, chains of copies of copies, a dense group and exact copies."""
    rows = list(AWKWARD)
    for k in range(12):
        base = words(150, 700 + k)
        rows += [(1000 + 10 * k + j, edited(base, j, 31 * k + j)) for j in range(9)]
    chain = words(200, 800).split()
    rows += [(2000 + i, " ".join(chain[:i] + ["zz"] * i + chain[2 * i :])) for i in range(0, 40, 3)]
    rows += [(3000 + i, edited(words(300, 801), 2, i)) for i in range(60)] + [(3100 + i, words(300, 801)) for i in range(20)]
    return rows


def test_near_copies_against_brute_force(spark):
    rows = planted()
    sets = sorted({shingle_set(t) for _, t, *_ in rows}, key=sorted)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                parent[root(i)] = root(j)
    number = {s: i for i, s in enumerate(sets)}
    text_of = {(-(2**63) if r.doc_id is None else r.doc_id, r.h): r.text for r in frame(spark, rows).selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()}
    got = near_copies.near_copies(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    seen = {(root(number[shingle_set(text_of[r.doc_id, r.text_hash])]), r.component) for r in got}
    assert len(seen) == len({a for a, _ in seen}) == len({b for _, b in seen})


def test_edited_copies_leave(spark):
    base = words(150, 71)
    rows = [(1, base), (2, edited(base, 1, 5)), (3, edited(base, 2, 6)), (4, edited(base, 60, 7)), (5, words(150, 72))]
    assert {r.doc_id for r in simhash_dedup.keep_one(frame(spark, rows)).collect()} == {1, 4, 5}


def test_null_and_repeated_ids_do_not_join_texts(spark):
    near = words(90, 60).split()
    rows = [(None, words(90, 60 + k)) for k in range(5)] + [(5, " ".join(near)), (6, words(90, 70)), (7, words(90, 71)), (7, words(90, 72))]
    kept = [(r.doc_id, r.text) for r in simhash_dedup.keep_one(frame(spark, rows)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [r for r in rows if r[0] != 5]))
    more = rows + [(20, words(90, 61) + " end"), (21, words(90, 64))]
    found = simhash_dedup.near_duplicates(frame(spark, [(None if d == 7 else d, t) for d, t in more])).collect()
    # by the graph of links: rows are together just when fingerprints within 2 bits lead from one to the other
    groups = {r.fp: {r.fp} for r in found}
    for a in list(groups):
        for b in list(groups):
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for x in groups[b]:
                    groups[x] = groups[a]
    null = -(2**63)
    assert all(r.component_id == min((x.doc_id for x in found if x.fp in groups[r.fp] and x.doc_id != null), default=null) for r in found)


def test_signatures_are_a_lower_bound():
    r = random.Random(3)
    for n in (0, 1, 7, 300, 4000):
        a = {r.getrandbits(63) for _ in range(n)}
        b = set(list(a)[n // 5 :]) | {r.getrandbits(63) for _ in range(n // 4)}
        x, y = (near_copies.signature(np.array(sorted(s), dtype=np.int64)) for s in (a, b))
        assert sum((int(p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, y, strict=True)) <= len(a ^ b)


def test_fingerprints_give_pairs_that_the_exact_test_keeps(spark, monkeypatch):
    """Without any prefix, texts within two bits of each other still meet in the SimHash grid; of these only what is alike is joined."""
    base = words(400, 91)
    rows = [(i, edited(base, 1, i)) for i in range(12)] + [(100 + i, words(150, 900 + i)) for i in range(6)] + [(200, "a b c a b c a"), (201, "a b c a b c a b c a")]
    docs = frame(spark, rows)
    text_of = {r.h: r.text for r in docs.selectExpr("text", "xxhash64(text) h").collect()}
    prints = {t: fingerprints.fingerprint(t) for t in text_of.values()}
    monkeypatch.setattr(near_copies, "prefixes", lambda docs, rarity: spark.createDataFrame([], "node long, size int, keys array<long>"))
    group = {text_of[r.text_hash]: r.component for r in near_copies.near_copies(docs).collect()}
    near = [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 2]
    alike = [(a, b) for a, b in near if 10 * len(shingle_set(a) & shingle_set(b)) >= 8 * len(shingle_set(a) | shingle_set(b))]
    assert alike and all(group[a] == group[b] for a, b in alike)
    assert all(group[t] not in {group[x] for x in group if x != t} for d, t in rows if 100 <= d < 200)
