"""The whole pipeline against plain loops: every stage on what the one before kept, with nulls, repeated rows and empty tables."""

import re
from collections import Counter, defaultdict

import pytest
import xxhash

import corpus_pipeline
from matchloom.llm import line_dedup, toxicity
from matchloom.llm.common import stored
from tests.llm.data import DOCS, frame, words
from tests.llm.test_models import toxic_rows
from tests.llm.test_near_copies import edited, shingle_set

WORD, TOKEN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = words(40, 900)
NO_ID = -(2**63)


def corpus():
    toxic, labels = toxic_rows(300)
    shared = "\n".join(words(12, 910 + k) for k in range(4))
    rows = [(d, t, f"s{d % 3}") for d, t in toxic]
    rows += [(2000 + k, f"{words(9, 2000 + k)}\n{shared}\n{words(70, 2100 + k)}", None if k % 4 == 0 else f"s{k % 2}") for k in range(12)]  # runs of lines that repeat
    rows += [(3000 + k, edited(words(220, 3000), k, k), "s1") for k in range(5)] + [(3100 + k, words(90, 3100), "s2") for k in range(6)]  # near copies, exact copies
    rows += [(4000 + k, f"{words(30, 4000 + k)} {' '.join(PASSAGE.split()[k : k + 14]).upper()} {words(30, 4100 + k)}", "s0") for k in range(4)]  # benchmark passages
    rows += [(None, words(60, 5000), "s0"), (None, words(60, 5001), None), (5002, None, "s1"), (5002, None, "s1"), (5003, "", None), (5004, " \n\t", "s2"), (5005, words(20, 5005), "rare"), (5006, words(60, 5006), "s1")]
    return rows + [(5006, words(60, 5006), "s1")] * 3 + [(5006, words(61, 5007), "s1")], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("byhand"))
    rows, labels = corpus()
    frame(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("a", PASSAGE), ("n", None), (None, "too short"), ("e", "")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def hashed(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64 if h >= 1 << 63 else 0)


def key(row):
    return (NO_ID if row[0] is None else row[0], hashed(row[1]))


def without_repeated_lines(rows, least=line_dedup.MIN_WORDS):
    first, gone = {}, defaultdict(set)
    for k, text in sorted({(key(r), r[1] or "") for r in rows}):
        lines = [(i, s) for i, s in enumerate(text.split("\n")) if WORD.search(s)]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(s for _, s in lines[a : b + 1])
                if sum(len(WORD.findall(s)) for s in run) >= least and first.setdefault(run, (k, a)) != (k, a):
                    gone[k] |= set(range(lines[a][0], lines[b][0] + 1))
    return [(r[0], None if r[1] is None else "\n".join(s for i, s in enumerate(r[1].split("\n")) if i not in gone[key(r)]), r[2]) for r in rows]


def one_of_each_group(rows):
    sets = sorted({shingle_set(r[1]) for r in rows}, key=sorted)
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    number = {s: group[i] for i, s in enumerate(sets)}
    least = {}
    for r in rows:
        g = number[shingle_set(r[1])]
        least[g] = min(least.get(g, key(r)), key(r))
    return {least[number[shingle_set(r[1])]] for r in rows}


def is_clean(text, items):
    x = TOKEN.findall((text or "").translate(LOWER))
    for item in items:
        y = TOKEN.findall((item or "").translate(LOWER))
        for q in {tuple(y[i : i + 10]) for i in range(max(1, len(y) - 9))} if y else ():
            if any(tuple(x[s : s + len(q)]) == q for s in range(len(x) - len(q) + 1)):
                return False
    return True


def test_every_stage_by_hand(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    rows = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, folder))
        kept[name] = rows(before), rows(docs), before
    before, after, table = kept["toxicity"]
    scored = toxicity.toxicity(table, spark.read.parquet(f"{folder}/labels.parquet"), "its_score").collect()
    assert Counter(after) == Counter((r.doc_id, r.text, r.source) for r in scored if r.its_score < toxicity.THRESHOLD) and len(after) < len(before)
    before, after, _ = kept["line_dedup"]
    assert Counter(after) == Counter(without_repeated_lines(before)) and Counter(after) != Counter(before)
    before, after, _ = kept["simhash_dedup"]
    assert {key(r) for r in after} == one_of_each_group(before) and len(after) == len({key(r) for r in after}) < len(before) and set(after) <= set(before)
    before, after, _ = kept["decontamination"]
    assert Counter(after) == Counter(r for r in before if is_clean(r[1], [PASSAGE, "too short"])) and len(before) - len(after) == 4
    before, after, _ = kept["mixing"]
    size, taken, copies = Counter(), Counter(), Counter(after)
    for r in before:
        size[r[2]] += len(WORD.findall(r[1] or ""))
    for r in after:
        taken[r[2]] += len(WORD.findall(r[1] or ""))
    assert set(after) <= set(before) and max(copies.values()) <= 3 and all(taken[s] <= 3 * n for s, n in size.items())
    assert abs(sum(taken.values()) - sum(size.values())) <= 2 * max(len(WORD.findall(r[1] or "")) for r in before) * len(size)
    assert Counter(after) == Counter(rows(corpus_pipeline.run(spark, folder)))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        (table if name == "labels" else table.limit(0)).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == [*DOCS.fieldNames(), "copy_no"]
    docs = frame(spark, [(1, words(30, 1), None), (None, None, None)])
    assert {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path)).collect()} == {1, None}
