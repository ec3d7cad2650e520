"""Filter audit, fill in the middle and BPE against plain code and the tokenizers library."""

import hashlib
import itertools
import random
import re
import struct
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.llm import bpe, fill_in_middle, filter_audit, rope
from tests.llm.data import AWKWARD, frame, words

WORD, UNIT = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
COPIES = [(d, "the same\ttext", s) for d, s in ((30, "s1"), (31, "s1"), (31, "s2"), (32, None), (None, "s1"), (30, "s2"))]
FILTERED = [*AWKWARD, *COPIES, (40, "A" * 50, ""), (41, "x % y", "s1"), (42, words(250, 40), "s1"), (43, words(250, 40), "s2"), (44, "dup " * 300, "s3")]
LABELS = [(8, 1, 0), (30, 1, 1), (31, 0, 1), (31, 1, 0), (44, 1, 1), (None, 1, 1), (99, 1, 1), (43, None, 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def audit_by_hand(rows):
    good, toxic = {d for d, q, _ in LABELS if q == 1 and d is not None}, {d for d, _, t in LABELS if t == 1 and d is not None}
    docs = [(d, t or "", (r[0] if r else "s0") or "") for d, t, *r in rows]
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t] = min(d, first.get(t, d))
    failing = []
    for d, t, part in docs:
        w = WORD.findall(t)
        tests = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        failing.append((part, d, {x for x, bad in tests.items() if bad}))
    out, removed_of = [], Counter()
    for part in {p for p, _, _ in failing}:
        mine = [(d, f) for p, d, f in failing if p == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                here = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                removed_of[part, x] += len(here)
                row = (len(left), len(here), sum(x in f for _, f in mine) - len(here), sum(f == {x} for _, f in mine), sum(d in good for d, _ in here), sum(d in toxic for d, _ in here))
                out.append((part, "".join(order), k + 1, x, *row))
    return {(p, o, k, *row, removed_of[p, x]) for p, o, k, x, *row in out}


def test_filter_audit_against_brute_force(spark, labels):
    got = [tuple(r) for r in filter_audit.filter_audit(frame(spark, FILTERED).repartition(5), labels).collect()]
    want = audit_by_hand(FILTERED)
    assert len(got) == len(set(got)) == len(want) and set(got) == want


def test_filter_audit_of_empty_tables_and_other_rules(spark, labels):
    assert filter_audit.filter_audit(frame(spark, []), labels).count() == 0
    none = filter_audit.filter_audit(frame(spark, FILTERED), labels.limit(0))
    assert none.filter("good_lost > 0 or toxic_lost > 0").count() == 0
    short = filter_audit.filter_audit(frame(spark, FILTERED), labels, part="lang", rules={"x": F.col("text").isNull(), "y": F.length("text") < 20}, copies="z")
    assert {(r.filter_order, r.step) for r in short.collect()} == {("".join(o), k) for o in itertools.permutations("xyz") for k in (1, 2, 3)}
    with pytest.raises(ValueError):
        filter_audit.filter_audit(frame(spark, FILTERED), labels, copies="A")


def test_filter_audit_counts_a_text_of_thousands_of_copies(spark, labels):
    many = frame(spark, [(d, "everywhere", f"s{d % 3}") for d in range(5000)] + [(7, "everywhere", "s1")])
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.filter_audit(many, labels).collect()}
    assert got["s0", "EABCD", 1].kept == 1 and got["s0", "EABCD", 1].removed == 1666
    assert got["s1", "EABCD", 1].kept == 0 and got["s1", "EABCD", 1].removed == 1668 and got["s1", "EABCD", 2].removed == 0


def test_filter_audit_needs_no_python(spark, labels):
    plan = filter_audit.masks(frame(spark, FILTERED).coalesce(1), labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


TEXTS = st.text(alphabet=st.sampled_from("ab \n\tüé漢<>PSM"), max_size=80)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 90), st.integers(1, 9))
def test_rope_splits_like_a_list_of_units(text, rank, leaf):
    whole, units = rope.grown(text, leaf), UNIT.findall(text)
    assert whole.units == len(units) and whole.chars == len(text) and rope.text_of(whole) == text
    a, b = rope.split(whole, rank)
    assert (rope.text_of(a), rope.text_of(b)) == ("".join(units[:rank]), "".join(units[rank:]))
    assert (a.units, a.chars) == (len(units[:rank]), len("".join(units[:rank])))
    c, d = rope.split(whole, rank, "chars")
    assert (rope.text_of(c), rope.text_of(d), c.chars) == (text[:rank], text[rank:], len(text[:rank]))
    both = rope.joined(b, a)
    assert rope.text_of(both) == "".join(units[rank:] + units[:rank]) and both.units == len(units)


def test_rope_stays_balanced():
    whole, r = rope.grown("ab " * 20_000, 16), random.Random(3)
    for _ in range(300):
        a, b = rope.split(whole, r.randrange(whole.units))
        whole = rope.joined(b, a)
    leaves, ahead = 0, [whole]
    while ahead:
        node = ahead.pop()
        if isinstance(node, rope.Leaf):
            leaves += 1
        else:
            assert abs(node.left.height - node.right.height) <= 2
            ahead += (node.left, node.right)
    assert whole.units == 20_001 and whole.height <= 2 * leaves.bit_length()


def fim_by_hand(doc_id, text):
    text = text or ""
    u, h = UNIT.findall(text), hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    a, z = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:z]), "".join(u[z:])
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_against_brute_force(spark):
    own = [(d, t) for d, t in AWKWARD if d is not None]
    rows = own + [(d, f"tail < and <S or P> {d}  \n" + words(d % 9, d)) for d in range(100, 400)] + [(500 + k, f"a {s} b") for k in range(9) for s in ("<P>", "<S>", "<M>")]
    docs = frame(spark, rows).repartition(3).withColumn("n", F.lit(1))
    got = fill_in_middle.fill_in_middle(docs).select("doc_id", "fim.*", fill_in_middle.restore("fim.output", "fim.form").alias("restored"), "text")
    found = got.collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found) == Counter((d, *fim_by_hand(d, t)) for d, t in rows)
    assert all(r.restored == (r.text or "") for r in found) and {r.form for r in found} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nulls_and_nothing(spark):
    report = fill_in_middle.fill_in_middle_report(frame(spark, [(None, "one two three"), (None, None), (1, None)])).collect()
    assert all(r.restored_sha256 == hashlib.sha256(t.encode()).hexdigest() for r, t in zip(sorted(report, key=lambda r: -r.n), ("one two three", "", ""), strict=True))
    assert fill_in_middle.fill_in_middle_report(frame(spark, [])).count() == 0


P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def own():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return bpe.Tokenizer(f.read())


STRANGE = [
    "", " ", "   x", "x  \n\n y", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "it's we'll I'M", "a" * 3000, "=-" * 500, "-" * 777, "　wide　 ", "naïve Ünï \x85 \x1f",
    "漢字かな", "😀😃 👩‍👩 𞤀𞥐", "՘₏\U00010940x", "0123456789" * 30, "\u0000\u0001", "Ġ Ċ", "�￾", "words" + " " * 200 + "end", "ſ'S 'ſ",
]


def test_bpe_against_the_library(own, library):
    r = random.Random(5)
    mixed = ["".join(r.choice(["the", " of", "ing", "é", "漢", "\n", "  ", "'s", "42", "!?", "Q", "zx", " ", "😀", "<|endoftext|>", "ation", "----"]) for _ in range(r.randint(1, 60))) for _ in range(2000)]
    rare = [chr(c) + " a" + chr(c) + "1" + chr(c) for c in r.sample(range(0x110000), 3000) if not 0xD800 <= c < 0xE000]
    texts = STRANGE + mixed + rare + [t or "" for _, t in AWKWARD]
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = own.encode(texts)
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
    assert [own.decode(x) for x in got] == texts
    assert own.decode(struct.pack("<3I", 128, 222, 447)) == library.decode([128, 222, 447], skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_of_any_text(own, library, text):
    assert own.encode([text])[0] == struct.pack(f"<{len(ids := library.encode(text, add_special_tokens=False).ids)}I", *ids)


def test_bpe_shares_prefixes(own):
    """Bytes walked: the distinct prefixes of all words, however many have them."""
    keys = ["interview", "interviewer", "internal", "inter", "zebra", "été", "éta"]
    trie, path, walked = bpe.Trie(keys), b"", []
    for depth, label, word in trie.walk():
        path = path[:depth] + label
        walked += [path[: depth + k + 1] for k in range(len(label))]
        assert path == word.encode()
    assert sorted(walked) == sorted({k.encode()[: i + 1] for k in keys for i in range(len(k.encode()))})
    found = dict(own.encodings(trie))
    assert all(found[k] == struct.pack(f"<{len(ids := own.merged(k.encode()))}I", *ids) for k in keys)


def test_bpe_neighbours_by_their_merges(own):
    """The quick test of a pair is that of merging its bytes."""
    r = random.Random(2)
    tokens = [t for t in range(256, 50_000, 7)] + list(range(256))
    pairs = [(r.choice(tokens), r.choice(tokens)) for _ in range(20_000)] + [(t, t) for t in tokens] + [own.made[t][1:] for t in range(300, 3000)]
    ends = [own.merged(own.bytes_of[a] + own.bytes_of[b]) == [a, b] for a, b in pairs]
    assert own.rising and [own.follows(a, b) for a, b in pairs] == ends and 0 < sum(ends) < len(ends)


def test_bpe_latin_cut_is_the_general_one(own):
    for c in map(chr, range(256)):
        for text in (f"a{c}1{c} {c}!{c}\t{c}b", f" {c}{c} {c}'s{c} x", f"{c}  {c}"):
            assert own.cut_latin(text) == own.cut(text)


def test_bpe_sections_and_bounds(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 50)
    monkeypatch.setattr(bpe, "PAIRS", 50)
    text = words(3000, 8) + "  \n " + "y" * 500 + "  " + words(300, 9)
    for most in (1, 7, 400):
        assert "".join(bpe.sections(text, most)) == text
        assert [w for s in bpe.sections(text, most) for w in own.cut(s)] == own.cut(text)
    monkeypatch.setattr(bpe, "SECTION", 100)
    assert own.encode([text, text])[1] == struct.pack(f"<{len(ids := library.encode(text).ids)}I", *ids)
    assert len(own.known) <= 50


def test_bpe_on_spark(spark, library):
    docs = frame(spark, AWKWARD + list(enumerate(STRANGE, 100))).repartition(3)
    path = P.path("byte_bpe_50k.json")
    rows = bpe.decode(bpe.encode(docs, path), path).select("text", "decoded", "w", bpe.unpacked("ids").alias("ids")).collect()
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "") and r.w == 1 for r in rows)
    report = bpe.bpe_report(docs, path)
    assert report.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and report.count() == len(AWKWARD) + len(STRANGE)
    assert bpe.bpe_report(frame(spark, []), path).count() == 0
