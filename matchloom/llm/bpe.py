"""Byte-level BPE encoding and decoding, by a trie of the distinct words of a task.

A text is cut at its added tokens and then into words as the tokenizer's file says. The words that a task has not met
yet make a trie. A depth-first walk carries along the path, byte by byte, the *last token* of the encoding of the
prefix that ends there: the longest token that ends the prefix and can follow the last token of what is before it. Two
tokens can follow one another if encoding their bytes together gives just these two; a sequence of tokens is the
encoding of its bytes if and only if all its neighbours can. So the state of a shared prefix is worked out once for all
words that have it, and the encoding of a word is read backwards off the path.

Words do not travel: each task encodes those of its own texts and remembers the frequent short ones up to a bound, so
there is no shuffle, and memory depends on a batch and on the bounds, not on the corpus. A lost task starts anew.

Ids are packed as little-endian unsigned 32-bit numbers into one binary value a document; ``unpacked`` gives arrays.

Edge cases: a null text is an empty one and has no ids; a text of any length is encoded in sections that end before a
separator; a word of any length is one path of the trie; strings of added tokens are those tokens; extra columns stay,
but for one named as ``into``, which is replaced; null and repeated ids play no part; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import json
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the cut of this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for code points below 256, with their white space, letters and numbers by name.
_SPACE, _LETTER, _NUMBER = r"\t-\r \x85\xa0", r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: A tokenizer's file is sent to all executors; a larger one is refused.
MAX_FILE = 64 * 2**20
#: Characters of texts cut at a time; words remembered, and their code points at most; pairs of tokens remembered.
SECTION, WORDS, WORD_CHARS, PAIRS = 2_000_000, 600_000, 40, 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: itself if printable in Latin-1, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


@functools.cache
def _recent() -> re.Pattern:
    """Code points that Unicode 3.2 did not assign: libraries may disagree on what they are."""
    old, spans = unicodedata.ucd_3_2_0, []
    for c in range(0x80, 0x110000):
        if not 0xD800 <= c < 0xE000 and old.category(chr(c)) == "Cn":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]")


def _latin(text: str) -> bool:
    """Whether a text has code points below 256 only."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Trie:
    """Distinct byte strings as a trie, held as its depth-first walk: the strings in order, and how much of the path to
    each is that of the one before. An edge is what a string has beyond that."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = sorted(words)  # code points are ordered as their UTF-8 bytes are

    def walk(self) -> Iterator[tuple[int, bytes, str]]:
        """For each string, in depth-first order: the depth of its fork off the path so far, the bytes below it, the word."""
        before = b""
        for word in self.words:
            key = word.encode()
            depth, most = 0, min(len(before), len(key))
            if before[: most // 2] == key[: most // 2]:
                depth = most // 2
            while depth < most and before[depth] == key[depth]:
                depth += 1
            yield depth, key[depth:], word
            before = key


class Tokenizer:
    """One tokenizer in one Python worker: its tables, and what it remembers."""

    def __init__(self, source: str) -> None:
        found = json.loads(source)
        model, cut, decoder = found["model"], found["pre_tokenizer"], found["decoder"]
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
        own = cut["type"] == decoder["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not found["normalizer"]
        if not own or any((model.get(k) or None) != (v or None) for k, v in plain.items()):
            raise ValueError("not a plain byte-level BPE tokenizer")
        letters = byte_letters()
        ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        added = {t["content"]: t["id"] for t in found["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found["added_tokens"]):
            raise ValueError("added tokens with rules of their own")
        self.source, self.ids, self.added = source, ids, added
        self.bytes_of = [b""] * (1 + max([*ids.values(), *added.values()]))
        for token, i in [*ids.items(), *((c.encode(), i) for c, i in added.items())]:
            self.bytes_of[i] = token
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank.setdefault((ids[a], ids[b]), (k, ids[a + b]))
        self.made = {new: (k, *pair) for pair, (k, new) in reversed(self.rank.items())}
        # whether each merge comes after those of its parts, as it does where merges were learnt one by one
        self.rising = all(k > max(self.made.get(a, (-1,))[0], self.made.get(b, (-1,))[0]) for k, a, b in self.made.values())
        self.edges: tuple[dict, dict] = ({}, {})
        # states of the walk: the longest end of the path that begins a token; they are numbered as they are met
        self.begins = {token[:n] for token in ids for n in range(len(token) + 1)}
        self.state_of = {b"": 0}
        self.path_of, self.ending, self.after = [b""], [()], {}
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.cut, self.cut_latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        self.split = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")").split if added else lambda text: [text]
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.library = None

    def merged(self, key: bytes) -> list[int]:
        """The encoding of a few bytes straight from the list of merges: the first of the lowest rank, again and again."""
        row = [self.ids[key[i : i + 1]] for i in range(len(key))]
        while len(row) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(row, row[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            row[i : i + 2] = [self.rank[row[i], row[i + 1]][1]]
        return row

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at one end of a token (0 left, 1 right) while it is merged, from its byte up, each with the rank of the merge that takes it."""
        found = self.edges[side].get(token)
        if found is None:
            up: list[tuple[int, float]] = [(token, math.inf)]
            while (made := self.made.get(up[-1][0])) is not None:
                up.append((made[1 + side], made[0]))
            found = self.edges[side][token] = up[::-1]
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether b can come after a; a is -1 at the start.

        While both are merged, the two at the border change; b cannot follow if a merge across the border comes before those
        that take either of them away from it. Of equal merges the leftmost comes first.
        """
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        if a < 0 or not self.rising:
            found = self.merged((self.bytes_of[a] if a >= 0 else b"") + self.bytes_of[b]) == ([a, b] if a >= 0 else [b])
        else:
            left, right, i, k = self._edge(a, 1), self._edge(b, 0), 0, 0
            while True:
                (x, gone), (y, also) = left[i], right[k]
                across = self.rank.get((x, y))
                found = across is None or across[0] >= gone or across[0] > also
                if not found or gone == also == math.inf:
                    break
                i, k = (i + 1, k) if gone <= also else (i, k + 1)
        self.pairs[a + 1 << 32 | b] = found
        return found

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte, and in ``ending`` the tokens that end there, longest first, with their lengths."""
        path = self.path_of[state] + bytes((byte,))
        while path not in self.begins:
            path = path[1:]
        new = self.state_of.get(path)
        if new is None:
            new = self.state_of[path] = len(self.path_of)
            self.path_of.append(path)
            ends = ((self.ids.get(path[-n:]), n) for n in range(len(path), 0, -1))
            self.ending.append(tuple((token, n) for token, n in ends if token is not None))
        self.after[state << 8 | byte] = new
        return new

    def encodings(self, trie: Trie) -> Iterator[tuple[str, bytes]]:
        """Each word of the trie with its packed ids, depth first. The path keeps, per byte, the state and the last token."""
        states, lasts = [0], [-1]
        after, ending, pairs, packed = self.after, self.ending, self.pairs, self.packed
        length = [len(x) for x in self.bytes_of]
        for depth, label, word in trie.walk():
            del states[depth + 1 :], lasts[depth + 1 :]
            state = states[-1]
            for byte in label:
                new = after.get(state << 8 | byte)
                state = self.step(state, byte) if new is None else new
                for token, n in ending[state]:
                    a = lasts[-n]
                    fits = pairs.get(a + 1 << 32 | token)
                    if self.follows(a, token) if fits is None else fits:
                        break
                else:
                    raise ValueError(f"no token ends {self.path_of[state]!r}")
                states.append(state)
                lasts.append(token)
            row, end = [], len(lasts) - 1
            while end:
                token = lasts[end]
                row.append(packed[token])
                end -= length[token]
            row.reverse()
            yield word, b"".join(row)

    def words(self, text: str) -> list[str]:
        if text.isascii() or _latin(text):
            return self.cut_latin(text)
        if not _recent().search(text):
            return self.cut(text)
        if self.library is None:
            import tokenizers

            self.library = tokenizers.Tokenizer.from_str(self.source).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _encoded(self, pieces: list[list[str]]) -> list[bytes]:
        """Packed ids of lists of words."""
        met = set().union(*pieces)
        new = met.difference(self.known)
        if len(self.known) + len(new) > WORDS:
            # what these texts have stays, as words that are met often do
            self.known = {w: self.known[w] for w in met.difference(new)} if len(met) < WORDS else {}
            new = met.difference(self.known)
        here = dict(self.encodings(Trie(new)))
        self.known.update((w, v) for w, v in here.items() if len(w) <= WORD_CHARS)
        long = {w: v for w, v in here.items() if len(w) > WORD_CHARS}
        find = (lambda w: long.get(w) or self.known[w]) if long else self.known.__getitem__
        return [b"".join(map(find, row)) for row in pieces]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[list[bytes]] = []
        places: list[tuple[int, int]] = []
        pieces: list[list[str]] = []
        size = 0

        def flush() -> None:
            for (text, k), value in zip(places, self._encoded(pieces), strict=True):
                out[text][k] = value
            places.clear()
            pieces.clear()

        for text in texts:
            out.append([])
            for k, part in enumerate(self.split(text)):
                if k % 2:
                    out[-1].append(self.added[part].to_bytes(4, "little"))
                    continue
                for section in sections(part):
                    places.append((len(out) - 1, len(out[-1])))
                    pieces.append(self.words(section))
                    out[-1].append(b"")
                    size += len(section)
                    if size >= SECTION:
                        flush()
                        size = 0
        flush()
        return [b"".join(row) for row in out]

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist())).decode("utf-8", errors="replace")


def sections(text: str, most: int = SECTION) -> Iterator[str]:
    """Parts of a text that end before a separator and after something else, where no word goes across."""
    begin = 0
    while len(text) - begin > most:
        end = text.find(" ", begin + most)
        while end > 0 and text[end - 1].isspace():
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[begin:end]
        begin = end
    if begin < len(text):
        yield text[begin:]


@functools.lru_cache(maxsize=2)
def _tokenizer(source: str) -> Tokenizer:
    return Tokenizer(source)


def _sent(spark: SparkSession, path: str):
    """The tokenizer's file as a broadcast value; its size does not depend on the corpus and is checked."""
    with open(path, encoding="utf-8") as f:
        source = f.read(MAX_FILE + 1)
    if len(source) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} characters")
    Tokenizer(source)
    return spark.sparkContext.broadcast(source)


def encode(docs: DataFrame, path: str, into: str = "ids") -> DataFrame:
    """All columns of docs and the column ``into``: the packed ids of the text by the tokenizer of a file."""
    source = _sent(docs.sparkSession, path)

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series(_tokenizer(source.value).encode(texts), dtype=object)

    return docs.withColumn(into, encoded(F.coalesce("text", F.lit(""))))


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of docs and the column ``into``: the text of packed ids (null for null)."""
    source = _sent(docs.sparkSession, path)

    @F.pandas_udf("string")
    def decoded(rows: pd.Series) -> pd.Series:
        own = _tokenizer(source.value)
        return pd.Series([None if row is None else own.decode(row) for row in rows], dtype=object)

    return docs.withColumn(into, decoded(ids))


def unpacked(ids: str | Column) -> Column:
    """Packed ids as an array of numbers."""

    @F.pandas_udf("array<int>")
    def numbers(rows: pd.Series) -> pd.Series:
        return pd.Series([None if row is None else np.frombuffer(row, dtype="<i4") for row in rows], dtype=object)

    return numbers(ids)


def bpe_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = decode(encode(docs.select("doc_id", "text"), path), path)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
