"""Byte-pair encoding of texts into the ids of a public vocabulary, and back.

A text's words come from the vocabulary's own rules. The different words of many documents lie in one flat array of symbols, a byte each at
first. Every round finds the lowest rank among the pairs of each word, by binary search over the sorted keys of all pairs, and merges them; words that have
no pair left leave the array. What a task has once merged, it keeps for the words to come.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters of text whose words are encoded together, and of words that a task keeps at most.
GROUP = 1 << 21
KEPT = 1 << 25

#: Words whose ids are looked up together.
SLICE = 1 << 18

#: The rank of a pair that isn't merged.
NONE = np.int32(2**31 - 1)

#: How the vocabulary file says that it reads texts; other files are refused.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

_WORDS = regex.compile(WORD_PATTERN.replace(r"\s", r"\p{White_Space}"))
_SPACE = re.compile(r"[ \t\r\n]")


class Vocabulary(NamedTuple):
    """first, last: a byte's symbol inside a word and at its end. keys: of all pairs, left * len(tokens) + right, sorted, ranks: their ranks. made: by rank, what
    the pair becomes. alone: by rank, whether no pair that what it makes is part of has a lower one. tokens: by id. special: ids of tokens that are looked for in raw texts."""

    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    alone: np.ndarray
    tokens: list[str]
    special: dict[str, int]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * len(self.tokens) + right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i], NONE)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [b for lo, hi in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(lo), ord(hi) + 1)]
    other = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(other.get(b, b)) for b in range(256)]


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a JSON file of a word-end BPE over bytes."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    model, split = j["model"], j["pre_tokenizer"]["pretokenizers"][0]
    end = model.get("end_of_word_suffix") or ""
    plain = not model.get("continuing_subword_prefix") and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback")
    if not (plain and end and [n["type"] for n in j["normalizer"]["normalizers"]] == NORMALIZERS and split["pattern"]["Regex"] == WORD_PATTERN and split["invert"] and split["behavior"] == "Removed" and j["decoder"] is None):
        raise ValueError(f"{path}: not a vocabulary that this operator can read")
    ids: dict[str, int] = model["vocab"]
    special = {a["content"]: a["id"] for a in j["added_tokens"]}
    size = max([*ids.values(), *special.values()]) + 1
    tokens = [""] * size
    for t, i in [*ids.items(), *special.items()]:
        tokens[i] = t
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right, made = (np.array([ids[x] for x in part], np.int64) for part in zip(*((a, b, a + b) for a, b in merges), strict=True))
    # of a pair that is listed twice, the later rank holds
    keys, at = np.unique((left * size + right)[::-1], return_index=True)
    ranks = (len(merges) - 1 - at).astype(np.int32)
    used = np.full(size, NONE)
    for part in (left, right):
        np.minimum.at(used, part[ranks], ranks)
    letters = byte_letters()
    symbols = lambda suffix: np.array([ids[x + suffix] for x in letters], np.int32)
    return Vocabulary(symbols(""), symbols(end), keys, ranks, made.astype(np.int32), used[made] > np.arange(len(merges)), tokens, special)


def merge(v: Vocabulary, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts): the ids of words of size bytes (1 at least) that lie behind each other in data, and how many each word has."""
    out = np.full(len(data), -1, np.int32)  # at a symbol's first byte, its id
    counted, at, symbol = np.cumsum(size) - size, np.arange(len(data)), v.first[data]
    ends = np.cumsum(size) - 1
    symbol[ends] = v.last[data[ends]]
    while len(size):
        n, begin = len(symbol), np.cumsum(size) - size
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # n: none
        after[begin[1:] - 1] = before[begin] = n
        rank = np.full(n, NONE)
        inner = np.flatnonzero(after < n)
        rank[inner] = v.rank(symbol[inner], symbol[inner + 1])
        live, dead = np.ones(n, bool), 0
        while True:
            least = np.minimum.reduceat(rank, begin)
            going = least < NONE
            if 2 * (dead + int(size[~going].sum())) >= n or not going.any():
                break
            hit = np.flatnonzero(rank == np.repeat(np.where(going, least, -1), size))
            order = np.arange(len(hit))
            follows, word = np.zeros(len(hit), bool), np.searchsorted(begin, hit, "right")
            follows[1:] = after[hit[:-1]] == hit[1:]
            # of pairs that overlap every other one counted from the left; of a pair whose product has a lower rank to offer, the first of its word
            even = (order - np.maximum.accumulate(np.where(follows, 0, order))) % 2 == 0
            hit = hit[np.where(v.alone[rank[hit]], even, np.concatenate(([True], word[1:] != word[:-1])))]
            gone = after[hit]
            symbol[hit], after[hit] = v.made[rank[hit]], after[gone]
            before[after[hit]] = hit
            rank[gone], live[gone] = NONE, False
            dead += len(gone)
            near = before[hit]
            changed = np.concatenate((hit, near[near < n]))
            rank[changed] = NONE
            changed = changed[after[changed] < n]
            rank[changed] = v.rank(symbol[changed], symbol[after[changed]])
        on = np.repeat(going, size)
        done = live & ~on
        out[at[done]] = symbol[done]
        size = np.add.reduceat(live, begin, dtype=np.int64)[going]
        at, symbol = at[live & on], symbol[live & on]
    found = out >= 0
    return out[found], np.add.reduceat(found, counted, dtype=np.int64) if len(counted) else np.zeros(0, np.int64)


@cache
def _new_parts() -> set[str]:
    """Characters later than Unicode 3.2 that others are composed of."""
    new = [chr(c) for c in range(0x110000) if unicodedata.ucd_3_2_0.category(chr(c)) == "Cn"]
    return {p for c in new if (d := unicodedata.decomposition(c)) and d[0] != "<" for x in d.split() if unicodedata.ucd_3_2_0.category(p := chr(int(x, 16))) == "Cn"}


def doubtful(c: str) -> bool:
    """Whether tables of another Unicode version may read a character otherwise: one without a meaning in Python's, or a later one than 3.2 that is a mark or part of a composition."""
    if unicodedata.category(c) == "Cn":
        return True
    return unicodedata.ucd_3_2_0.category(c) == "Cn" and (unicodedata.combining(c) != 0 or unicodedata.decomposition(c) != "" or c in _new_parts())


@cache
def _library(pattern: str) -> tuple[Any, Any]:
    from tokenizers import Regex, normalizers, pre_tokenizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(pattern), "removed", invert=True)


def words_of(text: str, sure: set[str]) -> list[str]:
    """The words of a text, normalised, white space left out. sure: characters known not to be doubtful, which it adds to; texts with a doubtful one are rare, and read by the public library's own rules."""
    if not text.isascii():
        for c in set(text) - sure:
            if doubtful(c):
                normal, split = _library(WORD_PATTERN)
                return [w for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]
            sure.add(c)
        # letters one by one: a sigma at a word's end is no other letter here
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return _WORDS.findall(text.lower())


def pieces(text: str, size: int = GROUP) -> Iterator[str]:
    """The text in pieces of size characters or somewhat more, cut before white space, where no word goes on."""
    lo = 0
    while lo < len(text):
        m = _SPACE.search(text, lo + size) if lo + size < len(text) else None
        yield text[lo : m.start() if m else len(text)]
        lo = m.start() if m else len(text)


class Encoder(dict):
    """Numbers words by their first appearance, and holds the ids of those that it knows."""

    def __init__(self, v: Vocabulary):
        self.v, self.fresh, self.chars, self.sure = v, [], 0, set()
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        for t in v.special:
            self[t]  # numbers of their own, before any word's
        self.learn()

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self.chars += len(word)
        self[word] = n = len(self)
        return n

    def learn(self) -> None:
        """Encodes the words met since."""
        if not self.fresh:
            return
        known = [w for w in self.fresh if w not in self.v.special]
        data = [w.encode() for w in known]
        ids, counts = merge(self.v, np.frombuffer(b"".join(data), np.uint8), np.array([len(x) for x in data], np.int64))
        if len(known) < len(self.fresh):  # only at first
            ids, counts = np.array([self.v.special[w] for w in self.fresh], np.int32), np.ones(len(self.fresh), np.int64)
        self.ids = np.concatenate((self.ids, ids))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(counts)))
        self.fresh = []

    def numbers(self, text: str) -> list[int]:
        """The numbers of a text's words. No word is a special token, as words are of letters or of signs alone."""
        if self.parts is None or "<" not in text:
            return list(map(self.__getitem__, words_of(text, self.sure)))
        out: list[int] = []
        for i, part in enumerate(self.parts.split(text)):
            out += [self[part]] if i % 2 else map(self.__getitem__, words_of(part, self.sure))
        return out

    def encode(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words by their numbers."""
        self.learn()
        counts, ids = self.first[numbers + 1] - self.first[numbers], [np.zeros(0, np.int32)]
        for lo in range(0, len(numbers), SLICE):
            part, many = numbers[lo : lo + SLICE], counts[lo : lo + SLICE]
            upto = np.cumsum(many)
            ids.append(self.ids[np.arange(int(upto[-1])) + np.repeat(self.first[part] - (upto - many), many)])
        return np.concatenate(ids), counts


def _encoded(shared: Any):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (doc_id, text) to those of (doc_id, ids)."""
        known = Encoder(shared.value)
        for b in batches:
            rows, lo, chars = [], 0, 0  # of the rows from lo on, the words' numbers
            for i, text in enumerate(b.column(1)):
                rows.append(np.concatenate([np.zeros(0, np.int64), *(np.array(known.numbers(x), np.int64) for x in pieces(text.as_py() or ""))]))
                chars += len(text.as_py() or "")
                if chars >= GROUP or i == len(b) - 1:
                    ids, counts = known.encode(np.concatenate(rows))
                    upto = np.concatenate(([0], np.cumsum(counts)))
                    offsets = upto[np.cumsum([0, *map(len, rows)])]
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(rows)), lists], ["doc_id", "ids"])
                    rows, lo, chars = [], i + 1, 0
                    if known.chars > KEPT:
                        known = Encoder(shared.value)

    return of


def _decoded(shared: Any):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (doc_id, ids) to those of (doc_id, ids, text)."""
        tokens = shared.value.tokens
        names = pa.array(tokens)
        known = np.array([bool(t) for t in tokens])
        for b in batches:
            lo = 0
            while lo < len(b):
                column = b.column(1).slice(lo)
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                many = max(1, int(np.searchsorted(np.cumsum(sizes), GROUP, "right")))
                ids = column.slice(0, many).flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(sizes[:many])), sizes[:many])
                good = (ids >= 0) & (ids < len(tokens))
                good[good] = known[ids[good].astype(np.int64)]
                offsets = np.concatenate(([0], np.cumsum(np.bincount(row[good], minlength=len(sizes[:many])))))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(ids[good].astype(np.int64))))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, many) for c in b.columns), pc.binary_join(lists, " ")], ["doc_id", "ids", "text"])
                lo += many

    return of


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: doc_id and ids, what the public library gives for the text without truncation, padding or added marks.

    Special tokens that stand in a text are found as such. Null text has no ids, as the empty one. Ids of rows may be null or repeat; other columns
    aren't read. An empty table gives an empty table. The vocabulary, of fixed size, goes to each executor once.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encoded(shared), f"doc_id {kind}, ids array<int>")


def decode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row for each row of df: doc_id, ids and text, the tokens of the ids joined by one space, special ones too. Ids that aren't the vocabulary's are left out; no ids, or null, give the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, ids_col)]
    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(_decoded(shared), f"doc_id {kinds[0]}, ids {kinds[1]}, text string")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    v = read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    out = decode(encode(table(spark, sf_dir, "documents"), v), v)
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256"))
