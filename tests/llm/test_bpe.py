"""Byte-pair encoding against the public library."""

import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftwave.llm import bpe

from .conftest import key

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


ODD = [
    "I'm you're DON'T it'll 'tis 's", "ΣΑΣ ὈΔΥΣΣΕΎΣ İstanbul ẞ ǅ", "é ọ̈ ẛ̣ 가각 ﬁ", "a\u0085b c　d\x1ce", "<|startoftext|>Hi<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>",
    "e<|endoftext|>́x", "=" * 300 + "-" * 77, "aaaaaaaaaaaaaaaa" * 40, "日本語のとても長い文章がここにあります" * 30, "𝔘𝔫𝔦 🤦🏽‍♂️ 🇩🇪", "1234 ٣٤ Ⅷ ½", "�\x00\x7f", "Ა Ɤ Ɤ Ᲊ Ꟛ \U00010d50 ࢏",
    "supercalifragilisticexpialidocious antidisestablishmentarianism",
]


def test_same_ids_and_texts(spark, docs, corpus, library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP", 700)
    monkeypatch.setattr(bpe, "KEPT", 3000)
    monkeypatch.setattr(bpe, "SLICE", 50)
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = [(i, t or "") for i, t, *_ in corpus] + [(1000 + i, t) for i, t in enumerate(ODD)]
    expected = []
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        expected.append((i, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    got = bpe.decode(bpe.encode(df, vocabulary), vocabulary).collect()
    assert sorted(((r.doc_id, tuple(r.ids), r.text) for r in got), key=key) == sorted(expected, key=key)


def test_query(spark, library):
    from siftwave.llm.common import table

    got = {r.doc_id: tuple(r)[1:] for r in bpe.op12_bpe(spark, "/root/testdata/sf0.001").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_every_character(library, vocabulary):
    """Between letters, signs, digits and marks, each character is read as the library reads it."""
    known = bpe.Encoder(vocabulary)
    some = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE0200)) + [0x10FFFF]
    for frame in ("A{}b", "!{}1", "e{}́"):
        for lo in range(0, len(some), 4096):
            texts = [frame.format(chr(c)) for c in some[lo : lo + 4096]]
            expected = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
            numbers = [np.array(known.numbers(t), np.int64) for t in texts]
            known.learn()
            for t, n, ids in zip(texts, numbers, expected, strict=True):
                assert known.encode(n)[0].tolist() == ids, [hex(ord(x)) for x in t]


def plain(rules, size, word):
    """One merge at a time: of the lowest rank the leftmost."""
    word = list(word)
    while True:
        found = [(rules[p], i) for i, p in enumerate(zip(word, word[1:])) if p in rules]
        if not found:
            return word
        rank, i = min(found, key=lambda x: (x[0][0], x[1]))
        word[i : i + 2] = [rank[1]]


@pytest.mark.parametrize("seed", range(30))
def test_rounds(seed):
    """Any rules, also those whose product is part of a pair of lower rank, and runs of one letter."""
    r = random.Random(seed)
    size, letters = 60, r.choice([1, 2, 3])
    pairs = r.sample([(a, b) for a in range(letters + 20) for b in range(letters + 20)], 50)
    made = [r.randrange(letters, 40) for _ in pairs]
    rules = {p: (i, m) for i, (p, m) in enumerate(zip(pairs, made, strict=True))}
    keys = np.array([a * size + b for a, b in pairs])
    order = np.argsort(keys)
    used = np.full(size, bpe.NONE)
    for i, p in enumerate(pairs):
        used[list(p)] = np.minimum(used[list(p)], i)
    v = bpe.Vocabulary(np.arange(256, dtype=np.int32), np.arange(256, dtype=np.int32), keys[order], order.astype(np.int32), np.array(made, np.int32), used[made] > np.arange(50), [""] * size, {})
    words = [[r.randrange(letters) for _ in range(r.choice([1, 2, 5, 9, 40]))] for _ in range(60)]
    ids, counts = bpe.merge(v, np.array([x for w in words for x in w], np.uint8), np.array([len(w) for w in words]))
    expected = [plain(rules, size, w) for w in words]
    assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == [x for w in expected for x in w]


def test_long_word(library, vocabulary):
    r = random.Random(3)
    word = "".join(r.choice("etaoinshrdlué") for _ in range(20_000))
    known = bpe.Encoder(vocabulary)
    assert known.encode(np.array(known.numbers(word), np.int64))[0].tolist() == library.encode(word, add_special_tokens=False).ids


def test_odd_tables(spark, empty, vocabulary):
    assert bpe.decode(bpe.encode(empty, vocabulary), vocabulary).collect() == []
    df = spark.createDataFrame([(1, [1, -5, 10**6, 256]), (None, None), (2, []), (2, [])], "doc_id int, ids array<int>")
    assert sorted(((r.doc_id, r.text) for r in bpe.decode(df, vocabulary).collect()), key=key) == [(None, ""), (1, '" !</w>'), (2, ""), (2, "")]
    with pytest.raises((ValueError, KeyError)):
        bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    assert unicodedata.category("\u088f") == "Cn" and bpe.doubtful("\u088f") and not bpe.doubtful("é")
