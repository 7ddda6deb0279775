import hashlib
from collections import Counter

import pytest

from siftwave.llm import substring_dedup as S

from .conftest import key, words


def brute(rows, window=50):
    """(id, n_words, n_removed, sha256) of each row."""
    last = (1 << 63) - 1
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - window + 1):
            g = tuple(w[j : j + window])
            first[g] = min(first.get(g, last), last if i is None else i)
    out = []
    for i, t, *_ in rows:
        w, gone = words(t), set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (last if i is None else i):
                gone.update(range(j, j + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [256, 1])  # 1: the windows of every minimiser go one by one
def test_report(docs, corpus, hot):
    got = [tuple(r) for r in S.report(docs, hot=hot).collect()]
    assert sorted(got, key=key) == sorted(brute(corpus), key=key)
    assert sum(r[2] > 0 for r in got) > 5


def test_small_windows(docs, corpus):
    got = [tuple(r) for r in S.report(docs, window=6, run=2, hot=3).collect()]
    assert sorted(got, key=key) == sorted(brute(corpus, 6), key=key)


def test_remove(docs, corpus):
    got = S.remove_repeats(docs)
    assert got.columns == docs.columns
    expected = {k: v for (i, n, gone, sha), (_, t, *_) in zip(brute(corpus), corpus, strict=True) for k, v in [((i, t), (gone, sha))]}
    kept = Counter()
    for i, (gone, sha) in ((k[0], v) for k, v in expected.items()):
        kept[i, gone > 0] += 1
    assert got.count() == docs.count()
    unchanged = {(r.doc_id, r.text) for r in got.collect()}
    for (i, t), (gone, sha) in expected.items():
        assert gone > 0 or (i, t) in unchanged


def test_clashing_names(docs):
    """A row's own columns may have any name that the operator uses."""
    names = {"lang": "did", "source": "h1", "n_chars": "h2", "words": "kept", "label": "row"}
    got, plain = S.remove_repeats(docs.withColumnsRenamed(names)), S.remove_repeats(docs)
    assert got.columns == [names.get(c, c) for c in plain.columns]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def morse(n):
    """The Thue-Morse word and its complement: polynomials modulo powers of two can't tell them apart."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_collide(spark):
    a, b = morse(1024)
    common = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{common} {x} {common}") for i, x in enumerate([a, b, a])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (256, 1):
        got = [tuple(r) for r in S.report(df, hot=hot).collect()]
        assert sorted(got) == sorted(brute(rows)) and sorted(r[2] for r in got) == [0, 0, 61]


def test_hot_passages(spark):
    """Passages of many lengths in very different surroundings, some with a word changed, by way of hot minimisers."""
    import random

    r = random.Random(3)
    text = lambda n: [f"{r.randrange(10**6)}" for _ in range(n)]
    shared = [text(n) for n in (50, 51, 64, 120, 400)]
    rows = []
    for i in range(60):
        parts = text(r.randrange(40))
        for p in r.sample(shared, 2):
            lo = r.randrange(0, len(p) - 49)
            p = list(p[lo:])
            if i % 5 == 0:
                p[r.randrange(len(p))] = "x"
            parts += [*p, *text(r.randrange(30))]
        rows.append((i, " ".join(parts)))
    got = [tuple(x) for x in S.report(spark.createDataFrame(rows, "doc_id long, text string"), hot=3).collect()]
    assert sorted(got) == sorted(brute(rows)) and sum(x[2] > 0 for x in got) > 30


def test_empty(empty):
    assert S.report(empty).collect() == []
    assert S.remove_repeats(empty).collect() == []
