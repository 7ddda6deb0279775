from collections import Counter, defaultdict

import pytest

from siftwave.llm import minhash as M

from .conftest import key, words

LAST = (1 << 63) - 1


def shingle_set(text, n):
    w = words(text, True)
    return frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, n=4, percent=80):
    sets = [shingle_set(t, n) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in enumerate(sets):
        for b in range(a):
            if s and sets[b] and 100 * len(s & sets[b]) >= percent * len(s | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: LAST)
    ids = [LAST if i is None else i for i, *_ in rows]
    for a in range(len(rows)):
        least[find(a)] = min(least[find(a)], ids[a])
    out = []
    for a, (i, *_) in enumerate(rows):
        c = least[find(a)] if sets[a] else ids[a]
        c = None if c == LAST else c
        out.append((i, len(sets[a]), c, i == c))
    return out


@pytest.mark.parametrize("options", [{}, {"rounds": 0, "block": 300}, {"rounds": 1, "block": 1}])
def test_report(docs, corpus, options):
    got = [tuple(r) for r in M.report(docs, **options).collect()]
    assert sorted(got, key=key) == sorted(brute(corpus), key=key)


def test_leaders(docs, corpus):
    got = M.keep_leaders(docs)
    assert got.columns == docs.columns
    ids = Counter(r.doc_id for r in got.collect())
    expected = Counter()
    for row in {(r[0], r[1]): b for r, b in zip(corpus, brute(corpus), strict=True)}.values():
        expected[row[0]] += row[3]
    # of two texts under one id, each is judged for itself
    assert {i for i, n in ids.items() if n} == {i for i, n in expected.items() if n}


@pytest.mark.parametrize("options", [{}, {"rounds": 0}, {"rounds": 0, "block": 2000}, {"rounds": 1, "block": 700}])
def test_many_near_copies(spark, options):
    """A group whose texts differ by more and more words: links, and pairs just below them, are both very many."""
    import random

    r = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(r.choice([1, 2, 3, 3, 4, 5])):
            t[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(t[: r.choice([150, 150, 140])])))
    expected = brute(rows)
    assert 20 < len({x[2] for x in expected}) < 110
    got = [tuple(x) for x in M.report(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()]
    assert sorted(got) == sorted(expected)


def test_words_that_collide(spark):
    """One word each, the Thue-Morse word and its complement."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, a), (2, a.translate(str.maketrans("ab", "ba"))), (3, a.upper())]
    got = [tuple(x) for x in M.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False)]


def test_exact_shingles():
    import pyarrow as pa

    texts = [["a b c d e a b c d", None, "A b", "x"], ["a b c d", "", "a b c", "b a"]]
    got = M.exact_shingles([pa.array(t) for t in texts], 4)
    back = {}
    for column, (doc, shingle) in zip(texts, got, strict=True):
        for i, t in enumerate(column):
            own = set(shingle[doc == i].tolist())
            assert len(own) == len(shingle_set(t, 4))
            back[t] = own
    assert back["a b c d"] < back["a b c d e a b c d"] and not back["A b"] & back["a b c"] and not back["A b"] & back["b a"]


def test_clashing_names(docs):
    names = {"lang": "did", "source": "t", "n_chars": "row", "words": "leader"}
    got, plain = M.keep_leaders(docs.withColumnsRenamed(names)), M.keep_leaders(docs)
    assert got.columns == [names.get(c, c) for c in plain.columns]
    assert got.count() == plain.count()


def test_empty(empty):
    assert M.report(empty).collect() == []
    assert M.keep_leaders(empty).collect() == []
