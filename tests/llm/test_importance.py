"""Importance resampling against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siftwave.llm import importance as I

from .conftest import key

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, n, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + m]).encode()) % buckets for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def plain(rows, target, n, buckets, percent, least, seed):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(grams(x, n, buckets))
    for x in target:
        t.update(grams(x, n, buckets))
    s_all, t_all, out = sum(s.values()), sum(t.values()), []
    for i, x in rows:
        g = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in grams(x, n, buckets)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least])
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], (x[0] is not None, x[0] or 0)))
    for place, x in enumerate(fit):
        x[4] = place + 1 if place < len(fit) * percent // 100 else None
    return [tuple(x[:4]) + (x[4] or None,) for x in out]


@pytest.mark.parametrize(("n", "buckets", "percent", "least", "chunk"), [(1, 10_000, 10, 20, 1 << 21), (1, 50, 60, 1, 40), (3, 1000, 100, 0, 40), (2, 7, 30, 20, 1000)])
def test_resample(spark, docs, corpus, n, buckets, percent, least, chunk, monkeypatch):
    """Whole and cut texts, nulls, repeated rows and ids."""
    monkeypatch.setattr(I, "CHUNK", chunk)
    target = [corpus[3][1], "One two THREE four", None, "", "a-b c1", *(t for _, t, *_ in corpus[:4])]
    df = spark.createDataFrame([(x,) for x in target], "text string")
    got = [tuple(r) for r in I.resample(docs, df, n=n, buckets=buckets, percent=percent, least_words=least).collect()]
    expected = plain([(i, t) for i, t, *_ in corpus], target, n, buckets, percent, least, 2024)
    assert sorted(x[:4] for x in got if x[0] is not None) == sorted(x[:4] for x in expected if x[0] is not None)
    assert Counter(x[:4] for x in got) == Counter(x[:4] for x in expected)
    # rows of one id and score may swap ranks
    ranked = lambda rows: sorted((x[4], x[3], x[0]) for x in rows if x[4] is not None)
    assert [x[:2] for x in ranked(got)] == [x[:2] for x in ranked(expected)]
    unique = {i for i, c in Counter(i for i, *_ in corpus).items() if c == 1}
    assert sorted((x for x in got if x[0] in unique), key=key) == sorted((x for x in expected if x[0] in unique), key=key)


def test_ties(spark):
    """Many rows of one score: the smaller ids are drawn, also over the border of a slot."""
    rows = spark.range(0, 1000, 1, 7).selectExpr("id as doc_id", "id % 3 * 256 as score")
    from siftwave.llm.common import Scratch

    assert I.threshold(rows, 333) == 512 and I.threshold(rows, 334) == 256 and I.threshold(rows, 1000) == 0 and I.threshold(rows, 1001) is None and I.threshold(rows, 0) is None
    got = [(r.rank, r.doc_id) for r in I.ranked(rows, Scratch(spark, "test")).orderBy("rank").collect()]
    assert got == list(enumerate(sorted(range(1000), key=lambda i: (-(i % 3), i)), 1))


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8])
def test_suffix_order(depth):
    r = random.Random(depth)
    ids = [r.choice([0, 1, 2, 3]) for _ in range(300)] + [1] * 40 + [0]

    def suffix(i):
        out = []
        for x in ids[i : i + depth]:
            out.append(x)
            if x == 0:
                break
        return out

    order, common = I.suffix_order(np.array(ids), depth)
    assert sorted(order.tolist()) == list(range(len(ids)))
    of = [suffix(i) for i in order]
    assert of == sorted(of)
    for i in range(1, len(of)):
        same = next((j for j, (a, b) in enumerate(zip(of[i - 1], of[i])) if a != b or a == 0), min(len(of[i - 1]), len(of[i])))
        assert common[i] == same


def test_no_rows(spark, docs, empty):
    target = spark.createDataFrame([("x",)], "text string")
    assert I.resample(empty, target).collect() == []
    assert all(r.rank is None or r.rank > 0 for r in I.resample(docs, empty).collect())
