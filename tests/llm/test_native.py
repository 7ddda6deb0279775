"""The operators without Python on the executors: mixing, URL rules, quality, decontamination."""

import hashlib
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from siftwave.llm import decontaminate as D
from siftwave.llm import mixing, quality
from siftwave.llm import url_filter as U

from .conftest import SCHEMA, key, words

PYTHON = re.compile("Python|Pandas|Arrow")


def native(df):
    assert not PYTHON.search(df._jdf.queryExecution().executedPlan().toString())
    return [tuple(r) for r in df.collect()]


def test_mix(spark, docs, corpus, empty):
    got = native(mixing.mix(docs, mixing.WEIGHTS))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(corpus, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"}))
    expected = con.execute(mixing.OP3_SQL).fetchall()
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert all(taken <= 2 * size for _, size, _, _, taken in got)
    assert mixing.mix(empty, mixing.WEIGHTS).collect() == []


def test_mix_nears_targets(spark):
    rows = [(i, "w " * (1 + i % 7), None if i % 5 == 0 else f"s{i % 4}") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.WEIGHTS).toPandas()
    got["source"] = got.doc_id.map({r[0]: r[2] or "none" for r in rows})
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per.taken - per.target).abs() <= 7).all()
    assert abs(per.target.sum() - 1.5 * got["size"].sum()) < 1e-6


URLS = ["http://A.example.COM/en/7?x", "https://example.com/en/8", "ftp://com", "http://com/en/", "http://xcom/en/", "http://b.net/de/1#y", "http://example.net/de/81", "http://example.net?/de/8", "nothing", None, "", "://", "http:///en/", "http://a..com/en/é", "http://org/es/", "x://y://net/de/", "http://" + "a." * 3000 + "org/es/" + "z" * 5000]


def test_urls(spark, empty):
    rows = [(i, u, "h", "p") for i, u in enumerate(URLS)] + [(3, URLS[3], "h", "p"), (None, URLS[0], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = native(U.judge_urls(pages, U.RULES))
    expected = []
    for i, u, *_ in rows:
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        expected.append((i, host, path, best and best.host + best.path, best.verdict if best else "allow"))
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert U.judge_urls(pages.limit(0), U.RULES).collect() == []
    assert {r.verdict for r in U.judge_urls(pages, []).collect()} == {"allow"}


def base(text):
    t, w = text or "", words(text)
    grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    hit = {p for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def low(x):
    return x - x % (1 << max(x.bit_length() - 6, 0))


def verdicts(rows):
    """kept for each row, with cutoffs from sorted values instead of sketches."""
    measured = []
    for _, t, lang, source, *_ in rows:
        n, chars, symbols, dup, _, failed = base(t)
        lines = len([x for x in (t or "").split("\n") if words(x)])
        measured.append((lang, source, failed, {"symbols": symbols * 10000 // max(n, 1), "dup_lines": dup * 10000 // max(lines, 1), "length": chars * 100 // max(n, 1)}))
    good = [m for m in measured if not m[2]]
    out = []
    for lang, source, failed, v in measured:
        own = [m for m in good if m[:2] == (lang, source)]
        if len(own) < quality.LEAST_DOCUMENTS:
            own = [m for m in good if m[0] == lang]
        if len(own) < quality.LEAST_DOCUMENTS:
            own = good
        kept = not failed
        for m in quality.MEASURES:
            values = sorted(low(x[3][m.name]) for x in own)
            at = lambda q, values=values: values[-(-len(values) * q // 1000) - 1]
            if values and v[m.name] > min(at(500) + quality.TIMES * max(at(750) - at(500), m.spread), m.most or 10**9):
                kept = False
        out.append(kept)
    return out


@pytest.mark.parametrize("times", [1, 60])
def test_quality(spark, docs, corpus, times):
    corpus = corpus if times == 1 else [(None if r[0] is None else 100 * r[0] + j, r[1], *r[2:]) for r in corpus if len(r[1] or "") < 5000 for j in range(times)]
    df = docs if times == 1 else spark.createDataFrame(corpus, SCHEMA)
    got = native(quality.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
    expected = [(r[0], *base(r[1]), k) for r, k in zip(corpus, verdicts(corpus), strict=True)]
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_keep_good(docs, corpus, empty):
    got = quality.keep_good(docs)
    assert got.columns == docs.columns
    assert got.count() == sum(verdicts(corpus))
    names = {"n_chars": "digest", "words": "row", "label": "_digest"}
    other = quality.keep_good(docs.withColumnsRenamed(names))
    assert other.columns == [names.get(c, c) for c in docs.columns] and other.count() == got.count()
    assert quality.judge(empty).collect() == [] and quality.keep_good(empty).collect() == []


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return ITEM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def contamination(rows, items, window=13):
    grams = {}
    for i, t in items:
        w = fold(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    lengths = {len(g) for g in grams}
    for i, t, *_ in rows:
        w, hit, found = fold(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if (g := tuple(w[j : j + n])) in grams:
                    hit.update(range(j, j + n))
                    found |= grams[g]
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def items(corpus):
    long = [r[1] for r in corpus if r[1] and 60 < len(r[1].split()) < 200]
    return [(1, long[0]), (20, "x " + " ".join(long[1].split()[5:25]).upper()), (3, "ONE, two!"), (4, None), (5, "..."), (6, long[0]), (7, "d")]


@pytest.mark.parametrize("most", [200_000, 0])  # 0: nothing is broadcast
def test_contamination(spark, docs, corpus, items, most):
    df = D.report(docs, spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=most)
    got, expected = native(df), list(contamination(corpus, items))
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert sum(r[-1] for r in got) > 2


def test_remove_contaminated(spark, docs, corpus, items, empty):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.remove_documents(docs, bench)
    assert got.columns == docs.columns and got.count() == sum(not r[-1] for r in contamination(corpus, items))
    cut = D.remove_spans(docs, bench)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    left = {r[0]: r[1] - r[2] for r in contamination(corpus, items) if r[0] not in (2, None)}
    assert {r.doc_id: len(fold(r.text)) for r in cut.collect() if r.doc_id not in (2, None)} == left
    assert D.report(empty, bench).collect() == [] and D.remove_documents(empty, bench).collect() == []
    assert not any(r.n_hit for r in D.report(docs, bench.limit(0)).collect())


def test_clashing_names(spark, docs):
    items = spark.createDataFrame([(i, r.text) for i, r in enumerate(docs.where("n_chars between 100 and 900").limit(3).collect())], "item_id long, text string")
    names = {"n_chars": "digest", "words": "row", "label": "hits", "lang": "id"}
    for f in (D.remove_documents, D.remove_spans):
        got, plain = f(docs.withColumnsRenamed(names), items), f(docs, items)
        assert got.columns == [names.get(c, c) for c in docs.columns]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
