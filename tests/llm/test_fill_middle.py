"""Fill-in-the-middle against plain slicing."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwave.llm import fill_middle as M

from .conftest import key


def units(text, unit):
    return re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)


def plain(doc_id, text, unit="line", seed=7, rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    parts = units(text, unit)
    n = len(parts)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, "spm" if out.startswith("<S>") else "psm", len(p), len(m), out)


ODD = ["\n", "\n\n\n", "a\n", "\na", "é\nß\n\U0001f600", "a<P>b\nc", "x<M>", "<S>", "<", "P>\n<S\n>M", "<P\n><P\n", "no end", "\U0001f600" * 300 + "\n" + "ü" * 50, "l\n" * 1000, "\r\n\r\n"]


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("char", 60, 20)])
@pytest.mark.parametrize(("every", "piece"), [(64, 1 << 20), (3, 7)])
def test_fill(spark, docs, corpus, unit, rate, spm, every, piece, monkeypatch):
    monkeypatch.setattr(M, "PIECE", piece)
    monkeypatch.setattr(M, "BATCH", 200)
    monkeypatch.setattr(M.checkpoints, "__defaults__", ("line", every))
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD * 4)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(more)
    expected = [plain(i, t, unit, 7, rate, spm) for i, t, *_ in corpus] + [plain(1000 + i, t, unit, 7, rate, spm) for i, t in enumerate(ODD * 4)]
    got = M.fill_in_middle(df, unit=unit, rate=rate, spm=spm)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)
    back = got.select("doc_id", M.restored(F.col("form"), F.col("output")).alias("text")).collect()
    texts = [(i, t or "") for i, t, *_ in corpus] + [(1000 + i, t) for i, t in enumerate(ODD * 4)]
    assert sorted(map(tuple, back), key=key) == sorted(texts, key=key)


@pytest.mark.parametrize("unit", M.UNITS)
@pytest.mark.parametrize("piece", [1, 2, 5, 1 << 20])
def test_checkpoints(unit, piece, monkeypatch):
    """Few are kept, and each cut is found."""
    monkeypatch.setattr(M, "PIECE", piece)
    for text in [*ODD, "", "ab\n" * 40 + "é\n" * 40]:
        data = np.frombuffer(text.encode(), np.uint8)
        index, parts = M.checkpoints(data, unit, 4), units(text, unit)
        assert index.n == len(parts) and len(index.at) == -(-index.n // 4) == len(index.points)
        for cut in range(index.n + 1):
            head = "".join(parts[:cut])
            assert index.find(cut) == (len(head.encode()), len(head)), (text, cut)


def test_empty_and_unit(empty):
    assert M.fill_in_middle(empty).collect() == []
    with pytest.raises(ValueError, match="unit"):
        M.fill_in_middle(empty, unit="word")
