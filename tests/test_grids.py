"""Anchors and rotations of whole batches, grids and all statistics of a run, against plain loops and the single queries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwave.operators import stats
from siftwave.operators import suffixes as S
from siftwave.operators.grids import Cell, Minima, grid_density, grid_stats, run_stats
from siftwave.operators.schemes import get_scheme, least_keys, sample


def padded(x):
    return bytes(x)[:16].ljust(16, b"\xff")


def number(x):
    return int("".join(["0" if x[0] < 100 else "1"] + ["1" if c < 100 else "0" for c in x[1:]]), 2)


#: The key of a suffix that its window has cut.
SUFFIXES = {
    "SusLex": padded,
    "SusAlternating": lambda x: padded(c ^ 255 if i % 2 else c for i, c in enumerate(x)),
    "SusAntiLex": lambda x: padded([x[0], *(c ^ 255 for c in x[1:])]),
    "SusABB": lambda x: padded([x[0], *(c == 0 for c in x[1:])]),
    "SusABB2": lambda x: (padded([x[0], *(c == 0 for c in x[1:])]), padded(x)),
    "SusRandomLex": lambda x: padded(hashlib.md5(("5" + x[:t].hex().upper()).encode()).digest()[0] for t in range(1, min(len(x), 16) + 1)),
    "SusThresholdABB": number,
    "SusThresholdABB2": lambda x: (number(x), padded(x)),
}
SHAPES = [(1, 1), (2, 3), (8, 2), (5, 1), (14, 3), (15, 2), (16, 1), (20, 4), (33, 17), (1, 20), (40, 1)]


def some_texts(seed):
    r = random.Random(seed)
    for letters in ([0, 1], [0, 1, 2, 3], [97, 98], range(256), [99, 100], [0]):
        yield bytes(r.choice(letters) for _ in range(r.choice([45, 90]))) + bytes([letters[0]]) * r.choice([0, 30])
    yield bytes([1, 2] * 40)


@pytest.mark.parametrize("name", SUFFIXES)
def test_least_suffixes(name):
    scheme, key = get_scheme(name, thr=100, seed=5), SUFFIXES[name]
    for text in some_texts(1):
        for w, k in SHAPES:
            expected = [min(range(w), key=lambda j: (key(text[s + j : s + w + k - 1]), j)) for s in range(len(text) - w - k + 2)]
            assert scheme.places(np.frombuffer(text, np.uint8), w, k).tolist() == expected, (w, k, text)


@pytest.mark.parametrize("r", [0, 1, 3, 7, 30])
def test_least_rotations(r):
    for text in some_texts(2):
        for w, k in SHAPES:
            l = w + k - 1
            many = max(1, l - max(r, k - 1))
            expected = [min(range(many), key=lambda j: (text[s + j : s + l] + text[s : s + j], j)) for s in range(len(text) - l + 1)]
            assert get_scheme("BdAnchor", r=r).places(np.frombuffer(text, np.uint8), w, k).tolist() == expected, (w, k, text)


def test_circle_ranks():
    r = random.Random(4)
    for l in (1, 2, 3, 7, 16, 33):
        rows = [bytes(r.choice([3, 200]) for _ in range(l)) for _ in range(20)] + [bytes([5] * l)]
        ranks = S.circle_ranks(np.array([list(x) for x in rows], np.uint8))
        for row, rank in zip(rows, ranks.tolist(), strict=True):
            turned = [row[i:] + row[:i] for i in range(l)]
            assert all((turned[i] < turned[j]) == (rank[i] < rank[j]) for i in range(l) for j in range(l))


def test_minima():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (2, 200)).astype(np.uint64)
    for rightmost in (False, True):
        least = Minima(words, rightmost)
        for w in (7, 1, 16, 5, 64, 63):
            assert (least.of(w) == least_keys(words, w, rightmost)).all()


@pytest.fixture(scope="module")
def seqs(spark):
    r = random.Random(6)
    texts = [bytes(r.randrange(4) for _ in range(n)) for n in (0, 1, 5, 11, 12, 300, 900)] + [b"\0" * 40, bytes(r.randrange(256) for _ in range(200))]
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "seq_id long, bytes binary").repartition(3).cache()


NESTED = [
    ("OpenClosed", {"r": 4, "open": 1}), ("OpenClosed", {"r": 3, "open": 1, "closed": 1, "open_tmer": 1, "other_tmer": 1}), ("OpenClosed", {"r": 2, "closed": 1, "modulo": 1, "open": 1}),
    ("OpenClosed", {"r": 4, "open": 1, "offset": 1, "anti_tmer": 1}), ("OpenClosed", {"r": 20, "closed": 1, "closed_tmer": 1, "anti_lex": 1}), ("OpenClosed", {"r": 3, "open": 1, "anti_lex": 1, "mod": 1}),
    ("Random", {}), ("Lex", {}), ("AntiLex", {"mod": 1, "r": 2}), ("Alternating", {}), ("ABB", {}), ("ABB2", {}),
    ("Miniception", {"r": 3}), ("Threshold", {"t": 2, "h": 1}), ("Threshold", {"t": 1, "h": 2, "loose": 1}), ("Threshold", {"t": 2, "h": 1, "open": 1}), ("Threshold", {"t": 1, "h": 30, "open": 1, "loose": 1}),
]


@pytest.mark.parametrize(("name", "p"), [*((n, {"thr": 2, "r": 1}) for n in ("SusAntiLex", "SusABB2", "BdAnchor", "SusThresholdABB")), *NESTED])
def test_as_with_strings(seqs, name, p):
    """The same rows as from a string for each k-mer, or for each place of each window."""
    scheme = get_scheme(name, **p)
    for w, k in ((8, 8), (5, 3)) if (name, p) in NESTED else ((8, 2), (20, 1)):
        assert sorted(sample(seqs, scheme, w, k, chunk=50).collect()) == sorted(sample(seqs, scheme._replace(places=None, words=None), w, k).collect())


@pytest.mark.parametrize(("name", "r"), [("SusAntiLex", 0), ("BdAnchor", 3)])
def test_wide_windows(spark, name, r):
    """w = 256, as in the queries over documents."""
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"ab ") for _ in range(700)), b"ab" * 400, b"a" * 300]
    scheme, l = get_scheme(name, r=r), 257
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "seq_id long, bytes binary")
    got = sorted((x.seq_id, x.win, x.pos) for x in sample(df, scheme, 256, 2).collect())
    if name == "SusAntiLex":
        best = lambda x: min(range(256), key=lambda j: (SUFFIXES[name](x[j:]), j))
    else:
        best = lambda x: min(range(l - r), key=lambda j: (x[j:] + x[:j], j))
    assert got == [(i, s, s + best(t[s : s + l])) for i, t in enumerate(texts) for s in range(len(t) - l + 1)]


CELLS = [Cell(n, get_scheme(n, **p), w, k) for n, p in (("Lex", {}), ("Random", {}), ("SusABB2", {}), ("BdAnchor", {"r": 1}), ("AntiLex", {"mod": 1, "r": 4})) for w, k in ((3, 2), (8, 4), (8, 12), (1, 1))]
CELLS += [Cell("last", get_scheme("ThresholdABB", thr=2)._replace(rightmost=True), 8, 4), Cell("long", get_scheme("Lex"), 500, 600)]


@pytest.mark.parametrize("chunk", [256, 20])
def test_grid_is_the_single_runs(seqs, chunk):
    got = {(x.scheme, x.w, x.k): (x.n_windows, x.n_changes, x.pos_sum) for x in grid_density(seqs, CELLS, chunk=chunk).collect()}
    assert len(got) == len(CELLS) and got["long", 500, 600] == (0, 0, 0)
    for c in CELLS:
        one = stats.density(sample(seqs, c.scheme, c.w, c.k)).first()
        assert got[c.name, c.w, c.k] == (one.n_windows, one.n_changes or 0, one.pos_sum or 0), c


@pytest.mark.parametrize(("name", "p", "w", "k"), [("Random", {}, 8, 4), ("BdAnchor", {"r": 1}, 6, 2)])
def test_all_statistics(seqs, name, p, w, k):
    scheme = get_scheme(name, **p)
    got = Counter({(x.stat, x.a, x.b): x.n for x in run_stats(seqs, scheme, w, k, chunk=64).collect()})
    samples = sample(seqs, scheme, w, k, letters=True).cache()
    one = stats.scheme_report(samples).first()
    expected = Counter({("windows", 0, 0): one.n_windows, ("changes", 0, 0): one.n_changes, ("pos_sum", 0, 0): one.pos_sum, ("outside", 0, 0): 0})
    expected["back", 0, 0] = samples.where("pos < prev").count()
    expected["runs", 0, 0] = samples.where("prev IS NULL OR pos <> prev").count()
    for stat, df in {
        "place": stats.positions(samples).selectExpr("place", "0", "n"), "jump": stats.distances(samples).selectExpr("jump", "0", "n"),
        "transfer": stats.transfer(samples), "kmer": stats.sampled_kmers(samples, k).selectExpr("kmer", "0", "n"), "kmer_place": stats.kmer_places(samples, k),
    }.items():
        expected.update({(stat, a, b): n for a, b, n in df.collect()})
    for x in stats.kmer_jumps(samples, k).collect():
        expected.update({("jump_to", x.kmer, x.jump): x.n_to, ("jump_from", x.kmer, x.jump): x.n_from})
    assert +got == +expected


def test_one_scan(spark, seqs):
    """A grid's plan reads its sequences once."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("seq_id"), F.encode("text", "UTF-8").alias("bytes"))
    plan = grid_density(df, CELLS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert grid_stats(seqs.limit(0), CELLS).collect() == []
