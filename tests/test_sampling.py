"""Schemes against plain loops over bytes, and exact densities against known counts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siftwave.functions.keys import SPARK
from siftwave.operators import stats
from siftwave.operators.orders import Shape
from siftwave.operators.schemes import cyclic, explicit_local, get_scheme, sample
from siftwave.plans import bounds, debruijn, explore, search


def lex(x):
    return (x[:16] + b"\xff" * 16)[:16]


def flip(x, where):
    return bytes(c ^ 255 if where(i) else c for i, c in enumerate(x[:16]))


PLAIN = {
    "Lex": lex,
    "AntiLex": lambda x: lex(flip(x, lambda i: i > 0)),
    "Alternating": lambda x: lex(flip(x, lambda i: i % 2)),
    "Random": lambda x: hashlib.md5(x.hex().upper().encode()).hexdigest(),
    "ABB": lambda x: lex(x[:1] + bytes(c == 0 for c in x[1:16])),
}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    return [bytes(r.randrange(4) for _ in range(n)) for n in (0, 1, 5, 11, 12, 300, 2500)] + [b"\0" * 40, bytes(r.randrange(256) for _ in range(200))]


@pytest.fixture(scope="module")
def seqs(spark, texts):
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "seq_id long, bytes binary")


def collected(df, n):
    out = [[] for _ in range(n)]
    for r in sorted(df.collect()):
        assert r.prev == (out[r.seq_id][-1] if out[r.seq_id] else None) and r.win == len(out[r.seq_id])
        out[r.seq_id].append(r.pos)
    return out


@pytest.mark.parametrize("name", PLAIN)
@pytest.mark.parametrize("w,k,chunk", [(8, 4, 1024), (1, 3, 7), (5, 1, 16), (13, 6, 50)])
def test_least_kmers(texts, seqs, name, w, k, chunk):
    got = collected(sample(seqs, get_scheme(name), w, k, chunk=chunk), len(texts))
    key = PLAIN[name]
    assert got == [[min(range(i, i + w), key=lambda p: (key(t[p : p + k]), p)) for i in range(len(t) - w - k + 2)] for t in texts]


@pytest.mark.parametrize("name", ["Lex", "AntiLex", "Alternating", "ABB"])
@pytest.mark.parametrize("w,k", [(8, 2), (6, 1)])
def test_anchors(texts, seqs, name, w, k):
    got = collected(sample(seqs, get_scheme(f"Sus{name}"), w, k, chunk=64), len(texts))
    key = PLAIN[name]
    assert got == [[min(range(i, i + w), key=lambda p: (key(t[p : i + w + k - 1]), p)) for i in range(len(t) - w - k + 2)] for t in texts]


@pytest.mark.parametrize("r", [0, 1, 3])
def test_rotations(texts, seqs, r):
    w, k = 8, 2
    got = collected(sample(seqs, get_scheme("BdAnchor", r=r), w, k), len(texts))
    l = w + k - 1
    most = max(l - max(r, k - 1), 1)
    expected = []
    for t in texts:
        windows = [t[i : i + l] for i in range(len(t) - l + 1)]
        expected.append([i + min(range(most), key=lambda j: (x[j:] + x[:j], j)) for i, x in enumerate(windows)])
    assert got == expected


@pytest.mark.parametrize("p", [{"r": 4}, {"r": 4, "lr": 1}, {"sampling": 5}])
def test_mod(texts, seqs, p):
    w, k = 8, 12
    t = p.get("sampling") or (k - w if p.get("lr") else (k - 4) % w + 4)
    got = collected(sample(seqs, get_scheme("Random", mod=1, **p), w, k, chunk=100), len(texts))
    inner = w + k - t
    key = PLAIN["Random"]
    expected = [[i + (min(range(i, i + inner), key=lambda p: (key(x[p : p + t]), p)) - i) % w for i in range(len(x) - w - k + 2)] for x in texts]
    assert got == expected


def test_rightmost(texts, seqs):
    got = collected(sample(seqs, get_scheme("ThresholdABB", thr=2)._replace(rightmost=True), 6, 3), len(texts))
    key = lambda x: (x[0] >= 2, *(c < 2 for c in x[1:]))
    assert got == [[min(range(i, i + 6), key=lambda p: (key(t[p : p + 3]), -p)) for i in range(len(t) - 7)] for t in texts]


def test_threshold(texts, seqs):
    def key(x, t=2, h=1):
        if x[0] < t:
            return 100, -x[0], PLAIN["Random"](x)
        run = next((i for i, c in enumerate(x[1:]) if c >= t), len(x) - 1)
        rank = 99 - run
        return 100 if rank > 100 - len(x) else rank, -x[0], PLAIN["Random"](x)

    got = collected(sample(seqs, get_scheme("Threshold", t=2, h=1), 6, 4), len(texts))
    assert got == [[min(range(i, i + 6), key=lambda p: (key(t[p : p + 4]), p)) for i in range(len(t) - 8)] for t in texts]


def test_registry():
    with pytest.raises(ValueError, match="Invalid minimizer type"):
        get_scheme("none")
    with pytest.raises(ValueError):
        get_scheme("Rot").order(SPARK, "x", Shape(3, 4, 4))


#: (w, k, sigma): samples on the circle for Lex, AntiLex and Alternating, by definition.
COUNTS = {(2, 2, 2): (12, 11, 11), (3, 2, 2): (19, 16, 16), (2, 3, 2): (24, 23, 20), (3, 3, 2): (38, 34, 30), (4, 2, 2): (32, 25, 25), (5, 3, 2): (107, 83, 81), (2, 2, 3): (58, 53, 53), (3, 1, 4): (136, 136, 136)}


@pytest.mark.parametrize("case", [(3, 2, 2), (5, 3, 2), (3, 1, 4)])
def test_exact(spark, case):
    for name, n in zip(("Lex", "AntiLex", "Alternating"), COUNTS[case], strict=True):
        r = debruijn.exact_density(spark, name, get_scheme(name), *case).first()
        assert (r.n_text, r.n_sampled) == (case[2] ** (case[0] + case[1]), n)


def test_exact_anchors(spark):
    assert debruijn.exact_density(spark, "", get_scheme("SusLex"), 6, 1, 2).first().n_sampled == 53
    assert debruijn.exact_density(spark, "", get_scheme("SusAntiLex"), 6, 1, 2).first().n_sampled == 39
    assert [debruijn.exact_density(spark, "", get_scheme("BdAnchor", r=r), 4, 1, 2, False).first().n_sampled for r in (0, 1)] == [60, 76]


def test_de_bruijn(spark):
    assert [r.seq for r in debruijn.de_bruijn(spark, 2, 3).unionByName(debruijn.de_bruijn(spark, 3, 2)).collect()] == ["0001011100", "0010211220"]
    for sigma, n in ((2, 6), (3, 3), (4, 2)):
        assert debruijn.de_bruijn(spark, sigma, n).first().seq[: sigma**n] == debruijn.de_bruijn_text(sigma, n)
    assert len(debruijn.exact_density_text(2, 3, 2)) == 2**6 + 1


def test_bounds(spark):
    """A forward scheme is never below its bound, and some reach it."""
    for (w, k, s), n in COUNTS.items():
        assert all(x >= bounds.forward_bound(w, k, s) * s ** (w + k) for x in n)
    assert str(bounds.forward_bound(5, 3, 2)) == "35/128" and str(bounds.forward_bound(3, 2, 3)) == "313/729"
    r = bounds.counted_bound(spark, 3, 2, 3).first()
    assert bounds.cycle_bound(3, 2, 3) == bounds.Fraction(r.num, r.den)


def test_search(spark):
    assert [search.best_order(spark, *c).first().n_sampled for c in ((2, 2, 2), (3, 2, 2), (4, 2, 2))] == [11, 16, 25]
    assert search.best_order(spark, 2, 2, 2, True).first().n_sampled <= 11
    local = search.best_local(spark, 2, 2, 2).first()
    assert local.n_text == 16 and local.n_sampled <= 11
    ring = {}
    for r in debruijn.all_words(spark, 2, 4).collect():
        x = tuple(map(int, r.word))
        ring[x] = min(range(3), key=lambda j: (x[j : j + 2], j))
    order = search.order_of_local(ring, 3, 2)
    assert order is not None and order.index((0, 0)) < order.index((1, 1))
    assert search.order_of_local({(0, 1): 0, (1, 0): 0}, 2, 1) is None


def test_equivalents():
    c = {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): 0}
    every = search.equivalents(c)
    assert c in every and {(1, 1): 0, (1, 0): 1, (0, 1): 0, (0, 0): 0} in every
    assert all(c in search.equivalents(x) for x in every) and len(every) <= 4


def test_selections(spark):
    """Every selection is a place of the window; the factors make up the word."""
    for r in debruijn.all_words(spark, 2, 7).collect():
        x = tuple(map(int, r.word))
        assert all(0 <= f(x) < 7 for f in explore.SELECTIONS.values())
        parts = [x[a:b] for a, b in explore.lyndon_factors(x)]
        assert sum(parts, ()) == x and parts == sorted(parts, reverse=True)
        assert all(p < p[i:] for p in parts for i in range(1, len(p)))
    total = search.exact_total(search.exact_counts(spark, explore.zeros_then_ones, 2, 5)).first()
    assert bounds.Fraction(total.n_sampled, total.n_places) >= bounds.cycle_bound(5, 1, 2)


def test_statistics(spark, texts, seqs):
    s = sample(seqs, get_scheme("Lex"), 8, 4).cache()
    d = stats.density(s).first()
    n = sum(max(len(t) - 10, 0) for t in texts)
    assert d.n_windows == n == sum(r.n for r in stats.positions(s).collect())
    assert d.n_changes == sum(r.n for r in stats.distances(s).collect())
    assert stats.out_of_range(s, 8).count() == 0 and all(r.forward for r in stats.is_forward(s).collect())
    assert all(abs(x - 1) < 1e-9 for x in [r.s for r in stats.transfer_power(stats.transfer(s)).groupBy("place_from").agg(F.sum("p").alias("s")).collect()])
    merged = sorted(tuple(r) for r in stats.merge_intervals(spark.createDataFrame([(1, 0, 4), (1, 3, 6), (1, 6, 8), (1, 10, 12), (2, 1, 2)], "seq_id long, first long, past long")).collect())
    assert merged == [(1, 0, 8), (1, 10, 12), (2, 1, 2)]


def test_cyclic_and_cycles(spark, seqs):
    ring = cyclic(seqs, get_scheme("Lex"), 8, 4)
    assert ring.where("pos >= size").count() == 0 and {r.seq_id for r in ring.collect()} == set(range(1, 9))
    bad = stats.bad_cycles(seqs, 9, get_scheme("Lex"), 4, 2).collect()
    assert bad == sorted(bad) and all(len(r.samples.split(",")) > 3 for r in bad)
    assert sum(r.n for r in stats.cycle_stats(stats.cycle_samples(seqs, 9, get_scheme("Lex"), 4, 2)).collect()) == sum(n // 9 for n in (0, 1, 5, 11, 12, 300, 2500, 40, 200))


def test_explicit_local(spark, seqs):
    table = spark.createDataFrame([(c, c % 3) for c in range(4**4)], "code long, choice int")
    got = explicit_local(seqs.where("seq_id < 8"), table, 3, 2, 4)
    assert got.where("pos < win or pos > win + 2").count() == 0 and got.count() == sum(max(n - 3, 0) for n in (0, 1, 5, 11, 12, 300, 2500, 40))


RANKS = (5, 2, 7, 0, 3, 6, 1, 4)
PATTERNS = ("_011", "<10", ">01", "0")


def greedy_key(kmer):
    """Ranks of lowest bits, ties by the next two bits."""
    low = high = 0
    for c in kmer:
        low, high = 2 * low + c % 2, 4 * high + c // 2 % 4
    return RANKS[low], high


def template_key(kmer):
    """Place in the list, start or end, and the next copy."""
    for i, p in enumerate(PATTERNS):
        word = [int(c) for c in p if c.isdigit()]
        m, k = len(word), len(kmer)
        at = [j for j in range(k - m + 1) if list(kmer[j : j + m]) == word]
        start = [100 - (j - 1) for j in at if j > 0][:1] or [1000]
        end = [j + 1 for j in at if j + m <= k - 2][-1:] or [1000]
        found = {"start": (0 in at, start[0]), "end": (k - m in at, end[0])}
        for rank, side in enumerate({"_": ("start", "end"), "<": ("start",), ">": ("end",)}.get(p[0], ("end", "start"))):
            if found[side][0]:
                return i, rank, found[side][1]
    return 1000, 0, 0


@pytest.mark.parametrize(("name", "params", "key", "w", "k", "sigma"), [("Greedy", {"ranks": RANKS}, greedy_key, 5, 3, 8), ("Greedy", {"ranks": RANKS}, greedy_key, 1, 3, 4), ("Templates", {"patterns": PATTERNS}, template_key, 6, 4, 2), ("Templates", {"patterns": PATTERNS}, template_key, 4, 7, 2)])
def test_listed_orders(spark, name, params, key, w, k, sigma):
    r = random.Random(5)
    texts = {i: bytes(r.randrange(sigma) for _ in range(r.choice([3, 40, 700]))) for i in range(12)}
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in texts.items()], "seq_id long, bytes binary")
    got = {(x.seq_id, x.win): x.pos for x in sample(df, get_scheme(name, **params), w, k, 256).collect()}
    expected = {(i, j): min(range(j, j + w), key=lambda p: (key(t[p : p + k]), p)) for i, t in texts.items() for j in range(len(t) - w - k + 2)}
    assert got == expected


def test_seeds(spark, texts, seqs):
    """Against plain loops over windows and seeds."""
    w, k, seeds = 5, 2, [7, 303023692]

    def sampled(seed, text):
        rank = lambda x: "".join(hashlib.md5((str(seed) + x[: i + 1].hex().upper()).encode()).hexdigest()[:2] for i in range(min(len(x), 16))).ljust(32, "f")
        windows = [text[i : i + w + k - 1] for i in range(len(text) - w - k + 2)]
        return [i + min(range(w), key=lambda j: (rank(x[j:]), j)) for i, x in enumerate(windows)]

    some = seqs.where("length(bytes) < 300")
    sides = [[t for t in texts if len(t) < 300], [t for t in texts if len(t) == 300]]
    expected = []
    for seed in seeds:
        n = [sum(sum(a != b for a, b in zip([None, *p], p)) for p in (sampled(seed, t) for t in side)) for side in sides]
        expected.append((seed, *n, sum(len(sampled(seed, t)) for t in sides[0])))
    counts = search.compare_seeds(some, seqs.where("length(bytes) = 300"), seeds, w, k, 256)
    assert sorted(map(tuple, counts.collect())) == sorted(expected)
    best = min(expected, key=lambda x: (x[1], x[2], x[0]))
    assert tuple(search.best_seed(counts).first()) == best


def test_optimum_sql():
    """The SQL's own bounds against exact fractions, in half the cases a little above."""
    import duckdb

    from siftwave.queries import optimum_sql

    grid = [(w, k, s, bounds.forward_bound(w, k, s), (w + k + s) % 2) for w in range(2, 6) for k in range(1, 5) for s in (2, 3)]
    got = duckdb.sql(optimum_sql([(w, k, s, b.numerator + more, b.denominator) for w, k, s, b, more in grid])).fetchall()
    assert sorted(got) == sorted((w, k, s, not more) for w, k, s, _, more in grid)


def test_distances(spark):
    (r,) = bounds.distances(spark.createDataFrame([(5, 1, 2, 11, 30, 0.4)], "w int, k int, sigma int, num int, den int, density double")).collect()
    assert (r.factor, r.above_bound, r.above_simple) == pytest.approx((2.4, 0.4 - 11 / 30, 0.4 - 2 / 6))


def test_common_prefix(spark):
    rows = [(b"", b"", 0), (b"", b"a", 0), (b"abc", b"abd", 2), (b"ab", b"abc", 2), (b"\xff\x00", b"\xff\x00", 2), (b"x", b"y", 0), (None, b"a", None), (b"a", None, None)]
    got = spark.createDataFrame(rows, "a binary, b binary, n int").select("n", stats.common_prefix(F.col("a"), F.col("b"))).collect()
    assert all(n == m for n, m in got)
