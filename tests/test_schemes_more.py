"""Directed orders, schemes of the user's own, and grids that are remembered."""

import random

import numpy as np
import pytest

from siftwave.operators import stats
from siftwave.operators.grids import Cell, grid_density
from siftwave.operators.schemes import get_scheme, sample, user_scheme
from siftwave.plans import search
from siftwave.queries import best_directed
from siftwave.sources import sinks


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    return [bytes(r.randrange(2) for _ in range(n)) for n in (0, 4, 5, 30, 700)] + [b"\0" * 40, b"\0\1" * 30]


@pytest.fixture(scope="module")
def seqs(spark, texts):
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "seq_id long, bytes binary").repartition(2).cache()


def rows(texts, w, k, best):
    return [(i, s, s + best(t[s : s + w + k - 1])) for i, t in enumerate(texts) for s in range(len(t) - w - k + 2)]


def got(df):
    return sorted((x.seq_id, x.win, x.pos) for x in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_directed(texts, seqs, seed):
    """Ranks with ties, each k-mer with a side of its own; the grid samples the same."""
    r = random.Random(seed)
    ranks, last = [r.randrange(3) for _ in range(8)], [r.randrange(2) for _ in range(8)]
    scheme, w = get_scheme("Directed", ranks=ranks, last=last), 6

    def best(x):
        codes = [x[j] * 4 + x[j + 1] * 2 + x[j + 2] for j in range(w)]
        key = min((ranks[c], last[c]) for c in codes)
        found = [j for j in range(w) if (ranks[codes[j]], last[codes[j]]) == key]
        return found[-1] if key[1] else found[0]

    assert got(sample(seqs, scheme, w, 3, 2, chunk=16)) == rows(texts, w, 3, best)
    one, all_of = stats.density(sample(seqs, scheme, w, 3, 2)).first(), grid_density(seqs, [Cell("d", scheme, w, 3), Cell("e", scheme, 4, 3)], 2, 16).where("w = 6").first()
    assert (one.n_windows, one.n_changes, one.pos_sum) == (all_of.n_windows, all_of.n_changes, all_of.pos_sum)


def test_winner_of_the_search(spark, seqs, texts):
    found = search.best_order(spark, 3, 2, 2, True).first()
    scheme, (ranks, last) = search.winner(found, 2, 2), best_directed(3, 2)
    assert got(sample(seqs, scheme, 3, 2, 2)) == got(sample(seqs, get_scheme("Directed", ranks=ranks, last=last), 3, 2, 2))


def test_user_schemes(texts, seqs):
    keys = user_scheme(keys=lambda kmers: np.stack((kmers.sum(axis=1, dtype=np.int64), 1 - kmers[:, 0].astype(np.int64))))
    best = lambda x: min(range(5), key=lambda j: (sum(x[j : j + 3]), 1 - x[j], j))
    assert got(sample(seqs, keys, 5, 3, chunk=16)) == rows(texts, 5, 3, best)
    places = user_scheme(places=lambda windows: windows.sum(axis=1, dtype=np.int64) % 4)
    assert got(sample(seqs, places, 4, 2, chunk=16)) == rows(texts, 4, 2, lambda x: sum(x) % 4)
    assert grid_density(seqs, [Cell("u", keys, 5, 3), Cell("v", places, 4, 2)]).where("n_windows = 0").count() == 0
    with pytest.raises(ValueError, match="either"):
        user_scheme()
    with pytest.raises(Exception, match="place isn't"):
        sample(seqs, user_scheme(places=lambda windows: windows.sum(axis=1) + 100), 4, 2).collect()


def test_grid_is_remembered(spark, seqs, tmp_path, monkeypatch):
    """Only cells that are new are sampled; another version of the input is another cell."""
    asked = []
    plain = sinks.grid_density
    monkeypatch.setattr(sinks, "grid_density", lambda s, cells, sigma: asked.append(len(cells)) or plain(s, cells, sigma))
    cells = [Cell(n, get_scheme(n), w, 2) for n in ("Lex", "AntiLex") for w in (3, 5)]
    path = str(tmp_path / "memo")
    run = lambda cells, version: sorted(tuple(x) for x in sinks.remembered_grid(spark, path, seqs, cells, version, 2).select("scheme", "w", "k", "n_windows", "n_changes", "pos_sum").collect())
    expected = sorted(tuple(x) for x in plain(seqs, cells, 2).select("scheme", "w", "k", "n_windows", "n_changes", "pos_sum").collect())
    assert run(cells[:3], "a") == [x for x in expected if (x[0], x[1]) != ("AntiLex", 5)] and asked == [3]
    assert run(cells, "a") == expected and asked == [3, 1]
    assert run([*cells, cells[0]], "a") == expected and asked == [3, 1]
    assert run(cells[:1], "b") == [x for x in expected if x[:2] == ("Lex", 3)] and asked == [3, 1, 1]
