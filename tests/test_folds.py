"""Counts by chunk and block against the rows of windows, and that none are made for a window."""

import functools
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siftwave import queries as core
from siftwave.operators import coverage, folds, grids, ranks, stats
from siftwave.operators import nested as N
from siftwave.operators import suffixes as S
from siftwave.operators.schemes import get_scheme, least_keys, sample
from siftwave.sources import sinks
from siftwave.sources.text import recoded, spelled

SMALL = "/root/testdata/sf0.001"


def some_texts():
    r = random.Random(8)
    return [bytes(r.randrange(4) for _ in range(n)) for n in (0, 1, 11, 12, 300, 900)] + [b"\0" * 60, bytes(r.randrange(256) for _ in range(200)), b"ab" * 90]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(some_texts())], "seq_id long, bytes binary").repartition(3).cache()


def batch_of(texts, l, chunk):
    """Chunks as they come to a task."""
    rows = [(s, min(chunk, len(t) - l + 1 - s), int(s > 0), t[s - (s > 0) : s + chunk + l - 1]) for t in texts for s in range(0, len(t) - l + 1, chunk)]
    start, count, lead, data = zip(*rows, strict=True)
    n = len(rows)
    columns = [pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array(lead, pa.int32()), pa.array(data, pa.binary()), pa.array([0] * n, pa.int32()), pa.array([[]] * n, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["start", "count", "lead", "data", "which", "keys"])


def test_grid_rows_do_not_grow():
    """grid_density: a task gives a row for each cell and number, however many batches it has."""
    cells = [grids.Cell(n, get_scheme(n), 8, 4) for n in ("Random", "Lex")]
    b = batch_of(some_texts(), 11, 50)
    once, often = (list(grids._counted(cells, [[0, 1]])(iter([b] * n))) for n in (1, 7))
    assert len(once) == len(often) == 1 and once[0].num_rows == often[0].num_rows <= 8
    assert [7 * x for x in once[0].column(4).to_pylist()] == often[0].column(4).to_pylist()


def test_md5_of_many():
    r = np.random.default_rng(3)
    for k in (1, 4, 10, 27, 28, 70):
        rows = r.integers(0, 256, (50, k)).astype(np.uint8)
        digests = [hashlib.md5(x.tobytes().hex().upper().encode()).digest() for x in rows]
        assert [a.to_bytes(8, "big") + b.to_bytes(8, "big") for a, b in ranks.md5_of_hex(rows).T.tolist()] == digests


def test_md5_of_blocks():
    r = np.random.default_rng(3)
    for k in (1, 2, 3, 4, 5, 8, 26, 27):
        rows = r.integers(0, 256, (ranks.FEW + 1, k)).astype(np.uint8)
        digests = [hashlib.md5(x.tobytes().hex().upper().encode()).digest() for x in rows]
        assert [a.to_bytes(8, "big") + b.to_bytes(8, "big") for a, b in ranks.md5_of_hex(rows).T.tolist()] == digests


def test_one_number_keeps_the_order():
    r = np.random.default_rng(4)
    for top in (1, 3, 1 << 20, 1 << 63):
        words = r.integers(0, top, (3, 400)).astype(np.uint64)
        words[0] //= np.uint64(max(1, top // 2))
        keys = list(zip(*words.tolist(), strict=True))
        order = {x: i for i, x in enumerate(sorted(set(keys)))}
        assert ranks.dense(words).tolist() == [order[x] for x in keys]
        for side in (False, True, words[2] % np.uint64(2) == 1):
            last = side.tolist() if isinstance(side, np.ndarray) else [side] * 400
            best = [min(range(i, i + 9), key=lambda p: (keys[p], -p if last[p] else p)) for i in range(392)]
            assert least_keys(words, 9, side).tolist() == best


def test_tied_rotations_are_not_ranked_whole(monkeypatch):
    """bd_anchor_w256: rotations that begin alike are compared further on, not all rotations of their window."""
    monkeypatch.setattr(S, "circle_ranks", lambda rows: pytest.fail("all rotations were ranked"))
    r = random.Random(5)
    phrase = bytes(r.choice(b"ab") for _ in range(18))
    texts = [b"a" * 150, b"ab" * 80, phrase * 9, phrase * 4 + b"a" + phrase * 5, b"".join(r.choice([phrase, phrase[::-1]]) for _ in range(9)), (b"a" * 17 + b"b") * 9, (b"a" * 30 + b"b" + b"a" * 33 + b"c") * 3]
    for text in texts:
        for l, many in ((17, 17), (40, 37), (65, 50)):
            expected = [min(range(many), key=lambda j: (text[s + j : s + l] + text[s : s + j], j)) for s in range(len(text) - l + 1)]
            assert S.least_rotations(np.frombuffer(text, np.uint8), l, many, least_keys).tolist() == expected


def test_few_suffixes_are_compared_alone(monkeypatch):
    """sus_antilex_w256: only windows whose least suffix may be a cut one are looked at closer."""
    seen, plain = [], S._less
    monkeypatch.setattr(S, "_less", lambda a, b: seen.append(a.shape[1]) or plain(a, b))
    text = np.random.default_rng(6).integers(0, 256, 4000).astype(np.uint8)
    get_scheme("SusAntiLex").places(text, 256, 2)
    assert sum(seen) < 0.2 * 15 * len(text)


def test_kmers_are_not_hashed_again(monkeypatch):
    """density_open_documents: k-mers of earlier blocks have their digests already, which don't travel with tasks."""
    hashed, plain = [], N.md5_of_hex
    monkeypatch.setattr(N, "md5_of_hex", lambda rows: hashed.append(len(rows)) or plain(rows))
    monkeypatch.setattr(N, "_DIGESTS", N.Digests() if hasattr(N, "Digests") else None, raising=False)
    places = get_scheme("OpenClosed", r=4, open=1).places
    text = np.random.default_rng(7).integers(0, 4, 4000).astype(np.uint8)
    first = places(text, 8, 8).tolist()
    once = sum(hashed)
    assert once and places(text, 8, 8).tolist() == first and sum(hashed) < 1.05 * once
    assert N._DIGESTS.tables and len(cloudpickle.dumps(N._DIGESTS)) < 1 << 16


@pytest.mark.parametrize("kept", [1, 3, 20])
@pytest.mark.parametrize("alike", [0, 30, 60, 64])
def test_digests_that_begin_alike(monkeypatch, kept, alike):
    """The MD5 decides to its last bit, however few digests are kept."""
    plain = N.md5_of_hex
    cut = lambda x: x if alike == 0 else x - x % 2**alike
    monkeypatch.setattr(N, "md5_of_hex", lambda rows: np.array([[cut(x) for x in plain(rows)[0].tolist()], plain(rows)[1].tolist()], np.uint64).reshape(2, -1))
    monkeypatch.setattr(N, "SLOT_BITS", kept)
    monkeypatch.setattr(N, "_DIGESTS", N.Digests())

    @functools.cache
    def md5(x):
        digest = hashlib.md5(x.hex().upper().encode()).digest()
        return cut(int.from_bytes(digest[:8], "big")), digest[8:]

    def key(x):
        slot = min(range(5), key=lambda j: (md5(x[j : j + 4]), j))
        return slot != 2, md5(x)

    scheme = get_scheme("OpenClosed", r=4, open=1)
    for text in (b"\0" * 30 + b"\1" * 20 + b"\0\1" * 20, bytes(np.random.default_rng(8).integers(0, 3, 400).tolist()), bytes(np.random.default_rng(9).integers(0, 256, 400).tolist())):
        expected = [min(range(8), key=lambda j: (key(text[i + j : i + j + 8]), j)) for i in range(len(text) - 14)]
        assert scheme.places(np.frombuffer(text, np.uint8), 8, 8).tolist() == expected
        expected = [min(range(8), key=lambda j: (md5(text[i + j : i + j + 4]), j)) for i in range(len(text) - 10)]
        assert get_scheme("Random").letter_places(np.frombuffer(text, np.uint8), 8, 4).tolist() == expected


@pytest.mark.parametrize(("name", "p", "w", "k"), [("Random", {}, 8, 4), ("OpenClosed", {"r": 4, "open": 1}, 8, 8), ("AntiLex", {"mod": 1, "r": 2}, 5, 4), ("BdAnchor", {"r": 1}, 20, 2), ("SusABB2", {}, 6, 3), ("ThresholdABB", {"thr": 2}, 8, 4), ("Lex", {}, 1, 1)])
@pytest.mark.parametrize("chunk", [7, 300])
def test_folds_are_the_rows(seqs, name, p, w, k, chunk):
    for scheme in (get_scheme(name, **p), get_scheme(name, **p)._replace(places=None, words=None)):
        samples = sample(seqs, scheme, w, k)
        assert sorted(folds.density(seqs, scheme, w, k, chunk=chunk).collect()) == sorted(stats.density(samples, "seq_id").collect())
        assert folds.density(seqs, scheme, w, k, by=(), chunk=chunk).collect() == stats.density(samples).collect()
        assert sorted(folds.distinct_positions(seqs, scheme, w, k, chunk=chunk).collect()) == sorted(stats.distinct_positions(samples).collect())
    assert folds.density(seqs.limit(0), get_scheme(name, **p), w, k, by=()).collect() == [(0, None, None)]


@pytest.mark.parametrize("name", ["density_random_w64", "density_open_documents", "distinct_positions", "fasta_density", "bd_anchor_w256", "sus_antilex_w256"])
def test_no_row_for_a_window(spark, name):
    plan = core.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "win#" not in plan and "pos#" not in plan


@pytest.mark.parametrize("chunk", [5, 40, 4096])
def test_islands_inside_are_not_dealt(seqs, monkeypatch, chunk):
    """interval_merge_documents: only islands near a chunk's borders are merged by a shuffle."""
    dealt, plain = [], coverage.stitched
    monkeypatch.setattr(coverage, "stitched", lambda islands, reach, block: dealt.append(islands) or plain(islands, reach, block))
    scheme = get_scheme("AntiLex")
    expected = sorted(stats.covered(sample(seqs, scheme, 24, 2), 2).collect())
    assert sorted(coverage.covered(seqs, scheme, 24, 2, chunk=chunk).collect()) == expected
    if chunk == 4096:  # all sequences are one chunk
        assert dealt[0].count() == 0
    elif chunk == 40:
        assert 0 < dealt[0].count() < len(expected) * 4


def test_spelled_and_written(spark, seqs, tmp_path):
    acgt = spelled(seqs, b"ACGT")
    assert sorted(acgt.select("seq_id", F.col("bytes").cast("string")).collect()) == sorted(recoded(seqs, 4).select("seq_id", F.translate(F.regexp_replace(F.hex("bytes"), "0(.)", "$1"), "0123", "ACGT")).collect())
    sinks.write_fasta(acgt, str(tmp_path / "x"), 7)
    lines = [x.value for x in spark.read.text(str(tmp_path / "x")).collect()]
    assert all(x.startswith(">") or 0 < len(x) <= 7 for x in lines) and sum(x.startswith(">") for x in lines) == len(some_texts())
    assert sum(len(x) for x in lines if not x.startswith(">")) == sum(map(len, some_texts()))
