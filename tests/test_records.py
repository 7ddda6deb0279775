"""Sequence files in splits against whole files, pieces as sequences, and what sampled k-mers cover."""

import random

import pytest
from pyspark.sql import functions as F

from siftwave.operators import coverage, stats
from siftwave.operators.schemes import chunks, get_scheme, sample, sample_pieces
from siftwave.plans import search
from siftwave.sources import records
from siftwave.sources.records import chunks_of_pieces, file_pieces, whole_sequences


def fasta_file(r, crlf):
    """Text of a file with odd headers and lines, and its records."""
    text, found, end = "ACGT before any header\n", [], "\r\n" if crlf else "\n"
    for i in range(12):
        letters = "".join(r.choice("ACGT") for _ in range(r.choice([0, 1, 59, 60, 300, 700])))
        name = r.choice([f"s{i}", f"s{i}>x", ""])
        head = f">{name}" + r.choice(["", " with > inside", " " * 40 + ">" * 30])
        width = r.choice([1, 7, 60, 5000])
        lines = [letters[j : j + width] for j in range(0, len(letters), width)]
        text += end.join([head, *lines, *r.choice([[], [""], [" "]])]) + end
        found.append((name, letters))
    return (text if r.random() < 0.5 else text.rstrip()).encode(), found


def fastq_file(r):
    text, found = "", []
    for i in range(25):
        n = r.choice([1, 5, 80])
        letters, quality = "".join(r.choice("ACGT") for _ in range(n)), "".join(r.choice("@+I#") for _ in range(n))
        text += f"@r{i}{r.choice(['', ' x'])}\n{letters}\n+{r.choice(['', f'r{i}'])}\n{quality}\n"
        found.append((f"r{i}", letters))
    return (text if r.random() < 0.5 else text[:-1]).encode(), found


def read(spark, path, kind, split):
    return sorted((x.seq_id, bytes(x.bytes).decode()) for x in whole_sequences(file_pieces(spark, str(path), kind, split)).collect())


class Opened:
    """Bytes as an open file."""

    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def rows_of(read, data, split):
    return [x for lo in range(0, len(data), split) for x in read(Opened(data), records.Span("f", lo, min(lo + split, len(data)), len(data)))]


@pytest.mark.parametrize("seed", range(20))
def test_readers(seed, monkeypatch):
    """Any split border, also inside headers, at line ends and between records, put together by plain loops."""
    monkeypatch.setattr(records, "AHEAD", 5)
    r = random.Random(seed)
    data, found = fasta_file(r, seed % 2)
    for split in (1, 2, 7, 13, 64, 1000):
        out, in_header, by = [], False, {}
        for x in rows_of(records.fasta_rows, data, split):
            by.setdefault(x.split, []).append(x)
        for s in sorted(by):
            for x in by[s]:
                if x.record > 0 and x.head is not None:
                    out.append([x.head, b""])
                elif x.record > records.WHOLE and out and not (x.record == records.LINE and in_header):
                    out[-1][1] += x.data
            in_header = by[s][-1].in_header if by[s][-1].in_header is not None else in_header
        assert sorted((h, x.decode()) for h, x in out) == sorted(found), split
    monkeypatch.setattr(records, "PIECE", 37)
    data, found = fastq_file(r)
    for split in (1, 3, 11, 90, 1000):
        out = {}
        for x in rows_of(records.fastq_rows, data, split):
            out.setdefault((x.split, x.record), [x.head, b""])[1] += x.data
        assert sorted((h, x.decode()) for h, x in out.values()) == sorted(found), split


@pytest.mark.parametrize("seed", range(2))
def test_fasta(spark, tmp_path, seed, monkeypatch):
    r, every = random.Random(seed), []
    monkeypatch.setattr(records, "AHEAD", 5)
    for i in range(2):
        data, found = fasta_file(r, i == 1)
        (tmp_path / f"{i}.fa").write_bytes(data)
        every += found
    for split in (150, 1 << 20):
        assert read(spark, tmp_path, "fasta", split) == sorted(every), split


def test_fastq(spark, tmp_path):
    data, found = fastq_file(random.Random(0))
    (tmp_path / "x.fq").write_bytes(data)
    for split in (300, 1 << 20):
        assert read(spark, tmp_path / "x.fq", "fastq", split) == sorted(found), split


def test_raw_and_errors(spark, tmp_path):
    data = bytes(random.Random(1).randrange(256) for _ in range(1000))
    (tmp_path / "x.bin").write_bytes(data)
    (tmp_path / "empty.bin").write_bytes(b"")
    for split in (133, 5000):
        got = whole_sequences(file_pieces(spark, str(tmp_path), "raw", split)).collect()
        assert [(x.seq_id.rsplit("/", 1)[1], bytes(x.bytes)) for x in got] == [("x.bin", data)]
    (tmp_path / "bad.fq").write_bytes(b"@a\nAC\n+\nII\nno header\nat all\nin here\nor there\nor anywhere\nx\n")
    for bad in (lambda: file_pieces(spark, str(tmp_path / "bad.fq"), "fastq").collect(), lambda: file_pieces(spark, str(tmp_path), "sam").collect(), lambda: file_pieces(spark, str(tmp_path / "none"), "raw").collect()):
        with pytest.raises(Exception, match="four lines|kind|none"):
            bad()


@pytest.fixture(scope="module")
def seqs(spark):
    r = random.Random(8)
    texts = [bytes(r.choice(b"ab \n") for _ in range(n)) for n in (0, 3, 9, 10, 64, 500, 2000)] + [b"a" * 300]
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "seq_id long, bytes binary").repartition(3).cache()


@pytest.fixture(scope="module")
def pieces(seqs):
    """Cut anywhere, some pieces empty, some long."""
    cut = F.explode(F.expr("array_distinct(array(0, 1, length(bytes) div 3, length(bytes) div 3 + 2, length(bytes) - 1))")).alias("at")
    rows = seqs.select("seq_id", "bytes", cut).where("at >= 0")
    rows = rows.withColumn("next", F.expr("coalesce(lead(at) OVER (PARTITION BY seq_id ORDER BY at), length(bytes))"))
    return rows.select("seq_id", F.col("at").cast("long").alias("at"), F.expr("substring(bytes, at + 1, next - at)").alias("data"))


@pytest.mark.parametrize(("w", "k", "chunk"), [(8, 4, 256), (8, 4, 16), (30, 12, 10), (1, 1, 3)])
def test_chunks_of_pieces(seqs, pieces, w, k, chunk):
    columns = ["seq_id", "start", "count", "lead", F.hex("data")]
    expected = chunks(seqs, w, k, chunk).select(*columns).collect()
    assert sorted(map(tuple, chunks_of_pieces(pieces, w, k, chunk).select(*columns).collect())) == sorted(map(tuple, expected))
    scheme = get_scheme("AntiLex")
    assert sorted(sample_pieces(pieces, scheme, w, k, chunk=chunk).collect()) == sorted(sample(seqs, scheme, w, k).collect())


@pytest.mark.parametrize(("name", "w", "k", "chunk", "block"), [("AntiLex", 8, 4, 256, 1024), ("AntiLex", 8, 4, 16, 2), ("BdAnchor", 30, 2, 10, 1), ("Lex", 3, 40, 7, 3), ("Random", 24, 2, 16, 4)])
def test_covered(seqs, name, w, k, chunk, block):
    scheme = get_scheme(name, r=1)
    expected = []
    samples = {}
    for x in sample(seqs, scheme, w, k).collect():
        samples.setdefault(x.seq_id, set()).add(x.pos)
    for seq, found in samples.items():
        islands = []
        for p in sorted(found):
            if islands and p <= islands[-1][1]:
                islands[-1][1] = p + k
            else:
                islands.append([p, p + k])
        expected += [(seq, a, b) for a, b in islands]
    assert sorted(map(tuple, coverage.covered(seqs, scheme, w, k, 256, chunk, block).collect())) == sorted(expected)
    assert sorted(map(tuple, stats.covered(sample(seqs, scheme, w, k), k).collect())) == sorted(expected)


def test_long_cycles(spark):
    """Circles of 200 letters against all their rotations."""
    r = random.Random(2)
    text = bytes(r.choice([0, 0, 0, 1]) for _ in range(2000)) + bytes([0, 1] * 100)
    df = spark.createDataFrame([(0, bytearray(text)), (1, bytearray(text[200:400]))], "seq_id long, bytes binary")
    got = [tuple(x) for x in stats.bad_cycles(df, 200, get_scheme("Lex"), 4, 2, 4).collect()]
    expected = {}
    for x in stats.cycle_samples(df, 200, get_scheme("Lex"), 4, 2, 4).collect():
        if len(x.samples) > 50:
            c = text[200:400] if x.cycle.seq_id else text[200 * x.cycle.c : 200 * x.cycle.c + 200]
            turn = min(range(200), key=lambda i: (c[i:] + c[:i], i))
            word = (c[turn:] + c[:turn]).hex().upper()
            places = ",".join(map(str, sorted((p - turn) % 200 for p in x.samples)))
            expected[word] = min(expected.get(word, places), places)
    assert got == sorted(expected.items()) and got


def test_seeds(seqs):
    one = search.seed_runs(seqs, [3, 5, 11], [2, 8], 1, 256).collect()
    for x in one:
        found = sample(seqs, get_scheme("SusRandomLex", seed=x.seed), x.w, 1)
        assert (x.n, x.n_windows) == (found.where("prev IS NULL OR pos <> prev").count(), found.count())
    assert {(x.seed, x.w) for x in one} == {(s, w) for s in (3, 5, 11) for w in (2, 8)}
    for x in search.seed_table(seqs, [3], [2, 5], 1, 256).collect():
        assert x.extra == x.n - x.least
