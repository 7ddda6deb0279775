"""Sources, sinks and the stream."""

import json
import struct

from pyspark.sql import functions as F

from siftwave.operators.schemes import get_scheme, sample
from siftwave.sources import sinks, text


def test_random(spark):
    rows = text.random_sequences(spark, 3, 500, 4).collect()
    assert rows == text.random_sequences(spark, 3, 500, 4).collect() and {c for r in rows for c in r.bytes} == {0, 1, 2, 3}
    assert text.unseeded_sequences(spark, 1, 50, 2).first().bytes != text.unseeded_sequences(spark, 1, 50, 2).first().bytes


def test_recode(spark):
    df = spark.createDataFrame([(1, "ACGTé"), (2, None)], "id long, t string")
    assert bytes(text.sequences(df, "id", "t").first().bytes) == "ACGTé".encode()
    assert list(text.sequences(df, "id", "t", 4).first().bytes) == [b & 3 for b in "ACGTé".encode()]
    assert list(text.sequences(df, "id", "t", 2).first().bytes) == [b & 1 for b in "ACGTé".encode()]
    assert sample(text.sequences(df, "id", "t"), get_scheme("Lex"), 2, 2).count() == 4


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nACG\nT\n>y\nGG\n")
    assert {(r.seq_id, bytes(r.bytes)) for r in text.fasta_sequences(spark, str(tmp_path / "a.fa")).collect()} == {("x", b"ACGT"), ("y", b"GG")}
    (tmp_path / "a.fq").write_text("@r1 z\nACGT\n+\n@@@@\n@r2\nGG\n+\nII\n")
    assert {(r.seq_id, bytes(r.bytes)) for r in text.fastq_sequences(spark, str(tmp_path / "a.fq")).collect()} == {("r1", b"ACGT"), ("r2", b"GG")}
    assert bytes(text.file_sequences(spark, str(tmp_path / "a.fa")).first().bytes) == b">x one\nACG\nT\n>y\nGG\n"
    (tmp_path / "o.json").write_text(json.dumps([[2, 1, 2, 3, 4], [3, 2, 2, 1, 2]]))
    assert [tuple(r) for r in text.optimum_table(spark, str(tmp_path / "o.json")).collect()] == [(2, 1, 2, 3, 4), (3, 2, 2, 1, 2)]
    (tmp_path / "g.bin").write_bytes(struct.pack("<Q4Q", 4, 7, 300, 65535, 0))
    assert [(r.code, r.rank) for r in text.order_file(spark, str(tmp_path / "g.bin")).collect()] == [(0, 7), (1, 300), (2, 65535), (3, 0)]


def test_results(spark, tmp_path):
    seqs = text.random_sequences(spark, 2, 300, 4)
    out = sinks.evaluate(seqs, [("Random", {}), ("OpenClosed", {"r": 2, "open": 1})], [4], [3, 5], 4, full=True)
    assert out.count() == 4
    sinks.write_results(out, str(tmp_path / "r"))
    back = text.results(spark, str(tmp_path / "r"))
    assert {r.minimizer_type for r in back.collect()} == {"Random", "OpenClosed"} and all(0 < r.density <= 1 for r in back.collect())
    made = []
    for _ in range(2):
        df = sinks.remembered(spark, str(tmp_path / "m"), lambda: made.append(1) or spark.range(3))
    assert df.count() == 3 and made == [1]
