"""Sequences from text columns, files, and generators: (seq_id, bytes)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import recode
from .records import file_pieces, whole_sequences

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sequences(df: DataFrame, id_col: str, text_col: str, sigma: int = 256) -> DataFrame:
    """(seq_id, bytes) of a text column: UTF-8 bytes, recoded to letters 0 up to sigma (2, 4 or 256) by their lowest bits. Null text is an empty sequence."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return df.select(F.col(id_col).alias("seq_id"), data.alias("bytes")) if sigma == 256 else recoded(df.select(F.col(id_col).alias("seq_id"), data.alias("bytes")), sigma)


def recoded(seqs: DataFrame, sigma: int) -> DataFrame:
    return seqs.withColumn("bytes", F.unhex(F.expr(recode("hex(bytes)", sigma))))


def _spelled(alphabet: bytes, at: int):
    table = np.frombuffer(alphabet, np.uint8)[np.arange(256) % len(alphabet)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            made = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(table[data])])
            yield b.set_column(at, b.schema.field(at), made)

    return of


def spelled(seqs: DataFrame, alphabet: bytes) -> DataFrame:
    """Sequences (seq_id, bytes) with the signs of an alphabet, of 2, 4, ... or 256, in place of letters, by their lowest bits."""
    return seqs.mapInArrow(_spelled(alphabet, seqs.columns.index("bytes")), seqs.schema)


def letters(codes: Column) -> Column:
    """Bytes of an array of letters."""
    return F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))


def random_sequences(spark: SparkSession, count: int, length: int, sigma: int, seed: int = 213456) -> DataFrame:
    """count sequences of random letters; the same for the same seed."""
    letter = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(sigma))
    return spark.range(count).select(F.col("id").alias("seq_id"), letters(F.transform(F.sequence(F.lit(1), F.lit(length)), letter)).alias("bytes"))


def unseeded_sequences(spark: SparkSession, count: int, length: int, sigma: int) -> DataFrame:
    """As random_sequences(), other letters at each call."""
    import secrets

    return random_sequences(spark, count, length, sigma, secrets.randbits(62))


def file_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as they are, line ends included: (seq_id, bytes), seq_id being the path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("seq_id"), F.col("content").alias("bytes"))


def fasta_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, bytes) of all records of FASTA files, read in splits; the id is the header's first word. For sequences beyond a row's size, see records.file_pieces()."""
    return whole_sequences(file_pieces(spark, path, "fasta"))


def fastq_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, bytes) of FASTQ files with four lines a record, read in splits."""
    return whole_sequences(file_pieces(spark, path, "fastq"))


def optimum_table(spark: SparkSession, path: str) -> DataFrame:
    """Known optimal densities from a JSON list of [w, k, sigma, numerator, denominator]."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<long>>")).alias("r"))
    return rows.select(*[F.col("r")[i].cast("int" if i < 3 else "long").alias(c) for i, c in enumerate(("w", "k", "sigma", "num", "den"))])


def order_file(spark: SparkSession, path: str) -> DataFrame:
    """(code, rank) of binary order files: a count of 8 bytes, little end first, then as many 8-byte ranks, of which the two low bytes hold."""
    data = spark.read.format("binaryFile").load(path).select("path", F.hex("content").alias("h"))
    two = lambda at: F.conv(F.concat(F.substring("h", at + F.lit(3), F.lit(2)), F.substring("h", at + F.lit(1), F.lit(2))), 16, 10).cast("long")
    count = two(F.lit(0))
    return data.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), count), lambda i: two(i * 16))).alias("code", "rank"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result records that sinks.write_results() wrote, or a JSON array of them, with the scheme's parameters as columns of their own."""
    df = spark.read.json(path, multiLine=True) if path.endswith(".json") else spark.read.json(path)
    return df.select("*", "tp.*").drop("tp") if "tp" in df.columns else df
