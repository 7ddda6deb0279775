"""Sequence files of any size: FASTA, FASTQ and raw bytes in splits, as pieces (seq_id, at, data) of sequences.

A split is a range of bytes. What begins in it is its own; what it begins in the middle of is sorted out afterwards from a few rows for each split: prefix sums
of letters say where in its sequence each piece stands. So neither a file nor a sequence has to fit in a task, and pieces become the chunks that schemes sample
in one shuffle. FASTA is read twice, once for these rows; nothing is written in between.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a split, letters of a piece, and bytes read at a time where a record goes on behind its split.
SPLIT = 32 << 20
PIECE = 1 << 20
AHEAD = 1 << 16

FORMATS = ("fasta", "fastq", "raw")

#: Values of ``record``: the line that a split begins in, the sequence that goes on from an earlier split, and the split itself; records that begin in it count from 1.
LINE, GOES_ON, WHOLE = -1, 0, -2


class Span(InputPartition):
    def __init__(self, path: str, lo: int, hi: int, size: int):
        self.path, self.lo, self.hi, self.size = path, lo, hi, size


class Row(NamedTuple):
    """data: letters, at of which of the same record stand before them in the split. in_header: of a split, whether it ends inside a header, null if it has no line's end."""

    file: str
    split: int
    record: int
    head: str | None
    at: int
    data: bytes | None
    in_header: bool | None


SCHEMA = "file string, split long, record int, head string, at long, data binary, in_header boolean"


def open_files(path: str):
    """(file system, [(path, size)]) of a file, a folder or several, comma-separated."""
    from pyarrow import fs

    out, system = [], None
    for one in path.split(","):
        system, inner = fs.FileSystem.from_uri(one) if "://" in one or one.startswith("file:") else (fs.LocalFileSystem(), one)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(one)
        found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(inner, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
        out += [(x.path, x.size) for x in sorted(found, key=lambda x: x.path)]
    return system, out


class SequenceFiles(DataSource):
    """Rows of FASTA, FASTQ or raw files; options path, kind and split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "sequence_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SequenceReader(self.options["path"], self.options["kind"], int(self.options.get("split", SPLIT)))


class SequenceReader(DataSourceReader):
    def __init__(self, path: str, kind: str, split: int):
        if kind not in FORMATS:
            raise ValueError(f"kind must be one of {FORMATS}")
        self.path, self.kind, self.split = path, kind, split

    def partitions(self) -> list[Span]:
        return [Span(p, lo, min(lo + self.split, size), size) for p, size in open_files(self.path)[1] for lo in range(0, size, self.split)]

    def read(self, span: Span) -> Iterator[tuple]:
        system, _ = open_files(self.path)
        with system.open_input_file(span.path) as f:
            yield from {"fasta": fasta_rows, "fastq": fastq_rows, "raw": raw_rows}[self.kind](f, span)


def _cut(data: bytes, file: str, lo: int, record: int, head: str | None = None, at: int = 0) -> Iterator[Row]:
    for i in range(0, max(1, len(data)), PIECE):
        yield Row(file, lo, record, head, at + i, data[i : i + PIECE], None)


def raw_rows(f, span: Span) -> Iterator[Row]:
    """Every byte as it is."""
    yield from _cut(f.read_at(span.hi - span.lo, span.lo), span.path, span.lo, 1, span.path, span.lo)


def _to_line_end(f, at: int, size: int) -> bytes:
    """Bytes from at up to a line's end."""
    out = []
    while at < size:
        part = f.read_at(min(AHEAD, size - at), at)
        end = part.find(b"\n")
        out.append(part if end < 0 else part[:end])
        if end >= 0:
            break
        at += len(part)
    return b"".join(out)


_WHITE = b" \t\r\n\v\f"


def fasta_rows(f, span: Span) -> Iterator[Row]:
    """A header is a line that begins with >; its first word names the sequence. What stands before a file's first header has no sequence."""
    data = f.read_at(span.hi - span.lo, span.lo)
    fresh = span.lo == 0 or f.read_at(1, span.lo - 1) == b"\n"
    at, in_header, record = 0, None, GOES_ON
    if not fresh:  # a header's rest or letters: the split before knows
        end = data.find(b"\n")
        at = len(data) if end < 0 else end + 1
        yield from _cut(data[:at].translate(None, _WHITE), span.path, span.lo, LINE)
        in_header = None if end < 0 else False
    else:
        in_header = False
    while at < len(data):
        begin = at if data[at : at + 1] == b">" else data.find(b"\n>", at) + 1 or len(data)
        if begin > at:  # letters of the record at hand
            yield from _cut(data[at:begin].translate(None, _WHITE), span.path, span.lo, record)
        if begin == len(data):
            break
        record = max(record, GOES_ON) + 1
        end = data.find(b"\n", begin)
        if end < 0:
            in_header = True
            line, at = data[begin:] + _to_line_end(f, span.hi, span.size), len(data)
        else:
            line, at = data[begin:end], end + 1
        words = line[1:].split(maxsplit=1)
        yield Row(span.path, span.lo, record, words[0].decode("utf-8", "replace") if words and not line[1:2].isspace() else "", 0, b"", None)
    yield Row(span.path, span.lo, WHOLE, None, 0, None, in_header)


def fastq_rows(f, span: Span) -> Iterator[Row]:
    """Four lines a record: @ and name, letters, + and qualities. A line is a header if it begins with @ and the next but one with +: a line of qualities that begins with @ is followed by a header and letters. Records that begin in the split are read to their ends."""
    at = span.lo
    if span.lo and f.read_at(1, span.lo - 1) != b"\n":
        at += len(_to_line_end(f, span.lo, span.size)) + 1
    buffer, taken, read, record, skipped = b"", 0, at, 0, 0
    while read - len(buffer) + taken < span.hi:
        ends: list[int] = []
        while len(ends) < 4:
            end = buffer.find(b"\n", ends[-1] + 1 if ends else taken)
            if end >= 0:
                ends.append(end)
            elif read < span.size:
                more = f.read_at(min(PIECE, span.size - read), read)
                buffer, taken, ends, read = buffer[taken:] + more, 0, [], read + len(more)
            else:
                ends.append(len(buffer))
                if len(buffer) == (ends[-2] if len(ends) > 1 else taken):
                    break
        begins = [taken, *(e + 1 for e in ends)]
        four = [buffer[b:e] for b, e in zip(begins, ends)]  # noqa: B905
        if not any(x.strip() for x in four):
            break
        if not (four[0].startswith(b"@") and len(four) > 2 and four[2].startswith(b"+")):
            if skipped >= 4:
                raise ValueError(f"{span.path}: no record of four lines before byte {span.hi}")
            skipped, taken = skipped + 1, min(ends[0] + 1, len(buffer))
            continue
        record, skipped, taken = record + 1, 0, min(ends[min(3, len(ends) - 1)] + 1, len(buffer))
        words = four[0][1:].split(maxsplit=1)
        yield from _cut(four[1].strip(_WHITE), span.path, span.lo, record, words[0].decode("utf-8", "replace") if words else "")


def file_pieces(spark: SparkSession, path: str, kind: str, split: int = SPLIT) -> DataFrame:
    """(seq_id, file, at, data): pieces of the sequences of files, at counted from 0 within each. kind: fasta, fastq or raw.

    seq_id is the name in the header, of raw files the path. Sequences of one name in one table are told apart by ``file`` and ``number``, a record's byte range and place in it. An empty
    sequence is one empty piece.
    """
    spark.dataSource.register(SequenceFiles)
    rows = spark.read.format("sequence_files").options(path=path, kind=kind, split=str(split)).load()
    if kind != "fasta":
        return rows.select(F.col("head").alias("seq_id"), "file", F.struct("split", "record").alias("number") if kind == "fastq" else F.struct(F.lit(0).cast("long").alias("split"), "record").alias("number"), "at", "data")
    # of each split's parts, in order: what it has of the record, and the number of letters
    parts = rows.groupBy("file", "split", "record").agg(F.max("head").alias("head"), F.sum(F.coalesce(F.length("data"), F.lit(0))).cast("long").alias("letters"), F.bool_or("in_header").alias("in_header"))
    place = F.when(F.col("record") == WHOLE, 1 << 30).otherwise(F.col("record"))
    before = Window.partitionBy("file").orderBy("split", place).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("split", place).rowsBetween(Window.unboundedPreceding, 0)
    # a line that goes on is a header's if the last split that had a line's end ended in one
    parts = parts.withColumn("header", (F.col("record") == LINE) & F.coalesce(F.last("in_header", True).over(before), F.lit(False)))
    parts = parts.withColumn("letters", F.when(F.col("header"), 0).otherwise(F.col("letters")))
    parts = parts.withColumn("before", F.coalesce(F.sum("letters").over(before), F.lit(0)))
    # a record with a header begins at the letters before it; the others belong to the last that did
    own = F.when(F.col("record") > 0, F.struct(F.col("before").alias("base"), "head", F.struct("split", "record").alias("number")))
    parts = parts.withColumn("of", F.last(own, True).over(upto)).where(~F.col("header") & F.col("of").isNotNull())
    parts = parts.select("file", "split", "record", "of", F.col("before").alias("first"))
    found = rows.where("data IS NOT NULL").join(parts, ["file", "split", "record"])
    return found.select(F.col("of.head").alias("seq_id"), "file", F.col("of.number").alias("number"), (F.col("at") + F.col("first") - F.col("of.base")).alias("at"), "data")


def whole_sequences(pieces: DataFrame) -> DataFrame:
    """(seq_id, bytes) of pieces: for sequences that fit in a row."""
    parts = pieces.groupBy("seq_id", "file", "number").agg(F.sort_array(F.collect_list(F.struct("at", F.hex("data").alias("h")))).alias("parts"))
    return parts.select("seq_id", F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")).alias("bytes"))


def chunks_of_pieces(pieces: DataFrame, w: int, k: int, chunk: int) -> DataFrame:
    """What schemes.chunks() gives for whole sequences, from pieces (seq_id, at, data) of them: each piece is cut at the borders of chunks, with the letters that neighbours share, and the parts of a chunk meet in one shuffle."""
    l = w + k - 1
    n = F.length("data")
    # a chunk has letters start - 1 up to start + chunk + l - 1; a piece meets those from the first whose end is behind its beginning on
    low = F.greatest(F.floor((F.col("at") - (chunk + l - 1)) / chunk) + 1, F.lit(0))
    high = F.floor((F.col("at") + n) / chunk)
    rows = pieces.where(n > 0).select("seq_id", "at", "data", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("c"))
    first = F.greatest(F.col("c") * chunk - 1, F.lit(0))
    begin = F.greatest(first, F.col("at"))
    end = F.least(F.col("c") * chunk + (chunk + l - 1), F.col("at") + F.length("data"))
    rows = rows.select("seq_id", (F.col("c") * chunk).alias("start"), begin.alias("begin"), F.substring("data", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("part")).where(F.length("part") > 0)
    rows = rows.groupBy("seq_id", "start").agg(F.sort_array(F.collect_list(F.struct("begin", F.hex("part").alias("h")))).alias("parts"))
    rows = rows.select("seq_id", "start", F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")).alias("data"), F.when(F.col("start") > 0, 1).otherwise(0).alias("lead"))
    count = F.least(F.lit(chunk), F.length("data") - F.col("lead") - (l - 1)).cast("int")
    return rows.withColumn("count", count).where("count > 0").select("seq_id", "start", "count", "lead", "data")
