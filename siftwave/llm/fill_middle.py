"""Fill-in-the-middle texts: a document is cut into prefix, middle and suffix, which sentinels announce in another order.

Cuts fall between units, lines or code points. While a text's units are counted, a checkpoint with byte and code-point offset is kept for
every EVERY-th unit; a cut is found by binary search among the checkpoints and a short scan from the one before it. So the index of a text is
small, whatever its length, and nothing is counted twice.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Units between checkpoints, and bytes of a text that are looked at together.
EVERY = 64
PIECE = 1 << 20

#: Bytes of output in a batch; a longer text is a batch of its own.
BATCH = 1 << 23

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

UNITS = ("line", "char")


class Checkpoints(NamedTuple):
    """units[i], at[i] and points[i]: a unit's number, and the bytes and code points before it. n, size and n_points are the whole text's."""

    data: np.ndarray
    unit: str
    units: list[int]
    at: list[int]
    points: list[int]
    n: int
    n_points: int

    def find(self, cut: int) -> tuple[int, int]:
        """Bytes and code points before unit number cut, the text's end if there are only cut."""
        if cut >= self.n:
            return len(self.data), self.n_points
        i = bisect_right(self.units, cut) - 1
        left, at, points = cut - self.units[i], self.at[i], self.points[i]
        end = self.at[i + 1] if i + 1 < len(self.at) else len(self.data)
        while left:  # pieces that grow, as most cuts are near
            part = self.data[at : min(end, at + max(256, PIECE if left > EVERY else 64 * left))]
            starts = _starts(part, self.unit, first=False)
            if len(part) + at == len(self.data):
                starts = starts[starts < len(part)]
            if len(starts) >= left:
                stop = int(starts[left - 1])
                return at + stop, points + int(np.count_nonzero((part[:stop] & 0xC0) != 0x80))
            left -= len(starts)
            points += int(np.count_nonzero((part & 0xC0) != 0x80))
            at += len(part)
        return at, points


def _starts(part: np.ndarray, unit: str, first: bool) -> np.ndarray:
    """Where units begin, at the beginning only if first is true. A line may begin behind the part's last byte."""
    if unit == "line":
        at = np.flatnonzero(part == 10) + 1
        return np.concatenate(([0], at)) if first else at
    at = np.flatnonzero((part & 0xC0) != 0x80)
    return at if first else at[at > 0]


def checkpoints(data: np.ndarray, unit: str = "line", every: int = EVERY) -> Checkpoints:
    """Counts the units of UTF-8 bytes, piece by piece. A line ends with its line feed; text behind the last one is a line too."""
    units, ats, points, n, n_points = [], [], [], 0, 0
    for lo in range(0, len(data), PIECE):
        part = data[lo : lo + PIECE]
        # a unit that begins with the piece: a line if the byte before is a line feed, a character if it isn't a later byte of one
        begins = lo == 0 or (unit == "line" and data[lo - 1] == 10) or (unit == "char" and (part[0] & 0xC0) != 0x80)
        starts = _starts(part, unit, bool(begins))
        starts = starts[starts < len(part)]  # behind the last byte the next piece begins, or nothing
        upto = np.cumsum((part & 0xC0) != 0x80, dtype=np.int64)
        chosen = starts[-n % every :: every]
        units += range(n + -n % every, n + len(starts), every)
        ats += (lo + chosen).tolist()
        points += (n_points + upto[chosen] - ((part[chosen] & 0xC0) != 0x80)).tolist()
        n, n_points = n + len(starts), n_points + int(upto[-1])
    return Checkpoints(data, unit, units, ats, points, n, n_points)


def _cut(data: np.ndarray, draws: str, unit: str, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, and output of one text."""
    h = [int(draws[8 * i : 8 * i + 8], 16) for i in range(4)]
    whole, p, s, m = data.tobytes(), *(x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    index = checkpoints(data, unit)
    if not whole or p in whole or s in whole or m in whole or h[2] % 100 >= rate:
        return index.n, "plain", None, None, whole
    cuts = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    (a, a_points), (b, b_points) = (index.find(c) for c in cuts)
    parts = (s, whole[b:], p, whole[:a]) if h[3] % 100 < spm else (p, whole[:a], s, whole[b:])
    return index.n, "spm" if parts[0] == s else "psm", a_points, b_points - a_points, b"".join([*parts, m, whole[a:b]])


def _filled(unit: str, rate: int, spm: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (doc_id, text, draws) to those of (doc_id, n, form, prefix_chars, middle_chars, output)."""
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())
        for b in batches:
            rows, lo, size = [], 0, 0
            for i in range(len(b)):
                text = b.column(1)[i].as_buffer() if b.column(1)[i].is_valid else b""
                rows.append(_cut(np.frombuffer(text, np.uint8), b.column(2)[i].as_py(), unit, rate, spm))
                size += len(rows[-1][-1])
                if size >= BATCH or i == len(b) - 1:
                    columns = [pa.array(x, k) for x, k in zip(zip(*[(*r[:-1], r[-1].decode()) for r in rows], strict=True), kinds, strict=True)]
                    columns[-1] = columns[-1].cast(pa.string())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(rows)), *columns], names)
                    rows, lo, size = [], i + 1, 0

    return of


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """A row for each row of df: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    rate: of a hundred texts, how many are cut; spm: of a hundred of those, how many have the suffix first. What a text gets follows from a hash of seed and
    id alone, so reruns agree, and rows with one id are cut by the same numbers. A null id counts as the empty text, null text as empty.
    An empty text, and one in which a sentinel stands, stays as it is. Other columns aren't read. An empty table gives an empty table.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    draws = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), draws.alias("draws"))
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_filled(unit, rate, spm), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output of a form was made of. A sentinel can't overlap itself, and the text has none, so the first one found is the one that was put there."""
    after = lambda x, mark: F.substring(x, F.locate(mark, x) + F.lit(len(mark)), F.length(x))
    until = lambda x, mark: F.substring(x, F.lit(1), F.locate(mark, x) - F.lit(1))
    psm = F.concat(until(after(output, PREFIX), SUFFIX), after(output, MIDDLE), until(after(output, SUFFIX), MIDDLE))
    spm = F.concat(until(after(output, PREFIX), MIDDLE), after(output, MIDDLE), until(after(output, SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, string_split(text, chr(10)) AS parts, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
v AS (SELECT *, (CASE WHEN text = '' THEN 0 WHEN parts[len(parts)] = '' THEN len(parts) - 1 ELSE len(parts) END)::BIGINT AS n FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 AS plain FROM v),
k AS (SELECT *, CASE WHEN a = n THEN text WHEN a = 0 THEN '' ELSE array_to_string(parts[1:a], chr(10)) || chr(10) END AS prefix,
      CASE WHEN b = n THEN text WHEN b = 0 THEN '' ELSE array_to_string(parts[1:b], chr(10)) || chr(10) END AS head FROM c),
m AS (SELECT *, substring(head, length(prefix) + 1) AS middle, substring(text, length(head) + 1) AS suffix FROM k),
f AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM m)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""
