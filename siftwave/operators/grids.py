"""Many schemes, windows and k-mer lengths over one reading of the sequences, and all statistics of a run at once.

A chunk carries the letters that the longest window of the grid needs. Each different order of k-mers has its keys worked out once, whatever the windows: a sparse
table of the least of 1, 2, 4, ... neighbours, from which the least of any w is the better of two. What windows sample is folded into histograms where it is found, for each
Arrow batch in numpy; the histograms are summed, and no row is made for a window.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import SPARK
from .orders import Shape
from .ranks import Minima, cut
from .schemes import BLOCK, CHUNK, Scheme, _key_words, binary_rows, chunk_size, tie_sides

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATS = "cell int, stat string, a long, b long, n long"


class Cell(NamedTuple):
    """A scheme, by a name of the caller's, with its window and k-mer length."""

    name: str
    scheme: Scheme
    w: int
    k: int


def low_codes(letters: np.ndarray, k: int) -> np.ndarray:
    """The number that the lowest bits of the k letters from each place on make."""
    bits = np.concatenate(((letters & 1).astype(np.int64), np.zeros(k, np.int64)))
    out = np.zeros(len(letters), np.int64)
    for i in range(k):
        out = out * 2 + bits[i : i + len(letters)]
    return out


def _counts(stat: str, *columns: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """A histogram of one or two columns."""
    if not len(columns[0]):
        return
    if len(columns) == 1:
        a, n = np.unique(columns[0], return_counts=True)
        yield stat, a, np.zeros(len(a), np.int64), n
    else:
        low = columns[1].min()
        width = int(columns[1].max() - low) + 1
        heads, head = np.unique(columns[0], return_inverse=True)
        key, n = np.unique(head * width + (columns[1] - low), return_counts=True)
        yield stat, heads[key // width], key % width + low, n


def _one(stat: str, n: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    return stat, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([n], np.int64)


def fold(win: np.ndarray, pos: np.ndarray, prev: np.ndarray, first: np.ndarray, w: int, full: bool, code: np.ndarray | None, code_before: np.ndarray | None) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(stat, a, b, n) of windows. A sequence's first windows have no prev, which counts as 0 for changes and jumps. code, code_before: of the k-mers at pos and prev."""
    before = np.where(first, 0, prev)
    changed = pos != before
    yield _one("windows", len(win))
    yield _one("changes", int(changed.sum()))
    yield _one("pos_sum", int(pos.sum()))
    yield _one("runs", int((first | (pos != prev)).sum()))
    if not full:
        return
    yield _one("back", int((~first & (pos < prev)).sum()))
    yield _one("outside", int(((pos < win) | (pos >= win + w)).sum()))
    yield from _counts("place", pos - win)
    yield from _counts("jump", (pos - before)[changed])
    yield from _counts("transfer", (prev - win + 1)[~first], (pos - win)[~first])
    if code is not None:
        ahead = ~first & (pos > prev)
        yield from _counts("kmer", code[changed])
        yield from _counts("kmer_place", code, pos - win)
        yield from _counts("jump_to", code[ahead], (pos - prev)[ahead])
        yield from _counts("jump_from", code_before[ahead], (pos - prev)[ahead])


def _folded(cells: list[Cell], keyed: list[list[int]], full: bool, kmers: bool):
    """keyed: of each column of keys, the cells that go by it; the last are those that go by letters."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (start, count, lead, data, which, keys) to (cell, stat, a, b, n)."""
        for part in batches:
            for lo in range(0, len(part), 1024):
                whole = part.slice(lo, 1024)
                whiches = whole.column(4).to_numpy(zero_copy_only=False)
                out: list[tuple[int, tuple]] = []
                for which in np.unique(whiches):
                    b = whole.filter(pa.array(whiches == which))
                    start, count, lead = (b.column(c).to_numpy().astype(np.int64) for c in range(3))
                    letters, offsets = binary_rows(b.column(3))
                    length = np.diff(offsets)
                    keys = b.column(5)
                    first_key = keys.offsets.to_numpy()[:-1].astype(np.int64) - keys.offsets[0].as_py()
                    words = _key_words(keys) if which < len(keyed) - 1 else None
                    minima: dict[tuple, Minima] = {}
                    codes: dict[int, np.ndarray] = {}
                    for c in keyed[which]:
                        _, scheme, w, k = cells[c]
                        some = np.maximum(0, np.minimum(length - (w + k - 2), count + lead))  # windows, the one before a chunk's among them
                        row = np.repeat(np.arange(len(some)), some)
                        if not len(row):
                            continue
                        j = np.arange(len(row)) - (np.cumsum(some) - some)[row]
                        if words is None:
                            if scheme.words:
                                iw, ik = scheme.inner(w, k)
                                own = (scheme.words, ik, scheme.rightmost)
                                if own not in minima:
                                    minima[own] = Minima(scheme.words(letters, ik), scheme.rightmost)
                                place = minima[own].of(iw)[offsets[row] + j] - (offsets[row] + j)
                            else:
                                place = scheme.letter_places(letters, w, k)[offsets[row] + j]
                            place = j + (place % w if scheme.mod else place)
                        else:
                            iw, _ = scheme.inner(w, k)
                            kind = (scheme.rightmost, scheme.sided)
                            if kind not in minima:
                                minima[kind] = Minima(words, tie_sides(scheme, keys))
                            at = minima[kind].of(iw)[first_key[row] + j] - first_key[row]
                            place = j + (at - j) % w if scheme.mod else at
                        shift = (start - lead)[row]
                        before = np.where(j == 0, 0, np.concatenate(([0], place[:-1])))
                        mine = j >= lead[row]
                        code = None
                        if kmers:
                            code = codes.setdefault(k, low_codes(letters, k))
                        take = lambda x: x[mine]
                        found = fold(
                            take(shift + j), take(shift + place), take(shift + before), take(j == 0), w, full,
                            take(code[offsets[row] + place]) if kmers else None, take(code[offsets[row] + before]) if kmers else None,
                        )
                        out += [(c, x) for x in found]
                sizes = [len(x[1]) for _, x in out]
                columns = [pa.array(np.repeat(np.array([c for c, _ in out], np.int32), sizes)), pa.array(np.repeat(np.array([x[0] for _, x in out], object), sizes), pa.string())]
                columns += [pa.array(np.concatenate([np.zeros(0, np.int64), *(x[i] for _, x in out)]).astype(np.int64)) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "stat", "a", "b", "n"])

    return of


class Found:
    """What windows of a block sample, each distinct way of finding it once."""

    def __init__(self, scheme_words: np.ndarray | None, sides: dict | None, letters: np.ndarray):
        self.words, self.sides, self.letters, self.minima = scheme_words, sides, letters, {}

    def of(self, scheme: Scheme, w: int, k: int) -> np.ndarray:
        """The place that the window at each place samples, counted as these are."""
        iw, ik = scheme.inner(w, k)
        if self.words is not None:
            key, make = (scheme.rightmost, scheme.sided), lambda: Minima(self.words, self.sides[scheme.sided, scheme.rightmost])
        elif scheme.words:
            key, make = (scheme.words, ik, scheme.rightmost), lambda: Minima(scheme.words(self.letters, ik), scheme.rightmost)
        else:
            place = scheme.letter_places(self.letters, w, k)
            return np.arange(len(place)) + (place % w if scheme.mod else place)
        if key not in self.minima:
            self.minima[key] = make()
        at = self.minima[key].of(iw)
        if scheme.mod:
            i = np.arange(len(at))
            at = i + (at - i) % w
        return at


def _counted(cells: list[Cell], keyed: list[list[int]]):
    """As _folded(), of windows, changes, pos_sum and runs alone: counted in a block as a whole, one row for each cell and task."""
    names = ("windows", "changes", "pos_sum", "runs")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(cells), len(names)), np.int64)
        for part in batches:
            whiches = part.column(4).to_numpy(zero_copy_only=False)
            for which in np.unique(whiches):
                mine = part.filter(pa.array(whiches == which))
                for lo, hi in cut(binary_rows(mine.column(3))[1], BLOCK):
                    b = mine.slice(lo, hi - lo)
                    start, count, lead = (b.column(c).to_numpy().astype(np.int64) for c in range(3))
                    letters, offsets = binary_rows(b.column(3))
                    by_keys = which < len(keyed) - 1
                    base, words, sides = offsets[:-1], None, None
                    if by_keys:
                        keys = b.column(5)
                        base, words = keys.offsets.to_numpy()[:-1].astype(np.int64) - keys.offsets[0].as_py(), _key_words(keys)
                        kinds = {(cells[c].scheme.sided, cells[c].scheme.rightmost): cells[c].scheme for c in keyed[which]}
                        sides = {kind: tie_sides(scheme, keys) for kind, scheme in kinds.items()}
                    found, masks = Found(words, sides, letters), {}
                    for c in keyed[which]:
                        _, scheme, w, k = cells[c]
                        some = np.maximum(0, np.minimum(np.diff(offsets) - (w + k - 2), count + lead))  # windows, the one before a chunk's among them
                        have = np.flatnonzero(some)
                        if not len(have):
                            continue
                        at = found.of(scheme, w, k)
                        if w + k not in masks:  # windows that have one before them
                            edges = np.zeros(len(at) + 1, np.int64)
                            np.add.at(edges, base[have] + 1, 1)
                            np.add.at(edges, base[have] + some[have], -1)
                            inner = np.cumsum(edges)[: len(at)]
                            masks[w + k] = inner, inner[1:] != 0
                        inner, later = masks[w + k]
                        first = have[lead[have] == 0]
                        zero = at[base[first]] - base[first]
                        others = some - (some > 0)  # all but the first of each sequence
                        moved = int(np.count_nonzero((at[1:] != at[:-1]) & later))
                        places = int(at.dot(inner)) + int((others * (start - lead - base)).sum()) + int(zero.sum())
                        total[c] += (int(others.sum()) + len(first), moved + int(np.count_nonzero(zero)), places, moved + len(first))
        cell, stat = np.nonzero(total)
        columns = [pa.array(cell.astype(np.int32)), pa.array([names[i] for i in stat], pa.string()), *(pa.array(x) for x in (np.zeros_like(cell), np.zeros_like(cell), total[cell, stat]))]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "stat", "a", "b", "n"])

    return of


def grid_stats(seqs: DataFrame, cells: Iterable[Cell], sigma: int = 256, full: bool = True, kmers: bool = False, chunk: int | None = None) -> DataFrame:
    """(cell, stat, a, b, n) of sequences (seq_id, bytes), read once for all cells; cell is a cell's number.

    stat is windows, changes, pos_sum (sums of positions) or runs (windows that sample another place than the one before, first ones too; a and b are 0), and with ``full`` also back (windows that sample a place before that of the one before), outside
    (windows that sample none of their w places), place (a: place in the window), jump (a: how far a change goes) and transfer (a, b: places of neighbouring
    windows); with ``kmers`` too, kmer (a: number of the lowest bits, of changes), kmer_place (b: place), jump_to and jump_from (b: jump forward). Sequences shorter than a cell's window have none there.
    """
    cells = list(cells)
    light = not full and not kmers
    chunk = chunk or (chunk_size(*(c.scheme for c in cells)) if light else CHUNK)
    lengths = [c.w + c.k - 1 for c in cells]
    least, most = min(lengths), max(lengths)
    texts: dict[str, list[int]] = {}
    by_letters: list[int] = []
    for i, c in enumerate(cells):
        if c.scheme.by_letters:
            by_letters.append(i)
            continue
        if c.scheme.kind != "minimizer":
            raise ValueError(f"{c.name}: anchors and rotations go by letters")
        iw, ik = c.scheme.inner(c.w, c.k)
        kmer, of = f"hex(substring(data, i + 1, {ik}))", lambda x, s=c.scheme, shape=Shape(iw, ik, sigma): s.order(SPARK, x, shape)
        key = of(kmer) if of("@").count("@") <= 2 else SPARK.let(kmer, of, "x")
        texts.setdefault(f"CASE WHEN length(data) >= {ik} THEN transform(sequence(0, length(data) - {ik}), i -> {key}) ELSE array() END", []).append(i)
    windows = F.col("size") - (least - 1)
    rows = seqs.withColumn("size", F.length("bytes")).where(F.col("size") >= least)
    rows = rows.select("seq_id", "size", "bytes", F.explode_outer(F.sequence(F.lit(0), windows - 1, F.lit(chunk))).alias("start"))
    rows = rows.withColumns({"count": F.least(F.lit(chunk), windows - F.col("start")), "lead": F.when(F.col("start") > 0, 1).otherwise(0)})
    data = F.substring("bytes", F.col("start") - F.col("lead") + 1, F.col("count") + F.col("lead") + (most - 1))
    rows = rows.select("seq_id", "start", "count", "lead", data.alias("data")).repartition("seq_id", "start").drop("seq_id")
    # a row for each column of keys, so that an Arrow batch holds one at a time
    columns = [f"named_struct('which', {i}, 'keys', {text})" for i, text in enumerate(texts)]
    if by_letters:
        columns.append(f"named_struct('which', {len(texts)}, 'keys', cast(array() as array<string>))")
    rows = rows.select("start", "count", "lead", "data", F.expr(f"inline(array({', '.join(columns)}))"))
    keyed = [*texts.values(), by_letters]
    found = rows.mapInArrow(_counted(cells, keyed) if light else _folded(cells, keyed, full, kmers), STATS)
    return found.groupBy("cell", "stat", "a", "b").agg(F.sum("n").alias("n"))


def grid_density(seqs: DataFrame, cells: Iterable[Cell], sigma: int = 256, chunk: int | None = None) -> DataFrame:
    """(scheme, w, k, n_windows, n_changes, pos_sum) for each cell, 0 where there is no window; density is n_changes / n_windows."""
    cells = list(cells)
    stats = grid_stats(seqs, cells, sigma, False, False, chunk)
    of = lambda stat: F.coalesce(F.sum(F.when(F.col("stat") == stat, F.col("n"))), F.lit(0)).alias
    sums = stats.groupBy("cell").agg(of("windows")("n_windows"), of("changes")("n_changes"), of("pos_sum")("pos_sum"))
    known = seqs.sparkSession.createDataFrame([(i, c.name, c.w, c.k) for i, c in enumerate(cells)], "cell int, scheme string, w int, k int")
    return known.join(sums, "cell", "left").na.fill(0, ["n_windows", "n_changes", "pos_sum"]).drop("cell")


def run_stats(seqs: DataFrame, scheme: Scheme, w: int, k: int, sigma: int = 256, kmers: bool = True, chunk: int | None = None) -> DataFrame:
    """(stat, a, b, n): all statistics of one scheme from one sampling."""
    return grid_stats(seqs, [Cell("", scheme, w, k)], sigma, True, kmers, chunk).drop("cell")
