"""Schemes: which position each window of a sequence samples.

A window is w consecutive k-mers. Sequences are cut into chunks of CHUNK windows that overlap by what a window needs, and chunks are dealt
evenly, which is the only shuffle. A chunk's keys are an array, and the least key of each window is found by doubling: the least of 2, 4, 8, ...
neighbours, for all chunks of an Arrow batch at once. Anchors and rotations are found from the letters themselves. A long sequence is many chunks, so neither memory nor time of a task follow it.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.keys import SPARK, Dialect
from ..sources.records import chunks_of_pieces
from . import nested as N
from . import orders as O
from . import suffixes as S
from .orders import Order, Shape
from .ranks import cut, least_keys

# executors need no copy of this module: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Windows in a chunk; an Arrow batch holds up to 10,000 chunks' keys.
CHUNK = 256

#: Windows in a chunk that gives no row for a window and has no strings of keys.
LONG_CHUNK = 4096

#: Letters that are looked at together, so that their arrays stay in a core's cache.
BLOCK = 1 << 16

#: Digits of a position in a key.
PLACE = 12


class Scheme(NamedTuple):
    """How windows of w k-mers are sampled.

    order: of k-mers, or of what an anchor prefers. kind: ``minimizer`` (least k-mer), ``anchor`` (least suffix of the window that starts at a k-mer)
    or ``rotation`` (least rotation of the window). mod: inner k-mer length from (w, k); the sampled place counts modulo w. places: the
    place that each window of a row of letters samples, from (letters, w, k), the inner ones; without it, ``order`` gives a string for each k-mer, and for each place of each window of anchors and rotations.
    words: the keys of all k-mers of a row of letters as rows of 64-bit numbers, from (letters, inner k), instead of strings of ``order``.
    sided: a key's last character says which of equal keys is preferred, 0 the first, 1 the last.
    """

    order: Order
    kind: str = "minimizer"
    rightmost: bool = False
    r: int = 0
    mod: Callable[[int, int], int] | None = None
    places: Callable[[np.ndarray, int, int], np.ndarray] | None = None
    sided: bool = False
    words: Callable[[np.ndarray, int], np.ndarray] | None = None

    def inner(self, w: int, k: int) -> tuple[int, int]:
        """Window and k-mer length that the order sees; they cover as many letters."""
        if self.mod is None:
            return w, k
        t = self.mod(w, k)
        if not 1 <= t < w + k:
            raise ValueError(f"t = {t} isn't between 1 and w + k - 1")
        return w + k - t, t

    @property
    def by_letters(self) -> bool:
        """Whether windows are sampled from the letters alone, without a string for each k-mer or place."""
        return self.places is not None or self.words is not None

    def letter_places(self, letters: np.ndarray, w: int, k: int) -> np.ndarray:
        """The place that each window of a row of letters samples, before it is taken modulo w."""
        iw, ik = self.inner(w, k)
        if self.places:
            return self.places(letters, iw, ik)
        if len(letters) < iw + ik - 1:
            return np.zeros(0, np.int64)
        best = least_keys(self.words(letters, ik), iw, self.rightmost)
        return best - np.arange(len(best))


def mod_sampling(scheme: Scheme, r: int = 1, lr: bool = False, t: int = 0) -> Scheme:
    """The scheme on k-mers of t letters, its places modulo w. Without t: k if it is less than r, else r more than (k - r) modulo w; lr: k, less w if it is at least w + r."""
    if lr:
        return scheme._replace(mod=lambda w, k: k if k < w + r else k - w)
    return scheme._replace(mod=lambda w, k: t or (k if k < r else (k - r) % w + r))


def _anchor(order: Order, keys: S.Keys) -> Scheme:
    return Scheme(order, "anchor", places=lambda letters, w, k: S.least_suffixes(keys(letters, w), w, k, least_keys))


def _anchor_under(order: Order, limit: int) -> Scheme:
    return Scheme(order, "anchor", places=lambda letters, w, k: S.least_under(letters < min(limit, 255) if limit <= 255 else letters >= 0, w, k))


def _rotation(r: int) -> Scheme:
    return Scheme(O.lex, "rotation", r=r, places=lambda letters, w, k: S.least_rotations(letters, w + k - 1, w + k - 1 - max(r, k - 1), least_keys))


def _tied(order: Order) -> Scheme:
    """Ties go by a hash of the k-mer."""
    return Scheme(O.pair(order, O.random))


_LEX, _ALTERNATING, _ANTI_LEX, _ABB, _ABB2 = map(S.of_kmers, (S.lex, S.alternating, S.anti_lex, S.abb, S.pair(S.abb, S.anti_lex)))


def _syncmers(p: O.Syncmer, by_letters: bool = False) -> Scheme:
    return _tied(O.open_closed(p, O.anti_lex if by_letters else O.random))._replace(places=N.open_closed(p, by_letters, least_keys))


def user_scheme(keys: Callable[[np.ndarray], np.ndarray] | None = None, places: Callable[[np.ndarray], np.ndarray] | None = None, rightmost: bool = False) -> Scheme:
    """A scheme of the caller's own, for all windows of a batch at once.

    keys: from a matrix of letters, a row for each k-mer, to its keys, whole numbers from 0 to 2^64 - 1, or several rows of them of which later ones break ties; the least is sampled.
    places: from a matrix of letters, a row for each window of w + k - 1, to the place that it samples, from 0 up to w - 1.
    """
    if (keys is None) == (places is None):
        raise ValueError("either keys or places are needed")

    def by_keys(letters: np.ndarray, w: int, k: int) -> np.ndarray:
        if len(letters) < w + k - 1:
            return np.zeros(0, np.int64)
        words = np.atleast_2d(keys(np.lib.stride_tricks.sliding_window_view(letters, k))).astype(np.uint64)
        best = least_keys(words, w, rightmost)
        return best - np.arange(len(best))

    def by_places(letters: np.ndarray, w: int, k: int) -> np.ndarray:
        if len(letters) < w + k - 1:
            return np.zeros(0, np.int64)
        found = np.asarray(places(np.lib.stride_tricks.sliding_window_view(letters, w + k - 1)), np.int64)
        if len(found) and not (0 <= found.min() and found.max() < w):
            raise ValueError(f"a place isn't from 0 up to {w - 1}")
        return found

    return Scheme(O.unit, "user", places=by_keys if keys else by_places)


def get_scheme(name: str, **p: Any) -> Scheme:
    """The scheme of that name; parameters are numbers. ``mod=1`` with ``r``, ``lr`` and ``sampling`` wraps it in mod-sampling."""
    t = lambda n=1: O.threshold_abb((n * p["thr"]) % 256)
    flag = lambda key: p.get(key) == 1
    made: dict[str, Callable[[], Scheme]] = {
        "Rot": lambda: _tied(O.rotational),
        "AltRot": lambda: _tied(O.alt_rotational),
        "Bruteforce": lambda: Scheme(O.explicit(tuple(p["ranks"]))),
        "Directed": lambda: Scheme(O.explicit_directed(tuple(p["ranks"]), tuple(p["last"])), sided=True),
        "Random": lambda: _tied(O.unit)._replace(words=N.random),
        "Lex": lambda: Scheme(O.lex, words=_LEX),
        "Alternating": lambda: Scheme(O.alternating, words=_ALTERNATING),
        "ABB": lambda: Scheme(O.abb_coded) if flag("coded") else Scheme(O.abb, words=_ABB),
        "ABB2": lambda: Scheme(O.pair(O.abb_coded, O.anti_lex)) if flag("coded") else Scheme(O.pair(O.abb, O.anti_lex), words=_ABB2),
        "ThresholdABB": lambda: Scheme(t()),
        "ThresholdABB2": lambda: Scheme(O.pair(t(), O.anti_lex)),
        "T2": lambda: Scheme(O.pair(O.two_under(p["thr"]), O.anti_lex)),
        "Thresholds": lambda: Scheme(O.pair(t(), t(2), t(3), O.anti_lex)),
        "AntiLex": lambda: Scheme(O.anti_lex, words=_ANTI_LEX),
        "Greedy": lambda: Scheme(O.greedy(tuple(p["ranks"]))),
        "RcAntiLex": lambda: Scheme(O.rc_anti_lex(letters=flag("letters"))),
        "RcAntiLexMax": lambda: Scheme(O.rc_anti_lex(True, letters=flag("letters"))),
        "Decycling": lambda: _tied(O.decycling()),
        "DoubleDecycling": lambda: _tied(O.decycling(True)),
        "BdAnchor": lambda: _rotation(p["r"]),
        "SusLex": lambda: _anchor(O.lex, S.lex),
        "SusAlternating": lambda: _anchor(O.alternating, S.alternating),
        "SusABB": lambda: _anchor(O.abb, S.abb),
        "SusABB2": lambda: _anchor(O.pair(O.abb, O.lex), S.pair(S.abb, S.lex)),
        "SusThresholdABB": lambda: _anchor_under(t(), p["thr"] % 256),
        # two suffixes never have the same such number
        "SusThresholdABB2": lambda: _anchor_under(O.pair(t(), O.lex), p["thr"] % 256),
        "SusAntiLex": lambda: _anchor(O.anti_lex, S.anti_lex),
        "SusRandomLex": lambda: _anchor(O.random_lex(p.get("seed", 8797977)), S.random_lex(p.get("seed", 8797977))),
        "FracMin": lambda: _tied(O.frac_min(p["f"], flag("coded"))),
        "OpenClosed": lambda: _syncmers(O.Syncmer(p["r"], *[flag(x) for x in ("open", "closed", "open_tmer", "closed_tmer", "other_tmer")], p.get("offset"), flag("modulo"), flag("anti_tmer")), flag("anti_lex")),
        "Miniception": lambda: _syncmers(O.Syncmer(p["r"], closed=True, miniception_r=True)),
        "Threshold": lambda: Scheme(O.threshold(p["t"], p["h"], flag("loose"), flag("open")), places=N.threshold(p["t"], p["h"], flag("loose"), flag("open"), least_keys)),
        "Templates": lambda: Scheme(O.templates(tuple(p["patterns"]))),
    }
    if name not in made:
        raise ValueError(f"Invalid minimizer type: {name}")
    scheme = made[name]()
    return mod_sampling(scheme, p.get("r", 1), flag("lr"), p.get("sampling", 0)) if flag("mod") else scheme


def window_key(d: Dialect, scheme: Scheme, w: int, k: int, sigma: int, lmer: str, j: str) -> str:
    """Text of the key of candidate j of a window whose hex is lmer, for anchors and rotations; '' where there's no such candidate."""
    l = w + k - 1
    if scheme.kind == "anchor":
        return scheme.order(d, f"substring({lmer}, 2 * {j} + 1)", Shape(w, l, sigma))
    r = max(scheme.r, k - 1)
    return f"CASE WHEN {j} > 0 AND {j} >= {l - r} THEN 'z' ELSE substring({lmer} || {lmer}, {d.integer(f'2 * {j} + 1')}, {2 * l}) END"


def chunk_size(*schemes: Scheme) -> int:
    """Windows in a chunk where windows have no rows."""
    return LONG_CHUNK if all(s.by_letters for s in schemes) else CHUNK


def chunks(seqs: DataFrame, w: int, k: int, chunk: int = CHUNK, keep: tuple[str, ...] = (), back: int = 1) -> DataFrame:
    """(seq_id, n, start, count, lead, data): windows start up to start + count; data begins at window start - lead, lead being ``back``, or less if there are fewer before it. Sequences shorter than a window have none."""
    l = w + k - 1
    n = F.length("bytes")
    windows = F.col("n") - (l - 1)
    rows = seqs.withColumn("n", n).where(F.col("n") >= l)
    rows = rows.select("seq_id", "n", "bytes", *keep, F.explode_outer(F.sequence(F.lit(0), windows - 1, F.lit(chunk))).alias("start"))
    rows = rows.withColumns({"count": F.least(F.lit(chunk), windows - F.col("start")), "lead": F.least(F.lit(back), F.col("start"))})
    return rows.select("seq_id", *keep, "n", "start", "count", "lead", F.substring("bytes", F.col("start") - F.col("lead") + 1, F.col("count") + F.col("lead") + (l - 1)).alias("data"))


def _key_words(keys: pa.ListArray) -> np.ndarray:
    """The keys of all lists, strings of one length, as big-endian numbers: a row for each 8 bytes."""
    flat = keys.flatten()
    n = len(flat)
    size = (len(flat[0].as_py().encode()) if n else 0) or 1
    data = np.zeros((n, -(-size // 8) * 8), np.uint8)
    if n and flat[0].as_py():
        offsets = np.frombuffer(flat.buffers()[1], np.int64 if pa.types.is_large_string(flat.type) else np.int32)
        data[:, :size] = np.frombuffer(flat.buffers()[2], np.uint8)[offsets[flat.offset] : offsets[flat.offset + n]].reshape(n, size)
    return data.view(">u8").T.astype(np.uint64)


def tie_sides(scheme: Scheme, keys: pa.ListArray) -> bool | np.ndarray:
    """Which of equal keys is preferred, of all or of each."""
    if not scheme.sided:
        return scheme.rightmost
    return pc.equal(pc.utf8_slice_codeunits(keys.flatten(), -1), "1").to_numpy(zero_copy_only=False)


class Windows(NamedTuple):
    """The windows of some chunks of a batch: of each its chunk (its row in the batch), the window's number, the position it samples and the one that the window before it does, a sequence's first windows, for which prev is nothing, and, if wanted, w + k bytes from win - 1 on."""

    batch: pa.RecordBatch
    row: np.ndarray
    win: np.ndarray
    pos: np.ndarray
    prev: np.ndarray
    first: np.ndarray
    letters: np.ndarray | None


def binary_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters, offsets) of a column of bytes without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Places(NamedTuple):
    """Some chunks of a batch: of each its window number, how many windows it has and how many stand before them, where its first window, those before it too, stands in ``place``, and its letters in ``letters``. place: where in its window each one samples."""

    batch: pa.RecordBatch
    start: np.ndarray
    count: np.ndarray
    lead: np.ndarray
    base: np.ndarray
    place: np.ndarray
    letters: np.ndarray
    offsets: np.ndarray


def places(batches: Iterator[pa.RecordBatch], scheme: Scheme, w: int, k: int, keyed: int) -> Iterator[Places]:
    """What each window of batches of chunks (start, count, lead, data, and keys if keyed) samples, up to BLOCK letters at a time. keyed: k-mers in a window whose keys there are."""
    for part in batches:
        for lo, hi in cut(binary_rows(part.column(part.schema.get_field_index("data")))[1], BLOCK):
            b = part.slice(lo, hi - lo)
            start, count, lead = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("start", "count", "lead"))
            letters, offsets = binary_rows(b.column(b.schema.get_field_index("data")))
            if scheme.by_letters:  # all places of the letters at once, chunks' ends too, where no window is
                base, place = offsets[:-1], scheme.letter_places(letters, w, k)
            else:
                keys = b.column(b.schema.get_field_index("keys"))
                many = np.diff(keys.offsets.to_numpy()).astype(np.int64)
                base = np.cumsum(many) - many
                if keyed:
                    best = least_keys(_key_words(keys), keyed, tie_sides(scheme, keys))
                    place = best - np.arange(len(best))
                else:
                    place = keys.flatten().to_numpy() - (np.arange(int(many.sum())) - np.repeat(base, many))
            yield Places(b, start, count, lead, base, place % w if scheme.mod else place, letters, offsets)


def sampled(batches: Iterator[pa.RecordBatch], scheme: Scheme, w: int, k: int, keyed: int, width: int) -> Iterator[Windows]:
    """What each window of batches of chunks, as of places(), samples. width: letters to give with each window."""
    for x in places(batches, scheme, w, k, keyed):
        row = np.repeat(np.arange(len(x.start)), x.count)
        j = np.arange(len(row)) - (np.cumsum(x.count) - x.count - x.lead)[row]
        at, shift = x.base[row] + j, (x.start - x.lead)[row] + j
        first = j == 0
        pieces = None
        if width:
            l = (x.offsets[row] + j - 1)[:, None] + np.arange(width)
            # the first window of a sequence has none before it
            pieces = np.where((l < x.offsets[row][:, None]), np.uint8(0), x.letters[np.maximum(l, 0)])
        yield Windows(x.batch, row, shift, shift + x.place[at], shift - 1 + x.place[np.where(first, at, at - 1)], first, pieces)


def _picked(scheme: Scheme, w: int, k: int, keyed: int, width: int, kept: list[str]):
    """Batches of (seq_id, kept, start, count, lead, data, keys) to those of (seq_id, kept, win, pos, prev, letters): a row for each window."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in sampled(batches, scheme, w, k, keyed, width):
            out = [x.batch.column(n).take(pa.array(x.row)) for n in range(len(kept))]
            out += [pa.array(x.win), pa.array(x.pos), pa.array(x.prev, mask=x.first)]
            if width:
                out.append(pa.Array.from_buffers(pa.large_binary(), len(x.row), [None, pa.py_buffer(np.arange(0, len(x.row) * width + 1, width, dtype=np.int64)), pa.py_buffer(x.letters.tobytes())]).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(out, [*kept, "win", "pos", "prev", *(["letters"] if width else [])])

    return of


def keyed_chunks(rows: DataFrame, scheme: Scheme, w: int, k: int, sigma: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(chunks with all that sampled() needs, keyed)."""
    many, columns = "count + lead", ["seq_id", *keep, "start", "count", "lead", "data"]
    if scheme.by_letters:
        return rows.select(*columns), 0
    if scheme.kind == "minimizer":
        keyed, ik = scheme.inner(w, k)
        kmer, of = f"hex(substring(data, i + 1, {ik}))", lambda x: scheme.order(SPARK, x, Shape(keyed, ik, sigma))
        # naming a k-mer costs more than cutting it out twice
        key = of(kmer) if of("@").count("@") <= 2 else SPARK.let(kmer, of, "x")
        rows = rows.withColumn("keys", F.expr(f"transform(sequence(0, {many} + {keyed} - 2), i -> {key})"))
    else:  # what each window samples, worked out from its letters
        keyed, n = 0, w if scheme.kind == "anchor" else w + k - 1
        least = f"array_min(transform(sequence(0, {n - 1}), j -> {window_key(SPARK, scheme, w, k, sigma, 'm', 'j')} || lpad(cast(j as string), {PLACE}, '0')))"
        body = SPARK.let(f"hex(substring(data, i + 1, {w + k - 1}))", lambda m: least, "m")
        rows = rows.withColumn("keys", F.expr(f"transform(sequence(0, {many} - 1), i -> i + cast(right({body}, {PLACE}) as bigint))"))
    return rows.select(*columns, "keys"), keyed


def sample(seqs: DataFrame, scheme: Scheme, w: int, k: int, sigma: int = 256, chunk: int = CHUNK, keep: tuple[str, ...] = (), letters: bool = False) -> DataFrame:
    """(seq_id, win, pos, prev) for each window of each sequence (seq_id, bytes): the position it samples, from 0, and the one the window before it samples (null for the first).

    keep: more columns of seqs to carry along, small ones. letters: the w + k bytes of the window and the one before it too, from place win - 1 on.
    """
    # keys cost a hundred times what moving a chunk's letters does, so chunks are dealt evenly whatever the files and however long a sequence
    return sample_chunks(chunks(seqs, w, k, chunk, keep).repartition("seq_id", "start"), scheme, w, k, sigma, keep, letters)


def sample_chunks(rows: DataFrame, scheme: Scheme, w: int, k: int, sigma: int = 256, keep: tuple[str, ...] = (), letters: bool = False) -> DataFrame:
    """As sample(), from chunks as of chunks()."""
    rows, keyed = keyed_chunks(rows, scheme, w, k, sigma, keep)
    kept = ["seq_id", *keep]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "win long, pos long, prev long", *(["letters binary"] if letters else [])])
    return rows.mapInArrow(_picked(scheme, w, k, keyed, w + k if letters else 0, kept), schema)


def sample_pieces(pieces: DataFrame, scheme: Scheme, w: int, k: int, sigma: int = 256, chunk: int = CHUNK, letters: bool = False) -> DataFrame:
    """As sample(), from pieces (seq_id, at, data) of sequences, which may be longer than a row can hold; the letters that a chunk needs of its neighbours come with the one shuffle."""
    return sample_chunks(chunks_of_pieces(pieces, w, k, chunk), scheme, w, k, sigma, (), letters)


def kmer_at(seq_bytes: Column, pos: Column, k: int) -> Column:
    """Hex of the k-mer at a position."""
    return F.hex(F.substring(seq_bytes, pos.cast("int") + 1, F.lit(k)))


def explicit_local(seqs: DataFrame, scheme_map: DataFrame, w: int, k: int, sigma: int, broadcast_rows: int = 1 << 20) -> DataFrame:
    """(seq_id, win, pos): the choice that a table (code, choice) has for each window as a number to the base sigma. The table has sigma ** (w + k - 1) rows; beyond ``broadcast_rows`` it isn't broadcast."""
    l = w + k - 1
    rows = chunks(seqs, w, k)
    code = SPARK.let(f"hex(substring(data, i + lead + 1, {l}))", lambda x: K.pack(x, l, sigma), "x")
    windows = rows.select("seq_id", "start", F.posexplode_outer(F.expr(f"transform(sequence(0, count - 1), i -> {code})")).alias("i", "code"))
    table = scheme_map.select("code", "choice")
    table = F.broadcast(table) if sigma**l <= broadcast_rows else table
    return windows.join(table, "code").select("seq_id", (F.col("start") + F.col("i")).cast("long").alias("win"), (F.col("start") + F.col("i") + F.col("choice")).cast("long").alias("pos"))


def cyclic(seqs: DataFrame, scheme: Scheme, w: int, k: int, sigma: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """(seq_id, size, keep, pos): the distinct positions that the windows of each sequence sample if its end is joined to its beginning."""
    l = w + k - 1
    times = F.ceil(F.lit(l - 1) / F.length("bytes")).cast("int")
    ring = seqs.where(F.length("bytes") > 0).select("seq_id", F.length("bytes").alias("size"), *keep, F.concat("bytes", F.substring(F.unhex(F.repeat(F.hex("bytes"), times + 1)), 1, l - 1)).alias("bytes"))
    found = sample(ring, scheme, w, k, sigma, keep=("size", *keep))
    return found.select("seq_id", "size", *keep, (F.col("pos") % F.col("size")).alias("pos")).distinct()
