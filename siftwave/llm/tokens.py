"""Words of Arrow text columns as numpy arrays: byte ranges and 64-bit hashes, found for many documents at once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together, so that memory doesn't follow the batch. A longer document is a chunk of its own.
CHUNK = 1 << 21

#: Bytes hashed together.
PIECE = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_GRAM = np.uint64(0xD1342543DE82EF95)
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Two hashes of a word are independent: a byte at a place has a random number of its own in each.
_SEEDS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0xA24BAED4963EE407))

#: Places of a word whose numbers are looked up; those of later ones are worked out.
_PLACES = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads each number over all 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words(NamedTuple):
    """The words of some documents in order: data[starts[i]:ends[i]]; those of document d are first[d] up to first[d + 1]; rows: the documents' rows in the batch."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    rows: range

    def text(self, lo: int, hi: int) -> bytes:
        """Words lo up to hi, joined by one space."""
        return b" ".join(self.data[self.starts[lo] : self.ends[hi - 1]].tobytes().split()) if hi > lo else b""

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes: the sum of the random numbers that its bytes have at their places. which: 0 or 1, two independent hashes."""
        out, lo = np.empty(len(self.starts), np.uint64), 0
        while lo < len(out):  # some words at a time, one at least, so that what is looked at stays in the processor's cache
            at = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, at + PIECE, "right")))
            starts, size = (self.starts[lo:hi] - at).astype(np.int32), (self.ends[lo:hi] - self.starts[lo:hi]).astype(np.int32)
            first = np.cumsum(size, dtype=np.int32) - size
            every = np.arange(int(size.sum()), dtype=np.int32)
            data = self.data[at : self.ends[hi - 1]][every + np.repeat(starts - first, size)]
            out[lo:hi] = mix64(np.add.reduceat(_numbers(data, every - np.repeat(first, size), which), first))
            lo = hi
        return out


def _random(key: np.ndarray, which: int) -> np.ndarray:
    return mix64(key * _STEP ^ _SEEDS[which])


_LOOKUP = [_random(np.arange(1, 256 * _PLACES + 1, dtype=np.uint64), which) for which in (0, 1)]


def _numbers(data: np.ndarray, place: np.ndarray, which: int) -> np.ndarray:
    out = _LOOKUP[which][np.minimum(place, _PLACES - 1) * 256 + data]
    far = np.flatnonzero(place >= _PLACES)
    out[far] = _random(place[far].astype(np.uint64) * np.uint64(256) + data[far] + np.uint64(1), which)
    return out


def digests(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the numbers h[start] up to h[start + size], in their order, for each start and size (1 at least)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    return mix64(np.add.reduceat(mix64(h[place + np.repeat(start, size)] + place.astype(np.uint64) * _STEP), first))


def _column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def words(column: pa.Array, fold: bool = False) -> Iterator[Words]:
    """The words of a text column, some documents at a time; null texts have none. fold: A-Z are lower-cased."""
    data, offsets = _column(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        at = offsets[lo : hi + 1] - offsets[lo]
        if fold:
            part = _FOLD[part]
        inside = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)  # where a document begins
        edge[at] = True
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1])))) if len(part) else np.zeros(0, np.int64)
        ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1 if len(part) else np.zeros(0, np.int64)
        yield Words(part, starts, ends, np.searchsorted(starts, at), range(lo, hi))
        lo = hi


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive hashes, wherever documents end."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _GRAM + h[i : i + len(out)]
    return mix64(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive numbers."""
    if len(x) < n:
        return x[:0]
    have = 1
    while 2 * have <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x
