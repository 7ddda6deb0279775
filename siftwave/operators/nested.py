"""Orders that look inside k-mers, for all k-mers of an Arrow batch: the least r-mer of each by nested minima, runs of letters by where the next run ends.

What k-mers share is worked out once: r-mers have their keys by what they are, minima double, and a k-mer is hashed only where it can decide between equals, and short ones not again in later blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle

from ..functions.keys import PREFIX
from .orders import Syncmer
from .ranks import dense, md5_of_hex, one_number
from .suffixes import beyond, packed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: K-mers of one length whose digests are kept, as a power of two; 16 bytes each.
SLOT_BITS = 20

_SPREAD = np.uint64(0x9E3779B97F4A7C15)

Least = Callable[..., np.ndarray]
Places = Callable[[np.ndarray, int, int], np.ndarray]


def kmers(letters: np.ndarray, k: int) -> np.ndarray:
    """All k-mers as rows of numbers of 8 letters."""
    n, raw = max(0, len(letters) - k + 1), packed(letters)[0]
    return np.stack([raw[i : i + n] >> np.uint64(8 * max(0, 8 - (k - i))) for i in range(0, k, 8)])


class Digests:
    """The first 64 bits of the MD5 of the hex of k-mers of up to 8 letters, kept for the blocks to come; a k-mer takes the slot of another."""

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    def __reduce__(self):
        return Digests, ()  # what is kept doesn't travel

    def of(self, words: np.ndarray, k: int) -> np.ndarray:
        """words: k-mers as of kmers(), one row."""
        if k not in self.tables:
            self.tables[k] = np.zeros((1 << SLOT_BITS, 2), np.uint64).T
            self.tables[k][0, 0] = 1  # the k-mer of zeros isn't there yet; the one of number 1 has another slot
        known, digests = self.tables[k]
        slot = ((words * _SPREAD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = digests[slot]
        new = np.flatnonzero(known[slot] != words)
        if len(new):
            some, slot = words[new], slot[new]
            out[new] = found = md5_of_hex((some << np.uint64(64 - 8 * k)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :k])[0]
            known[slot] = some
            last = known[slot] == some
            digests[slot[last]] = found[last]
        return out


_DIGESTS = Digests()


def _distinct(x: np.ndarray) -> int:
    x = np.sort(x)
    return int(np.count_nonzero(x[1:] != x[:-1])) + min(len(x), 1)


def _told_apart(found: np.ndarray, words: np.ndarray, reach: int | None) -> bool:
    """Whether different words less than ``reach`` places apart, or any, have different numbers."""
    if reach is None or reach > 32:
        return _distinct(found) == _distinct(words)
    return not any(((found[d:] == found[:-d]) & (words[d:] != words[:-d])).any() for d in range(1, min(reach, len(words))))


def _place_bits(n: int) -> int:
    return max(1, (n - 1).bit_length())


def hashed(letters: np.ndarray, k: int, at: np.ndarray | None = None, bits: int = 0, reach: int | None = None) -> np.ndarray:
    """Numbers, as a row, in the order of the MD5 of the hex of the k letters from each of some places on, or from all: the MD5's first ``bits`` bits, by default as many as leave room for a place, or ranks where these don't tell k-mers apart. reach: k-mers that many places apart or more don't meet."""
    words = kmers(letters, k)  # one row up to 8 letters
    if at is None:
        at = np.arange(words.shape[1])
    else:
        words = words[:, at]
    if not len(at):
        return np.zeros((1, 0), np.uint64)
    if k <= 8:
        found = _DIGESTS.of(words[0], k) >> np.uint64(64 - (bits or 64 - _place_bits(len(at))))
        if _told_apart(found, words[0], reach):
            return found[None]
    number = dense(words)
    first = np.empty(int(number.max()) + 1, np.int64)
    first[number] = at
    digests = md5_of_hex(np.lib.stride_tricks.sliding_window_view(letters, k)[first])
    return dense(digests)[number][None].astype(np.uint64)


def random(letters: np.ndarray, k: int) -> np.ndarray:
    """The keys of all k-mers by orders.random()."""
    return hashed(letters, k)


def _sliding(x: np.ndarray, w: int, better: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    have = 1
    while have < w:
        step = min(have, w - have)
        x, have = better(x[:-step], x[step:]), have + step
    return x


def tied_by_hash(words: np.ndarray, letters: np.ndarray, w: int, k: int, least: Least) -> np.ndarray:
    """The place in each window of the least of its w k-mers by words, then by their MD5, then the first. Only k-mers that no other of some window is less than are hashed."""
    n = words.shape[1]
    if n < w:
        return np.zeros(0, np.int64)
    rank, have = one_number(words)
    if have > 8:
        rank = dense(words)
        have = int(rank.max()).bit_length()
    rank = rank.astype(np.int8 if have < 7 else np.int64)
    lowest = _sliding(rank, w, np.minimum)
    none = np.full(w - 1, -1, rank.dtype)
    around = np.concatenate((none, lowest, none))
    at = np.flatnonzero(_sliding(around, w, np.maximum) == rank)
    keys = np.zeros((2, n), np.uint64)
    keys[0] = rank
    keys[1:, at] = hashed(letters, k, at, max(1, 64 - _place_bits(n) - have), w)
    best = least(keys, w)
    return best - np.arange(len(best))


def open_closed(p: Syncmer, by_letters: bool, least: Least) -> Places:
    """Places by orders.open_closed() and a hash. by_letters: r-mers go by anti-lexicographic order instead of their hash."""

    def of(letters: np.ndarray, w: int, k: int) -> np.ndarray:
        r = min(p.r, k)
        if p.miniception_r:
            r = max(r, k - w)
        n, slots = len(letters), k - r + 1
        if n < w + k - 1:
            return np.zeros(0, np.int64)
        offset = p.offset if p.offset is not None else ((k - r) % w if p.modulo else k - r) // 2
        if p.modulo:
            offset %= w
        kinds = [(0, p.open_tmer) if p.open and (i % w if p.modulo else i) == offset else (1, p.closed_tmer) if p.closed and i in (0, slots - 1) else (2, p.other_tmer) for i in range(slots)]
        kind, by_rmer = (np.array(x) for x in zip(*kinds, strict=True))
        kinds_alone = not (by_rmer.any() or p.anti_tmer)
        if by_letters:
            inner = (packed(letters)[:, : n - r + 1] ^ beyond(1)) | beyond(min(r, PREFIX))
        else:
            inner = hashed(letters, r, reach=slots if kinds_alone else w + slots)
        best = least(inner, slots)
        slot = best - np.arange(len(best))
        words = kind[slot][None].astype(np.uint64)
        if not kinds_alone:
            rmer = inner[:, best]
            other = ~rmer if p.anti_tmer else np.zeros_like(rmer)
            words = np.concatenate((words, np.where(by_rmer[slot].astype(bool), rmer, other)))
        return tied_by_hash(words, letters, w, k, least)

    return of


def threshold(t: int, h: int, loose: bool, opened: bool, least: Least) -> Places:
    """Places by orders.threshold()."""

    def of(letters: np.ndarray, w: int, k: int) -> np.ndarray:
        n = len(letters) - k + 1
        if n < w:
            return np.zeros(0, np.int64)
        sums = np.concatenate(([0], np.cumsum(letters, dtype=np.int64)))
        first = np.arange(n)
        head = sums[first + min(h, k)] - sums[first]
        run = np.zeros(n, np.int64)
        if k > h:  # h-mers under the limit in a row from the second on: where the next one that isn't stands
            places = len(letters) - h + 1
            ends = np.where(sums[h:] - sums[:places] < t * h, places, np.arange(places))
            ends = np.minimum.accumulate(ends[::-1])[::-1]
            run = np.minimum(ends[first + 1] - first - 1, k - h)
        rank = np.where(head >= t * h, 99 - run, 100)
        if not loose:
            rank = np.where(rank > 100 - k, 100, rank)
        letter = letters[:n].astype(np.int64)
        if opened:
            place = least((255 - letters.astype(np.int64))[None].astype(np.uint64), k, True) - first if k > 1 else np.zeros(n, np.int64)
            late = rank >= 100
            mid, end = place == k // 2, place == k - 1
            letter = np.where(late & mid, letters[first + k // 2], np.where(late & end, letters[first + k - 1], letter))
            rank = np.where(late, np.where(mid, 200, np.where(end | (place == 0), 300, 400)), rank)
        return tied_by_hash(np.stack((rank, 255 - letter)).astype(np.uint64), letters, w, k, least)

    return of
