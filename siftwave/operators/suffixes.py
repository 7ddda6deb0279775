"""Least suffixes and rotations of all windows of an Arrow batch of letters.

Orders of suffixes look at PREFIX letters, so what stands at a place has a rank of two 64-bit numbers: packed letters, found by doubling and shared by all
windows. A suffix that its window's end cuts has the letters behind it replaced by the greatest, which is one mask for each place in the window. Whole suffixes go through
the sliding minimum; the fewer than PREFIX places near a window's end are compared one by one, for all windows at once. No string is made for a place of a window.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle

from ..functions.keys import PREFIX
from .ranks import dense, one_number

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: (letters, w) -> a row of 64-bit numbers for each 8 bytes of the keys of the suffixes at all places. Suffixes that are w places apart or more don't meet.
Keys = Callable[[np.ndarray, int], np.ndarray]

#: Letters of windows that are compared as circles together.
BLOCK = 1 << 20


def packed(letters: np.ndarray) -> np.ndarray:
    """The PREFIX letters from each place on, as two numbers; zeros behind the end. One, two, four, eight letters at a time."""
    n = len(letters)
    x = np.zeros(n + PREFIX, np.uint64)
    x[:n] = letters
    for have in (1, 2, 4):
        x[:-have] = (x[:-have] << np.uint64(8 * have)) | x[have:]
    return np.stack((x[:n], x[8 : n + 8]))


def _mask(*byte: int) -> np.ndarray:
    """Two numbers of the bytes, which repeat."""
    return np.frombuffer(bytes(byte[i % len(byte)] for i in range(PREFIX)), ">u8").astype(np.uint64)[:, None]


def beyond(length: int) -> np.ndarray:
    """Ones in all letters from length on."""
    return np.frombuffer(bytes(0 if i < length else 255 for i in range(PREFIX)), ">u8").astype(np.uint64)[:, None]


def lex(letters: np.ndarray, w: int) -> np.ndarray:
    return packed(letters)


def alternating(letters: np.ndarray, w: int) -> np.ndarray:
    """Every other letter complemented."""
    return packed(letters) ^ _mask(0, 255)


def anti_lex(letters: np.ndarray, w: int) -> np.ndarray:
    """All letters but the first complemented."""
    return packed(letters) ^ beyond(1)


def abb(letters: np.ndarray, w: int) -> np.ndarray:
    """All letters but the first replaced by whether they are zero."""
    first = beyond(1)
    return (packed(letters) & ~first) | (packed((letters == 0).astype(np.uint8)) & first)


def pair(*keys: Keys) -> Keys:
    """The first order, ties by the next."""
    return lambda letters, w: np.concatenate([k(letters, w) for k in keys])


def of_kmers(keys: Keys) -> Callable[[np.ndarray, int], np.ndarray]:
    """The same order's keys of k-mers, from (letters, k)."""

    def of(letters: np.ndarray, k: int) -> np.ndarray:
        words = keys(letters, 1)[:, : max(0, len(letters) - k + 1)]
        return words | _beyond_all(min(k, PREFIX), len(words))

    return of


class Prefixes:
    """The different prefixes of the suffixes of a row of letters, by length, found once for all seeds."""

    def __init__(self, letters: np.ndarray):
        self.letters, self.text, self.raw = letters, letters.tobytes(), packed(letters)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(heads, number): where each different prefix first stands, and the number of the prefix at each place."""
        if length not in self.known:
            words = (self.raw & ~beyond(length))[: 1 + (length > 8)]
            order = np.lexsort(words[::-1])
            first = np.ones(len(order), bool)
            first[1:] = (words[:, order[1:]] != words[:, order[:-1]]).any(axis=0)
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(first) - 1
            self.known[length] = order[first], number
        return self.known[length]

    def keys(self, seed: int, w: int) -> np.ndarray:
        """A random byte for each prefix, the first of its MD5, as keys of the suffixes. Only suffixes that are alike so far, and near enough to meet, are looked at any further, and each different prefix is hashed once."""
        n = len(self.letters)
        out, near, rank = np.zeros((PREFIX, n), np.uint8), np.arange(n), np.zeros(n, np.int64)
        for t in range(1, PREFIX + 1):
            heads, number = self.of(t)
            some, which = np.unique(number[near], return_inverse=True)
            hexes = (self.text[p : p + t].ljust(t, bytes(1)).hex().upper() for p in heads[some].tolist())
            byte = np.fromiter((hashlib.md5(f"{seed}{x}".encode()).digest()[0] for x in hexes), np.uint8, len(some))[which]
            out[t - 1, near] = byte
            # alike so far, and another such suffix less than w places away
            rank = np.unique(rank * 256 + byte, return_inverse=True)[1]
            order = np.lexsort((near, rank))
            close = (rank[order][1:] == rank[order][:-1]) & (np.diff(near[order]) < w)
            keep = np.zeros(len(near), bool)
            keep[order[np.concatenate((close, [False])) | np.concatenate(([False], close))]] = True
            near, rank = near[keep], rank[keep]
            if not len(near):
                break
        return np.ascontiguousarray(out.T).view(">u8").T.astype(np.uint64)


class Shared:
    """The prefixes of the letters last asked for, for all seeds that ask for the same."""

    def __init__(self):
        self.last: Prefixes | None = None

    def of(self, letters: np.ndarray) -> Prefixes:
        if self.last is None or self.last.letters is not letters:
            self.last = Prefixes(letters)
        return self.last


def random_lex(seed: int, shared: Shared | None = None) -> Keys:
    """Letters in a random order that depends on what stands before them. shared: one for many seeds that are sampled side by side."""
    of = (shared or Shared()).of
    return lambda letters, w: of(letters).keys(seed, w)


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(a.shape[1], bool)
    for x, y in zip(a[::-1], b[::-1], strict=True):
        out = (x < y) | ((x == y) & out)
    return out


def least_under(is_under: np.ndarray, w: int, k: int) -> np.ndarray:
    """The place in each window of the least suffix as a binary number of whether letters are under a limit, the first bit inverted.

    Of two suffixes the digits behind the second one's first are the same, so the first one is less only if its letter is under the limit and none from there to the second's is:
    the least begins with the last letter of the window's w that is under the limit, or if none is, it is the last of all.
    """
    at = np.arange(len(is_under))
    last = np.maximum.accumulate(np.where(is_under != 0, at, -1))
    begin = at[: max(0, len(at) - (w + k - 2))]
    found = last[begin + w - 1]
    return np.where(found >= begin, found - begin, w - 1)


def least_suffixes(keys: np.ndarray, w: int, k: int, least_keys: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """The place in each window, of w + k - 1 letters, of the least of the suffixes that begin at its first w letters, the first of equals. keys: see Keys; letters behind a window's end count as greatest."""
    l, n = w + k - 1, keys.shape[1]
    count = max(0, n - l + 1)
    whole = max(0, min(w, l - PREFIX + 1))
    if not count or whole == w:
        return least_keys(keys, w)[:count] - np.arange(count)
    if whole:
        # letters that are replaced by the greatest make no key less, so only windows whose least would be a cut suffix are looked at closer
        x = one_number(keys, 1)[0][None]
        place = least_keys(x, w)[:count] - np.arange(count)
        some = np.flatnonzero(place >= whole)
        now = least_keys(x, whole)[some] - some
        best = keys[:, some + now]
    else:
        whole, place, some, now = 1, np.zeros(count, np.int64), np.arange(count), np.zeros(count, np.int64)
        best = keys[:, :count] | _beyond_all(l, len(keys))
    for j in range(whole, w):
        other = keys[:, some + j] | _beyond_all(l - j, len(keys))
        less = _less(other, best)
        now[less] = j
        best = np.where(less, other, best)
    place[some] = now
    return place


def _beyond_all(length: int, words: int) -> np.ndarray:
    return np.concatenate([beyond(length)] * (words // 2))


def circle_ranks(rows: np.ndarray) -> np.ndarray:
    """The ranks of all rotations of each row of letters, equal ones alike. Ranks by one letter, then two, four, ..., until all differ or they are by whole rows."""
    rank, have, l = rows.astype(np.int64), 1, rows.shape[1]
    while have < l:
        key = rank * np.int64(max(l, 256)) + np.roll(rank, -have, axis=1)
        order = np.argsort(key, axis=1)
        key = np.take_along_axis(key, order, axis=1)
        up = np.zeros(key.shape, np.int64)
        up[:, 1:] = key[:, 1:] != key[:, :-1]
        np.put_along_axis(rank, order, np.cumsum(up, axis=1), axis=1)
        have *= 2
        if (up[:, 1:] != 0).all():
            break
    return rank


def least_rotations(letters: np.ndarray, l: int, many: int, least_keys: Callable[..., np.ndarray]) -> np.ndarray:
    """The place in each window of l letters of the least of its first ``many`` rotations, the first of equals.

    The first PREFIX letters of a rotation are those at its place, and near the window's end those of the window's beginning behind them. Where longer rotations are alike in
    these, those rotations are compared further on.
    """
    keys, n = packed(letters), len(letters)
    count = max(0, n - l + 1)
    if not count:
        return np.zeros(0, np.int64)
    begin, head = np.arange(count), keys[:, :count]
    many = max(1, min(many, l))
    whole = max(0, min(many, l - PREFIX + 1))
    tie = np.zeros(count, bool)
    if whole:
        rank = dense(keys)
        place = least_keys(rank[None], whole)[:count] - begin
        tie = least_keys(rank[None], whole, True)[:count] - begin != place
        best = keys[:, begin + place]
    else:
        whole, place, best = 1, np.zeros(count, np.int64), _turned(head, head, 0, l)
    for j in range(whole, many):
        # the letters up to the window's end alone make all others greater
        some = np.flatnonzero((keys[0, j : j + count] & ~beyond(l - j)[0]) <= best[0])
        other, now = _turned(keys[:, some + j], head[:, some], j, l), best[:, some]
        less = _less(other, now)
        tie[some] = (tie[some] & ~less) | (other == now).all(axis=0)
        place[some[less]] = j
        best[:, some[less]] = other[:, less]
    if l > PREFIX and tie.any():
        alike, at = Alike(rank), np.flatnonzero(tie)
        for lo in range(0, len(at), BLOCK // PREFIX):
            some = at[lo : lo + BLOCK // PREFIX]
            place[some] = _least_of_tied(keys, some, place[some], best[:, some], l, whole, many, alike)
    return place


class Alike:
    """The places of each rank in order, and how far they follow each other at one distance, PREFIX at most. Of three rotations that begin alike for d letters or more and stand d apart, the one between is never the only least:
    each is the same d letters and then the next, so they rise, fall or are equal."""

    def __init__(self, rank: np.ndarray):
        n = len(rank)
        self.at = np.argsort(rank, kind="stable")
        self.number = np.empty(n, np.int64)
        self.number[self.at] = np.arange(n)
        self.gap = np.full(n, n + 1)
        same = rank[self.at[1:]] == rank[self.at[:-1]]
        self.gap[:-1][same] = np.diff(self.at)[same]
        ends = np.where(np.append(self.gap[1:] != self.gap[:-1], True), np.arange(n) + 1, n)
        self.end = np.minimum.accumulate(ends[::-1])[::-1]

    def after(self, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The next place of the same rank before limit, those between at one distance left out, or -1."""
        i = self.number[at]
        gap, room = self.gap[i], limit - 1 - at
        steps = np.where(gap <= PREFIX, np.minimum(self.end[i] - i, room // gap), gap <= room)
        return np.where(steps > 0, self.at[np.minimum(i + steps, len(self.at) - 1)], -1)


def _least_of_tied(keys: np.ndarray, begin: np.ndarray, place: np.ndarray, best: np.ndarray, l: int, whole: int, many: int, alike: Alike) -> np.ndarray:
    """The places of the least rotations of some windows, which begin at ``begin`` and have several that begin with the PREFIX letters of ``best``. These are compared eight letters on at a time, all windows at once."""
    found = []
    window = np.flatnonzero(place < whole)
    at = begin[window] + place[window]
    while len(window):
        found.append((window, at - begin[window]))
        at = alike.after(at, begin[window] + whole)
        window, at = window[at >= 0], at[at >= 0]
    for j in range(whole, many):
        equal = np.flatnonzero((_turned(keys[:, begin + j], keys[:, begin], j, l) == best).all(axis=0))
        found.append((equal, np.full(len(equal), j)))
    window, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(window * l + j)
    window, j = window[order], j[order]
    out = place.copy()
    letters = PREFIX
    while len(window) and letters < l:
        x = (j + letters) % l
        tail, left = keys[0][begin[window] + x], (l - x).astype(np.uint64)
        over = left < 8
        shift = np.uint64(8) * np.where(over, left, np.uint64(0))
        wrapped = ((tail >> (np.uint64(64) - shift)) << (np.uint64(64) - shift)) | (keys[0][begin[window]] >> shift)
        key = np.where(over, wrapped, tail)
        first = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        size = np.diff(np.append(first, len(window)))
        keep = key == np.repeat(np.minimum.reduceat(key, first), size)
        window, j, letters = window[keep], j[keep], letters + 8
        # those between others at one distance, and the only ones of their window
        new = np.append(True, window[1:] != window[:-1])
        gap = np.append(0, np.diff(j))
        between = np.zeros(len(j), bool)
        between[1:-1] = ~new[1:-1] & ~new[2:] & (gap[1:-1] == gap[2:]) & (gap[1:-1] <= letters)
        only = new & np.append(new[1:], True)
        out[window[only]] = j[only]
        stay = ~between & ~only
        window, j = window[stay], j[stay]
    new = np.append(True, window[1:] != window[:-1])[: len(window)]
    out[window[new]] = j[new]  # equal ones: the first
    return out


def _turned(tail: np.ndarray, head: np.ndarray, j: int, l: int) -> np.ndarray:
    """The first PREFIX letters, l at most, of rotation j: l - j letters of tail, then those of head."""
    if l - j >= PREFIX:
        return tail
    out = tail & ~beyond(l - j)
    shift = 8 * (l - j)
    if shift >= 64:
        out = np.stack((out[0], out[1] | (head[0] >> np.uint64(shift - 64))))
    elif shift:
        out = np.stack((out[0] | (head[0] >> np.uint64(shift)), out[1] | (head[0] << np.uint64(64 - shift)) | (head[1] >> np.uint64(shift))))
    else:
        out = out | head
    return out & ~beyond(l)
