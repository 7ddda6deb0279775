"""Keys of all places of an Arrow batch as one number each, so that the least of neighbours is a plain minimum.

Keys come as rows of 64-bit numbers, later ones breaking ties. Only bits that differ count. What doesn't fit in one number beside the place is replaced by its rank, a few letters at a time, each by one sort of
numbers that hold the place too.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_U = np.uint64

#: Rows that are hashed one by one.
FEW = 512


def _bits(x: np.ndarray) -> tuple[np.ndarray, int]:
    """(the bits of x from the first to the last that differ, how many)."""
    differ = int(np.bitwise_or.reduce(x ^ x[0]))
    if not differ:
        return x, 0
    low, high = (differ & -differ).bit_length() - 1, differ.bit_length()
    return (x >> _U(low)) & _U((1 << (high - low)) - 1), high - low


def _ranked(x: np.ndarray, place_bits: int) -> np.ndarray:
    """Ranks from 0, equal ones alike, of numbers that leave place_bits free."""
    n, mask = len(x), _U((1 << place_bits) - 1)
    both = np.sort((x << _U(place_bits)) | np.arange(n, dtype=_U))
    values, at = both >> _U(place_bits), (both & mask).astype(np.int64)
    out = np.zeros(n, _U)
    out[at[1:]] = np.cumsum(values[1:] != values[:-1])
    return out


def one_number(words: np.ndarray, spare: int = 0) -> tuple[np.ndarray, int]:
    """(numbers in the order of the keys, equal ones alike; bits of them). They leave free what a place and ``spare`` bits need."""
    n = words.shape[1] if len(words) else 0
    out, have = np.zeros(n, _U), 0
    if not n:
        return out, have
    place_bits = max(1, (n - 1).bit_length())
    room = 64 - place_bits - spare
    for row in words.astype(_U, copy=False):
        x, left = _bits(row)
        while left:
            if have == room or (have and have + left > room >= place_bits + left):
                out = _ranked(out, place_bits)
                top = int(out.max())
                have = top.bit_length()
                if top == n - 1:  # all differ
                    return out, have
            take = min(left, room - have)
            left -= take
            out = (out << _U(take)) | ((x >> _U(left)) & _U((1 << take) - 1))
            have += take
    return out, have


def dense(words: np.ndarray) -> np.ndarray:
    """Ranks of keys, equal ones alike."""
    x, have = one_number(words)
    return _ranked(x, max(1, (len(x) - 1).bit_length())).astype(np.int64) if len(x) else np.zeros(0, np.int64)


class Minima:
    """The least of any number of neighbouring keys, the first of equals or the last, by a table of the least of 1, 2, 4, ... that grows with what is asked for. rightmost may say it for each key, alike for equal ones."""

    def __init__(self, words: np.ndarray, rightmost: bool | np.ndarray):
        sided = isinstance(rightmost, np.ndarray)
        key, _ = one_number(words, int(sided))
        self.n, self.rightmost = len(key), rightmost
        self.bits = max(1, (self.n - 1).bit_length())
        place = np.arange(self.n, dtype=_U)
        if sided:
            place = np.where(rightmost, _U(max(self.n - 1, 0)) - place, place) | (rightmost.astype(_U) << _U(self.bits))
        elif rightmost:
            place = place[::-1]
        self.levels = [(key << _U(self.bits + sided)) | place]

    def least(self, w: int) -> np.ndarray:
        """The least of each w keys, with its place."""
        if w > self.n:
            return np.zeros(0, _U)
        level = w.bit_length() - 1
        while len(self.levels) <= level:
            step, x = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(x[:-step], x[step:]))
        x, rest = self.levels[level], w - (1 << level)
        return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x

    def of(self, w: int) -> np.ndarray:
        """The place of the least of each w keys."""
        found = self.least(w)
        place = (found & _U((1 << self.bits) - 1)).astype(np.int64)
        if isinstance(self.rightmost, np.ndarray):
            return np.where((found >> _U(self.bits)) & _U(1), self.n - 1 - place, place)
        return self.n - 1 - place if self.rightmost else place


def least_keys(words: np.ndarray, w: int, rightmost: bool | np.ndarray = False) -> np.ndarray:
    """The place of the least of each w consecutive keys, the first of equals or the last; rightmost may say it for each key, alike for equal ones. words: a row of 64-bit numbers for each 8 bytes of the keys."""
    return Minima(words, rightmost).of(w)


_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(4, 4, 4).reshape(64).tolist()
_LEFT, _RIGHT = ([np.array(x, np.uint32) for x in some] for some in (_TURNS, [32 - x for x in _TURNS]))
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_HEX = np.frombuffer("".join(f"{i:02X}" for i in range(256)).encode(), np.uint16)


def md5_of_hex(rows: np.ndarray) -> np.ndarray:
    """The MD5 of the upper-case hex of each row of letters, as two numbers: (2, rows). All rows at once if their hex fits in one block of 64 bytes and they are not few."""
    n, k = rows.shape
    if k > 27 or n < FEW:
        text = rows.tobytes().hex().upper().encode()
        digests = b"".join([hashlib.md5(text[i : i + 2 * k]).digest() for i in range(0, 2 * k * n, 2 * k)])
        return np.frombuffer(digests, ">u8").reshape(-1, 2).T.astype(_U)
    out = np.empty((2, n), _U)
    for lo in range(0, n, 16384):  # as many as stay in the cache
        out[:, lo : lo + 16384] = _md5_block(rows[lo : lo + 16384])
    return out


def _md5_block(rows: np.ndarray) -> np.ndarray:
    n, k = rows.shape
    block = np.zeros((n, 2 * k // 4 * 4 + 4), np.uint8)
    block.view(np.uint16)[:, :k] = np.take(_HEX, rows)
    block[:, 2 * k] = 128
    m = np.ascontiguousarray(block.view("<u4").T)
    begin = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, x, np.uint32) for x in begin)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 32:
            x, y, z, g = (b, c, d, i) if i < 16 else (d, b, c, (5 * i + 1) % 16)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (7 * i) % 16
        np.add(f, a, out=f)
        if g < len(m):
            np.add(f, m[g], out=f)
        # of the rest of the block only the length, in word 14, isn't zero
        np.add(f, np.array((_SINES[i] + (16 * k if g == 14 else 0)) % 2**32, np.uint32), out=f)
        np.right_shift(f, _RIGHT[i], out=t)
        np.left_shift(f, _LEFT[i], out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)  # the old a is not needed again
        a, b, c, d = d, a, b, c
    four = np.stack([x + y for x, y in zip((a, b, c, d), begin, strict=True)], axis=1).astype("<u4")
    return four.view(">u8").T.astype(_U)


def cut(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have up to ``most`` letters together, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi
