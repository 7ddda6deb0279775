"""Orders of k-mers: each gives the text of a key; the least key is preferred.

``coded`` variants keep what a literal evaluation of the usual byte tricks gives; the plain names follow the documented intent.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from ..functions import keys as K
from ..functions.keys import Dialect


class Shape(NamedTuple):
    """Window size in k-mers, k-mer length, alphabet size."""

    w: int
    k: int
    sigma: int


#: (dialect, k-mer, shape) -> text of the key. k-mers of anchors may be shorter than shape.k.
Order = Callable[[Dialect, str, Shape], str]


def unit(d: Dialect, x: str, s: Shape) -> str:
    return "''"


def random(d: Dialect, x: str, s: Shape) -> str:
    return f"md5({x})"


def lex(d: Dialect, x: str, s: Shape) -> str:
    return K.padded(K.part(x, 0, K.PREFIX))


def alternating(d: Dialect, x: str, s: Shape) -> str:
    pieces = [K.part(x, i, 1) if i % 2 == 0 else K.complement(K.part(x, i, 1)) for i in range(min(s.k, K.PREFIX))]
    return K.padded(K.joined(pieces))


def anti_lex(d: Dialect, x: str, s: Shape) -> str:
    return K.padded(K.joined([K.part(x, 0, 1), K.complement(K.part(x, 1, K.PREFIX - 1))]))


def abb(d: Dialect, x: str, s: Shape) -> str:
    """The first byte, then 00 for each byte that isn't zero and 01 for each that is."""
    rest = [f"CASE WHEN {K.part(x, i, 1)} = '' THEN '' WHEN {K.part(x, i, 1)} = '00' THEN '01' ELSE '00' END" for i in range(1, min(s.k, K.PREFIX))]
    return K.padded(K.joined([K.part(x, 0, 1), *rest]))


def abb_coded(d: Dialect, x: str, s: Shape) -> str:
    """The first byte, then 00 for every other."""
    return K.padded(K.joined([K.part(x, 0, 1), f"repeat('00', {d.integer(f'least(length({x}) / 2, {K.PREFIX})')} - 1)"]))


def threshold_abb(limit: int) -> Order:
    """Whether letters are under the limit, the first one inverted, as a binary number."""

    def of(d: Dialect, x: str, s: Shape) -> str:
        first = f"CASE WHEN {K.part(x, 0, 1)} < '{min(limit, 255):02X}' OR {limit} > 255 THEN '0' ELSE '1' END"
        return f"lpad({K.joined([first, *[K.under(x, i, limit) for i in range(1, s.k)]])}, {s.k}, '0')"

    return of


def two_under(limit: int) -> Order:
    """Whether two neighbours are under the limit, the first such bit inverted."""

    def of(d: Dialect, x: str, s: Shape) -> str:
        both = lambda i: f"{K.part(x, i - 1, 1)} < '{limit:02X}' AND {K.part(x, i, 1)} < '{limit:02X}'"
        bits = [f"CASE WHEN {both(i)} THEN '{int(i > 1)}' ELSE '{int(i == 1)}' END" for i in range(1, s.k)]
        return K.joined(bits)

    return of


def pair(*orders: Order) -> Order:
    """The first order, ties by the next."""
    return lambda d, x, s: K.joined([o(d, x, s) for o in orders])


def _strands(d: Dialect, x: str, s: Shape, letters: bool) -> tuple[str, str]:
    if letters:  # complement of letters 0 to 3 is 3 minus the letter
        other = f"translate({K.reverse_bytes(x, s.k)}, '0123', '3210')"
        other = K.joined([f"'0' || substring({d.let(other, lambda v: v, 'o')}, {2 * i + 2}, 1)" for i in range(s.k)])
    else:
        other = K.complement(K.reverse_bytes(x, s.k))
    return anti_lex(d, x, s), d.let(other, lambda v: anti_lex(d, v, s), "r")


def rc_anti_lex(most: bool = False, letters: bool = False) -> Order:
    """The lesser, or greater, of the anti-lexicographic keys of a k-mer of up to 16 bytes and its reverse complement. letters: complements are 3 minus the letter, else bitwise."""

    def of(d: Dialect, x: str, s: Shape) -> str:
        if s.k > K.PREFIX:
            raise ValueError("k is at most 16")
        forward, backward = _strands(d, x, s, letters)
        return f"{'greatest' if most else 'least'}({forward}, {backward})"

    return of


def random_lex(seed: int) -> Order:
    """A random byte for each prefix: k-mers are compared by letters whose random order depends on what stands before them."""

    def of(d: Dialect, x: str, s: Shape) -> str:
        n = min(s.k, K.PREFIX)
        pieces = [f"CASE WHEN length({x}) < {2 * i} THEN '' ELSE substring(md5('{seed}' || {K.part(x, 0, i)}), 1, 2) END" for i in range(1, n + 1)]
        return f"rpad({K.joined(pieces)}, {2 * K.PREFIX}, 'f')"

    return of


def decycling(double: bool = False) -> Order:
    """0 where the sum of letters at roots of unity points just before the negative axis, 1 (double) just before the positive axis, else 2. Angles are rounded to 9 digits."""

    def of(d: Dialect, x: str, s: Shape) -> str:
        turn = 2 * math.pi / s.k
        term = lambda f: " + ".join(f"{K.byte(x, j)} * CAST({f(turn * j)!r} AS DOUBLE)" for j in range(s.k))
        angle = f"round(atan2({term(math.sin)}, {term(math.cos)}), 9)"
        real = lambda v: f"CAST({round(v, 9)!r} AS DOUBLE)"
        second = f"WHEN a >= {real(-turn)} AND a < {real(0.0)} THEN '1'" if double else ""
        return d.let(angle, lambda a: f"CASE WHEN {a} >= {real(math.pi - turn)} AND {a} < {real(math.pi)} THEN '0' {second} ELSE '2' END", "a")

    return of


def frac_min(f: int, coded: bool = False) -> Order:
    """0 for one in f hashes, else 1. coded: the bound is beyond every hash, so always 0."""

    def of(d: Dialect, x: str, s: Shape) -> str:
        return "'0'" if coded else f"CASE WHEN substring(md5({x}), 1, 8) <= '{(1 << 32) // f - 1:08x}' THEN '0' ELSE '1' END"

    return of


class Syncmer(NamedTuple):
    """Open and closed syncmers by the place of the least r-mer in a k-mer."""

    r: int
    open: bool = False
    closed: bool = False
    open_tmer: bool = False
    closed_tmer: bool = False
    other_tmer: bool = False
    offset: int | None = None
    modulo: bool = False
    anti_tmer: bool = False
    miniception_r: bool = False


def open_closed(p: Syncmer, inner: Order = random) -> Order:
    """Class 0 if open and the least r-mer stands at the offset, 1 if closed and it stands at an end, else 2; then the r-mer's key, its inverse, or nothing."""

    def of(d: Dialect, x: str, s: Shape) -> str:
        r = min(p.r, s.k)
        if p.miniception_r:
            r = max(r, s.k - s.w)
        slots = s.k - r + 1
        offset = p.offset if p.offset is not None else ((s.k - r) % s.w if p.modulo else s.k - r) // 2
        if p.modulo:
            offset %= s.w
        small = Shape(slots, r, s.sigma)
        best = [f"{inner(d, K.part(x, i, r), small)} || '{i:03d}'" for i in range(slots)]
        least = best[0] if slots == 1 else f"least({', '.join(best)})"
        digits = "0123456789abcdef"

        def ranked(v: str) -> str:
            key, at = f"substring({v}, 1, 32)", f"substring({v}, 33, 3)"
            by_class = {}
            for i in range(slots):
                if p.open and (i % s.w if p.modulo else i) == offset:
                    by_class[i] = ("0", p.open_tmer)
                elif p.closed and i in (0, slots - 1):
                    by_class[i] = ("1", p.closed_tmer)
                else:
                    by_class[i] = ("2", p.other_tmer)
            other = f"translate(lower({key}), '{digits}', '{digits[::-1]}')" if p.anti_tmer else f"repeat('0', 32)"
            arms: dict[tuple[str, bool], list[int]] = {}
            for i, c in by_class.items():
                arms.setdefault(c, []).append(i)
            cases = [f"WHEN {at} IN ({', '.join(repr(f'{i:03d}') for i in own)}) THEN '{c}' || {f'lower({key})' if tmer else other}" for (c, tmer), own in arms.items()]
            return f"CASE {' '.join(cases)} END"

        return d.let(least, ranked, "m")

    return of


def rotational(d: Dialect, x: str, s: Shape) -> str:
    """0 if no sum of every w-th letter is more than sigma above that from the first letter, else 1. k must be a multiple of w."""
    if s.k % s.w:
        raise ValueError("k must be a multiple of w")
    first = K.strided_sum(x, s.k, 0, s.w)
    fits = [f"{K.strided_sum(x, s.k, j, s.w)} <= {first} + {s.sigma}" for j in range(1, s.w)]
    return f"CASE WHEN {' AND '.join(fits) or 'TRUE'} THEN '0' ELSE '1' END"


def alt_rotational(d: Dialect, x: str, s: Shape) -> str:
    """The sum of every w-th letter from the first."""
    return d.number(K.strided_sum(x, s.k, 0, s.w), 8)


def threshold(t: int, h: int, loose: bool = False, open: bool = False) -> Order:
    """A k-mer whose first h letters reach t * h is preferred by how many h-mers after it stay under that; then larger first letters; then a hash. open: others are ranked by the place of their largest letter."""

    def of(d: Dialect, x: str, s: Shape) -> str:
        e = min(h, s.k)
        total = lambda a, n: "(" + " + ".join(K.byte(x, i) for i in range(a, a + n)) + ")"
        flags = K.joined([f"CASE WHEN {total(i, h)} < {t * h} THEN '1' ELSE '0' END" for i in range(1, s.k - h + 1)])
        run = f"(instr({flags} || '0', '0') - 1)"
        pref = f"CASE WHEN {total(0, e)} >= {t * h} THEN 99 - {run} ELSE 100 END"
        if not loose:
            pref = d.let(pref, lambda v: f"CASE WHEN {v} > {100 - s.k} THEN 100 ELSE {v} END", "q")

        def ranked(pref: str, v: str) -> str:
            return K.joined([d.number(pref, 3), d.number(f"(255 - {v})", 3), f"md5({x})"])

        if not open:
            return ranked(pref, K.byte(x, 0))
        # of equal letters the last is the largest
        place = f"greatest({', '.join(f'{K.part(x, i, 1)} || {chr(39)}{i:03d}{chr(39)}' for i in range(s.k))})" if s.k > 1 else f"{K.part(x, 0, 1)} || '000'"

        def opened(q: str) -> str:
            at = lambda m: f"substring({m}, 3, 3)"
            mid, end = f"{s.k // 2:03d}", f"{s.k - 1:03d}"

            def cases(m: str) -> str:
                rank = f"CASE WHEN {at(m)} = '{mid}' THEN 200 WHEN {at(m)} IN ('000', '{end}') THEN 300 ELSE 400 END"
                letter = f"CASE WHEN {at(m)} = '{mid}' THEN {K.byte(x, s.k // 2)} WHEN {at(m)} = '{end}' THEN {K.byte(x, s.k - 1)} ELSE {K.byte(x, 0)} END"
                return ranked(rank, letter)

            return f"CASE WHEN {q} >= 100 THEN {d.let(place, cases, 'm')} ELSE {ranked(q, K.byte(x, 0))} END"

        return d.let(pref, opened, "p")

    return of


def explicit(ranks: tuple[int, ...]) -> Order:
    """The rank that a table has for the k-mer's number to the base sigma."""

    def of(d: Dialect, x: str, s: Shape) -> str:
        if len(ranks) != s.sigma**s.k:
            raise ValueError("a rank for each k-mer is needed")
        listed = ", ".join(map(str, ranks))
        table = f"array({listed})" if d.name == "spark" else f"[{listed}]"
        at = K.pack(x, s.k, s.sigma) if d.name == "spark" else f"({K.pack(x, s.k, s.sigma)} + 1)"
        return d.number(f"{table}[{d.integer(at)}]", 8)

    return of


def explicit_directed(ranks: tuple[int, ...], last: tuple[int, ...]) -> Order:
    """The rank that a table has for the k-mer's number, and which of equal k-mers is preferred: 0 the first, 1 the last. Of k-mers with one rank, those whose first is preferred come first."""
    rank = explicit(ranks)

    def of(d: Dialect, x: str, s: Shape) -> str:
        listed = ", ".join(f"'{int(bool(v))}'" for v in last)
        table = f"array({listed})" if d.name == "spark" else f"[{listed}]"
        at = K.pack(x, s.k, s.sigma) if d.name == "spark" else f"({K.pack(x, s.k, s.sigma)} + 1)"
        return K.joined([rank(d, x, s), f"{table}[{d.integer(at)}]"])

    return of


def greedy(ranks: tuple[int, ...]) -> Order:
    """The rank, modulo 2^16, that a table has for the number that the lowest bits of the letters make; ties by their next two bits, as numbers to the base 4."""

    def of(d: Dialect, x: str, s: Shape) -> str:
        if len(ranks) != 2**s.k:
            raise ValueError("a rank for each word of lowest bits is needed")
        listed = ", ".join(str(r % 65536) for r in ranks)
        low = d.integer(K.low_bits(x, s.k))
        rank = f"array({listed})[{low}]" if d.name == "spark" else f"[{listed}][{low} + 1]"
        # twice the number that the next bits make, so that nothing is divided
        rest = " + ".join(f"CAST({K.byte(x, i)} % 8 - {K.byte(x, i)} % 2 AS BIGINT) * {4 ** (s.k - 1 - i)}" for i in range(s.k))
        return d.number(f"(CAST({rank} AS BIGINT) * {2 * 4**s.k} + {rest})", 18)

    return of


#: A pattern's first sign, and where it is looked for, in this order; without a sign, at the end and then at the start.
ENDS_OF = {"_": ("start", "end"), "<": ("start",), ">": ("end",)}


def templates(patterns: tuple[str, ...]) -> Order:
    """Patterns of digits, with a sign from ENDS_OF before them or none. The first that a k-mer begins or ends with decides, the first place looked at before
    the second; then how far its next copy is: at the start 100 less the places between, at the end the place of the last copy that stops two letters before
    it, counted from 1; without a copy 1000. k-mers without a pattern come last."""

    def of(d: Dialect, x: str, s: Shape) -> str:
        cases = []
        for i, p in enumerate(patterns):
            sides = ENDS_OF.get(p[0], ("end", "start"))
            digits = p[1:] if p[0] in ENDS_OF else p
            word, m = "".join(f"0{c}" for c in digits), len(digits)
            here = lambda at, word=word, m=m: f"{K.part(x, at, m)} = '{word}'"
            for rank, side in enumerate(sides):
                if m > s.k:
                    continue
                copies = [(1 + j, 100 - j) for j in range(s.k - m)] if side == "start" else [(j, j + 1) for j in reversed(range(s.k - 2 - m + 1))]
                far = " ".join(f"WHEN {here(at)} THEN '{n:04d}'" for at, n in copies)
                cases.append(f"WHEN {here(0 if side == 'start' else s.k - m)} THEN '{i:04d}{rank}' || {f'CASE {far} ELSE {chr(39)}1000{chr(39)} END' if far else repr('1000')}")
        return f"CASE {' '.join(cases)} ELSE '100000000' END"

    return of
