"""SQL text for keys of k-mers.

A k-mer is the upper-case hex of its bytes, so comparing strings compares bytes. Every key is a string of fixed width: joining
keys gives the order of tuples, and the least string is the preferred k-mer. The text holds in Spark SQL as in DuckDB, but for
let(), lists and conversions, which a Dialect writes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

DIGITS = "0123456789ABCDEF"

#: Bytes of a k-mer that byte-wise keys look at.
PREFIX = 16


class Dialect(NamedTuple):
    """What Spark SQL and DuckDB write differently."""

    name: str
    text: str

    def let(self, value: str, body: Callable[[str], str], name: str = "v") -> str:
        """body of a name for value, which is worked out once."""
        if self.name == "spark":
            return f"transform(array({value}), {name} -> {body(name)})[0]"
        return f"list_transform([{value}], lambda {name}: {body(name)})[1]"

    def string(self, value: str) -> str:
        return f"CAST({value} AS {self.text})"

    def integer(self, value: str) -> str:
        return f"CAST({value} AS INT)"

    def number(self, value: str, width: int) -> str:
        """A whole number from 0 as a string of a fixed width."""
        return f"lpad({self.string(value)}, {width}, '0')"


SPARK = Dialect("spark", "STRING")
DUCKDB = Dialect("duckdb", "VARCHAR")


def byte(x: str, i: int) -> str:
    """The number of byte i, counted from 0."""
    digit = lambda at: f"(instr('{DIGITS}', substring({x}, {at}, 1)) - 1)"
    return f"({digit(2 * i + 1)} * 16 + {digit(2 * i + 2)})"


def part(x: str, start: int, count: int) -> str:
    """Bytes start up to start + count."""
    return f"substring({x}, {2 * start + 1}, {2 * count})"


def complement(x: str) -> str:
    """Each byte's bitwise complement."""
    return f"translate({x}, '{DIGITS}', '{DIGITS[::-1]}')"


def padded(x: str) -> str:
    return f"rpad({x}, {2 * PREFIX}, 'F')"


def joined(pieces: Sequence[str]) -> str:
    return "(" + " || ".join(pieces) + ")" if pieces else "''"


def reverse_bytes(x: str, k: int) -> str:
    return joined([part(x, i, 1) for i in reversed(range(k))])


def under(x: str, i: int, limit: int) -> str:
    """'1' where byte i is less than limit, '0' where it isn't, '' beyond the end."""
    return f"CASE WHEN length({x}) < {2 * i + 2} THEN '' WHEN {part(x, i, 1)} < '{min(limit, 255):02X}' OR {limit} > 255 THEN '1' ELSE '0' END"


def pack(x: str, k: int, base: int) -> str:
    """The k-mer as a number to the base."""
    return "(" + " + ".join(f"CAST({byte(x, i)} AS BIGINT) * {base ** (k - 1 - i)}" for i in range(k)) + ")"


def low_bits(x: str, k: int) -> str:
    """The number that the lowest bits of the bytes make."""
    return "(" + " + ".join(f"CAST({byte(x, i)} % 2 AS BIGINT) * {2 ** (k - 1 - i)}" for i in range(k)) + ")"


def strided_sum(x: str, k: int, start: int, step: int) -> str:
    """The sum of every step-th byte from start."""
    return "(" + (" + ".join(byte(x, i) for i in range(start, k, step)) or "0") + ")"


def recode(x: str, sigma: int) -> str:
    """Bytes to letters 0 up to sigma, by their lowest bits; 256 leaves them. The text to replace with is written for Spark, see recode_duckdb()."""
    if sigma == 256:
        return x
    low = DIGITS[:sigma] * (16 // sigma)
    return f"translate(regexp_replace({x}, '.(.)', '0$1'), '{DIGITS[sigma:]}', '{low[sigma:]}')"


def recode_duckdb(x: str, sigma: int) -> str:
    if sigma == 256:
        return x
    low = DIGITS[:sigma] * (16 // sigma)
    return f"translate(regexp_replace({x}, '.(.)', '0\\1', 'g'), '{DIGITS[sigma:]}', '{low[sigma:]}')"
