"""Words over small alphabets and De Bruijn sequences, on which cyclic sampling gives exact densities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schemes import Scheme, cyclic

DIGITS = "0123456789"


def all_words(spark: SparkSession, sigma: int, n: int) -> DataFrame:
    """(code, word): every word of n letters, written in digits; sigma is 10 at most."""
    digits = F.concat(*[((F.col("id") / F.lit(sigma ** (n - 1 - i))).cast("long") % sigma).cast("string") for i in range(n)])
    return spark.range(sigma**n).select(F.col("id").alias("code"), digits.alias("word"))


def lyndon_words(spark: SparkSession, sigma: int, n: int) -> DataFrame:
    """(word): words of a length that divides n that are less than all their other rotations."""
    out = None
    for d in (d for d in range(1, n + 1) if n % d == 0):
        words = all_words(spark, sigma, d)
        if d > 1:
            words = words.where(F.expr(f"forall(sequence(1, {d - 1}), i -> word < substring(word, i + 1) || substring(word, 1, i))"))
        out = words.select("word") if out is None else out.unionByName(words.select("word"))
    return out


def de_bruijn(spark: SparkSession, sigma: int, n: int) -> DataFrame:
    """(sigma, ord, seq): the least cyclic sequence with every word of n letters once, with its first n - 1 letters once more at its end. It is the Lyndon words in order, put together: one row of sigma ** n letters, as is wanted."""
    row = lyndon_words(spark, sigma, n).agg(F.array_join(F.sort_array(F.collect_list("word")), "").alias("s"))
    return row.select(F.lit(sigma).alias("sigma"), F.lit(n).alias("ord"), F.concat("s", F.substring("s", 1, n - 1)).alias("seq"))


def de_bruijn_text(sigma: int, n: int) -> str:
    """The same sequence without its repeated end, worked out on the driver for sizes a driver can hold."""
    out: list[str] = []
    word = [-1]
    while word:
        word[-1] += 1
        if n % len(word) == 0:
            out += [DIGITS[c] for c in word]
        size = len(word)
        while len(word) < n:
            word.append(word[-size])
        while word and word[-1] == sigma - 1:
            word.pop()
    return "".join(out)


def exact_order(w: int, k: int, forward: bool = True) -> int:
    """Letters on which a scheme's choice of a new sample depends: two windows' of a forward scheme, else all that may have sampled before."""
    return w + k if forward else 2 * w + k - 2


def exact_density_text(sigma: int, w: int, k: int, forward: bool = True) -> str:
    """A linear text whose density is exact: the sequence one order up, as long as its windows take."""
    n = exact_order(w, k, forward) + 1
    text = de_bruijn_text(sigma, n)
    size = sigma**n + k - 1
    return (text * (size // len(text) + 1))[:size]


def letters_to_bytes(df: DataFrame, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """(seq_id, bytes) from words in digits."""
    return df.select(F.col(id_col).alias("seq_id"), F.unhex(F.regexp_replace(seq_col, "(.)", "0$1")).alias("bytes"))


def exact_density(spark: SparkSession, name: str, scheme: Scheme, w: int, k: int, sigma: int, forward: bool = True) -> DataFrame:
    """(scheme, w, k, sigma, n_text, n_sampled): the density over all texts is n_sampled / n_text."""
    n = exact_order(w, k, forward)
    seq = de_bruijn(spark, sigma, n).select(F.lit(0).cast("long").alias("seq_id"), F.substring("seq", 1, sigma**n).alias("seq"))
    found = cyclic(letters_to_bytes(seq), scheme, w, k, sigma)
    return found.agg(F.count("*").alias("n_sampled")).select(F.lit(name).alias("scheme"), *[F.lit(v).alias(c) for c, v in (("w", w), ("k", k), ("sigma", sigma))], F.lit(sigma**n).cast("long").alias("n_text"), "n_sampled")
