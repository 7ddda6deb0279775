"""Lower bounds of densities, as columns where doubles do and as exact fractions where they don't."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .debruijn import lyndon_words


def next_k(w: int, k: int) -> int:
    """The least length from k on that is 1 more than a multiple of w; bounds never rise with k, so that of the longer length holds too."""
    return -(-(k - 1) // w) * w + 1


def divisors(n: int) -> list[int]:
    return [d for d in range(1, n + 1) if n % d == 0]


def moebius(n: int) -> int:
    """0 if a square divides n, else whether its number of primes is even (1) or odd (-1)."""
    sign, p = 1, 2
    while n > 1:
        if n % p == 0:
            n //= p
            sign = -sign
            if n % p == 0:
                return 0
        p += 1
    return sign


def aperiodic_necklaces(n: int, sigma: int) -> int:
    """Circles of n letters that no rotation but the full one leaves as they are; Lyndon words count the same."""
    return sum(moebius(d) * sigma ** (n // d) for d in divisors(n)) // n


def cycle_bound(w: int, k: int, sigma: int) -> Fraction:
    """Every circle of p letters needs p / w samples, rounded up: the mean over circles whose length divides w + k."""
    n = w + k
    return Fraction(sum(aperiodic_necklaces(p, sigma) * -(-p // w) for p in divisors(n)), sigma**n)


def forward_bound(w: int, k: int, sigma: int) -> Fraction:
    """The cycle bound, or that of the next length that is 1 more than a multiple of w."""
    return max(cycle_bound(w, k, sigma), cycle_bound(w, next_k(w, k), sigma))


def simple(w: Column, k: Column) -> Column:
    """A circle of w + k letters needs (w + k) / w samples, rounded up."""
    return F.ceil((w + k) / w) / (w + k)


def add_bounds(df: DataFrame) -> DataFrame:
    """Adds to (w, k, sigma): trivial, expected (a random order's), sampled_kmers, older, older_improved, lower, lower_next and lower_smooth."""
    w, k = F.col("w"), F.col("k")
    longer = F.ceil((k - 1) / w) * w + 1
    return df.withColumns({
        "trivial": 1 / w,
        "expected": 2 / (w + 1),
        "sampled_kmers": F.pow(F.col("sigma").cast("double"), -k),
        "older": (1.5 + F.greatest(F.floor((k - w) / w), F.lit(0)) + 1 / (2 * w)) / (w + k),
        "older_improved": 1.5 / (w + k - 0.5),
        "lower": simple(w, k),
        "lower_next": F.greatest(simple(w, k), simple(w, longer)),
        "lower_smooth": (w + k + (w - 1)) / w / (w + k),
    })


def exact_bounds(spark: SparkSession, grid: list[tuple[int, int, int]]) -> DataFrame:
    """(w, k, sigma, num, den) of forward_bound(), whose integers the driver works out."""
    rows = [(w, k, s, b.numerator, b.denominator) for w, k, s in grid for b in [forward_bound(w, k, s)]]
    return spark.createDataFrame(rows, "w int, k int, sigma int, num long, den long")


def counted_bound(spark: SparkSession, w: int, k: int, sigma: int) -> DataFrame:
    """(num, den) of cycle_bound(), by counting Lyndon words instead of inverting sums; not in lowest terms."""
    needed = F.ceil(F.length("word") / F.lit(w)).cast("long")
    return lyndon_words(spark, sigma, w + k).agg(F.sum(needed).alias("num")).select("num", F.lit(sigma ** (w + k)).cast("long").alias("den"))


def against_optima(bounds: DataFrame, optima: DataFrame) -> DataFrame:
    """(w, k, sigma, tight): whether a known optimum (w, k, sigma, num, den) equals its bound. Fractions are compared by cross-multiplying."""
    b = bounds.select("w", "k", "sigma", F.col("num").alias("b_num"), F.col("den").alias("b_den"))
    return optima.join(b, ["w", "k", "sigma"]).select("w", "k", "sigma", (F.col("num") * F.col("b_den") == F.col("b_num") * F.col("den")).alias("tight"))


def distances(df: DataFrame) -> DataFrame:
    """Adds to (w, k, sigma, num, den) with a density: factor, its multiple of 1 / (w + 1), and how far it is above the bound num / den and above the simple one of the next length."""
    w, k = F.col("w"), F.col("k")
    longer = F.ceil((k - 1) / w) * w + 1
    return df.withColumns({
        "factor": F.col("density") * (w + 1),
        "above_bound": F.col("density") - F.col("num") / F.col("den"),
        "above_simple": F.col("density") - F.greatest(simple(w, k), simple(w, longer)),
    })
