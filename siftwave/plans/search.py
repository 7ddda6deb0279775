"""Searches of small scheme spaces: every candidate is a row of a range, and tasks score them in numpy batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import suffixes as S
from ..operators.grids import Cell, grid_stats
from ..operators.schemes import Scheme, get_scheme, least_keys
from .debruijn import all_words, de_bruijn_text

Window = tuple[int, ...]


def permutation(number: int, n: int) -> list[int]:
    """The number-th order of 0 up to n, by factorial digits."""
    left, out = list(range(n)), []
    for i in range(n - 1, -1, -1):
        at, number = divmod(number, math.factorial(i))
        out.append(left.pop(at))
    return out


def _circle(w: int, k: int, sigma: int) -> np.ndarray:
    """Codes of the k-mers that begin at each letter of the De Bruijn circle that makes densities exact."""
    text = np.array([int(c) for c in de_bruijn_text(sigma, w + k)])
    return sum(np.roll(text, -i) * sigma ** (k - 1 - i) for i in range(k))


def _sampled(ranks: np.ndarray, right: np.ndarray, codes: np.ndarray, w: int) -> int:
    """Distinct places that windows of w of the circle's k-mers sample: the least rank, the last of equal ones where right says so."""
    n = len(codes)
    view = np.stack([np.roll(codes, -j) for j in range(w)])
    keys = ranks[view]
    best = keys.min(0)
    first = keys.argmin(0)
    last = w - 1 - keys[::-1].argmin(0)
    least = view[first, np.arange(n)]
    del best
    return len(np.unique((np.arange(n) + np.where(right[least], last, first)) % n))


def best_order(spark: SparkSession, w: int, k: int, sigma: int, directed: bool = False) -> DataFrame:
    """(n_sampled, n_text, code, direction): an order of all k-mers with the fewest samples on all texts, the least code among equals. directed: each k-mer also takes its leftmost or rightmost place. There are (sigma ** k)! orders."""
    n = sigma**k
    ways = 2**n if directed else 1
    codes = _circle(w, k, sigma)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = []
            for i in b.column(0).to_pylist():
                code, way = divmod(i, ways)
                ranks = np.array(permutation(code, n))
                counts.append(_sampled(ranks, np.array([way >> j & 1 for j in range(n)], bool), codes, w))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["id", "n_sampled"])

    found = spark.range(math.factorial(n) * ways).mapInArrow(score, "id long, n_sampled long")
    best = found.agg(F.min(F.struct("n_sampled", "id")).alias("x"))
    return best.select("x.n_sampled", F.lit(len(codes)).cast("long").alias("n_text"), F.floor(F.col("x.id") / ways).alias("code"), (F.col("x.id") % ways).alias("direction"))


def best_local(spark: SparkSession, w: int, k: int, sigma: int) -> DataFrame:
    """(n_sampled, n_text, code): a map from windows to places, as a number to the base w, with the fewest samples on the circle of 2w + k - 2 letters. There are w ** (sigma ** (w + k - 1)) maps."""
    l = w + k - 1
    text = np.array([int(c) for c in de_bruijn_text(sigma, 2 * w + k - 2)])
    windows = sum(np.roll(text, -i) * sigma ** (l - 1 - i) for i in range(l))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = []
            for i in b.column(0).to_pylist():
                choice = np.array([i // w**j % w for j in range(sigma**l)])
                counts.append(len(np.unique((np.arange(len(text)) + choice[windows]) % len(text))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["id", "n_sampled"])

    best = spark.range(w ** (sigma**l)).mapInArrow(score, "id long, n_sampled long").agg(F.min(F.struct("n_sampled", "id")).alias("x"))
    return best.select("x.n_sampled", F.lit(len(text)).cast("long").alias("n_text"), F.col("x.id").alias("code"))


def order_of_local(choice: dict[Window, int], w: int, k: int) -> list[Window] | None:
    """An order of k-mers under which the least k-mer of each window is that of choice, or None if choices contradict each other. A window's choice comes before its other k-mers, which a topological order respects."""
    after: dict[Window, set[Window]] = {}
    for window, at in choice.items():
        kmers = [window[j : j + k] for j in range(w)]
        for x in kmers:
            after.setdefault(x, set())
        after[kmers[at]] |= {x for x in kmers if x != kmers[at]}
    state: dict[Window, int] = {}
    out: list[Window] = []
    for root in sorted(after):
        work = [(root, iter(sorted(after[root])))] if root not in state else []
        state.setdefault(root, 1)
        while work:
            x, rest = work[-1]
            y = next(rest, None)
            if y is None:
                state[x] = 2
                out.append(x)
                work.pop()
            elif state.get(y) == 1:
                return None
            elif y not in state:
                state[y] = 1
                work.append((y, iter(sorted(after[y]))))
    return out[::-1]


def exact_counts(spark: SparkSession, choose: Callable[[Window], int], sigma: int, w: int) -> DataFrame:
    """(word, samples, minimal): for each circle of w + 1 letters the number of places that windows of w letters sample, and whether it is its least rotation."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            samples, minimal = [], []
            for word in b.column(0).to_pylist():
                s = tuple(map(int, word))
                turns = [s[i:] + s[:i] for i in range(len(s))]
                samples.append(len({(i + choose(t[:w])) % len(s) for i, t in enumerate(turns)}))
                minimal.append(s == min(turns))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(samples, pa.int64()), pa.array(minimal)], ["word", "samples", "minimal"])

    return all_words(spark, sigma, w + 1).select("word").mapInArrow(count, "word string, samples long, minimal boolean")


def exact_total(counts: DataFrame) -> DataFrame:
    """(n_sampled, n_places) of exact_counts(): the density is their ratio."""
    return counts.agg(F.sum("samples").alias("n_sampled"), F.sum(F.length("word").cast("long")).alias("n_places"))


def failing_cycles(counts: DataFrame) -> DataFrame:
    """(word, samples): circles with more than two samples that aren't as many copies of one stretch."""
    even = F.expr("length(word) % samples = 0 AND repeat(substring(word, 1, cast(length(word) div samples as int)), cast(samples as int)) = word")
    return counts.where(F.col("minimal") & (F.col("samples") > 2) & ~even).select("word", "samples")


def suffix_minimal(spark: SparkSession, sigma: int, n: int) -> DataFrame:
    """(word): words of n letters of which no proper suffix comes before them."""
    words = all_words(spark, sigma, n).select("word")
    return words.where(F.expr(f"forall(sequence(2, {n}), i -> substring(word, i) >= word)")) if n > 1 else words


def rank_listing(order: DataFrame) -> DataFrame:
    """(code, rank) of an order: its k-mers with less than the greatest rank, preferred ones first."""
    most = order.agg(F.max("rank").alias("most"))
    return order.join(F.broadcast(most), F.col("rank") < F.col("most")).select("code", "rank").orderBy("rank", "code")


def equivalents(choice: dict[Window, int]) -> list[dict[Window, int]]:
    """The choices that are the same but for swapping the letters 0 and 1, reading from the other side, or both. Places count in letters of the window."""
    swap = lambda c: {tuple(1 - v for v in x): at for x, at in c.items()}
    turn = lambda c: {x[::-1]: len(x) - 1 - at for x, at in c.items()}
    out: list[dict[Window, int]] = []
    for c in (choice, swap(choice), turn(choice), turn(swap(choice))):
        if c not in out:
            out.append(c)
    return out


def window_ratio(samples: DataFrame, pattern: str, k: int, w: int) -> DataFrame:
    """(windows, chosen): windows that have a k-mer that fits the pattern (hex digits, ``.`` for any), and those whose sampled k-mer does. samples carry letters."""
    kmer = f"hex(substring(letters, cast(pos - win + 2 as int), {k}))"
    has = f"exists(sequence(0, {w - 1}), j -> hex(substring(letters, cast(j + 2 as int), {k})) RLIKE '^{pattern}$')"
    return samples.where(has).agg(F.count("*").alias("windows"), F.sum(F.expr(f"cast({kmer} RLIKE '^{pattern}$' as long)")).alias("chosen"))


def winner(found: Row, k: int, sigma: int) -> Scheme:
    """The scheme of a row (code, direction) of best_order()."""
    ranks = permutation(found.code, sigma**k)
    last = [found.direction >> i & 1 for i in range(sigma**k)]
    return get_scheme("Directed", ranks=ranks, last=last)


def seed_cells(seeds: list[int], ws: list[int], k: int) -> list[Cell]:
    """Anchors by the random prefix order of each seed, for each w. All share the prefixes of their letters."""
    shared = S.Shared()
    base = get_scheme("SusRandomLex")

    def of(seed: int) -> Scheme:
        keys = S.random_lex(seed, shared)
        return base._replace(places=lambda letters, w, k: S.least_suffixes(keys(letters, w), w, k, least_keys))

    return [Cell(str(seed), of(seed), w, k) for seed in seeds for w in ws]


def seed_runs(seqs: DataFrame, seeds: list[int], ws: list[int], k: int, sigma: int) -> DataFrame:
    """(seed, w, n, n_windows): for each seed and w, how many places the anchors sample in sequences (seq_id, bytes), which are read once for all, and the windows."""
    stats = grid_stats(seqs, seed_cells(seeds, ws, k), sigma, False)
    of = lambda stat: F.coalesce(F.sum(F.when(F.col("stat") == stat, F.col("n"))), F.lit(0))
    sums = stats.groupBy("cell").agg(of("runs").alias("n"), of("windows").alias("n_windows"))
    known = seqs.sparkSession.createDataFrame([(i * len(ws) + j, seed, w) for i, seed in enumerate(seeds) for j, w in enumerate(ws)], "cell int, seed long, w int")
    return known.join(sums, "cell", "left").na.fill(0, ["n", "n_windows"]).drop("cell")


def compare_seeds(first: DataFrame, second: DataFrame, seeds: list[int], w: int, k: int, sigma: int) -> DataFrame:
    """(seed, n_first, n_second, n_windows): for each seed of the random prefix order, the places its anchors sample in two tables of sequences (seq_id, bytes), each read once. The best is that with the fewest in the first, then the second, then the least seed."""
    one, two = (seed_runs(t, seeds, [w], k, sigma).drop("w") for t in (first, second))
    return one.withColumnRenamed("n", "n_first").join(two.select("seed", F.col("n").alias("n_second")), "seed").select("seed", "n_first", "n_second", "n_windows")


def seed_table(seqs: DataFrame, seeds: list[int], ws: list[int], k: int, sigma: int) -> DataFrame:
    """(w, seed, n, least, extra): places sampled, the least that any scheme could sample of as many windows, and how many more those are."""
    least = F.expr(f"n_windows * ((2 * w + {k} - 1) div w) div (w + {k})")
    runs = seed_runs(seqs, seeds, ws, k, sigma).withColumn("least", least)
    return runs.select("w", "seed", "n", "least", (F.col("n") - F.col("least")).alias("extra"))


def best_seed(counts: DataFrame) -> DataFrame:
    """The row of compare_seeds() that is best."""
    return counts.agg(F.min(F.struct("n_first", "n_second", "seed", "n_windows")).alias("x")).select("x.seed", "x.n_first", "x.n_second", "x.n_windows")
