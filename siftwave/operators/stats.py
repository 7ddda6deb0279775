"""Statistics of samples (seq_id, win, pos, prev), as aggregations that combine before they shuffle."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .schemes import Scheme, cyclic
from .suffixes import circle_ranks

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def changed() -> Column:
    """The position before the first counts as 0, so a first sample at 0 is no change."""
    return F.expr("pos <> coalesce(prev, 0)")


def density(samples: DataFrame, *by: str) -> DataFrame:
    """n_windows, n_changes and pos_sum (a checksum); density is n_changes / n_windows."""
    return samples.groupBy(*by).agg(F.count("*").alias("n_windows"), F.sum(changed().cast("long")).alias("n_changes"), F.sum("pos").alias("pos_sum"))


def distinct_positions(samples: DataFrame) -> DataFrame:
    """(seq_id, n_sampled): sampled positions, each once. For schemes that go back, it is less than the changes."""
    return samples.select("seq_id", "pos").distinct().groupBy("seq_id").agg(F.count("*").alias("n_sampled"))


def positions(samples: DataFrame) -> DataFrame:
    """(place, n): how often each place in the window is sampled."""
    return samples.groupBy((F.col("pos") - F.col("win")).alias("place")).agg(F.count("*").alias("n"))


def distances(samples: DataFrame) -> DataFrame:
    """(jump, n): how far each change goes."""
    return samples.where(changed()).groupBy((F.col("pos") - F.coalesce("prev", F.lit(0))).alias("jump")).agg(F.count("*").alias("n"))


def transfer(samples: DataFrame) -> DataFrame:
    """(place_from, place_to, n): places of neighbouring windows. The first window has none before it."""
    return samples.where("prev IS NOT NULL").groupBy((F.col("prev") - F.col("win") + 1).alias("place_from"), (F.col("pos") - F.col("win")).alias("place_to")).agg(F.count("*").alias("n"))


def transfer_power(matrix: DataFrame, doublings: int = 3) -> DataFrame:
    """(place_from, place_to, p): the matrix with rows that sum to 1, to the power 2 ** doublings, by joins with itself. It has w rows and columns at most."""
    total = F.sum("n").over(Window.partitionBy("place_from"))
    m = matrix.select("place_from", "place_to", (F.col("n") / total).alias("p"))
    for _ in range(doublings):
        right = m.select(F.col("place_from").alias("place_mid"), F.col("place_to").alias("end"), F.col("p").alias("q"))
        m = m.withColumnRenamed("place_to", "place_mid").join(right, "place_mid").groupBy("place_from", F.col("end").alias("place_to")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
    return m


def sampled_kmers(samples: DataFrame, k: int) -> DataFrame:
    """(kmer, n): changes by the number that the lowest bits of the k-mer there make. samples carry letters."""
    kmer = F.expr(f"hex(substring(letters, cast(pos - win + 2 as int), {k}))")
    return samples.where(changed()).select(kmer.alias("x")).groupBy(F.expr(K.low_bits("x", k)).alias("kmer")).agg(F.count("*").alias("n"))


def kmer_places(samples: DataFrame, k: int) -> DataFrame:
    """(kmer, place, n): windows by sampled k-mer, as in sampled_kmers(), and place."""
    kmer = F.expr(f"hex(substring(letters, cast(pos - win + 2 as int), {k}))")
    named = samples.select(kmer.alias("x"), (F.col("pos") - F.col("win")).alias("place"))
    return named.groupBy(F.expr(K.low_bits("x", k)).alias("kmer"), "place").agg(F.count("*").alias("n"))


def kmer_jumps(samples: DataFrame, k: int) -> DataFrame:
    """(kmer, jump, n_to, n_from): changes forward by the k-mer they go to and by the one they leave."""
    at = lambda c: F.expr(K.low_bits(f"hex(substring(letters, cast({c} - win + 2 as int), {k}))", k))
    ahead = samples.where("prev IS NOT NULL AND pos > prev").select((F.col("pos") - F.col("prev")).alias("jump"), F.explode(F.array(F.struct(at("pos").alias("kmer"), F.lit(1).alias("to")), F.struct(at("prev").alias("kmer"), F.lit(0).alias("to")))).alias("x"))
    return ahead.groupBy("x.kmer", "jump").agg(F.sum("x.to").alias("n_to"), F.sum(1 - F.col("x.to")).alias("n_from"))


def mean_jumps(jumps: DataFrame) -> DataFrame:
    """(kmer, n, jump_sum) of kmer_jumps(): means are jump_sum / n; the farthest first."""
    means = jumps.groupBy("kmer").agg(F.sum("n_to").alias("n"), F.sum(F.col("jump") * F.col("n_to")).alias("jump_sum")).where("n > 0")
    return means.orderBy(F.desc(F.col("jump_sum") / F.col("n")), "kmer")


def out_of_range(samples: DataFrame, w: int) -> DataFrame:
    """Windows whose sample isn't one of their w places; a right scheme has none."""
    return samples.where(~F.col("pos").between(F.col("win"), F.col("win") + (w - 1)))


def is_forward(samples: DataFrame) -> DataFrame:
    """(seq_id, forward): whether no window samples a place before that of the window before it."""
    return samples.groupBy("seq_id").agg(F.coalesce(F.bool_and(F.col("pos") >= F.col("prev")), F.lit(True)).alias("forward"))


def scheme_report(samples: DataFrame) -> DataFrame:
    """One row: n_windows, n_changes, pos_sum and forward."""
    back = F.coalesce(F.col("pos") >= F.col("prev"), F.lit(True))
    return samples.agg(F.count("*").alias("n_windows"), F.sum(changed().cast("long")).alias("n_changes"), F.sum("pos").alias("pos_sum"), F.bool_and(back).alias("forward"))


def cycles(seqs: DataFrame, l: int) -> DataFrame:
    """(seq_id, bytes) for each whole chunk of l letters; seq_id is (sequence, chunk)."""
    rows = seqs.withColumn("n", F.length("bytes")).where(F.col("n") >= l)
    rows = rows.select("seq_id", "bytes", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / l).cast("int") - 1)).alias("c"))
    return rows.select(F.struct("seq_id", "c").alias("seq_id"), F.substring("bytes", F.col("c") * l + 1, F.lit(l)).alias("bytes"))


def cycle_samples(seqs: DataFrame, l: int, scheme: Scheme, w: int, k: int, sigma: int = 256) -> DataFrame:
    """(cycle, samples): the sorted positions that each chunk of l letters, taken as a circle, has sampled."""
    found = cyclic(cycles(seqs, l), scheme, w, k, sigma)
    return found.groupBy(F.col("seq_id").alias("cycle")).agg(F.sort_array(F.collect_list("pos")).alias("samples"))


def cycle_stats(samples: DataFrame) -> DataFrame:
    """(samples, n): circles by their number of samples."""
    return samples.groupBy(F.size("samples").alias("samples")).agg(F.count("*").alias("n"))


def _turned(l: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (circle, samples) to (word, samples): the least rotation in hex, and the samples as text, counted from where it begins."""
        for b in batches:
            rows = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(len(b), l)
            turn = np.argmin(circle_ranks(rows), axis=1) if len(b) else np.zeros(0, np.int64)
            words = np.take_along_axis(rows, (np.arange(l) + turn[:, None]) % l, axis=1)
            samples = [",".join(map(str, sorted((x - t) % l for x in xs))) for xs, t in zip(b.column(1).to_pylist(), turn.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes().hex().upper() for w in words], pa.string()), pa.array(samples, pa.string())], ["word", "samples"])

    return of


def bad_cycles(seqs: DataFrame, l: int, scheme: Scheme, w: int, k: int, sigma: int = 256) -> DataFrame:
    """(word, samples): distinct circles with more than l / w samples, rounded up, each turned to its least rotation, in order. A circle's letters go along with its samples; rotations are ranked by doubling, many circles at a time."""
    circles = cycles(seqs, l).withColumn("circle", F.col("bytes"))
    found = cyclic(circles, scheme, w, k, sigma, ("circle",)).groupBy("seq_id").agg(F.first("circle").alias("circle"), F.collect_list("pos").alias("samples"))
    many = found.where(F.size("samples") > -(-l // w)).select("circle", "samples")
    return many.mapInArrow(_turned(l), "word string, samples string").groupBy("word").agg(F.min("samples").alias("samples")).orderBy("word")


def rolling_min(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Adds least_so_far: the least value up to each row of its group, 1 at most."""
    so_far = F.min(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("least_so_far", F.least(F.lit(1.0), so_far))


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """(seq_id, first, past): unions of intervals (seq_id, first, past) that overlap or touch."""
    before = Window.partitionBy("seq_id").orderBy("first", "past").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("seq_id").orderBy("first", "past")
    marked = intervals.withColumn("new", F.coalesce(F.col("first") > F.max("past").over(before), F.lit(True)).cast("int"))
    return marked.withColumn("island", F.sum("new").over(upto)).groupBy("seq_id", "island").agg(F.min("first").alias("first"), F.max("past").alias("past")).drop("island")


def covered(samples: DataFrame, k: int) -> DataFrame:
    """The stretches of letters in sampled k-mers. Changes alone are looked at, as the windows between sample nothing new."""
    changes = samples.where("prev IS NULL OR pos <> prev").select("seq_id", F.col("pos").alias("first"), (F.col("pos") + k).alias("past"))
    return merge_intervals(changes.distinct())


def contexts(samples: DataFrame) -> DataFrame:
    """(context): distinct pairs of neighbouring windows' letters of which the second samples another place than the first. samples carry letters."""
    return samples.where("prev IS NOT NULL AND pos <> prev").select(F.hex("letters").alias("context")).distinct()


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Contexts of left that right doesn't have."""
    return left.join(right, "context", "left_anti")


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(context, side): contexts that only one of the two has, side being left or right. One shuffle of both."""
    both = left.select("context", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("context", F.lit(0).alias("l"), F.lit(1).alias("r")))
    found = both.groupBy("context").agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l <> r")
    return found.select("context", F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many letters two columns of bytes begin with alike; null if one is null."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    either = a.isNull() | b.isNull()
    return F.when(~either, F.when(n > 0, F.coalesce(F.array_min(differ) - 1, n)).otherwise(F.lit(0)))
