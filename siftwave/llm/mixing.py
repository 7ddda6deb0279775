"""Mixing sources to target weights with thresholds on a hash of each document, found from histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, table

#: Bits of the hash that each of the three histograms looks at.
LEVEL_BITS = 10
LEVELS = 3


def hash_bucket(*cols: Column) -> Column:
    """The first 30 bits of the MD5 of the columns as text, as a long; nulls count as empty."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.shiftright(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), 32 - LEVEL_BITS * LEVELS)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """(source, source_size, target): sources by code point, null last, weigh ``weights``, repeating, and divide ``share`` of all sizes.

    No target is above ``limit`` times its source's size; what is over goes to the others by weight, again and again. Its end is
    min(limit * size, level * weight) with one level for all, found by filling sources in the order of limit * size / weight. The table
    has one row a source, so the windows over all of it hold the sources' names and sums, never documents.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("ratio", "n").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")).cast("double")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("n", F.row_number().over(every) - 1).withColumn("weight", weight)
    per = per.withColumn("most", F.col("source_size") * F.lit(float(limit))).withColumn("ratio", F.col("most") / F.col("weight"))
    per = per.withColumn("rest", F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(filling), F.lit(0.0)))
    per = per.withColumn("level", F.col("rest") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))))
    # the first source in filling order that its level doesn't fill sets the level of all from there on
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "n", F.col("level").alias("of")))).over(whole)["of"])
    return per.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size, target, whole, below): every document of the source is taken ``whole`` times, and once more where its bucket is under ``below``.

    The budgets of the first, second and later copies are nested; only one of them takes a part of the source. A histogram of sizes by
    source and the first bits of the hash finds the bucket in which that budget ends, and only that bucket is looked at more closely.
    """
    budget = F.col("target") - F.col("whole") * F.col("source_size")
    state = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    state = state.withColumns({"left": budget, "below": F.lit(0).cast("long")})
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        # the documents of each source's boundary bucket; at first, all
        edge = sizes.join(state.select(F.col("source").alias("s"), F.col("below").alias("at")), F.col("source").eqNullSafe(F.col("s")))
        edge = edge.where(F.shiftright("bucket", shift + LEVEL_BITS) == F.shiftright("at", shift + LEVEL_BITS))
        histogram = edge.groupBy("source", F.shiftright("bucket", shift).alias("slot")).agg(F.sum("size").alias("words"))
        upto = histogram.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("slot")))
        upto = upto.join(state.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
        over = upto.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("slot", (F.col("upto") - F.col("words")).alias("before"), "words")).alias("end"))
        state = state.join(over.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        if level < LEVELS - 1:
            # where no bucket goes beyond the budget, the budget is all that is left: below stays past every bucket
            state = state.withColumn("below", F.when(F.col("end").isNull(), F.lit(1 << (LEVEL_BITS * LEVELS))).otherwise(F.shiftleft(F.col("end.slot"), shift)))
            state = state.withColumn("left", F.col("left") - F.coalesce("end.before", F.lit(0)))
        else:
            nearer = (F.col("left") - F.col("end.before")) * 2 > F.col("end.words")
            state = state.withColumn("below", F.when(F.col("end").isNull(), F.col("below")).otherwise(F.col("end.slot") + nearer.cast("long")))
        # a row for each source, kept as a table: the next level doesn't work it out anew
        state = scratch.save(state.drop("end"), f"level-{level}")
    return state.drop("left")


def mix(df: DataFrame, weights: Sequence[float], share: float = 1.5, limit: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each row of df: id, size (words), source_size, target (its source's) and taken (words the mix takes, repeats counted).

    Documents are taken whole, so a source's taken words differ from its target by half its boundary bucket at most, a bucket being
    2^-30 of the hashes. The hash is of id and text: reruns agree, and equal rows are taken alike. Null text: size 0, taken 0. A null
    source is a source of its own. Sources without words have target 0. An empty table gives an empty table. Other columns are not read.
    The texts are read once; histograms and thresholds work on a table of ids, sources, sizes and buckets.
    """
    scratch = Scratch(df.sparkSession, "mix")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = scratch.save(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), hash_bucket(F.col(id_col), F.md5(text)).alias("bucket")), "sizes")
    targets = scratch.save(source_targets(sizes, weights, share, limit), "targets")
    found = thresholds(sizes, targets, scratch).withColumnRenamed("source", "s")
    taken = F.col("size") * (F.col("whole") + F.when(F.col("bucket") < F.col("below"), 1).otherwise(0))
    return sizes.join(found, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


#: Weights, share and limit of the query.
WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2.0


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS, SHARE, LIMIT)


def mix_sql(docs: str) -> str:
    """DuckDB SQL of the query over the relation ``docs``."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT >> 2 AS bucket FROM {docs}),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(n % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS most FROM p),
f AS (SELECT *, most / weight AS ratio,
      (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER x, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER x, 0)) AS level
      FROM w WINDOW x AS (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, first_value(CASE WHEN level <= ratio THEN level END) OVER (ORDER BY level > ratio, ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS one FROM f),
t AS (SELECT source, source_size, least(most, coalesce(one * weight, most)) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
b AS (SELECT source, bucket, sum(size) AS words FROM d GROUP BY ALL),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM b),
e AS (SELECT c.source, arg_min(bucket, bucket) AS at, arg_min(upto - words, bucket) AS before, arg_min(words, bucket) AS words
      FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source WHERE upto > target - whole * source_size GROUP BY c.source),
z AS (SELECT q.*, CASE WHEN e.at IS NULL THEN 1 << 30 ELSE e.at + CASE WHEN (target - whole * source_size - before) * 2 > words THEN 1 ELSE 0 END END AS below
      FROM q LEFT JOIN e ON e.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN bucket < below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source
"""


OP3_SQL = mix_sql("documents")
