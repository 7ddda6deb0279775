"""Importance resampling: documents whose n-grams are as frequent as a target's are drawn more often.

N-grams of words are hashed into buckets. In a task the words of many texts are numbered, and their suffixes are sorted by as many words as the longest n-gram
has. Where neighbours in that order share n words or more, they are one n-gram: each such run is hashed once, and its bucket goes back to all its places.
Counts of buckets in the source and in the target give each bucket a gain, and the mean gain of a document's n-grams is its weight. Gumbel noise from a
hash of the id turns weights into scores whose highest are a draw without replacement.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .tokens import Words

#: Bytes of text looked at together; longer texts are cut between words.
CHUNK = 1 << 21

#: Scores in a slot of the first histogram.
SLOT = 256

#: What stands between words, in UTF-8, and a run of words.
BETWEEN = rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
INSIDE = rb"[0-9A-Za-z\x80-\xFF]"
_GAP = re.compile(BETWEEN)
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def suffix_order(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): places sorted by the depth numbers from there on, and how many of them each has in common with the place before it in that order. 0 ends a text: nothing behind it counts, and it is like no other."""
    n, have = len(ids), 1
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    while have < depth:
        behind = np.zeros(n, np.int64)
        behind[: n - have] = rank[have:] + 1
        behind[ids == 0] = 0
        rank, have = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64), 2 * have
    order = np.argsort(rank, kind="stable")
    common, alike = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    padded = np.concatenate((ids, np.zeros(depth, ids.dtype)))
    for d in range(depth):
        a, b = padded[order[:-1] + d], padded[order[1:] + d]
        alike &= (a == b) & (a != 0)
        common[1:] += alike
    return order, common


def word_numbers(w: Words) -> np.ndarray:
    """A number from 1 for each word, the same for the same bytes."""
    first, second = w.hashes(0), w.hashes(1)
    _, at, number = np.unique(first, return_index=True, return_inverse=True)
    if (second != second[at][number]).any():  # two words with one hash
        number = np.unique(np.stack((first, second)), axis=1, return_inverse=True)[1].reshape(-1)
    return number.astype(np.int64) + 1


def _parts(column: pa.Array, n: int) -> Iterator[tuple[int, bytes, int]]:
    """(row, bytes, own): texts, long ones in parts. N-grams that begin in the first ``own`` bytes are the part's; behind them are the n - 1 words that they may need."""
    more = re.compile(b"(?:" + BETWEEN + b"*+" + INSIDE + b"++){0,%d}" % (n - 1))
    for row, value in enumerate(column):
        data = bytes(value.as_buffer()) if value.is_valid else b""
        lo = 0
        while len(data) - lo > CHUNK:
            m = _GAP.search(data, lo + CHUNK)
            if not m:
                break
            yield row, data[lo : more.match(data, m.start()).end()], m.start() - lo
            lo = m.start()
        yield row, data[lo:], len(data) - lo


def _groups(column: pa.Array, n: int) -> Iterator[list[tuple[int, bytes, int]]]:
    group, size = [], 0
    for part in _parts(column, n):
        group.append(part)
        size += len(part[1]) + 1
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def features(group: list[tuple[int, bytes, int]], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, bucket, words): for each n-gram of 1 to n words its part in the group and its bucket, and the number of words of each part."""
    data = _FOLD[np.frombuffer(b"\x00".join([x for _, x, _ in group]) + b"\x00", np.uint8)]
    inside = _INSIDE[data]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    begin = np.cumsum([0] + [len(x) + 1 for _, x, _ in group])
    part = np.searchsorted(begin, starts, "right") - 1
    own = starts - begin[part] < np.array([o for _, _, o in group])[part]
    many = np.bincount(part[own], minlength=len(group))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), many
    # a 0 behind each part's words
    place = np.arange(len(starts)) + part
    ids = np.zeros(len(starts) + len(group), np.int64)
    ids[place] = word_numbers(Words(data, starts, ends, begin, range(0)))
    word = np.cumsum(ids > 0) - 1  # of a place, its word
    left = np.searchsorted(part, part, "right") - np.arange(len(starts))  # words from here to the part's end
    order, common = suffix_order(ids, n)
    parts, found = [], []
    for size in range(1, n + 1):
        whole = np.zeros(len(ids), bool)
        whole[place] = left >= size
        keep = whole[order]
        at, first = order[keep], common[keep] < size
        leaders = word[at[first]]
        texts = (data[s:e].tobytes() for s, e in zip(starts[leaders], ends[leaders + size - 1], strict=True))
        joined = texts if size == 1 else (b" ".join(re.findall(INSIDE + b"+", x)) for x in texts)
        hashed = np.fromiter((crc32(x) for x in joined), np.int64, len(leaders)) % buckets
        which = word[at]
        bucket = hashed[np.cumsum(first) - 1]
        mine = own[which]
        parts.append(part[which[mine]])
        found.append(bucket[mine])
    return np.concatenate(parts), np.concatenate(found), many


def _counted(n: int, buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (text) to one of (bucket, c): how many n-grams of the task each bucket has."""
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for group in _groups(b.column(0), n):
                total += np.bincount(features(group, n, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "c"])

    return of


def bucket_counts(df: DataFrame, text_col: str, n: int, buckets: int) -> DataFrame:
    """(bucket, c) over all texts; buckets without an n-gram have no row."""
    return df.select(F.col(text_col).alias("text")).mapInArrow(_counted(n, buckets), "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int, spark: SparkSession) -> DataFrame:
    """(bucket, gain) for each bucket, from (bucket, c) of source and target: a thousand times the logarithm of how much more frequent it is in the target, each count plus one, floored."""
    d = lambda c: c.cast("double")
    s, t = source.select("bucket", F.col("c").alias("s")), target.select("bucket", F.col("c").alias("t"))
    both = spark.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("s_all"), F.sum("t").alias("t_all"))
    ratio = d(F.col("t") + 1) * d(F.col("s_all") + buckets) / (d(F.col("s") + 1) * d(F.col("t_all") + buckets))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def _weighed(n: int, gains: np.ndarray):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (doc_id, text) to those of (doc_id, n_words, n_features, gains)."""
        for b in batches:
            words, many, sums = (np.zeros(len(b), np.int64) for _ in range(3))
            for group in _groups(b.column(1), n):
                part, bucket, own = features(group, n, len(gains))
                rows = np.array([r for r, _, _ in group])
                np.add.at(words, rows, own)
                np.add.at(many, rows, np.bincount(part, minlength=len(group)))
                order = np.argsort(part, kind="stable")
                upto = np.concatenate(([0], np.cumsum(gains[bucket[order]])))  # whole numbers, so sums are exact
                edge = np.searchsorted(part[order], np.arange(len(group) + 1))
                np.add.at(sums, rows, upto[edge[1:]] - upto[edge[:-1]])
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, many, sums))], ["doc_id", "n_words", "n_features", "gains"])

    return of


def ranked(scored: DataFrame, scratch: Scratch) -> DataFrame:
    """(all of scored, rank): 1, 2, 3, ... by falling score and rising doc_id. Sorted by range, each partition's rows are numbered, and the partitions' counts (a row each) say where each begins."""
    rows = scored.orderBy(F.desc("score"), "doc_id").withColumn("place", F.monotonically_increasing_id())
    rows = scratch.save(rows.withColumns({"part": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)}), "ranked")
    counts = rows.groupBy("part").agg(F.count("*").alias("c")).collect()  # as many as shuffle partitions
    before, first = [], 0
    for r in sorted(counts):
        before.append((r.part, first))
        first += r.c
    begin = rows.sparkSession.createDataFrame(before, "part long, begin long")
    return rows.join(F.broadcast(begin), "part").withColumn("rank", F.col("place") + F.col("begin") + 1).drop("part", "place", "begin")


def threshold(scores: DataFrame, draw: int) -> int | None:
    """The greatest score that draw rows of scores reach; None if there are fewer rows or draw is 0. Two histograms: of slots of SLOT scores, then of the scores of one. As scores are logarithms times a thousand, slots are some hundreds."""
    if draw <= 0:
        return None
    slot = F.floor(F.col("score") / SLOT)
    left = draw
    for r in sorted(scores.groupBy(slot.alias("slot")).agg(F.count("*").alias("c")).collect(), reverse=True):
        if r.c >= left:
            break
        left -= r.c
    else:
        return None
    for x in sorted(scores.where(slot == r.slot).groupBy("score").agg(F.count("*").alias("c")).collect(), reverse=True):
        left -= x.c
        if left <= 0:
            return x.score
    return None


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """A row for each row of docs: doc_id, n_features (n-grams of 1 to n words), weight, score and rank (null if not drawn).

    Of the N rows with least_words words or more, percent in a hundred are drawn, rounded down: those with the highest scores, ties to the smaller id. Equal ids
    and scores are ranked one after the other. A null id is hashed as the empty text and ranks before all ids; null text has no words, as the empty one. Without
    n-grams a text's weight is 0. Other columns aren't read. Empty tables give an empty table, and a target without words gives gains by
    the source alone. Texts are read twice, once for the counts; what a task holds is a group of texts of some megabytes, and long texts are cut between words.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "resample")
    # as tables, as both are used twice
    source, wanted = (scratch.save(bucket_counts(df, c, n, buckets), name) for df, c, name in ((docs, text_col, "source"), (target, target_text_col, "target")))
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(source, wanted, buckets, spark).collect():  # as many as buckets, a parameter
        gains[r.bucket] = r.gain
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_weighed(n, gains), f"doc_id {kind}, n_words long, n_features long, gains long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)
    # whole numbers: their quotient rounds towards 0, so one less where it is below and there is a rest
    rest = F.when((F.col("gains") < 0) & (F.col("gains") % F.col("n_features") != 0), 1).otherwise(0)
    weight = F.when(F.col("n_features") > 0, F.expr("gains div n_features") - rest).otherwise(F.lit(0)).cast("long")
    scored = scratch.save(rows.withColumn("weight", weight).withColumn("score", (F.col("weight") + noise).cast("long")).drop("gains"), "scored")
    fit = F.col("n_words") >= least_words
    draw = scored.where(fit).count() * percent // 100
    least = threshold(scored.where(fit), draw)
    out = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = ranked(scored.where(fit & (F.col("score") >= least)).select(*out), scratch)
    others = scored.where(~fit | (F.col("score") < least)).select(*out, F.lit(None).cast("long").alias("rank"))
    return drawn.select(*out, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank")).unionByName(others)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
ds AS (SELECT word, count(*) AS s FROM dw GROUP BY word),
bs AS (SELECT word, count(*) AS t FROM bw GROUP BY word),
v AS (SELECT coalesce(ds.word, bs.word) AS word, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM ds FULL JOIN bs ON ds.word = bs.word),
x AS (SELECT word, s, t, hex(encode(word)) AS h FROM v),
k AS (SELECT word, s, t, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
      lambda c, b: xor(c >> 8, tab[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM x, tab),
g AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM k GROUP BY bucket),
n AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM g),
m AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN k ON dw.word = k.word JOIN n ON k.bucket = n.bucket GROUP BY r),
c AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN m ON d.r = m.r),
s AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM c),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank FROM o
"""
