"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). A word's class is a hash of its last bytes; the end of a text has a class of its own.
P(class | history) is a softmax over sums of weights, one row of weights for each active feature: the last word, the last two
words, and the word before the last alone (a skip), each hashed into ROWS rows. P(word | class) is the softmax of the
words' own weights, which training by counts solves outright: (count + 1) / (class total + class size + 1), the one more being for unknown words.

Steps: count all training words; train the weights in ROUNDS rounds, each over its own part of the texts, whose shards take gradient
steps from the last round's weights and end in their mean, where a shard counts for a row as often as it met the row; score every text in
numpy batches. Up to HEAD of the most frequent words are known to every task, which bounds what is broadcast; the
others travel to their counts, and by being rare they don't make a key hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .tokens import Words, mix64, words

CLASSES = 64
ROWS = 1 << 13
TABLES = 3
HEAD = 1 << 16
BLOCK = 64
BATCH = 4096
RATE = 0.25

#: Rounds of training; a text is in one of them, by a hash.
ROUNDS = 4

#: Training tokens that a shard of a round has at least, where there are as many; a shard sends one set of weights.
SHARD = 1_000_000

_ONES = np.ones(CLASSES, np.float32)
_START = np.uint64(0x2545F4914F6CDD1D)


def tokens_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token, ends included: document, hash (0 for an end), class, and the rows of its features, one array for each table."""
    n = np.diff(w.first)
    doc = np.repeat(np.arange(len(n)), n + 1)
    total = len(doc)
    ends = np.cumsum(n + 1) - 1
    is_word = np.ones(total, bool)
    is_word[ends] = False
    h = np.zeros(total, np.uint64)
    h[is_word] = np.maximum(w.hashes(), np.uint64(1))
    kind = np.zeros(total, np.uint8)
    last = w.data[w.ends - 1].astype(np.uint64) if len(w.ends) else np.zeros(0, np.uint64)
    two = np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends - 2, 0)] if len(w.ends) else 0, 0).astype(np.uint64)
    kind[is_word] = (mix64(last * np.uint64(256) + two) % np.uint64(CLASSES - 1)).astype(np.uint8) + 1
    at = np.arange(total) - (ends - n)[doc]
    before = []
    for d in (1, 2):
        x = np.full(total, _START * np.uint64(d), np.uint64)
        far = np.flatnonzero(at >= d)
        x[far] = h[far - d]
        before.append(x)
    keys = (before[0], before[0] * np.uint64(0x9E3779B97F4A7C15) + before[1] + np.uint64(1), before[1] ^ _START)
    return doc, h, kind, np.stack([(mix64(k) % np.uint64(ROWS)).astype(np.uint16) for k in keys])


def _logits(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = weights[0].take(f[0], 0)
    for t in range(1, TABLES):
        z += weights[t].take(f[t], 0)
    z += bias
    if max(z.max(initial=0), -z.min(initial=0)) > 80:  # beyond that, sums of powers could leave float32
        z -= z.max(1, keepdims=True)
    return z


def gradient_steps(weights: np.ndarray, bias: np.ndarray, moved: np.ndarray, met: np.ndarray, kind: np.ndarray, f: np.ndarray) -> None:
    """Steps over batches of tokens, in place. For each row, moved: the sum of squared gradients, which slows its steps; met: its tokens."""
    for lo in range(0, len(kind), BATCH):
        y, own = kind[lo : lo + BATCH], f[:, lo : lo + BATCH]
        p = _logits(weights, bias, own)
        np.exp(p, out=p)
        p /= (p @ _ONES)[:, None]
        p[np.arange(len(y)), y] -= 1
        for t in range(TABLES):
            order = np.argsort(own[t], kind="stable")
            row = own[t][order]
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            g, n, row = p.take(order[first], 0), np.diff(np.append(first, len(row))), row[first]
            many = n > 1  # most rows are met once in a batch; only the others need sums
            if many.any():
                g[many] = np.add.reduceat(p.take(order[np.repeat(many, n)], 0), np.cumsum(n[many]) - n[many], axis=0)
            met[t][row] += n
            moved[t][row] += np.einsum("ij,ij->i", g, g)
            g *= (RATE / np.sqrt(moved[t][row] + 1e-6))[:, None]
            weights[t][row] -= g


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text) to those of (h, kind, c), end tokens as h 0."""
    for b in batches:
        for w in words(b.column(0), fold=True):
            _, h, kind, _ = tokens_of(w)
            h, at, c = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind[at].astype(np.int32)), pa.array(c)], ["h", "kind", "c"])


def _train(model):
    """Batches of (text), a shard, to those of (block, weights, moved, met): rows of its weights and what its steps are slowed by, in float32, and how often it met them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, moved, bias = model.value[0].copy(), model.value[1].copy(), model.value[2]
        met = np.zeros((TABLES, ROWS))
        for b in batches:
            for w in words(b.column(0), fold=True):
                _, _, kind, f = tokens_of(w)
                gradient_steps(weights, bias, moved, met, kind, f)
        if met.any():
            parts = [x.reshape(-1, BLOCK * n) for x, n in ((weights, CLASSES), (moved, 1), (met, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts[0]), dtype=np.int32)), *[pa.array([r.tobytes() for r in x], pa.binary()) for x in parts]], ["block", "weights", "moved", "met"])

    return of


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (block, weights, moved, met) to (block, weights, moved): means over shards. A shard counts by how often it met a row, so that shards without it don't shrink its weights. Holds one sum a block."""
    sums: dict[int, tuple] = {}
    for b in batches:
        for block, weights, moved, met in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = np.frombuffer(met)[:, None] + 1e-9  # rows that no shard met keep what they had
            x = np.frombuffer(weights, np.float32).reshape(-1, CLASSES) * n, np.frombuffer(moved, np.float32)[:, None] * n, n
            sums[block] = tuple(p + q for p, q in zip(sums[block], x, strict=True)) if block in sums else x
    raw = lambda i: pa.array([(x[i] / x[2]).astype(np.float32).tobytes() for x in sums.values()], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), raw(0), raw(1)], ["block", "weights", "moved"])


def fit(train: DataFrame, bias: np.ndarray, n: int) -> np.ndarray:
    """Weights (table, row, class) trained on the texts of train, which have n tokens. Only one set of weights, of fixed size, comes to the driver after each round."""
    context = train.sparkSession.sparkContext
    weights, moved = np.zeros((TABLES, ROWS, CLASSES), np.float32), np.zeros((TABLES, ROWS), np.float32)
    blocks = TABLES * ROWS // BLOCK
    shards = max(1, n // (ROUNDS * SHARD))
    part = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(ROUNDS))
    for i in range(ROUNDS):
        model = context.broadcast((weights, moved, bias))
        # partitions are put together, not dealt anew
        trained = train.where(part == i).coalesce(shards).mapInArrow(_train(model), "block int, weights binary, moved binary, met binary")
        means = trained.repartition(min(shards, blocks), "block").mapInArrow(_mean, "block int, weights binary, moved binary").collect()
        weights, moved = weights.copy(), moved.copy()
        for r in means:
            weights.reshape(blocks, -1)[r.block] = np.frombuffer(r.weights, np.float32)
            moved.reshape(blocks, -1)[r.block] = np.frombuffer(r.moved, np.float32)
        model.unpersist()
    return weights


def _score(model):
    """Batches of (doc_id, held_out, text) to those of (doc_id, held_out, n_tokens, known, counts, score, rare): sums over the tokens that every task knows, and the rest as (h, n)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        weights, bias, head, count, size = (m[k] for k in ("weights", "bias", "head", "count", "size"))
        for b in batches:
            for w in words(b.column(2), fold=True):
                doc, h, kind, f = tokens_of(w)
                n = len(w.rows)
                p = np.empty(len(doc))
                for lo in range(0, len(doc), BATCH):
                    z = _logits(weights, bias, f[:, lo : lo + BATCH])
                    own = z[np.arange(len(z)), kind[lo : lo + BATCH]].astype(np.float64)
                    p[lo : lo + BATCH] = own - np.log((np.exp(z, out=z) @ _ONES).astype(np.float64))
                p = p / np.log(10) - np.log10(size)[kind]
                at = np.minimum(np.searchsorted(head, h), max(len(head) - 1, 0))
                known = head[at] == h if len(head) else np.zeros(len(h), bool)
                c = np.where(known, count[at], 0) if len(head) else np.zeros(len(h))
                logs = np.log10(c + 1)
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((h[rare], doc[rare]))]
                rd, rh = doc[order], h[order]
                first = np.flatnonzero(np.concatenate(([True], (rd[1:] != rd[:-1]) | (rh[1:] != rh[:-1])))) if len(rd) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(rd))).astype(np.int32)
                ends = np.concatenate(([0], np.cumsum(np.bincount(rd[first], minlength=n)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(rh[first].view(np.int64)), pa.array(times)], ["h", "n"]))
                total = lambda x: np.bincount(doc, weights=x, minlength=n)
                own = [x.slice(w.rows.start, n) for x in b.columns[:2]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.bincount(doc, minlength=n).astype(np.int64)), pa.array(total(known).astype(np.int64)), pa.array(total(logs)), pa.array(total(p + logs)), lists], ["doc_id", "held_out", "n_tokens", "known", "counts", "score", "rare"])

    return of


def score(df: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    held_out: a boolean Column; the model learns from all other rows. Null texts count as empty and have one token, the end. Rows are never
    grouped by id, so null and repeated ids do no harm. Without training tokens, every word is unknown and all classes are equally
    likely. An empty table gives an empty table. Words are told apart by 64-bit hashes. Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "lm")
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    train = docs.where("not held_out").select("text")
    counts = train.mapInArrow(_count_words, "h long, kind int, c long").groupBy("h", "kind").agg(F.sum("c").alias("c"))
    counts = scratch.save(counts, "counts")
    totals = {r.kind: (r.c, r.n) for r in counts.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    n, v = (sum(x[i] for x in totals.values()) for i in (0, 1))
    size = np.array([sum(totals.get(k, (0, 0))) + 1 for k in range(CLASSES)], np.float64)
    share = np.array([totals.get(k, (0, 0))[0] for k in range(CLASSES)], np.float64) + 1
    bias = np.log(share / share.sum()).astype(np.float32)

    weights = fit(train, bias, n)
    # whole levels of counts, from the top, that have HEAD words at most; so no task sends more than its share of them
    level = F.floor(F.log2(F.col("c").cast("double")) * 8)
    least, known = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        known += r.n
        if known > HEAD:
            break
        least = r.level
    head = sorted((r.h % (1 << 64), r.c) for r in counts.where(level >= least).select("h", "c").collect()) if least is not None else []
    model = {"weights": weights, "bias": bias, "size": size, "head": np.array([x[0] for x in head], np.uint64), "count": np.array([x[1] for x in head], np.float64)}
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known long, counts double, score double, rare array<struct<h: long, n: int>>"
    scored = scratch.save(docs.mapInArrow(_score(spark.sparkContext.broadcast(model)), schema).withColumn("row", F.monotonically_increasing_id()), "scored")

    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.h", "x.n").join(counts.select("h", "c"), "h")
    more = rare.groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    out = scored.drop("rare").join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    base = F.col("counts") + extra - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0).cast("long"))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + extra).alias("score"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2)
