"""MinHash near-duplicates by an inverted join of signature coordinates.

A document's signature has SIZE coordinates, each the least of one hash of its shingles. Two documents go on to the exact check if at
least MATCHES coordinates agree. The steps:

1. Documents with equal shingle sets become one node; what follows sees nodes only.
2. Each node is posted under each of its (coordinate, value) pairs. Pairs that only one node has are dropped, but count as its rarest.
3. Prefix: of its pairs, in order of frequency, a node stays under the SIZE - MATCHES + 1 rarest. Two nodes that agree in MATCHES
   coordinates share one of these. So a pair that very many nodes have is in no prefix unless nearly all of a node's pairs are such.
4. Skip merging: the nodes of a list are merged with its least node first. The other coordinates are skipped over and counted on the
   two signatures. Who agrees in enough of them is compared on the full sets. Linked nodes are one component afterwards; lists whose nodes
   are all in one component are done, and in the others the least node, which has met all others, leaves.
5. What is open after ROUNDS rounds are lists of many nodes that resemble each other without being linked, like texts around one
   passage. Their nodes are posted once more, under the rarest fifth of their shingles: two sets with 80% in common share one of these, and
   nodes with enough words of their own are posted nowhere. Lists led by the same node are merged. In each list the nodes of its largest component meet all others, and the
   others meet each other, in blocks of sets. A block's common shingles are counted for all its pairs by one product of matrices, and only
   links that join two components leave it, fewer than it has nodes.

So what moves for a large group of near copies, or of texts with a passage in common, grows with its size, not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, boxed, table
from .components import components
from .tokens import Words, gram_hashes, mix64, words

SHINGLE = 4
PERCENT = 80

#: A pair at 80% agrees in fewer than 37 of 64 coordinates once in 70,000 pairs, one at 85% never in practice.
SIZE = 64
MATCHES = 37
ROUNDS = 2

#: Shingles in a block of step 5, in its sets taken together, each of which counts as LIGHT at least; and columns of a matrix.
BLOCK = 1 << 19
LIGHT = 512
COLUMNS = 4096

#: Stands for a null id: no id is greater.
LAST = (1 << 63) - 1


def shingles(w: Words, n: int, second: bool = False) -> tuple[np.ndarray, ...]:
    """The distinct shingles of each document: document, then hash, in order; second: an independent hash beside them. With fewer words than n, all of them are one; without words there is none."""
    count = np.diff(w.first)
    many = np.maximum(count - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), many)
    at = np.arange(len(doc)) - (np.cumsum(many) - many)[doc] + w.first[doc]
    docs = [doc, *(np.flatnonzero(count == m) for m in range(1, n))]

    def hashed(h: np.ndarray) -> np.ndarray:
        found = [gram_hashes(h, n)[at] if len(at) else np.zeros(0, np.uint64)]
        found += [gram_hashes(h, m)[w.first[few]] ^ np.uint64(m) if len(few) else np.zeros(0, np.uint64) for m, few in enumerate(docs[1:], 1)]
        return np.concatenate(found)

    doc, h = np.concatenate(docs), hashed(w.hashes())
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(doc) else np.zeros(0, bool)
    return (doc[new], h[new], hashed(w.hashes(1))[order][new]) if second else (doc[new], h[new])


def _signatures(n: int, size: int):
    """Batches of (doc_id, did, t, text) to those of (doc_id, did, t, n_shingles, s1, s2, sig). s1 and s2 stand for the set; sig is empty without words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix64(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        times, plus = seeds[:size] | np.uint64(1), seeds[size:]
        for b in batches:
            for w in words(b.column(3), fold=True):
                doc, h, other = shingles(w, n, True)
                count = np.bincount(doc, minlength=len(w.rows))
                has = np.flatnonzero(count)
                first = (np.cumsum(count) - count)[has]
                s = np.zeros((2, len(w.rows)), np.uint64)
                sig = np.zeros((len(has), size), np.uint32)
                if len(has):
                    s[0, has] = np.add.reduceat(mix64(h), first)
                    s[1, has] = np.add.reduceat(mix64(other), first)
                    for i in range(size):
                        sig[:, i] = np.minimum.reduceat(h * times[i] + plus[i], first) >> np.uint64(32)
                ends = np.concatenate(([0], np.cumsum((count > 0) * size))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.reshape(-1).view(np.int32)))
                own = [c.slice(w.rows.start, len(w.rows)) for c in b.columns[:3]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(count.astype(np.int64)), pa.array(s[0].view(np.int64)), pa.array(s[1].view(np.int64)), lists], ["doc_id", "did", "t", "n_shingles", "s1", "s2", "sig"])

    return of


def exact_shingles(columns: list[pa.Array], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text column: document and shingle of its distinct shingles. Shingles are numbered by their words themselves, alike in all columns."""
    ids, counts = [], []
    for column in columns:
        for w in words(column, fold=True):
            size = w.ends - w.starts
            ends = np.concatenate(([0], np.cumsum(size)))
            data = w.data[np.arange(ends[-1]) + np.repeat(w.starts - ends[:-1], size)]
            ids.append(pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]))
            counts.append(np.diff(w.first))
    if not ids:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in columns]
    word, count = pa.concat_arrays(ids).dictionary_encode().indices.to_numpy().astype(np.int64), np.concatenate(counts)
    # documents of fewer words are filled up with a word that is none
    size = np.where(count > 0, np.maximum(count, n), 0)
    doc = np.repeat(np.arange(len(count)), size)
    at = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
    padded = np.full(len(doc), -1)
    padded[at < count[doc]] = word
    gram = padded
    for i in range(1, n):
        gram = pa.array(gram[: len(padded) - i] * (len(word) + 2) + padded[i:] + 1).dictionary_encode().indices.to_numpy().astype(np.int64)
    whole = np.flatnonzero(at <= size[doc] - n)
    keys = np.unique(doc[whole] * (len(padded) + 1) + gram[whole])
    doc, gram = np.divmod(keys, len(padded) + 1)
    firsts = np.cumsum([0, *(len(c) for c in columns)])
    cuts = np.searchsorted(doc, firsts)
    return [(doc[lo:hi] - first, gram[lo:hi]) for lo, hi, first in zip(cuts[:-1], cuts[1:], firsts[:-1], strict=True)]


def _confirm(n: int, percent: int):
    """Batches of (a, b, text of a, text of b) to those (a, b) whose sets of shingles, by their words, are similar enough. Nodes come as (did, t) in columns of their own."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                (da, ga), (db, gb) = exact_shingles(part.columns[4:6], n)
                doc, g = np.concatenate((da, db)), np.concatenate((ga, gb))
                order = np.lexsort((g, doc))
                doc, g = doc[order], g[order]
                both = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (g[1:] == g[:-1])], minlength=len(part)) if len(doc) else np.zeros(len(part), int)
                union = np.bincount(da, minlength=len(part)) + np.bincount(db, minlength=len(part)) - both
                yield part.filter(pa.array((100 * both >= percent * union) & (both > 0))).select(["a_did", "a_t", "b_did", "b_t"])

    return of


def _sets(n: int):
    """Batches of (did, t, text) to those of (did, t, hashes): the shingles."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column(2), fold=True):
                doc, h = shingles(w, n)
                ends = np.searchsorted(doc, np.arange(len(w.rows) + 1)).astype(np.int32)
                own = [c.slice(w.rows.start, len(w.rows)) for c in b.columns[:2]]
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["did", "t", "hashes"])

    return of


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many numbers each set of a has in common with each of b. Numbers that one side lacks are left out; the others are columns of two matrices, some at a time."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    places = [[np.searchsorted(both, x[np.isin(x, both, assume_unique=True)]) for x in side] for side in (a, b)]
    for lo in range(0, len(both), COLUMNS):
        sides = []
        for side in places:
            m = np.zeros((len(side), COLUMNS), np.float32)
            for i, p in enumerate(side):
                m[i, p[np.searchsorted(p, lo) : np.searchsorted(p, lo + COLUMNS)] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def joining_links(a: list[tuple], b: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """(place in a, place in b) of links between different components, until those that are linked are one. Rows: (component, sorted array of shingles)."""
    common = common_counts([x[1] for x in a], [x[1] for x in b])
    sizes = [np.array([len(x[1]) for x in side]) for side in (a, b)]
    linked = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
    number = {c: i for i, c in enumerate(dict.fromkeys(x[0] for x in [*a, *b]))}
    now = np.arange(len(number))  # of each component, the one that it has been joined to
    of_a, of_b = (np.array([number[x[0]] for x in side]) for side in (a, b))
    for i in range(len(a)):
        found = np.flatnonzero(linked[i])
        _, at = np.unique(now[of_b[found]], return_index=True)
        for j in found[at].tolist():
            own, other = now[of_a[i]], now[of_b[j]]
            if own != other:
                now[now == other] = own
                yield i, j


def _blocks(percent: int):
    """Batches of (key, i, j, side, did, t, comp_did, comp_t, hashes), sorted by the first three, to links (a, b) of nodes of two components. A block's sets are few: they hold some BLOCK shingles a side. Without side 1, side 0 meets itself."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[tuple]) -> Iterator[tuple]:
            sides = [[r for r in rows if r[0] == x] for x in (0, 1)]
            if rows[0][6] and not (sides[0] and sides[1]):  # one side of two has no node
                return
            a, b = sides[0], sides[1] or sides[0]
            for i, j in joining_links([(r[3:5], r[5]) for r in a], [(r[3:5], r[5]) for r in b], percent):
                yield (*a[i][1:3], *b[j][1:3])

        def out(found: list[tuple]) -> pa.RecordBatch:
            cols = zip(*found, strict=True) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a_did", "a_t", "b_did", "b_t"])

        now, group, found = None, [], []
        for b in batches:
            ends, values = b.column(8).offsets.to_numpy(), b.column(8).values.to_numpy().view(np.uint64)
            plain = zip(*(c.to_pylist() for c in b.columns[:8]), strict=True)
            for k, r in enumerate(plain):
                if r[:3] != now:
                    found += links(group) if group else []
                    now, group = r[:3], []
                group.append((*r[3:], values[ends[k] : ends[k + 1]], r[1] != r[2]))
            yield out(found)
            found = []
        yield out(list(links(group)) if group else [])

    return of


def _node(did: str, t: str) -> Column:
    return F.struct(F.col(did).alias("did"), F.col(t).alias("t"))


_PAIR = "a_did long, a_t long, b_did long, b_t long"


class NearDuplicates:
    """How near_duplicates() came to its result: ``rows`` (doc_id, did, t, n_shingles, s1, s2), ``nodes`` (s1, s2, n_shingles, node), ``labels`` (node, label) of linked nodes."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, labels: DataFrame):
        self.rows, self.nodes, self.labels = rows, nodes, labels

    def members(self) -> DataFrame:
        """A row for each document: doc_id, did, t, n_shingles and leader, the (did, t) that leads its component; null without words."""
        found = self.nodes.join(self.labels, "node", "left").select("s1", "s2", "n_shingles", F.coalesce("label", "node").alias("leader"))
        return self.rows.join(found, ["s1", "s2", "n_shingles"], "left").select("doc_id", "did", "t", "n_shingles", "leader")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(text).alias("t"), text.alias("text"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, size: int = SIZE, matches: int = MATCHES, rounds: int = ROUNDS, block: int = BLOCK) -> NearDuplicates:
    """Links documents whose sets of ``shingle``-word shingles have ``percent`` of their union in common, and finds what is reachable by links. Parameters as in the module's text."""
    spark = df.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = _keyed(df, id_col, text_col)
    rows = scratch.save(docs.mapInArrow(_signatures(shingle, size), "doc_id long, did long, t long, n_shingles long, s1 long, s2 long, sig array<int>"), "rows")
    nodes = rows.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min_by(F.struct(_node("did", "t").alias("node"), "sig"), _node("did", "t")).alias("x"))
    nodes = scratch.save(nodes.select("s1", "s2", "n_shingles", "x.node", "x.sig"), "nodes")

    posted = nodes.select("node", F.posexplode("sig").alias("i", "v")).select("node", (F.col("i") * F.lit(1 << 32) + F.col("v")).alias("key"))
    often = posted.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    mine = posted.join(often, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("keys"))
    # pairs that no other node has come first in a node's prefix
    need = F.size("keys") - (matches - 1)
    prefix = mine.where(need > 0).select("node", F.explode(F.slice("keys", 1, need)).alias("x")).select("node", "x.key")
    lists = scratch.save(prefix.join(prefix.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "key"), "lists-0")

    met = lists.select("node").distinct()
    signs = scratch.save(met.join(nodes, "node").select("node", "n_shingles", "sig", F.col("node").alias("label")), "signs")
    texts = scratch.save(docs.join(signs.select("node.did", "node.t"), ["did", "t"], "left_semi").dropDuplicates(["did", "t"]).select(_node("did", "t").alias("node"), "text"), "texts")
    labels = signs.select("node", "label")
    links: list[DataFrame] = []

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text")) for x in "ab")
        pairs = pairs.distinct().join(a, "a").join(b, "b").select("a.did", "a.t", "b.did", "b.t", "a_text", "b_text").toDF("a_did", "a_t", "b_did", "b_t", "a_text", "b_text")
        return scratch.save(pairs.mapInArrow(_confirm(shingle, percent), _PAIR).select(_node("a_did", "a_t").alias("a"), _node("b_did", "b_t").alias("b")), name)

    def relabelled(name: str) -> DataFrame:
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        found = components(every, scratch, name)
        return scratch.save(signs.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label")), f"{name}-labels")

    def open_lists(name: str) -> DataFrame:
        """The lists that have nodes of several components, with labels."""
        named = lists.join(labels, "node")
        some = named.groupBy("key").agg(F.min("node").alias("head"), F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("c")).where("l <> m").drop("l", "m")
        return scratch.save(named.join(some, "key"), name)

    agree = F.aggregate(F.zip_with("a_sig", "b_sig", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    fits = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    active, done = open_lists("open-0"), False
    for k in range(rounds):
        if not active.limit(1).count():
            done = True
            break
        heads = signs.select(F.col("node").alias("head"), F.col("n_shingles").alias("b_n"), F.col("sig").alias("b_sig"))
        own = signs.select("node", F.col("n_shingles").alias("a_n"), F.col("sig").alias("a_sig"))
        headed = labels.select(F.col("node").alias("head"), F.col("label").alias("head_label"))
        pairs = active.where("node <> head").select("node", "label", "head").distinct().join(headed, "head").where("label <> head_label").join(own, "node").join(heads, "head").where(fits & (agree >= matches))
        found = confirmed(pairs.select(F.col("node").alias("a"), F.col("head").alias("b")), f"links-{k}")
        lists = active.where("node <> head").select("node", "key")
        if found.limit(1).count():
            links.append(found)
            labels = relabelled(f"round-{k}")
        active = open_lists(f"open-{k + 1}")
    if not done and active.limit(1).count():
        left = scratch.save(signs.join(active.select("node").distinct(), "node", "left_semi").select("node", "n_shingles").join(labels, "node"), "left")
        sets = texts.join(left.select("node"), "node", "left_semi").select("node.did", "node.t", "text").mapInArrow(_sets(shingle), "did long, t long, hashes array<long>")
        sets = scratch.save(sets, "sets")
        single = sets.select("did", "t", F.explode("hashes").alias("hash"))
        often = single.groupBy("hash").agg(F.count("*").alias("often")).where("often > 1")
        own = single.join(often, "hash").groupBy("did", "t").agg(F.array_sort(F.collect_list(F.struct("often", "hash"))).alias("keys"))
        own = own.select(_node("did", "t").alias("node"), "keys").join(left, "node")
        # the prefix of a set of n is n less the least number in common plus 1; shingles that no other node has come first in it
        need = F.size("keys") - F.expr(f"cast(ceil(n_shingles * {percent} / 100.0) as int)") + 1
        prefix = own.where(need > 0).select("node", "label", "n_shingles", F.explode(F.slice("keys", 1, need)).alias("x")).select("node", "label", "n_shingles", F.col("x.hash").alias("key"))
        prefix = scratch.save(prefix, "prefix")
        # lists led by the same node, that of fewest shingles, are one: texts around a passage are together once and not once for each of its shingles
        led = prefix.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.min(F.struct("n_shingles", "node")).alias("lead")).where("l <> m")
        led = scratch.save(led.select("key", F.xxhash64("lead.node").alias("lead")), "led")
        prefix = scratch.save(prefix.join(led, "key").select(F.col("lead").alias("key"), "node", "label", "n_shingles").distinct(), "led-lists")
        # of each list: its largest component, and how many blocks that and the rest make; block numbers of the rest come first
        by_label = prefix.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum(F.greatest("n_shingles", F.lit(LIGHT))).alias("s"))
        lists = by_label.groupBy("key").agg(F.max(F.struct("c", "label", "s")).alias("x"), F.sum("s").alias("s"))
        blocks = lambda s: F.ceil(s / F.lit(float(block))).cast("int")
        lists = scratch.save(lists.select("key", F.col("x.label").alias("most"), blocks(F.col("s") - F.col("x.s")).alias("rest"), blocks(F.col("x.s")).alias("main")), "block-lists")
        mine = prefix.join(lists, "key").withColumn("is_main", F.col("label") == F.col("most"))
        mine = mine.withColumn("own", F.when(F.col("is_main"), F.col("rest") + F.pmod(F.xxhash64("node"), F.col("main"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int"))
        meets = F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("rest")).otherwise(F.col("rest") + F.col("main")) - 1)
        dealt = mine.select("key", "own", "node", "label", F.explode(meets).alias("o"))
        dealt = dealt.select("key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"), "node", "label")
        dealt = dealt.join(sets.select(_node("did", "t").alias("node"), "hashes"), "node").select("key", "i", "j", "side", "node.did", "node.t", F.col("label.did").alias("comp_did"), F.col("label.t").alias("comp_t"), "hashes")
        met = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_blocks(percent), _PAIR)
        found = confirmed(met.select(_node("a_did", "a_t").alias("a"), _node("b_did", "b_t").alias("b")), "links-blocks")
        if found.limit(1).count():
            links.append(found)
            labels = relabelled("blocks")
    return NearDuplicates(rows.drop("sig"), nodes.drop("sig"), labels)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each row of df: doc_id, n_shingles, component_id (the least id reachable) and kept (doc_id is component_id).

    Null and wordless texts have no shingles and are linked with nothing. A null id counts as greater than all others; a document that
    reaches null ids only has component_id null and is kept. Equal rows get equal results. An empty table gives an empty table; other columns are not read.
    """
    found = near_duplicates(df, id_col, text_col, **options).members()
    least = F.coalesce("leader.did", "did")
    component = F.when(least != LAST, least)
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_leaders(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df that lead their components, with their columns, whatever their names: of each component one, that with the least id. Wordless texts stay, each (id, text) once. An empty table gives an empty table."""
    found = near_duplicates(df, id_col, text_col, **options).members()
    lead = found.where(F.col("leader").isNull() | (F.col("leader") == _node("did", "t"))).select("did", "t").distinct()
    keyed = boxed(df, did=F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), t=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return keyed.join(lead, ["did", "t"], "left_semi").dropDuplicates(["did", "t"]).select("row.*")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
