"""Substring dedup by super-k-mer partitioning.

A window is 50 consecutive words, its minimiser the least hash of the 8-word runs in it. Consecutive windows with one
minimiser make a super-k-mer. The steps:

1. Each document's super-k-mers are listed, without words: minimiser, text key, first window, number of windows.
2. A repeated window has the same minimiser wherever it stands, so only super-k-mers go on whose minimiser is in two different
   texts. Equal texts are one from here on; every copy but that with the least id loses all its windows at once.
3. What goes on travels as one packed string to its minimiser's bucket. There its windows are sorted as strings of words, and equal
   neighbours give the windows that a document with a smaller id has too.
4. Minimisers with more than HOT super-k-mers aren't brought together. Their windows are looked at by 128-bit hashes of words, from the coarse to
   the fine: super-k-mers, blocks and quarters of the windows in which a minimiser stands at certain places, and single windows. A
   text has a row for each different unit, with all places where it stands. At each level the least id of each unit is found by an aggregation that combines before it shuffles. All documents but
   that one lose the unit, and only the unit of the least id is taken apart, as it has whatever window another has in that unit.
   All windows of a block have some words in common, its core; a block whose core is in one document alone has no repeated window and isn't taken
   apart. So no key brings many rows together, and a passage that very many documents share moves a few rows for each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, boxed, table
from .tokens import Words, digests, gram_hashes, mix64, sliding_min, words

WINDOW = 50
RUN = 8
HOT = 256

#: Places of a minimiser in a block and in a quarter.
BLOCKS = (16, 4)

#: Stands for a null id: no id is greater.
LAST = (1 << 63) - 1


def _windows(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: its first word, and its document."""
    n = np.diff(w.first)
    count = np.maximum(n - window + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    before = np.cumsum(count) - count
    return np.arange(len(doc)) - before[doc] + w.first[doc], doc


def _super_kmers(window: int, run: int):
    """Arrow batches of (h1, h2, text) to those of (mini, h1, h2, at, n)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = (b.column(i).to_numpy() for i in (0, 1))
            for w in words(b.column(2)):
                first, doc = _windows(w, window)
                if not len(first):
                    continue
                least = sliding_min(gram_hashes(w.hashes(), run), window - run + 1)[first]
                new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))))
                d = doc[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[new].view(np.int64)), pa.array(h1[w.rows.start + d]), pa.array(h2[w.rows.start + d]), pa.array((first[new] - w.first[d]).astype(np.int32)), pa.array(np.diff(np.append(new, len(first))).astype(np.int32))],
                    ["mini", "h1", "h2", "at", "n"],
                )

    return of


def _pack(window: int):
    """Batches of (did, h1, h2, text, runs) to those of (mini, did, h1, h2, at, n, packed), for runs that aren't hot."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, runs = [b.column(i).to_numpy() for i in (0, 1, 2)], b.column(4).to_pylist()
            for w in words(b.column(3)):
                out: list[list] = [[] for _ in range(7)]
                for d, row in enumerate(w.rows):
                    for r in runs[row]:
                        if not r["hot"]:
                            lo = int(w.first[d]) + r["at"]
                            for o, v in zip(out, (r["mini"], *(int(x[row]) for x in ids), r["at"], r["n"], w.text(lo, lo + r["n"] + window - 1)), strict=True):
                                o.append(v)
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["mini", "did", "h1", "h2", "at", "n", "packed"])

    return of


def _both(w: Words, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two independent hashes of the words from each start on, as many as size says."""
    return [digests(w.hashes(i), start, size).view(np.int64) for i in (0, 1)]


def _once(row: np.ndarray, hashes: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Of units that are alike in a row, the first; and all their places."""
    order = np.lexsort((at, *hashes, row))
    keys = [x[order] for x in (row, *hashes)]
    new = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))
    return order[new], pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array(at[order].astype(np.int32)))


def _hot_runs(window: int):
    """Batches of (did, h1, h2, text, runs) to those of (id1, id2, did, h1, h2, ats, n): hot super-k-mers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, runs = [b.column(i).to_numpy() for i in (0, 1, 2)], b.column(4).to_pylist()
            for w in words(b.column(3)):
                own = [(row, int(w.first[d]), r["at"], r["n"]) for d, row in enumerate(w.rows) for r in runs[row] if r["hot"]]
                if own:
                    row, first, at, n = (np.array([o[i] for o in own]) for i in range(4))
                    hashes = _both(w, at + first, n + window - 1)
                    one, ats = _once(row, hashes, at)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[one]) for x in hashes), *(pa.array(x[row[one]]) for x in ids), ats, pa.array(n[one].astype(np.int32))], ["id1", "id2", "did", "h1", "h2", "ats", "n"])

    return of


def _places(w: Words, start: np.ndarray, window: int, run: int) -> np.ndarray:
    """Of each window by its first word: where in it the least run of words stands, the first of equals."""
    grams = gram_hashes(w.hashes(), run)
    best, place = grams[start], np.zeros(len(start), np.int64)
    for j in range(1, window - run + 1):
        other = grams[start + j]
        place[other < best] = j
        best = np.minimum(best, other)
    return place


def _blocks(window: int, run: int):
    """Batches of (did, h1, h2, text, own), own being places and lengths of super-k-mers, to those of (id1, id2, core1, core2, did, h1, h2, ats, n, parts): blocks, their parts being quarters, and theirs windows, whose places count from the block's."""
    sizes = [min(s, window) for s in BLOCKS]

    def units(w: Words, start: np.ndarray, mark: np.ndarray, apart: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """First window and number of windows of each unit, and the hashes of units and cores. mark: where each window's minimiser stands; apart: windows that don't go with the one before."""
        slot = (mark - start) // size
        new = np.flatnonzero(apart | np.concatenate(([True], slot[1:] != slot[:-1])))
        count = np.diff(np.append(new, len(start)))
        return new, count, _both(w, start[new], count + window - 1), _both(w, mark[new] - size * slot[new], np.full(len(new), window - size + 1))

    def lists(ends: np.ndarray, columns: dict) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, runs = [b.column(i).to_numpy() for i in (0, 1, 2)], b.column(4).to_pylist()
            for w in words(b.column(3)):
                own = [(row, int(w.first[d]), at, r["n"]) for d, row in enumerate(w.rows) for r in runs[row] for at in r["ats"]]
                if not own:
                    continue
                row, first, at, n = (np.array([o[i] for o in own]) for i in range(4))
                each = np.repeat(np.arange(len(own)), n)
                start = np.arange(len(each)) - (np.cumsum(n) - n)[each] + (at + first)[each]
                mark = start + _places(w, start, window, run)
                apart = np.concatenate(([True], (each[1:] != each[:-1]) | (mark[1:] != mark[:-1])))
                coarse, count, hashes, cores = units(w, start, mark, apart, sizes[0])
                apart[coarse] = True
                fine, few, own_hashes, own_cores = units(w, start, mark, apart, sizes[1])
                single = _both(w, start, np.full(len(start), window))
                parts = lists(np.append(fine, len(start)), {"id1": single[0], "id2": single[1]})
                of_block = np.searchsorted(coarse, fine, "right") - 1
                offset = (start[fine] - start[coarse][of_block]).astype(np.int32)
                quarters = {"id1": own_hashes[0], "id2": own_hashes[1], "core1": own_cores[0], "core2": own_cores[1], "at": offset, "n": few.astype(np.int32), "parts": parts}
                quarters = lists(np.append(np.searchsorted(fine, coarse), len(fine)), quarters)
                owner = row[each[coarse]]
                one, ats = _once(owner, hashes, start[coarse] - first[each[coarse]])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[one]) for x in (*hashes, *cores)), *(pa.array(x[owner[one]]) for x in ids), ats, pa.array(count[one].astype(np.int32)), quarters.take(pa.array(one))],
                    ["id1", "id2", "core1", "core2", "did", "h1", "h2", "ats", "n", "parts"],
                )

    return of


_UNIT = "id1: long, id2: long, core1: long, core2: long"
_BLOCK = f"{_UNIT.replace(':', '')}, did long, h1 long, h2 long, ats array<int>, n int, parts array<struct<{_UNIT}, at: int, n: int, parts: array<struct<id1: long, id2: long>>>>"


def _repeats(group: list[tuple], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(did, h1, h2, at, n): runs of windows that a smaller id has too. group: (did, h1, h2, at, n, packed) of one minimiser."""
    by: dict[bytes, list[tuple]] = {}
    for g in group:
        by.setdefault(g[5], []).append(g)
    least = {p: min(g[0] for g in gs) for p, gs in by.items()}
    owned: dict[bytes, list[int]] = {}
    if len(by) == 1:
        owned = {p: [least[p]] * gs[0][4] for p, gs in by.items()}
    else:
        entries = []
        for p, gs in by.items():
            ends = [i for i, c in enumerate(p) if c == 32]
            begins, ends, did = [0, *(e + 1 for e in ends)], [*ends, len(p)], least[p]
            owned[p] = [did] * gs[0][4]
            entries += [(p[begins[j] : ends[j + window - 1]], did, p, j) for j in range(gs[0][4])]
        entries.sort(key=lambda x: x[:2])
        now, owner = None, 0
        for text, did, p, j in entries:
            if text != now:
                now, owner = text, did
            owned[p][j] = owner
    for p, gs in by.items():
        for g in gs:
            lost, at = [o < g[0] for o in owned[p]], 0
            while True in lost[at:]:
                at = lost.index(True, at)
                end = lost.index(False, at) if False in lost[at:] else len(lost)
                yield (*g[1:3], g[0], g[3] + at, end - at)
                at = end


def _bucket(window: int):
    """Batches of packed super-k-mers, sorted by minimiser, to those of (h1, h2, did, at, n). A minimiser's strings are together, HOT at most."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 2, strict=True)], ["h1", "h2", "did", "at", "n"])

        now, group, found = None, [], []
        for b in batches:
            for mini, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if mini != now:
                    if len(group) > 1:
                        found += _repeats(group, window)
                    now, group = mini, []
                group.append(tuple(rest))
            yield done(found)
            found = []
        if len(group) > 1:
            found += _repeats(group, window)
        yield done(found)

    return of


def _covered(ranges: list[dict], n_words: int, window: int) -> np.ndarray:
    """Of each word, whether a window in ranges covers it."""
    step = np.zeros(n_words + 1, np.int64)
    for r in ranges:
        for at in r["ats"]:
            step[at] += 1
            step[at + r["n"] + window - 1] -= 1
    return np.cumsum(step[:-1]) > 0


def _cut(window: int):
    """Batches of (did, h1, h2, text, ranges) to those of (did, h1, h2, n_removed, kept)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, kept = [], []
            for text, ranges in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                own = (text or "").encode().split()
                gone = _covered(ranges or [], len(own), window)
                removed.append(int(gone.sum()))
                kept.append(b" ".join(x for x, g in zip(own, gone.tolist(), strict=True) if not g).decode())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["did", "h1", "h2", "n_removed", "kept"])

    return of


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, did, h1, h2, text) to those of (doc_id, did, h1, h2, n_words, sha256)."""
    for b in batches:
        n, sha = [], []
        for text in b.column(4).to_pylist():
            own = (text or "").encode().split()
            n.append(len(own))
            sha.append(hashlib.sha256(b" ".join(own)).hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "did", "h1", "h2", "n_words", "sha256"])


def _keyed(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), text.alias("text"), *more)


class Repeats:
    """What find_repeats() found: ``owner`` (h1, h2, first: the least id of each text) and ``cut`` (did, h1, h2, n_removed, kept), for each text with a repeated window, at its least id."""

    def __init__(self, owner: DataFrame, cut: DataFrame):
        self.owner, self.cut = owner, cut


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN, hot: int = HOT) -> Repeats:
    """Windows of ``window`` words that also start in a document with a smaller id, and the texts without the words they cover.

    Documents are told apart by id and text. A null id counts as greater than all others, and nothing is a repeat among documents with
    one id. Null or shorter texts have no window.
    """
    scratch = Scratch(df.sparkSession, "substring")
    docs = _keyed(df, id_col, text_col)
    owner = scratch.save(docs.groupBy("h1", "h2").agg(F.min("did").alias("first")), "owner")
    runs = scratch.save(docs.select("h1", "h2", "text").mapInArrow(_super_kmers(window, run), "mini long, h1 long, h2 long, at int, n int"), "runs")
    # a table of its own, so that the join's sides are plain shuffles and a minimiser with very many runs can be split
    shared = scratch.save(runs.groupBy("mini").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.count("*").alias("c")).where("a < b").select("mini", (F.col("c") > hot).alias("hot")), "shared")
    # a run for each text and place; copies of a text have the same
    going = runs.join(shared, "mini").groupBy("h1", "h2", "at").agg(F.first("n").alias("n"), F.first("mini").alias("mini"), F.first("hot").alias("hot"))
    going = going.groupBy("h1", "h2").agg(F.collect_list(F.struct("mini", "at", "n", "hot")).alias("runs"))
    going = scratch.save(going.join(owner, ["h1", "h2"]).withColumnRenamed("first", "did"), "going")
    texts = scratch.save(docs.drop("doc_id").join(going, ["did", "h1", "h2"]).select("did", "h1", "h2", "text", "runs"), "texts")
    scratch.drop("runs", "shared", "going")
    packed = texts.mapInArrow(_pack(window), "mini long, did long, h1 long, h2 long, at int, n int, packed binary").repartition("mini").sortWithinPartitions("mini")
    gone = [packed.mapInArrow(_bucket(window), "h1 long, h2 long, did long, at int, n int").select("h1", "h2", "did", F.array("at").alias("ats"), "n")]

    def owned(units: DataFrame) -> DataFrame:
        """The units of least ids; the others' windows are gone. The joins' keys have the id, so none is hot."""
        least = units.groupBy("id1", "id2").agg(F.min("did").alias("did"))
        gone.append(units.join(least, ["id1", "id2", "did"], "left_anti").select("h1", "h2", "did", "ats", "n"))
        kept = units.join(least, ["id1", "id2", "did"], "left_semi")
        if "core1" in units.columns:
            alone = units.groupBy("core1", "core2").agg(F.min("did").alias("did"), F.max("did").alias("most")).where("did = most").drop("most")
            kept = kept.join(alone, ["core1", "core2", "did"], "left_anti")
        return kept

    moved = lambda by: F.transform("ats", lambda a: a + by).alias("ats")
    hot_runs = scratch.save(texts.where(F.exists("runs", lambda r: r["hot"])).mapInArrow(_hot_runs(window), "id1 long, id2 long, did long, h1 long, h2 long, ats array<int>, n int"), "hot-runs")
    own = owned(hot_runs).groupBy("did", "h1", "h2").agg(F.collect_list(F.struct("ats", "n")).alias("own"))
    blocks = scratch.save(texts.drop("runs").join(own, ["did", "h1", "h2"]).mapInArrow(_blocks(window, run), _BLOCK), "blocks")
    quarters = owned(blocks).select("did", "h1", "h2", "ats", F.explode("parts").alias("x"))
    quarters = scratch.save(quarters.select("x.id1", "x.id2", "x.core1", "x.core2", "did", "h1", "h2", moved(F.col("x.at")), "x.n", "x.parts"), "quarters")
    single = owned(quarters).select("did", "h1", "h2", "ats", F.posexplode("parts").alias("i", "x"))
    single = scratch.save(single.select("x.id1", "x.id2", "did", "h1", "h2", moved(F.col("i")), F.lit(1).alias("n")), "windows")
    owned(single)
    every = gone[0]
    for more in gone[1:]:
        every = every.unionByName(more)
    ranges = every.groupBy("did", "h1", "h2").agg(F.collect_list(F.struct("ats", "n")).alias("ranges"))
    cut = texts.select("did", "h1", "h2", "text").join(ranges, ["did", "h1", "h2"]).select("did", "h1", "h2", "text", "ranges")
    cut = scratch.save(cut.mapInArrow(_cut(window), "did long, h1 long, h2 long, n_removed long, kept string").distinct(), "cut")
    scratch.drop("texts", "hot-runs", "blocks", "quarters", "windows")
    return Repeats(owner, cut)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """A row for each row of df: doc_id, n_words, n_removed and kept_sha256, of the kept words joined by one space. Null text: no words. An empty table gives an empty table; other columns are not read."""
    found = find_repeats(df, id_col, text_col, window, **options)
    rows = _keyed(df, id_col, text_col).mapInArrow(_count, "doc_id long, did long, h1 long, h2 long, n_words long, sha256 string")
    cut = found.cut.select("did", "h1", "h2", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    copy = (F.col("did") > F.col("first")) & (F.col("n_words") >= window)
    out = rows.join(found.owner, ["h1", "h2"], "left").join(cut, ["did", "h1", "h2"], "left")
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """All rows of df with their columns, whatever their names. Texts that lose words are their kept words joined by one space, the rest stay as they are, null too. An empty table gives an empty table."""
    found = find_repeats(df, id_col, text_col, window, **options)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = boxed(df, did=F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), h1=F.xxhash64(text), h2=F.xxhash64(F.lit(7), text), text=F.col(text_col))
    # owners and cuts meet by the rows' keys alone; texts then move once, to what they lose
    keys = keyed.select("did", "h1", "h2", (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)) >= window).alias("long")).distinct()
    change = keys.join(found.owner, ["h1", "h2"]).join(found.cut, ["did", "h1", "h2"], "left").withColumn("copy", F.col("long") & (F.col("did") > F.col("first")))
    change = change.where(F.col("copy") | F.col("kept").isNotNull()).select("did", "h1", "h2", F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"))
    out = keyed.drop("text").join(change, ["did", "h1", "h2"], "left")
    own = lambda c: F.col("row").getField(c)
    return out.select(*[(F.coalesce("kept", own(c)) if c == text_col else own(c)).alias(c) for c in df.columns])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, coalesce(doc_id, 9223372036854775807) AS id, unnest(range(1, (len(w) - 48)::BIGINT)) AS a, w FROM d WHERE len(w) >= 50),
g AS (SELECT r, id, a, md5(array_to_string(w[a:a + 49], ' ')) AS k FROM s),
m AS (SELECT k, min(id) AS lo FROM g GROUP BY k HAVING min(id) < max(id)),
p AS (SELECT DISTINCT r, unnest(range(a, a + 50)) AS i FROM g JOIN m USING (k) WHERE lo < id),
n AS (SELECT r, count(*) AS n_removed FROM p GROUP BY r),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, (len(w) + 1)::BIGINT)) AS i FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN p USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""
