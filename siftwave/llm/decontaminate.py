"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over the token windows of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, boxed, table

#: A word is a run of these, after A-Z is lower-cased; what stands between words.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Consecutive words of an item in a window.
WINDOW = 13

#: Windows that are broadcast at most; some 150 bytes each. With more, windows of documents and items meet in a shuffle.
BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ITEM_WORD), F.lit(0))


def digest_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(n, gram, hash, items): the distinct windows, of n words each, and the ids of the items they stand in, as strings. An item of fewer words is one window; without words it has none."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    grams = words.withColumn("n", n).select("item", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))).alias("gram"))
    return grams.groupBy("n", "gram").agg(F.collect_set(F.coalesce("item", F.lit(""))).alias("items")).withColumn("hash", F.xxhash64("gram"))


def window_hashes(n: int) -> Column:
    """The hashes of all windows of n words of the column words."""
    all_of = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.xxhash64(F.slice("words", i, n)))
    return F.when(F.size("words") >= n, all_of).otherwise(F.array().cast("array<bigint>"))


def with_words(hashes: Column, n: int) -> Column:
    return F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), F.slice("words", i + 1, n).alias("own")))


def _covered(hits: Column) -> Column:
    """Words inside any of the hits, an array of (at, n)."""
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))

    def step(a: Column, x: Column) -> Column:
        end = x["at"] + x["n"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["words"] + F.greatest(end - F.greatest(a["end"], x["at"]), F.lit(0))).alias("words"))

    return F.aggregate(F.array_sort(hits), none, step)["words"]


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, digest, hits, item_ids) for each id and text of docs in which some window of an item occurs. hits: array of (at, n), the windows' first words from 0 and their lengths; item_ids: sorted strings.

    Every window of every document meets the windows of the items by a 64-bit hash, and the words themselves confirm it. Documents are
    told apart by id and text, so repeated rows give one row here and null ids are an id. Null text has no words.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    grams = scratch.save(benchmark_windows(items, item_col, item_text_col, window), "windows")
    lengths = [r.n for r in grams.select("n").distinct().collect()]  # at most ``window`` numbers
    few = grams.count() <= broadcast_windows
    rows = docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest"), words_of(F.col(text_col)).alias("words"))
    hits = None
    # outer, as an inner explode would infer a filter that works out every window's hash from the text anew
    for n in sorted(lengths):
        hashes = window_hashes(n)
        own = grams.where(F.col("n") == n).select("hash", "gram", "items")
        if few:  # explode, probe and the look at the words are one generated loop; no array is copied for a window without a hit
            windows = rows.withColumn("hashes", hashes).select("doc_id", "digest", "words", F.posexplode_outer("hashes").alias("at", "hash"))
            here = F.slice("words", F.col("at") + 1, n)  # two bounds, as an equality would become a key that is taken of every window
            found = windows.join(F.broadcast(own), "hash").where((here >= F.col("gram")) & (here <= F.col("gram")))
        else:
            windows = rows.withColumn("hashes", with_words(hashes, n)).select("doc_id", "digest", F.posexplode_outer("hashes").alias("at", "x"))
            found = windows.select("doc_id", "digest", "at", "x.hash", "x.own").join(own, "hash").where(F.col("own") == F.col("gram"))
        found = found.select("doc_id", "digest", F.struct("at", F.lit(n).alias("n")).alias("hit"), "items")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, digest bigint, hits array<struct<at: int, n: int>>, item_ids array<string>").withColumn("doc_id", F.col("doc_id").cast(rows.schema["doc_id"].dataType))
    # first a row for each window that is hit, then sets: repeated rows add nothing, and no set outgrows its document and the items
    hits = hits.groupBy("doc_id", "digest", "hit").agg(F.first("items").alias("items"))
    return hits.groupBy("doc_id", "digest").agg(F.collect_list("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and 20 * n_hit >= n_words). Without items, nothing is hit. An empty table gives an empty table; other columns are not read."""
    hits = find_hits(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d"), _covered(F.col("hits")).cast("long").alias("_hit"), "item_ids")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("_digest"), F.regexp_count(ascii_lower(text), F.lit(ITEM_WORD)).cast("long").alias("n_words"))
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n = F.coalesce("_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((n > 0) & (20 * n >= F.col("n_words"))).alias("contaminated"))


def _beside_hits(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, digest, text, and hits' columns) for each row of docs, whatever its columns' names; null beside rows without a hit."""
    keyed = boxed(docs, id=F.col(id_col), digest=digest_of(F.col(text_col)), text=F.col(text_col))
    hits = hits.withColumnsRenamed({"digest": "hit_digest"})
    return keyed.join(hits, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("hit_digest")), "left")


def remove_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns. Null texts stay; without items all rows do. An empty table gives an empty table."""
    hits = find_hits(docs, items, id_col, text_col, **options).select("doc_id", "digest", _covered(F.col("hits")).cast("long").alias("hit"))
    bad = F.col("hit").isNotNull() & (20 * F.col("hit") >= F.regexp_count(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(ITEM_WORD)))
    return _beside_hits(docs, hits, id_col, text_col).where(~bad).select("row.*")


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows of docs; from their texts every word that is hit is cut, with what stands between it and the next word. Texts without a hit stay as they are, null too. An empty table gives an empty table."""
    hits = find_hits(docs, items, id_col, text_col, **options).select("doc_id", "digest", "hits")
    inside = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    some = _beside_hits(docs, hits, id_col, text_col)
    some = some.withColumn("gone", F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))))
    some = some.withColumn("pieces", F.regexp_extract_all("text", F.lit(inside + BETWEEN + "*"), F.lit(0)))
    # positions that stay: all but those that are gone
    stay = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), F.col("gone"))
    cut = F.concat(F.regexp_extract("text", f"^{BETWEEN}*", 0), F.array_join(F.transform(stay, lambda i: F.get("pieces", i)), ""))
    out = F.when(F.col("hits").isNull(), F.col("text")).otherwise(cut)
    return some.select(*[(out if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item, least(len(w), 13) AS n, unnest(list_transform(range(1, (len(w) - least(len(w), 13) + 2)::BIGINT), lambda j: w[j:j + least(len(w), 13) - 1])) AS gram FROM i WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
l AS (SELECT DISTINCT n FROM g),
s AS (SELECT r, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS a, w FROM d, l WHERE len(w) >= n),
h AS (SELECT r, a, s.n, item FROM (SELECT r, n, a, w[a:a + n - 1] AS gram FROM s) AS s JOIN g ON s.n = g.n AND s.gram = g.gram),
k AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)
"""
