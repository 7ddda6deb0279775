"""Quality rules whose cutoffs come from mergeable quantile sketches for each language and source."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, boxed, table

#: Characters that count as symbols, and white space, which parts words.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"

#: Words in a window whose repetition counts.
WINDOW = 5


class Measure(NamedTuple):
    """A whole number by document, which fails where it is above median + TIMES * max(q75 - median, spread) of its language and source, and above ``most`` in any case (none: no limit)."""

    name: str
    spread: int
    most: int | None


#: Symbols and repeated lines for each 10,000 words or lines, and 100 times the mean length of a word. Up to a fourth of a group can be junk without moving its median and its third quartile by more than good documents do. Least spreads are for
#: groups where nearly all values are equal; shares of lines can't pass 10,000, so a cutoff near that would be none.
TIMES = 4
MEASURES = (
    Measure("symbols", 1_500, 15_000),
    Measure("dup_lines", 1_250, 8_000),
    Measure("length", 250, None),
)

#: A language and source with fewer documents takes the cutoffs of its language's merged sketches, and a language with fewer those of all.
LEAST_DOCUMENTS = 100


def _repeat_words(n: Column, grams: Column, ranked: Column) -> Column:
    """Words inside a window that occurs at least twice. ranked: the sorted array of (window hash, position)."""
    same = lambda j, x: F.coalesce(F.get(ranked, j)["h"] == x["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter(ranked, lambda x, j: same(j - 1, x) | same(j + 1, x)), lambda x: x["i"]))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))
    covered = F.aggregate(starts, none, lambda a, p: F.struct((p + WINDOW).alias("end"), (a["words"] + p + WINDOW - F.greatest(a["end"], p)).alias("words")))
    return F.when(F.size(grams) > 0, covered["words"]).otherwise(0).cast("long")


def metrics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words of the whole text (null: as empty). df must have none of these names, nor any beginning with an underscore.

    Windows are compared by 64-bit hashes inside one document; they are sorted only where some hash occurs twice.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumns({
        "_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "_lines": F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_grams": F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")),
    }).drop("_lines", "_words")
    some = F.size(F.array_distinct("_grams")) < F.size("_grams")
    df = df.withColumn("_ranked", F.when(some, F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_ranked").isNotNull(), _repeat_words(F.col("n_words"), F.col("_grams"), F.col("_ranked"))), F.lit(0).cast("long"))).drop("_ranked", "_grams")


def bucket(x: Column) -> Column:
    """The lower end of x's bucket: exact below 64, beyond that the first six binary digits, so within 1/32."""
    drop = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    power = F.pow(F.lit(2.0), drop).cast("long")
    return x - x % power


def _measures() -> dict[str, Column]:
    return {
        "symbols": F.expr("n_symbols * 10000 div greatest(n_words, 1)"),
        "dup_lines": F.expr("n_dup_lines * 10000 div greatest(n_lines, 1)"),
        "length": F.expr("word_chars * 100 div greatest(n_words, 1)"),
    }


def cutoffs(measured: DataFrame) -> DataFrame:
    """(lang, source, cutoffs) from (lang, source, base_failed, and a column for each measure).

    A sketch is a histogram: for each language, source and measure the number of documents in each bucket. Sketches merge by adding up
    their counts, which gives those of whole languages and of everything. Quantiles are lower ends of buckets.
    """
    stack = ", ".join(f"'{m.name}', {m.name}" for m in MEASURES)
    values = measured.where(~F.col("base_failed")).select("lang", "source", F.expr(f"stack({len(MEASURES)}, {stack}) AS (measure, value)"))
    sketches = values.groupBy("lang", "source", "measure", bucket(F.col("value")).alias("low")).agg(F.count("*").alias("docs"))
    # each group at the level it is large enough for: 0 its own, 1 its language's, 2 everything's
    groups = measured.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("own"))
    groups = groups.withColumn("in_lang", F.sum("own").over(Window.partitionBy("lang")))
    level = F.when(F.col("own") >= LEAST_DOCUMENTS, 0).when(F.col("in_lang") >= LEAST_DOCUMENTS, 1).otherwise(2)
    groups = groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), level.alias("level"))
    merged = [
        sketches.withColumn("level", F.lit(0)),
        sketches.groupBy("lang", F.lit(None).cast("string").alias("source"), "measure", "low").agg(F.sum("docs").alias("docs")).withColumn("level", F.lit(1)),
        sketches.groupBy(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "measure", "low").agg(F.sum("docs").alias("docs")).withColumn("level", F.lit(2)),
    ]
    every = merged[0].unionByName(merged[1]).unionByName(merged[2])
    by = Window.partitionBy("level", "lang", "source", "measure")
    every = every.withColumns({"upto": F.sum("docs").over(by.orderBy("low")), "all": F.sum("docs").over(by)})
    quantile = lambda q: F.min(F.when(F.col("upto") * 1000 >= F.col("all") * q, F.col("low")))
    by_name = lambda x: F.create_map(*[c for m in MEASURES for c in (F.lit(m.name), x(m))])[F.col("measure")]
    found = every.groupBy("level", "lang", "source", "measure").agg(quantile(F.lit(750)).alias("high"), quantile(F.lit(500)).alias("mid"))
    free = F.col("mid") + TIMES * F.greatest(F.col("high") - F.col("mid"), by_name(lambda m: F.lit(m.spread)))
    # least() passes over nulls
    return _fit(groups, found.select("level", "lang", "source", "measure", F.least(free, by_name(lambda m: F.lit(m.most).cast("long"))).alias("cutoff")))


def _fit(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, a cutoff for each measure): each group's cutoffs from the level that it is large enough for."""
    # a row for each group and measure; level tells a null language from a merged sketch
    groups = groups.select("l", "s", F.col("level").alias("at"), F.when(F.col("level") < 2, F.col("l")).alias("kl"), F.when(F.col("level") < 1, F.col("s")).alias("ks"))
    fits = (F.col("at") == F.col("level")) & F.col("kl").eqNullSafe(F.col("lang")) & F.col("ks").eqNullSafe(F.col("source"))
    return groups.join(found, fits).groupBy("l", "s").pivot("measure", [m.name for m in MEASURES]).agg(F.first("cutoff")).select(F.col("l").alias("lang"), F.col("s").alias("source"), *[F.col(m.name).alias(f"{m.name}_cutoff") for m in MEASURES])


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of df: id, the metrics, base_failed, one failed_<measure> for each measure, kept, and the columns in ``keep``.

    base_failed: fewer than 10 words, or over 20% of the words in repeated windows. Documents that don't fail it make the sketches;
    a document is kept if it isn't base_failed and is above none of its group's cutoffs. Null languages and sources are groups of their
    own; null ids stay; null text counts as empty and fails the base. An empty table gives an empty table; repeated rows are judged
    alike. The texts are read once; sketches and verdicts work on a table of numbers.
    """
    scratch = Scratch(df.sparkSession, "quality")
    columns = [F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *[F.col(c) for c in keep]]
    found = metrics(df.select(*columns, F.col(text_col).alias("_text")), "_text").drop("_text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = scratch.save(found.withColumn("base_failed", failed).withColumns(_measures()), "metrics")
    limits = scratch.save(cutoffs(found), "cutoffs").withColumnsRenamed({"lang": "l", "source": "s"})
    joined = found.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    over = {f"failed_{m.name}": F.coalesce(F.col(m.name) > F.col(f"{m.name}_cutoff"), F.lit(False)) for m in MEASURES}
    kept = ~F.col("base_failed")
    for m in MEASURES:
        kept = kept & ~F.col(f"failed_{m.name}")
    joined = joined.withColumns(over).withColumn("kept", kept)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *over, "kept", *keep)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The name under which these cutoffs were first registered.
op8_quality_robust = op8_quality_rules


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of documents that judge() keeps, with their columns, whatever their names. Verdicts are joined by id and a hash of the text, language and source, so repeated and null ids do no harm; rejected texts alone cross the join. An empty table gives an empty table."""
    digest = F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in (text_col, lang_col, source_col)])
    keyed = boxed(df, doc_id=F.col(id_col), digest=digest)
    plain = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), digest.alias("digest"))
    bad = judge(plain, keep=("digest",)).where("not kept").select(F.col("doc_id").alias("id"), F.col("digest").alias("d")).distinct()
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left_anti").select("row.*")


def _sql() -> str:
    """DuckDB SQL of the query: quantiles from sorted values of buckets' lower ends, which is what the histograms give."""
    fixed = {"symbols": "n_symbols * 10000 // greatest(n_words, 1)", "dup_lines": "n_dup_lines * 10000 // greatest(n_lines, 1)", "length": "word_chars * 100 // greatest(n_words, 1)"}
    values = " UNION ALL ".join(f"SELECT r, lang, source, base_failed, '{m.name}' AS k, {fixed[m.name]} AS v, {m.spread} AS spread, {'NULL' if m.most is None else m.most}::BIGINT AS most FROM m" for m in MEASURES)

    def cut(by: str) -> str:
        at = lambda q: f"list(low ORDER BY low)[CAST((count(*) * {q} + 999) // 1000 AS INT)]"
        return f"SELECT {by} k, least({at('500')} + {TIMES} * greatest({at('750')} - {at('500')}, any_value(spread)), any_value(most)) AS cutoff FROM g GROUP BY {by} k"

    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
e AS (SELECT r, a, array_to_string(w[a:a + 4], ' ') AS gram FROM (SELECT r, w, unnest(range(1, (len(w) - 3)::BIGINT)) AS a FROM d WHERE len(w) >= 5)),
f AS (SELECT r, a FROM e QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(a, a + 5)) AS p FROM f) GROUP BY r),
b AS (SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN c ON d.r = c.r),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
v AS ({values}),
g AS (SELECT *, v - v % (1 << greatest(length(bin(v)) - 6, 0)::INT) AS low FROM v WHERE NOT base_failed),
q0 AS ({cut("lang, source,")}), q1 AS ({cut("lang,")}), q2 AS ({cut("")}),
s AS (SELECT lang, source, own, sum(own) OVER (PARTITION BY lang) AS in_lang FROM (SELECT lang, source, count(*) FILTER (NOT base_failed) AS own FROM m GROUP BY lang, source)),
x AS (SELECT DISTINCT v.r FROM v JOIN s ON v.lang IS NOT DISTINCT FROM s.lang AND v.source IS NOT DISTINCT FROM s.source
      LEFT JOIN q0 ON q0.k = v.k AND q0.lang IS NOT DISTINCT FROM v.lang AND q0.source IS NOT DISTINCT FROM v.source
      LEFT JOIN q1 ON q1.k = v.k AND q1.lang IS NOT DISTINCT FROM v.lang LEFT JOIN q2 ON q2.k = v.k
      WHERE v.v > CASE WHEN own >= {LEAST_DOCUMENTS} THEN q0.cutoff WHEN in_lang >= {LEAST_DOCUMENTS} THEN q1.cutoff ELSE q2.cutoff END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x.r IS NULL AS kept FROM m LEFT JOIN x ON m.r = x.r
"""


OP8_SQL = _sql()
