"""Licence scans of texts as they are wrapped in files: known sentences pass the same splitter as texts do.

Beside licenses.scan(), units of view 1 end at lines without letters and digits too, and a known sentence with a mark inside is several
units, which must stand side by side.
"""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_table import ALL_RULES, ALL_SENTENCES
from .licenses import Rule, normal

#: Where units end, by view: 0 lines; 1 marks before white space, and lines that hold no letter or digit.
ENDS = ("\n", "[.;:!?][ \t\r\n]+|\n[^a-zA-Z0-9\n]*\n")


def split_known(sentence: str, view: int) -> list[str]:
    """The units of a known sentence; as a line it is whole."""
    parts = [sentence] if view == 0 else re.split(ENDS[1], sentence)
    return [u for p in parts if (u := re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]+", lambda m: m[0].lower(), p)).strip())]


def known_units(sentences: dict[str, str], view: int) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Units to identifiers, and sentences to the identifiers of their units. A unit of several sentences has one identifier, the first."""
    unit_ids: dict[str, str] = {}
    of: dict[str, list[str]] = {}
    for name, sentence in sorted(sentences.items()):
        units = split_known(sentence, view)
        of[name] = [unit_ids.setdefault(u, name if len(units) == 1 else f"{name}/{i}") for i, u in enumerate(units, 1)]
    return unit_ids, of


def _groups(rules: tuple[Rule, ...]) -> list[tuple[str, list[Rule]]]:
    """Rules for one licence that follow each other, which are one pattern."""
    return [(licence, list(g)) for licence, g in groupby(rules, key=lambda r: r.licence)]


def _pattern(rules: list[Rule], of: dict[str, list[str]]) -> str:
    """Fits chains of identifiers in which the sentences of one of the rules stand one after another. of: the units of each sentence."""
    fits = ("[,+]".join(r"\+".join(re.escape(u) for u in of[s]) for s in r.sentences) for r in rules)
    return f"[,+](?:{'|'.join(fits)})[,+]"


def scan_texts(df: DataFrame, sentences: dict[str, str] = ALL_SENTENCES, rules: tuple[Rule, ...] = ALL_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns and treatment of odd rows as in licenses.scan(). A rule matches if its sentences stand one after another in either view, other units between
    them or not; the units of one sentence stand side by side. Texts are never shuffled, only known units are."""
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    known = [known_units(sentences, v) for v in (0, 1)]
    found = None
    for view in (0, 1):
        at = F.broadcast(df.sparkSession.createDataFrame(sorted(known[view][0].items()), "unit string, id string"))
        units = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), ENDS[view], -1), normal), lambda s: s != "")
        # outer, as an inner explode would infer a filter that splits every text twice
        rows = df.select(F.col(id_col).alias("_id"), digest.alias("_d"), F.posexplode_outer(units).alias("at", "unit")).join(at, "unit").select("_id", "_d", F.lit(view).alias("view"), "at", "id")
        found = rows if found is None else found.unionByName(rows)
    placed = lambda view: F.array_sort(F.collect_set(F.when(F.col("view") == view, F.struct("at", "id"))))
    found = found.groupBy("_id", "_d").agg(placed(0).alias("lines"), placed(1).alias("sentences"))
    out = df.select(F.col(id_col).alias("doc_id"), digest.alias("_digest")).join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d")), "left")

    def chain(c: str) -> Column:
        """Identifiers, each after + if its unit follows the one before at once, or else after a comma; a comma at the end."""
        lead = lambda x, i: F.when((i > 0) & (F.get(F.col(c), i - 1)["at"] == x["at"] - 1), "+").otherwise(",")
        return F.concat(F.array_join(F.transform(c, lambda x, i: F.concat(lead(x, i), x["id"])), ""), F.lit(","))

    ids = lambda c: F.coalesce(F.transform(c, lambda x: x["id"]), F.array().cast("array<string>"))
    out = out.select("doc_id", ids("lines").alias("line_ids"), ids("sentences").alias("sentence_ids"), chain("lines").alias("_l"), chain("sentences").alias("_s"))
    groups = _groups(rules)
    fits = lambda g: F.coalesce(F.col("_l").rlike(_pattern(g, known[0][1])) | F.col("_s").rlike(_pattern(g, known[1][1])), F.lit(False))
    none = F.array().cast("array<string>")
    some = F.array_distinct(F.array_compact(F.array(*[F.when(fits(g), F.lit(licence)) for licence, g in groups]))) if rules else none
    licences = F.when(F.size("line_ids") + F.size("sentence_ids") > 0, some).otherwise(none)
    return out.withColumn("licences", licences).drop("_l", "_s").withColumn("licence", F.get("licences", F.lit(0)))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_texts(table(spark, sf_dir, "documents")).select("doc_id", F.array_join("line_ids", ",").alias("line_ids"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), "licence")


#: The name under which this table was first registered.
op4_license_texts = op4_license_scan


def _sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    known = [known_units(ALL_SENTENCES, v) for v in (0, 1)]
    units = ", ".join(f"({v}, {text(u)}, {text(i)})" for v in (0, 1) for u, i in known[v][0].items())
    rules = ", ".join(f"({v}, {rank}, {text(licence)}, {text(_pattern(g, known[v][1]))})" for rank, (licence, g) in enumerate(_groups(ALL_RULES)) for v in (0, 1))
    normal_sql = "trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
WITH k AS (SELECT * FROM (VALUES {units}) v(view, unit, id)),
r AS (SELECT * FROM (VALUES {rules}) v(view, rank, licence, pattern)),
d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT n, 0 AS view, string_split(text, chr(10)) AS parts FROM d UNION ALL SELECT n, 1, string_split_regex(text, '[.;:!?][ \t\r\n]+|\n[^a-zA-Z0-9\n]*\n') FROM d),
u AS (SELECT n, view, {normal_sql} AS unit, place FROM (SELECT n, view, unnest(parts) AS part, unnest(range(len(parts))) AS place FROM p)),
w AS (SELECT n, view, unit, row_number() OVER (PARTITION BY n, view ORDER BY place) AS place FROM u WHERE unit <> ''),
f AS (SELECT n, w.view, place, id, lag(place) OVER (PARTITION BY n, w.view ORDER BY place) AS before FROM w JOIN k ON w.view = k.view AND w.unit = k.unit),
s AS (SELECT n, view, string_agg(id, ',' ORDER BY place) AS ids, string_agg(CASE WHEN before = place - 1 THEN '+' ELSE ',' END || id, '' ORDER BY place) || ',' AS chain FROM f GROUP BY n, view),
m AS (SELECT n, licence, min(rank) AS rank FROM s JOIN r ON s.view = r.view AND regexp_matches(chain, pattern) GROUP BY n, licence),
o AS (SELECT n, string_agg(licence, ',' ORDER BY rank) AS licences, arg_min(licence, rank) AS licence FROM m GROUP BY n)
SELECT doc_id, coalesce(a.ids, '') AS line_ids, coalesce(b.ids, '') AS sentence_ids, coalesce(licences, '') AS licences, licence
FROM d LEFT JOIN o USING (n) LEFT JOIN (FROM s WHERE view = 0) a USING (n) LEFT JOIN (FROM s WHERE view = 1) b USING (n)
"""


OP4_SQL = _sql()
