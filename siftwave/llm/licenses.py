"""Licence scans: normalised sentences become identifiers, and ordered rules are matched against sequences of identifiers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Sentences of public licences and notices, by identifier.
SENTENCES = {
    "apache2": "Licensed under the Apache License, Version 2.0.",
    "apache2-may-not": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-redistribution": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-released": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "spdx-apache2": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-mit": "SPDX-License-Identifier: MIT",
}


class Rule(NamedTuple):
    """Identifiers that stand one after another, other sentences between them or not, mean the licence."""

    licence: str
    sentences: tuple[str, ...]


#: The first rule that matches names the document's licence.
RULES = (
    Rule("BSD-3-Clause", ("bsd-redistribution", "bsd-binary", "bsd-endorse")),
    Rule("BSD-2-Clause", ("bsd-redistribution", "bsd-binary")),
    Rule("MIT", ("mit-permission", "mit-notice")),
    Rule("GPL-3.0", ("gpl-redistribute",)),
    Rule("GPL-3.0", ("gpl3-work",)),
    Rule("GPL-3.0", ("spdx-gpl3",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    Rule("CC-BY-4.0", ("cc-by-4",)),
    Rule("Apache-2.0", ("apache2-may-not", "apache2-copy")),
    Rule("Apache-2.0", ("apache2",)),
    Rule("Apache-2.0", ("spdx-apache2",)),
    Rule("MIT", ("mit-released",)),
    Rule("MIT", ("spdx-mit",)),
)


def normal(text: Column) -> Column:
    """A-Z lower-cased; what isn't a letter a-z or a digit becomes one space, none at the ends."""
    return F.trim(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", " "))


def units(text: Column, view: int) -> Column:
    """Normalised units that hold something. View 0: lines. View 1: sentences, which end with a mark before white space and run over line ends."""
    return F.filter(F.transform(F.split(text, "\n" if view == 0 else "[.;:!?]+[ \t\r\n]+", -1), normal), lambda s: s != "")


def known_sentences(spark: SparkSession, sentences: dict[str, str]) -> DataFrame:
    """(unit, id): the table is a parameter of some hundred rows."""
    return spark.createDataFrame(sorted(sentences.items()), "id string, sentence string").select(normal(F.col("sentence")).alias("unit"), "id")


def scan(df: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, line_ids and sentence_ids (arrays of identifiers in the order in which they stand), licences (of all rules that match, in the rules' order, each once) and licence (the first, or null).

    A rule matches if its identifiers stand one after another in either array. Documents are told apart by id and text, so null ids and
    repeated rows do no harm; null text has no sentence. An empty table gives an empty table; other columns are not read. Texts are never
    shuffled, only known sentences are.
    """
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    known = F.broadcast(known_sentences(df.sparkSession, sentences))
    found = None
    for view in (0, 1):
        rows = df.select(F.col(id_col).alias("_id"), digest.alias("_d"), units(F.coalesce(F.col(text_col), F.lit("")), view).alias("units"))
        # outer, as an inner explode would infer a filter that splits every text twice
        rows = rows.select("_id", "_d", F.posexplode_outer("units").alias("at", "unit")).join(known, "unit").select("_id", "_d", F.lit(view).alias("view"), "at", "id")
        found = rows if found is None else found.unionByName(rows)
    at = lambda view: F.array_sort(F.collect_set(F.when(F.col("view") == view, F.struct("at", "id"))))
    found = found.groupBy("_id", "_d").agg(at(0).alias("lines"), at(1).alias("sentences"))
    ids = lambda c: F.coalesce(F.transform(c, lambda x: x["id"]), F.array().cast("array<string>"))
    out = df.select(F.col(id_col).alias("doc_id"), digest.alias("_digest")).join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d")), "left")
    out = out.select("doc_id", ids("lines").alias("line_ids"), ids("sentences").alias("sentence_ids"))
    sequence = lambda c: F.concat(F.lit(","), F.array_join(c, ","), F.lit(","))
    fits = lambda r: sequence("line_ids").contains(f",{','.join(r.sentences)},") | sequence("sentence_ids").contains(f",{','.join(r.sentences)},")
    licences = F.array_distinct(F.array_compact(F.array(*[F.when(fits(r), F.lit(r.licence)) for r in rules]))) if rules else F.array().cast("array<string>")
    return out.withColumn("licences", licences).withColumn("licence", F.get("licences", F.lit(0)))


def _sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    normal_sql = lambda x: f"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    known = ", ".join(f"({text(i)}, {text(s)})" for i, s in SENTENCES.items())
    rules = ", ".join(f"({i}, {text(r.licence)}, ',{','.join(r.sentences)},')" for i, r in enumerate(RULES))
    marks = "'[.;:!?]+[ \\t\\r\\n]+'"
    return f"""
WITH k AS (SELECT i AS id, {normal_sql("s")} AS unit FROM (VALUES {known}) v(i, s)),
r AS (SELECT * FROM (VALUES {rules}) v(rank, licence, pattern)),
d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT n, 0 AS view, string_split(text, chr(10)) AS parts FROM d UNION ALL SELECT n, 1, string_split_regex(text, {marks}) FROM d),
u AS (SELECT n, view, unnest(parts) AS part, unnest(range(len(parts))) AS place FROM p),
f AS (SELECT n, view, place, id FROM (SELECT n, view, place, {normal_sql("part")} AS unit FROM u) JOIN k USING (unit)),
s AS (SELECT n, view, string_agg(id, ',' ORDER BY place, id) AS ids FROM f GROUP BY n, view),
m AS (SELECT DISTINCT n, rank, licence FROM s JOIN r ON contains(',' || ids || ',', pattern)),
o AS (SELECT n, string_agg(licence, ',' ORDER BY rank) AS licences, arg_min(licence, rank) AS licence FROM (SELECT n, licence, min(rank) AS rank FROM m GROUP BY n, licence) GROUP BY n)
SELECT doc_id, coalesce(a.ids, '') AS line_ids, coalesce(b.ids, '') AS sentence_ids, coalesce(licences, '') AS licences, licence
FROM d LEFT JOIN o USING (n) LEFT JOIN (FROM s WHERE view = 0) a USING (n) LEFT JOIN (FROM s WHERE view = 1) b USING (n)
"""


#: DuckDB SQL of scan() over the view ``documents``, with the columns as in op4_license_scan.
SCAN_SQL = _sql()
