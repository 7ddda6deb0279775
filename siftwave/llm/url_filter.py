"""URL rules by hashed expressions: host suffixes times path prefixes, short hash prefixes, then full digests."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table


class Rule(NamedTuple):
    """path is empty or starts with a slash; host is lower case."""

    verdict: str
    host: str
    path: str


#: The rules of the query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def url_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?`` or ``#``. Null or no ``://``: both empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    return df.withColumns({"host": ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def rule_table(spark: SparkSession, rules: Sequence[Rule], prefix_bytes: int) -> DataFrame:
    """One row a rule: its expression's full digest, the digest's first bytes, and its rank (longer expressions first, then longer hosts, then block)."""
    for r in rules:
        if (r.path and not r.path.startswith("/")) or r.verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {r}")
    rows = [(r.verdict, r.host, r.path) for r in rules]
    df = spark.createDataFrame(rows, "rule_verdict string, rule_host string, rule_path string")
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(rule), F.length("rule_host"), (F.col("rule_verdict") == "block").cast("int"))
    return df.select(rule.alias("rule"), "rule_verdict", rank.alias("rank"), F.sha2(rule, 256).alias("digest")).withColumn("short", F.substring("digest", 1, 2 * prefix_bytes))


def judge_urls(df: DataFrame, rules: Sequence[Rule], url_col: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """A row for each row of df: ``keep``, host, path, rule (null where none fits) and verdict (the rule's, else ``default``).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins. What rules can tell apart
    of a URL is its host and as many first characters of the path as the longest rule path has; each such distinct
    pair is expanded once, into the suffixes with as many labels as some rule's host has and the prefixes as long as some rule's path.
    The expansions meet the rules by the first bytes of SHA-256, and full digests confirm. No row is grouped by its id, so
    null or repeated ids and repeated rows stay as they are. Other columns of df are not read, so clashing names do no harm.
    An empty table gives an empty table; an empty list of rules gives every row the default.
    """
    pages = url_parts(df.select(*keep, F.col(url_col).alias("_url")), "_url").drop("_url")
    if not rules:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    depths = sorted({r.host.count(".") + 1 if r.host else 0 for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    pages = pages.withColumn("_start", F.substring("path", 1, lengths[-1]))
    hosts = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) if n else F.lit("") for n in depths]))
    starts = F.array_compact(F.array(*[F.when(F.length("_start") >= n, F.substring("_start", 1, n)) for n in lengths]))
    expressions = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    best = (
        pages.select("host", "_start").distinct()
        .select("host", "_start", F.explode(expressions).alias("expression"))
        .withColumn("full", F.sha2("expression", 256)).drop("expression")
        .withColumn("short", F.substring("full", 1, 2 * prefix_bytes))
        .join(rule_table(df.sparkSession, rules, prefix_bytes), "short")
        .where(F.col("full") == F.col("digest"))
        .groupBy("host", "_start").agg(F.max_by(F.struct("rule", "rule_verdict"), "rank").alias("_best"))
    )
    return pages.join(best, ["host", "_start"], "left").select(*keep, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.rule_verdict", F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


OP7_SQL = r"""
WITH r(v, h, p) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
n AS (SELECT row_number() OVER () AS i, * FROM s),
m AS (SELECT i, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM n, r
      WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM n LEFT JOIN m USING (i)
"""
