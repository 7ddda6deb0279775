"""Chat formatting by perspective rotation: each participant's view of a dialogue, that speaker as assistant and the others as named users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: How a turn begins and ends.
ASSISTANT, CONTEXT, USER, END = "<|assistant|>\n", "<|system|>\n", "<|user:{}|>\n", "<|end|>\n"

#: Turn numbers in a part. A longer dialogue is several rows, so no row or task has to hold it whole; each later one begins with the context in force and the last turns before it.
PART = 256

#: How many turns of the part before a later part begins with.
OVERLAP = 16


def _header(role: Column, speaker: Column, context: tuple[str, ...]) -> Column:
    before, after = USER.split("{}")
    user = F.concat(F.lit(before), role, F.lit(after))
    return F.when(role == speaker, F.lit(ASSISTANT)).when(role.isin(*context), F.lit(CONTEXT)).otherwise(user)


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context: tuple[str, ...] = ("system",), part: int = PART) -> DataFrame:
    """A row for each conversation, participant and part: conv_id, speaker, part, n_turns, text, spans and mask_chars.

    text is the part of the dialogue as the speaker sees it; spans, an array of (start, end) in code points, are what the model learns: the
    speaker's own turns with their end marks. Roles in ``context`` give context and have no view of their own. Turns are ordered
    by number, then role and text; part p has the numbers from p * PART on. It begins with the last context turn of earlier parts and the participants' last OVERLAP turns of the part before it, as the
    speaker sees them: what is said in a part has something to answer to. These are neither counted in n_turns nor learned, as they are in their own part. Equal turns all stay. Null ids are one
    conversation, null numbers come first, in part 0, null roles are ``unknown``, null texts empty. Without participants there is no
    row. An empty table gives an empty table; other columns are not read.
    """
    turn = F.col(turn_col)
    rows = df.select(F.col(conv_col).alias("conv_id"), turn.alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / part), F.lit(0)).cast("long"))
    one = F.struct("turn", "role", "text")
    speakers = rows.where(~F.col("role").isin(*context)).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(one)).alias("turns"), F.max(F.when(F.col("role").isin(*context), one)).alias("context"))
    # a row for each part: of the longest dialogue a 256th of its turns
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    said = F.filter("turns", lambda t: ~t["role"].isin(*context))
    parts = parts.withColumn("said", F.reverse(F.slice(F.reverse(said), 1, OVERLAP)))
    parts = parts.withColumns({"carried": F.last("context", True).over(earlier), "before": F.lag("said").over(Window.partitionBy("conv_id").orderBy("part"))}).drop("context", "said")
    views = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    piece = lambda t: F.concat(_header(t["role"], F.col("speaker"), context), t["text"], F.lit(END))
    views = views.withColumn("head", F.concat(F.coalesce(piece(F.col("carried")), F.lit("")), F.coalesce(F.array_join(F.transform("before", piece), ""), F.lit(""))))
    views = views.withColumn("pieces", F.transform("turns", lambda t: F.struct((t["role"] == F.col("speaker")).alias("own"), piece(t).alias("text"))))
    none = F.struct(F.length("head").alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p["text"])
        span = F.array(F.struct((a["at"] + len(ASSISTANT)).alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    views = views.withColumn("spans", F.aggregate("pieces", none, step)["spans"])
    masked = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    text = F.concat("head", F.array_join(F.transform("pieces", lambda p: p["text"]), ""))
    return views.select("conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), "spans", masked.alias("mask_chars"))


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).select("conv_id", "speaker", "part", "n_turns", F.sha2("text", 256).alias("text_sha256"), spans.alias("mask_spans"), "mask_chars")


OP2_SQL = """
WITH t AS (SELECT row_number() OVER () AS n, conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, coalesce(floor(turn / 256), 0)::BIGINT AS part FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
c AS (SELECT conv_id, part, last('<|system|>' || chr(10) || text || '<|end|>' || chr(10) ORDER BY turn NULLS FIRST, text) FILTER (role = 'system') AS own FROM t GROUP BY conv_id, part),
g AS (SELECT conv_id, part, lag(part) OVER (PARTITION BY conv_id ORDER BY part) AS before, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS carried FROM c),
q AS (SELECT g.conv_id, g.part, turn, role, text, n, row_number() OVER (PARTITION BY g.conv_id, g.part ORDER BY turn DESC NULLS LAST, role DESC, text DESC, n DESC) AS k FROM g JOIN t ON g.conv_id IS NOT DISTINCT FROM t.conv_id AND g.before = t.part WHERE role <> 'system'),
b AS (SELECT q.conv_id, q.part, speaker, string_agg(CASE WHEN role = speaker THEN '<|assistant|>' ELSE '<|user:' || role || '|>' END || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text, n) AS said
      FROM q JOIN p ON q.conv_id IS NOT DISTINCT FROM p.conv_id WHERE k <= 16 GROUP BY q.conv_id, q.part, speaker),
h AS (SELECT g.conv_id, g.part, p.speaker AS viewer, carried || coalesce(said, '') AS head FROM g JOIN p ON g.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN b ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND g.part = b.part AND p.speaker = b.speaker),
r AS (SELECT t.*, speaker, head, CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user:' || role || '|>' END || chr(10) || text || '<|end|>' || chr(10) AS piece
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id JOIN h ON t.conv_id IS NOT DISTINCT FROM h.conv_id AND t.part = h.part AND speaker = viewer),
o AS (SELECT *, (length(head) + sum(length(piece)) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text, n ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM r)
SELECT conv_id, speaker, part, count(*) AS n_turns, sha256(any_value(head) || string_agg(piece, '' ORDER BY turn NULLS FIRST, role, text, n)) AS text_sha256,
       coalesce(string_agg(CASE WHEN role = speaker THEN (stop - length(piece) + 14) || '-' || stop END, ',' ORDER BY turn NULLS FIRST, role, text, n), '') AS mask_spans,
       coalesce(sum(CASE WHEN role = speaker THEN length(piece) - 14 END), 0)::BIGINT AS mask_chars
FROM o GROUP BY conv_id, speaker, part
"""
