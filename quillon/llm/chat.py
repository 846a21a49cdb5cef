"""Chat formatting by perspective rotation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import named

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, speaker, turn_no, segment, start, content_start, content_end, trained): a row a turn and perspective.

    Every participant but the system is once the assistant; then the others are named users and
    only the participant's own content is trained on. ``start`` and the content's ends are offsets
    in code points in the dialogue rendered for that speaker. Control markers inside texts are
    broken up, so a text cannot open or close a turn.

    Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have a fixed
    order. A null role is the participant "unknown", a null text is empty; a system turn keeps its
    place and is never trained on. Rows without a conversation id belong to none and give nothing,
    as does a conversation that holds system turns only. One shuffle, by conversation.
    """
    rows = turns.select(
        named(conv_col).alias("conv_id"),
        named(turn_col).alias("turn"),
        F.coalesce(named(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(named(text_col).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    ).where("conv_id is not null")
    talk = Window.partitionBy("conv_id")
    cast = F.collect_set(F.when(F.col("role") != SYSTEM, F.col("role"))).over(talk)
    rows = rows.withColumn("speaker", cast).withColumn("speaker", F.explode("speaker"))
    name = F.regexp_replace(F.replace("role", F.lit("<|"), F.lit("< |")), r"[\r\n]", " ")
    head = F.when(F.col("role") == SYSTEM, F.lit(SYSTEM)).when(F.col("role") == F.col("speaker"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name))
    rows = rows.withColumn("head", F.concat(F.lit(START), head, F.lit("\n")))
    rows = rows.withColumn("segment", F.concat("head", "text", F.lit(f"{END}\n")))
    order = Window.partitionBy("conv_id", "speaker").orderBy(F.asc_nulls_first("turn"), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.length("segment").cast("long")).over(upto) - F.length("segment")
    out = rows.withColumn("turn_no", F.row_number().over(order)).withColumn("start", start)
    first = F.col("start") + F.length("head")
    return out.select("conv_id", "speaker", "turn_no", "segment", "start", first.alias("content_start"), (first + F.length("text")).alias("content_end"), (F.col("role") == F.col("speaker")).alias("trained"))


def render(turns: DataFrame, **columns) -> DataFrame:
    """(conv_id, speaker, n_turns, text, mask): the dialogue as each participant's, and the trained spans.

    ``mask`` is an array of (start, end) in code points, end exclusive, in order.
    """
    parts = perspectives(turns, **columns)
    cells = F.array_sort(F.collect_list(F.struct("turn_no", "segment", "content_start", "content_end", "trained")))
    out = parts.groupBy("conv_id", "speaker").agg(cells.alias("cells"))
    spans = F.transform(F.filter("cells", lambda c: c["trained"]), lambda c: F.struct(c["content_start"].alias("start"), c["content_end"].alias("end")))
    return out.select("conv_id", "speaker", F.size("cells").cast("long").alias("n_turns"), F.array_join(F.transform("cells", lambda c: c["segment"]), "").alias("text"), spans.alias("mask"))


def chat_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, speaker, n_turns, n_chars, n_trained, text_sha256, mask) of every perspective."""
    out = render(turns)
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    trained = F.aggregate("mask", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("conv_id", "speaker", "n_turns", F.length("text").cast("long").alias("n_chars"), trained.alias("n_trained"), F.sha2("text", 256).alias("text_sha256"), mask.alias("mask"))


CHAT_SQL = r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
        FROM conversations WHERE conv_id IS NOT NULL),
    s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
    h AS (
        SELECT t.conv_id, speaker, turn, role, text, '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || regexp_replace(replace(role, '<|', '< |'), '[\r\n]', ' ', 'g') END || chr(10) AS head
        FROM t JOIN s ON t.conv_id = s.conv_id),
    n AS (
        SELECT *, row_number() OVER o AS no, sum(length(head) + length(text) + 11) OVER (o ROWS UNBOUNDED PRECEDING) - length(text) - 11 AS a
        FROM h WINDOW o AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text))
    SELECT conv_id, speaker, count(*) AS n_turns, CAST(sum(length(head) + length(text) + 11) AS BIGINT) AS n_chars,
           CAST(sum(CASE WHEN role = speaker THEN length(text) ELSE 0 END) AS BIGINT) AS n_trained,
           sha256(string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY no)) AS text_sha256,
           string_agg(CASE WHEN role = speaker THEN CAST(a AS BIGINT) || ':' || CAST(a + length(text) AS BIGINT) END, ',' ORDER BY no) AS mask
    FROM n GROUP BY conv_id, speaker"""
