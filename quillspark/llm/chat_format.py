"""Chat formatting by perspective rotation (operator 6).

For every participant of a conversation (every role but ``system``) the dialogue is rendered with that speaker
as the assistant and all others as named users; only the assistant's words are trained on.

Messages are rendered a row each, so a conversation of any length is spread over tasks; ``dialogues`` joins
them where conversations fit in memory. Built-in functions only.

Defined results: a null role is the speaker ``unknown``; rows with a null conv_id form one conversation; null
texts are empty and never trained on; a conversation of system messages only has no perspective; repeated rows
are rendered each; an empty table gives an empty result; markers within texts and names are broken by a space,
and line ends within a name are spaces in its header. In ``dialogues`` messages of one turn stand in order of
their rendered text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"


def rotated(conversations: DataFrame) -> DataFrame:
    """``conv_id, perspective, turn, role, name, rendered, trained, mask_start, mask_end`` for each message and participant.

    mask_start, mask_end: the trained code points of ``rendered`` (end exclusive; equal where none).
    """
    speaker = F.coalesce(F.col("role"), F.lit("unknown"))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    said = conversations.select("conv_id", "turn", speaker.alias("speaker"), text.alias("text"))
    cast = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    each = said.join(cast, F.col("conv_id").eqNullSafe(F.col("_conv")))
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).when(own, "assistant").otherwise("user")
    name = F.when(F.col("role") == "user", F.col("speaker"))
    safe = F.translate(F.replace(F.col("name"), F.lit("<|im_"), F.lit("<| im_")), "\r\n", "  ")
    head = F.concat(F.lit("<|im_start|>"), F.col("role"), F.coalesce(F.concat(F.lit(" name="), safe), F.lit("")), F.lit("\n"))
    out = each.withColumn("role", role).withColumn("name", name).withColumn("rendered", F.concat(head, "text", F.lit("<|im_end|>\n"))).withColumn("trained", own & (F.col("text") != ""))
    start = F.char_length(head)
    end = F.when(F.col("trained"), start + F.char_length("text") + len("<|im_end|>")).otherwise(start)
    return out.select("conv_id", "perspective", "turn", "role", "name", "rendered", "trained", start.alias("mask_start"), end.alias("mask_end"))


def dialogues(conversations: DataFrame) -> DataFrame:
    """``conv_id, perspective, text, masks array<struct<a, b>>``, for conversations that fit in memory."""
    one = F.struct("turn", "rendered", "trained", "mask_start", "mask_end")
    rows = rotated(conversations).groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(one)).alias("m"))
    step = lambda s, x: F.struct((s["n"] + F.char_length(x["rendered"])).alias("n"), F.when(x["trained"], F.concat(s["masks"], F.array(F.struct((s["n"] + x["mask_start"]).alias("a"), (s["n"] + x["mask_end"]).alias("b"))))).otherwise(s["masks"]).alias("masks"))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<a:int,b:int>>").alias("masks"))
    return rows.select("conv_id", "perspective", F.array_join(F.col("m.rendered"), "").alias("text"), F.aggregate("m", start, step)["masks"].alias("masks"))


ORACLE = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations
), actors AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), each AS (
  SELECT s.*, a.perspective,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN actors a ON s.conv_id IS NOT DISTINCT FROM a.conv_id
), named AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name, speaker = perspective AND text <> '' AS trained FROM each
), headed AS (
  SELECT *, '<|im_start|>' || role || coalesce(' name=' || translate(replace(name, '<|im_', '<| im_'), chr(13) || chr(10), '  '), '') || chr(10) AS head FROM named
)
SELECT conv_id, perspective, turn, role, name, head || text || '<|im_end|>' || chr(10) AS rendered, trained,
  CAST(length(head) AS INTEGER) AS mask_start,
  CAST(CASE WHEN trained THEN length(head) + length(text) + 10 ELSE length(head) END AS INTEGER) AS mask_end
FROM headed
"""
