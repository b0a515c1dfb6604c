"""Multi-party perspective rotation of dialogues.

Every participant of a conversation gets the dialogue told with that speaker as the assistant and all
others as named users; system turns stay system turns.  A rendered dialogue is a sequence of segments,
one a turn, each with its place in the whole and the part of it that is trained on: the speaker's own
words and end marker.  Places are sums of the lengths before, taken in two steps - within blocks of
turns, then over the block totals - so a conversation that holds a third of all rows still spreads over
many tasks.  Everything is DataFrame functions.

Defined results: a null text is empty; a null role is ``unknown``; turns go by (turn, role, text), null
turns first; repeated rows are told twice; a conversation of system turns only has no participant and
no rows; control markers within a text are broken up; an empty table gives an empty table; a null
conv_id is a conversation like any other; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BLOCK = 1024


def _turns(conversations: DataFrame) -> DataFrame:
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), text.alias("text"))


def rotate(conversations: DataFrame) -> DataFrame:
    """A row per conversation, perspective and turn, with its text and its places in characters.

    ``segment`` is the rendered turn, at ``start`` of the dialogue; ``mask_start`` and ``mask_end``
    bound what is trained on and are equal where nothing is.
    """
    turns = _turns(conversations)
    parties = turns.filter("role <> 'system'").groupBy("conv_id", "role").agg(F.lit(1).alias("one")).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective"))
    told = turns.join(parties, turns.conv_id.eqNullSafe(parties.of)).drop("of")
    own: Column = F.col("role") == F.col("perspective")
    speaks_as = F.when(F.col("role") == "system", "system").when(own, "assistant").otherwise("user")
    name = F.regexp_replace("role", "[^A-Za-z0-9_-]", "_")
    head = F.concat(F.lit(START), F.when(speaks_as == "user", F.concat(F.lit("user name="), name)).otherwise(speaks_as), F.lit("\n"))
    body = F.concat("text", F.lit(END))
    rows = told.select(
        "conv_id",
        "perspective",
        "turn",
        "role",
        speaks_as.alias("speaks_as"),
        F.concat(head, body, F.lit("\n")).alias("segment"),
        F.length(head).alias("head_length"),
        F.when(own, F.length(body)).otherwise(0).alias("trained"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block"),
    )
    size = F.length("segment").cast("long")
    keys = ["conv_id", "perspective", "block"]
    within = Window.partitionBy(*keys).orderBy("turn", "role", "segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum(size).over(within), F.lit(0)))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(F.sum(size).alias("total")).select(*(F.col(k).alias(f"t_{k}") for k in keys), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("outer"))
    same = placed.conv_id.eqNullSafe(totals.t_conv_id) & (placed.perspective == totals.t_perspective) & (placed.block == totals.t_block)
    start = F.col("outer") + F.col("inner")
    mask = start + F.col("head_length")
    return placed.join(totals, same).select(
        "conv_id", "perspective", "turn", "role", "speaks_as", "segment", start.alias("start"), mask.alias("mask_start"), (mask + F.col("trained")).alias("mask_end")
    )


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), s AS (
  SELECT t.conv_id, perspective, turn, role,
    CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user' END AS speaks_as,
    '{START}' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant'
      ELSE 'user name=' || regexp_replace(role, '[^A-Za-z0-9_-]', '_', 'g') END || chr(10) AS head,
    text || '{END}' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, head || body
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM s
)
SELECT conv_id, perspective, turn, role, speaks_as, head || body || chr(10) AS segment, start,
  start + length(head) AS mask_start,
  start + length(head) + CASE WHEN role = perspective THEN length(body) ELSE 0 END AS mask_end
FROM o
"""
