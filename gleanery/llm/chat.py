"""Chat formatting: every participant's view of a dialogue, with masks of what that participant says. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import materialize

BEGIN, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _speaker(name: Column) -> Column:
    """A name that fits on the one line of a head: marks are broken, control characters and runs of white space are one space; without any name ``unknown``."""
    plain = F.btrim(F.regexp_replace(F.replace(F.coalesce(name, F.lit("")), F.lit("<|"), F.lit("< |")), r"[\x00-\x20\x7F]+", " "))
    return F.when(plain == "", "unknown").otherwise(plain)


def rotate_perspectives(messages: DataFrame, speaker: str = "role", part_turns: int | None = None) -> DataFrame:
    """conv_id, perspective, part, n_messages, rendered and mask: the dialogue as each participant would learn it.

    ``messages`` has conv_id, turn, text and the column ``speaker``. Participants are a conversation's distinct
    speakers but ``system``. In a participant's view their messages are the assistant's, system messages stay, all
    others are users named by their speaker. mask lists the learnt spans of rendered, the participant's own texts
    with their end mark, as ``start-end`` in code points, comma-separated (empty where there is none).

    A dialogue is one row for each participant (part 0), whatever its length. ``part_turns`` asks for parts instead:
    part p covers that many turn numbers from p times as many on, for dialogues that no one row should hold.
    Messages are ordered by turn, speaker and text. Rows that repeat another exactly are one message. A null turn
    comes first (it counts as -1), a null text is empty, rows with a null conv_id are one conversation. Marks inside
    a text or a name are broken by a space; control characters and line ends in a name become one space, and a null
    or blank name is the user ``unknown``. Other columns are ignored. The result has participants times messages, as
    the method asks: a dialogue of thousands of speakers is that many times as long.
    """
    safe = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    told = messages.select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), _speaker(F.col(speaker)).alias("who"), safe.alias("said")).distinct()
    told = materialize(told, "messages")
    views = materialize(told.where(F.col("who") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("who").alias("perspective")).distinct(), "participants")
    seen = told.join(views, told["conv_id"].eqNullSafe(views["c"])).drop("c")
    head = F.when(F.col("who") == F.col("perspective"), f"{BEGIN}assistant\n").when(F.col("who") == SYSTEM, f"{BEGIN}system\n").otherwise(F.concat(F.lit(f"{BEGIN}user name="), "who", F.lit("\n")))
    line = F.struct("turn", "who", "said", head.alias("head"), (F.col("who") == F.col("perspective")).alias("own"))
    part = F.floor(F.col("turn") / part_turns).cast("long") if part_turns else F.lit(0).cast("long")
    parts = seen.groupBy("conv_id", "perspective", part.alias("part")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    rendered = F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["said"], F.lit(f"{END}\n"))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(state, x):
        begin = state["at"] + F.char_length(x["head"])
        end = begin + F.char_length(x["said"]) + len(END)
        span = F.concat_ws("-", begin.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(x["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    mask = F.array_join(F.aggregate("lines", start, add)["spans"], ",")
    return parts.select("conv_id", "perspective", "part", F.size("lines").cast("long").alias("n_messages"), rendered.alias("rendered"), mask.alias("mask"))


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation, whole, from each participant's side."""
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP5_SQL = rf"""
WITH m AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(nullif(trim(regexp_replace(replace(coalesce(role, ''), '<|', '< |'), '[\x00-\x20\x7F]+', ' ', 'g')), ''), 'unknown') AS who, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS perspective FROM m WHERE who <> '{SYSTEM}'),
s AS (SELECT m.conv_id, perspective, 0::BIGINT AS part, turn, who, said, who = perspective AS own,
  CASE WHEN who = perspective THEN '{BEGIN}assistant' WHEN who = '{SYSTEM}' THEN '{BEGIN}system' ELSE '{BEGIN}user name=' || who END || chr(10) AS head
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(said) + {len(END) + 1}) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, who, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS begin_ FROM s)
SELECT conv_id, perspective, part, count(*) AS n_messages, string_agg(head || said || '{END}' || chr(10), '' ORDER BY turn, who, said) AS rendered,
  coalesce(string_agg(begin_ || '-' || (begin_ + length(said) + {len(END)}), ',' ORDER BY turn, who, said) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""
