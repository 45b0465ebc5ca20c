"""Chat preference formatting, in DataFrame functions only.

Input: two turn tables ``(pair_id, turn, role, text)``, chosen and rejected. The longest common
prefix of turns (equal turn, role and text) is rendered once as the prompt; the turns after it
become the chosen and the rejected completion. The result has one row per rendered turn (the texts
of a part are its rows in the order of turns; they are not joined), so a conversation of any length
is spread over tasks: no group is gathered. ``loss_start``/``loss_end`` mark the characters of ``rendered`` that count in the loss (assistant turns of a completion, from
the content to the end mark); both are 0 where the whole segment is masked.

Null texts and roles count as empty. Null turns come after all others. Of several rows for one
turn the smallest (role, text) counts, so repeated rows change nothing. A pair present on one side
only has an empty prompt and all its turns as that side's completion. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
NO_TURN = 2 ** 62


def _turns(df: DataFrame, side: str) -> DataFrame:
    turn = F.struct(F.coalesce(F.col("role"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return (df.select("pair_id", F.coalesce(F.col("turn").cast("bigint"), F.lit(NO_TURN)).alias("turn"), turn.alias("t"))
            .groupBy("pair_id", "turn").agg(F.min("t").alias(side)))


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``(pair_id, part, turn, role, rendered, loss_start, loss_end)`` with part in
    prompt, chosen, rejected."""
    both = _turns(chosen, "c").join(_turns(rejected, "r"), ["pair_id", "turn"], "full")
    same = F.col("c").isNotNull() & F.col("r").isNotNull() & (F.col("c") == F.col("r"))
    differs = both.where(~F.coalesce(same, F.lit(False))).groupBy("pair_id").agg(F.min("turn").alias("first_diff"))
    placed = both.join(differs, "pair_id", "left")
    shared = F.col("first_diff").isNull() | (F.col("turn") < F.col("first_diff"))
    parts = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("t")))).otherwise(
        F.filter(F.array(F.struct(F.lit("chosen").alias("part"), F.col("c").alias("t")),
                         F.struct(F.lit("rejected").alias("part"), F.col("r").alias("t"))),
                 lambda x: x["t"].isNotNull()))
    rows = placed.select("pair_id", "turn", F.explode(parts).alias("p"))
    head = F.concat(F.lit(START), F.col("p.t.role"), F.lit("\n"))
    rendered = F.concat(head, F.col("p.t.text"), F.lit(END + "\n"))
    learns = (F.col("p.part") != "prompt") & (F.col("p.t.role") == "assistant")
    return rows.select(
        "pair_id", F.col("p.part").alias("part"), "turn", F.col("p.t.role").alias("role"), rendered.alias("rendered"),
        F.when(learns, F.length(head)).otherwise(0).cast("bigint").alias("loss_start"),
        F.when(learns, F.length(rendered) - 1).otherwise(0).cast("bigint").alias("loss_end"))


def pairs_from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations: a conversation up to its last assistant
    turn is chosen; the rejected one ends with the last assistant turn of its neighbour (the id
    with the lowest bit flipped; empty when there is none). As in the query's SQL, conversations
    without an assistant turn, turns behind the last assistant turn and null turns are left out."""
    t = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = (t.where(F.col("role") == "assistant").groupBy("pair_id")
            .agg(F.max(F.struct("turn", "text")).alias("last")))
    answer = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("other"))
    ends = last.join(answer, "pair_id", "left").select(
        "pair_id", F.col("last.turn").alias("end"), F.coalesce("other", F.lit("")).alias("other"))
    upto = t.join(ends.select("pair_id", "end"), "pair_id")
    chosen = upto.where("turn <= end").select("pair_id", "turn", "role", "text")
    rejected = (upto.where("turn < end").select("pair_id", "turn", "role", "text")
                .union(ends.select("pair_id", F.col("end").alias("turn"), F.lit("assistant").alias("role"),
                                   F.col("other").alias("text"))))
    return chosen, rejected
