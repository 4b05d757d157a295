"""Preference formatting: the longest common turn prefix of two conversations, rendered once as prompt,
and the two rests as completions with loss masks.

Built-in expressions only.  Turns are gathered per conversation, which is one training example and
so one value of the result; nothing larger is gathered.

Defined cases: turns are ordered by turn, then role, then text, nulls first; a null role or text counts
as empty.  A turn without a conversation id is a conversation of its own.  If one conversation is a
prefix of the other, its completion is empty; if both are equal, both are.  Repeated rows are repeated
turns.  Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomscope.llm.common import text_or_empty, with_next

#: Role whose words carry the loss.
TRAINED = "assistant"


def conversations(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id and turns, an ordered array<struct<role, text>>."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    rows = rows.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t"))
    ordered = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    alone = rows.filter("conv_id IS NULL").select("conv_id", F.array("t").alias("turns"))
    bare = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return ordered.unionByName(alone).select("conv_id", bare.alias("turns"))


def _opening(turn: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), turn["role"], F.lit("\n"))


def _closing() -> Column:
    return F.lit("<|im_end|>\n")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_opening(t), t["text"], _closing())), "")


def loss_spans(turns: Column) -> Column:
    """array<struct<start, stop>>: code points of the rendered turns that carry loss, each with its closing mark."""
    kind = "struct<at:int,spans:array<struct<start:int,stop:int>>>"

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_opening(t))
        stop = start + F.length(t["text"]) + F.length(_closing())
        more = F.when(t["role"] == TRAINED, F.array(F.struct(start.alias("start"), stop.alias("stop")))).otherwise(
            F.array().cast("array<struct<start:int,stop:int>>")
        )
        return F.struct(stop.alias("at"), F.concat(acc["spans"], more).alias("spans")).cast(kind)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")).cast(kind)
    return F.aggregate(turns, zero, step)["spans"]


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns that both share."""
    same = F.zip_with(chosen, rejected, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with columns conv_id, chosen, rejected (arrays of turns) to prompt, completions and masks."""
    cut = pairs.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.expr(f"slice({c}, prompt_turns + 1, greatest(size({c}) - prompt_turns, 0))")
    cut = cut.select(
        "conv_id", F.col("prompt_turns").cast("long").alias("prompt_turns"),
        render(F.expr("slice(chosen, 1, prompt_turns)")).alias("prompt"),
        rest("chosen").alias("chosen"), rest("rejected").alias("rejected"),
    )
    return cut.select(
        "conv_id", "prompt_turns", "prompt",
        render(F.col("chosen")).alias("chosen"), render(F.col("rejected")).alias("rejected"),
        loss_spans(F.col("chosen")).alias("chosen_loss"), loss_spans(F.col("rejected")).alias("rejected_loss"),
    )


def branch(turns: Column) -> Column:
    """Place, from 1, of the last turn that carries loss; the last turn's if none does."""
    from_end = F.array_position(F.transform(F.reverse(turns), lambda t: t["role"] == TRAINED), True)
    return F.when(from_end > 0, F.size(turns) - from_end + 1).otherwise(F.size(turns)).cast("int")


def contrast_pairs(rows: DataFrame) -> DataFrame:
    """One pair per conversation: as it is (chosen), and from its branch on as the next conversation goes from its own (rejected).

    So both sides may have different numbers of turns, and share more turns than those before the branch where
    the next ones agree.  Conversations follow each other by ascending id, the first after the last; one without
    an id is paired with an empty answer.
    """
    convs = conversations(rows).withColumn("branch", branch(F.col("turns")))
    ends = convs.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").alias("next_conv_id"), F.expr("slice(turns, branch, size(turns) - branch + 1)").alias("other")
    )
    order = with_next(rows.select(F.col("conv_id").cast("long").alias("conv_id")), "conv_id")
    other = order.join(ends, "next_conv_id").select("conv_id", "other")
    paired = convs.join(other, "conv_id", "left")
    empty = F.array(F.struct(F.element_at("turns", F.col("branch"))["role"].alias("role"), F.lit("").alias("text")))
    return paired.select(
        "conv_id", F.col("turns").alias("chosen"),
        F.concat(F.expr("slice(turns, 1, branch - 1)"), F.coalesce("other", empty)).alias("rejected"),
    )
