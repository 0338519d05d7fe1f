"""Preference formatting of conversations (built-in functions only).

Conversations that open with the same turn are alternatives for one prompt. Two of them make a pair; the
longest common prefix of their turns is rendered once, as prompt, and the turns after it are the chosen and
the rejected completion, with a mask that is 1 on assistant turns.

Output and work are by turn, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorwise.llm.common import stored

LAST = (1 << 63) - 1


def render(role: Column, text: Column) -> Column:
    """One turn; the opening of a mark inside a text is broken up so that no text can forge a turn."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def clean_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text without repeated rows; a null turn comes last, a null role or text is empty, rows without conversation are left out."""
    return (
        turns.filter(F.col(f"`{conv_col}`").isNotNull())
        .select(
            F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
            F.coalesce(F.col(f"`{turn_col}`").cast("long"), F.lit(LAST)).alias("turn"),
            F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        )
        .distinct()
    )


def preference_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected (conversation ids) from clean turns.

    Conversations of the same opening turn are paired in the order of their ids, first with second, third with
    fourth. Of a pair the one with more assistant text is chosen, the smaller id of equal ones. The pair_id is
    the smaller id; one left over, at most one of each opening, has a null ``rejected``.

    Conversations are dealt into ranges of (opening, id), so that an opening that many share is numbered in many
    tasks; the ranks inside a range are shifted by the counts of the ranges before it.
    """
    size = F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0))
    convs = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", F.sha2("text", 256).alias("text"))).alias("opening"), size.alias("size"))
    dealt = stored(convs.repartitionByRange("opening", "conv_id").withColumn("range", F.spark_partition_id()))
    earlier = Window.partitionBy("opening").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("opening", "range").agg(F.count("*").alias("n")).select("opening", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("opening", "range").orderBy("conv_id"))
    ranked = dealt.withColumn("inside", inside).join(counts, ["opening", "range"])
    pair = F.floor((F.col("before") + F.col("inside") - 1) / 2).alias("pair")
    one = F.struct("conv_id", "size")
    two = ranked.groupBy("opening", pair).agg(F.min(one).alias("one"), F.max(one).alias("other"))
    alone = F.col("one.conv_id") == F.col("other.conv_id")
    swap = F.col("other.size") > F.col("one.size")
    return two.select(
        F.col("one.conv_id").alias("pair_id"),
        F.when(swap, F.col("other.conv_id")).otherwise(F.col("one.conv_id")).alias("chosen"),
        F.when(alone, None).when(swap, F.col("one.conv_id")).otherwise(F.col("other.conv_id")).alias("rejected"),
    )


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected, part (prompt, chosen or rejected), turn, role, rendered, mask: one row per rendered turn.

    Turns are compared by number, role and text; the prefix ends before the first turn number at which the
    two differ. A conversation without partner has its turns before the first assistant turn as prompt.
    Concatenating ``rendered`` by (turn, role, rendered) gives each part. Null turn numbers come last.
    """
    sides = F.array(F.struct(F.col("chosen").alias("conv_id"), F.lit("chosen").alias("side")), F.struct(F.col("rejected").alias("conv_id"), F.lit("rejected").alias("side")))
    members = pairs.select("pair_id", "chosen", "rejected", F.explode(sides).alias("m")).select("pair_id", "chosen", "rejected", "m.*").filter(F.col("conv_id").isNotNull())
    lines = members.join(turns, "conv_id")
    both = lines.groupBy("pair_id", "chosen", "rejected", "turn", "role", "text").agg(F.min("side").alias("one"), F.max("side").alias("two"))
    both = stored(both)
    alone = F.col("rejected").isNull()
    ends = F.when(alone, F.col("role") == "assistant").otherwise(F.col("one") == F.col("two"))  # only one side has it
    first = both.filter(ends).groupBy("pair_id").agg(F.min("turn").alias("first"))
    after = both.join(first, "pair_id", "left")
    prompt = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    side = F.when(F.col("one") == F.col("two"), F.array("one")).otherwise(F.array(F.lit("chosen"), F.lit("rejected")))
    part = F.explode(F.when(prompt, F.array(F.lit("prompt"))).otherwise(side))
    out = after.select("pair_id", "chosen", "rejected", part.alias("part"), "turn", "role", "text")
    return out.select(
        "pair_id",
        "chosen",
        "rejected",
        "part",
        F.when(F.col("turn") != LAST, F.col("turn")).alias("turn"),
        "role",
        render(F.col("role"), F.col("text")).alias("rendered"),
        ((F.col("part") != "prompt") & (F.col("role") == "assistant")).cast("int").alias("mask"),
    )
