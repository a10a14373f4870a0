"""Conversation end detection replayed over recorded turns.

At each patient (user) turn the doctor shows a judge the last few messages
*before* that turn (Q11), gets a verdict, and keeps a streak of consecutive
"yes" verdicts; the conversation ends after the reply that follows the first
check whose streak reaches 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (DOCTOR_INSIST, END_CHECK_HEADER, END_CHECK_SPEAKERS, END_CHECK_TAIL,
                         END_STREAK, MAX_TURNS)
from ..functions.text import py_strip
from .ordered import DEFAULT_BLOCK, Blocks, lookback, order_blocks


def end_check_prompts(turns: DataFrame, tail: int = END_CHECK_TAIL,
                      block: int = DEFAULT_BLOCK) -> DataFrame:
    """``conv_id, turn, prompt`` for every user turn.  The tail is the
    ``tail`` messages before the turn; system messages count toward it but
    are not shown; the header runs straight into the first line."""
    framed = lookback(turns, ["conv_id"], "turn", tail, ["turn", "role", "text"], out="tail",
                      include_current=False, block=block)
    users = framed.filter(F.col("role") == "user")
    labels = F.create_map(*[x for k, v in END_CHECK_SPEAKERS.items() for x in (F.lit(k), F.lit(v + ": "))])
    shown = F.filter("tail", lambda m: F.try_element_at(labels, m["role"]).isNotNull())
    body = F.array_join(F.transform(shown, lambda m: F.concat(
        F.try_element_at(labels, m["role"]), py_strip(m["text"]), F.lit("\n"))), "")
    return users.select("conv_id", "turn", F.concat(F.lit(END_CHECK_HEADER), body).alias("prompt"))


def end_streaks(checks: DataFrame, verdict: str = "verdict", block: int = DEFAULT_BLOCK) -> DataFrame:
    """streak = consecutive yes verdicts ending at each check (reset on no; a null verdict has streak 0
    and resets nothing).

    ``cy`` = count of yes so far, ``z`` = ``cy`` at the last no; streak = cy - z.  Both are windows of one
    exchange.  A block of a large conversation is summed up as (yes, yes up to its last no), from which the
    streak that enters the next block follows.
    """
    yes = F.col(verdict).cast("boolean")
    b = order_blocks(checks, ["conv_id"], F.col("turn"), block)
    w = b.window("turn").rowsBetween(Window.unboundedPreceding, 0)
    d = b.df.withColumn("_cy", F.sum(F.when(yes, 1).otherwise(0).cast("long")).over(w))
    d = d.withColumn("_z", F.max(F.when(~yes, F.col("_cy"))).over(w))
    before = F.lit(0)
    if b.hot:
        ends = Blocks(d, b.by, True).summaries(F.max("_cy").alias("_n"), F.max("_z").alias("_no"))
        ends = ends.withColumn("_so_far", F.coalesce(F.sum("_n").over(b.earlier()), F.lit(0)))
        ends = ends.withColumn("_in", F.col("_so_far") - F.coalesce(F.max(F.col("_so_far") + F.col("_no")).over(b.earlier()), F.lit(0)))
        d = b.carried(d, ends.select(*b.by, "_in"))
        before = F.coalesce("_in", F.lit(0))
    streak = F.when(yes, F.col("_cy") - F.coalesce(F.col("_z"), -before)).otherwise(F.lit(0))
    return b.done(d.withColumn("streak", streak.cast("long")).drop("_cy", "_z", "_in"))


def end_points(streaks: DataFrame, threshold: int = END_STREAK) -> DataFrame:
    """First check turn whose streak reaches ``threshold`` (per conversation)."""
    return streaks.groupBy("conv_id").agg(
        F.min(F.when(F.col("streak") >= threshold, F.col("turn"))).alias("end_turn"))


def truncate_at_end(turns: DataFrame, streaks: DataFrame, threshold: int = END_STREAK,
                    max_turns: int = MAX_TURNS, insist: str = DOCTOR_INSIST,
                    block: int = DEFAULT_BLOCK) -> DataFrame:
    """W6 + W7: keep turns up to the reply of the ending exchange and at most
    ``max_turns`` exchanges; at streak 1 the following reply gets ``"\\n" + insist``.

    Returns the kept turn rows with ``text`` rewritten and ``insisted`` flag.
    """
    # turns and streaks lie in one ordered table, so the turns are exchanged once
    checks = streaks.select("conv_id", "turn", F.col("streak").alias("_streak"))
    both = turns.withColumn("_turn", F.lit(True)).unionByName(checks, allowMissingColumns=True)
    b = order_blocks(both, ["conv_id"], F.col("turn"), block)
    d = b.df.withColumn("_end", F.min(F.when(F.col("_streak") >= threshold, F.col("turn"))).over(Window.partitionBy(*b.by)))
    one = F.max(F.when(F.col("_streak") == 1, F.col("turn")))
    upto = b.window("turn").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("exchange", F.coalesce(F.sum(F.when(F.col("_turn") & (F.col("role") == "user"), 1).otherwise(0).cast("long")).over(upto), F.lit(0)))
    d = d.withColumn("_one", one.over(b.window("turn").rangeBetween(Window.unboundedPreceding, -1)))
    if b.hot:
        cuts = Blocks(d, b.by, True).summaries(F.min("_end").alias("_e"), F.max("exchange").alias("_x"), one.alias("_o"))
        cuts = cuts.select(*b.by, F.min("_e").over(b.whole_key()).alias("_e"), F.sum("_x").over(b.earlier()).alias("_x"),
                           F.max("_o").over(b.earlier()).alias("_o"))
        d = b.carried(d, cuts)
        d = d.withColumn("_end", F.coalesce("_e", "_end")).withColumn("_one", F.greatest("_one", "_o"))
        d = d.withColumn("exchange", F.col("exchange") + F.coalesce("_x", F.lit(0))).drop("_e", "_x", "_o")
    d = b.done(d.where("_turn").drop("_turn", "_streak").withColumnRenamed("_end", "end_turn"))
    kept = d.filter((F.col("end_turn").isNull() | (F.col("turn") <= F.col("end_turn") + 1))
                    & (F.col("exchange") <= max_turns)).withColumn("insisted", F.col("_one") == F.col("turn") - 1).drop("_one")
    insisted = F.coalesce(F.col("insisted"), F.lit(False)) & (F.col("role") == "assistant")
    return kept.withColumn("insisted", insisted).withColumn(
        "text", F.when(F.col("insisted"), F.concat("text", F.lit("\n" + insist))).otherwise(F.col("text")))
