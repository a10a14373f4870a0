"""Rolling-window samples.

Input is the turn table ``(conv_id, turn, role, text)``; ``turn`` orders a conversation and may
have gaps, as frames count rows.  One framed pass at the largest
window serves every window size (W2): the frame is computed once and sliced.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SFT_SYSTEM_PROMPT
from ..functions.text import normalize_role, py_strip, sample_role
from .ordered import DEFAULT_BLOCK, lookback

MSG = "array<struct<role:string,content:string>>"


def _msg(role, content):
    return F.struct(role.alias("role"), content.alias("content"))


def normalized_turns(turns: DataFrame, conv: str = "conv_id", pos: str = "turn",
                     role: str = "role", text: str = "text") -> DataFrame:
    """Turn rows with X1-normalised roles (system and unknown roles become user, Q4)."""
    return turns.select(F.col(conv).alias("conv_id"), F.col(pos).alias("turn"),
                        normalize_role(role).alias("role"), F.col(text).alias("text"))


def sft_samples(turns: DataFrame, windows: Sequence[int] = (5,),
                system_prompt: str = SFT_SYSTEM_PROMPT, block: int = DEFAULT_BLOCK) -> DataFrame:
    """W1/W2 + F4 + X25: one sample per user->assistant pair and window size.

    Returns ``conv_id, turn (target), window_size, messages ARRAY<STRUCT<role,content>>``
    where messages = [system] + up to w turns before the target + the target.
    ``turns`` must already carry normalised roles (see ``normalized_turns``).
    """
    if not windows or min(windows) < 1:
        raise ValueError("window sizes must be >= 1 (Q15)")
    wmax = max(windows)
    framed = lookback(turns, ["conv_id"], "turn", wmax, ["turn", "role", "text"],
                      out="frame", block=block)
    n = F.size("frame")
    targets = framed.filter((F.col("role") == "assistant") & (n >= 2)
                            & (F.try_element_at("frame", F.lit(-2))["role"] == "user"))
    out = targets.select("conv_id", "turn", "frame",
                         F.explode(F.array(*[F.lit(int(w)) for w in sorted(set(windows))]))
                         .alias("window_size"))
    k = F.least(F.size("frame"), F.col("window_size") + 1)
    ctx = F.slice("frame", -k, k)
    body = F.transform(F.slice(ctx, 1, k - 1),
                       lambda m: _msg(sample_role(m["role"]), py_strip(m["text"])))
    target = _msg(F.lit("assistant"), py_strip(F.try_element_at(ctx, F.lit(-1))["text"]))
    messages = F.concat(F.array(_msg(F.lit("system"), F.lit(system_prompt))), body,
                        F.array(target)).cast(MSG)
    return out.select("conv_id", "turn", "window_size", messages.alias("messages"))


def full_windows(samples: DataFrame) -> DataFrame:
    """keep samples whose context holds exactly ``window_size`` turns."""
    return samples.filter(F.size("messages") - 2 == F.col("window_size"))


def explode_messages(samples: DataFrame) -> DataFrame:
    """One row per message: ``conv_id, turn, window_size, pos, role, content``."""
    return samples.select("conv_id", "turn", "window_size",
                          F.posexplode("messages").alias("pos", "m")) \
        .select("conv_id", "turn", "window_size", F.col("pos").cast("long").alias("pos"),
                F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def inference_contexts(turns: DataFrame, w: int, block: int = DEFAULT_BLOCK) -> DataFrame:
    """W3 + F2: at each user turn, [first system message] + the last ``w``
    non-system messages ending with that user message (Q16).

    ``turns`` carries raw roles (system/user/assistant).  The frame counts the non-system rows alone.
    """
    if w < 1:
        raise ValueError("window size must be >= 1 (Q15)")
    ns = turns.filter(F.col("role") != "system")
    framed = lookback(ns, ["conv_id"], "turn", w - 1, ["turn", "role", "text"], out="frame", block=block)
    users = framed.filter(F.col("role") == "user")
    system = (turns.filter(F.col("role") == "system").groupBy("conv_id")
              .agg(F.min_by("text", "turn").alias("system_text")))
    joined = users.join(system, "conv_id", "left")
    sys_arr = F.when(F.col("system_text").isNull(), F.array().cast(MSG)) \
        .otherwise(F.array(_msg(F.lit("system"), F.col("system_text"))).cast(MSG))
    body = F.transform("frame", lambda m: _msg(m["role"], m["text"]))
    return joined.select("conv_id", "turn", F.lit(int(w)).alias("window_size"),
                         F.concat(sys_arr, body).cast(MSG).alias("messages"))


def prompt_target(samples: DataFrame) -> DataFrame:
    """Last assistant message is the target; the rest is the prompt."""
    last = F.try_element_at("messages", F.lit(-1))
    is_asst = (F.size("messages") > 0) & (last["role"] == "assistant")
    return samples.withColumn("prompt_messages",
                              F.when(is_asst, F.slice("messages", 1, F.size("messages") - 1))
                              .otherwise(F.col("messages"))) \
        .withColumn("target", F.when(is_asst, last["content"]).otherwise(F.lit("")))


def eval_pick(samples: DataFrame, n: int, window_size: int | None = None) -> DataFrame:
    """F6 + L2: full windows of the given size, first ``n`` by (conv_id, turn), empty ones skipped.

    ``orderBy().limit()`` plans as a distributed top-k (TakeOrderedAndProject).
    """
    s = samples
    if window_size is not None:
        s = s.filter((F.col("window_size") == window_size)
                     & (F.size("messages") - 2 == window_size))
    # the first n are picked first; an empty one among them is skipped, not replaced
    return s.orderBy("conv_id", "turn", "window_size").limit(n).filter(F.size("messages") > 0)
