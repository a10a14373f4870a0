"""From labelled rows or dialogue exports to SFT samples: S4/S5 -> L3 -> W2 -> F5 -> X17/X10."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SPLIT_SEED, TRAIN_FRAC
from ..functions.chat import chat_text
from ..functions.text import strip_tags_dataset
from .samples import full_windows, sft_samples
from .split import split_ids


def conversation_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id string, turn, role, text)`` from ``labelled_rows_to_turns`` or ``read_dialogue_rows``.

    Rows without a transcript column are one conversation, whose id is the empty string.  Of the file's
    own ids those that could be generated ones (digits, perhaps after ``#``) get a leading ``#``: the two kinds never meet."""
    key, pos = ("transcript_id", "pos") if "transcript_id" in rows.columns else ("id", "turn")
    conv = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if "id_generated" in rows.columns:
        conv = F.when(~F.col("id_generated") & conv.rlike("^#*[0-9]+$"), F.concat(F.lit("#"), conv)).otherwise(conv)
    return rows.select(conv.alias("conv_id"),
                       F.col(pos).cast("long").alias("turn"), "role", "text")


def prepare_sft(turns: DataFrame, windows: Sequence[int] = (1, 2, 5), require_full_window: bool = False,
                train_frac: float = TRAIN_FRAC, seed: int = SPLIT_SEED) -> DataFrame:
    """Samples of every window size with their split and rendered text:
    ``conv_id, turn, window_size, messages, split, text``.

    Whole conversations go to one side.  All of them are split, also those that give no sample, so the sides
    do not depend on the windows asked for.  ``turns`` has normalised roles; its positions may have gaps."""
    samples = sft_samples(turns, windows)
    if require_full_window:
        samples = full_windows(samples)
    sides = split_ids(turns.select("conv_id"), train_frac=train_frac, seed=seed)
    return samples.join(sides, "conv_id").withColumn("text", strip_tags_dataset(chat_text("messages")))
