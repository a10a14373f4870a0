"""Turn rows <-> dialogue documents (K1/S3 shapes, A4 grouping, X5/X6 rows)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TEXT_COLUMNS, TRANSCRIPT_SPEAKERS
from ..functions.text import first_text, interlocutor_role, with_clean_text
from .ordered import DEFAULT_BLOCK, dense_position


def render_dialogue(turns: DataFrame, line: Column, sep: str, key: str = "conv_id",
                    pos: str = "turn", out: str = "dialogue", carry: Sequence[str] = ()) -> DataFrame:
    """One document per conversation: ``line`` of each turn in position order,
    joined by ``sep``.  The conversation is the unit of the document format, so
    this aggregates per key (hash partial aggregation does not apply to lists;
    rows are shuffled once by key).  ``carry``: columns of the conversation, taken from its first turn."""
    first = F.min(F.struct(F.col(pos).alias("_p"), *carry)).alias("_first")
    return (turns.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("l"))))
                 .alias("_lines"), *([first] if carry else []))
            .select(key, *[F.col(f"_first.`{c}`") for c in carry], F.array_join(F.transform("_lines", lambda x: x["l"]), sep).alias(out)))


def transcript_lines(turns: DataFrame) -> DataFrame:
    """K1 rows: drop system/unknown roles (F7), speaker label, cleaned text (X7),
    and the ``'Speaker: text\\n\\n'`` line that the transcript file is made of."""
    speakers = F.create_map(*[x for k, v in TRANSCRIPT_SPEAKERS.items() for x in (F.lit(k), F.lit(v))])
    t = turns.withColumn("speaker", F.try_element_at(speakers, F.col("role"))) \
        .filter(F.col("speaker").isNotNull())
    t = with_clean_text(t, "text", "clean")
    return t.withColumn("line", F.concat("speaker", F.lit(": "), "clean", F.lit("\n\n")))


def labelled_rows_to_turns(df: DataFrame, block: int = DEFAULT_BLOCK,
                           quality_filter: bool = True) -> DataFrame:
    """A4 + F1 + W9 + X5 + X6 on labelled CSV rows.

    * F1: keep ``lower(mi_quality) == 'high'`` when the column exists.
    * groups by ``transcript_id`` (null ids dropped, Q17), or one group without it;
    * position by ``utterance_id`` (nulls last), ties by ``input_pos`` when present;
    * role from ``interlocutor``; text = first non-null text column, else ''.

    Returns turn rows ``transcript_id, pos, role, text`` — the grouped lists of the
    source are a view over these (``collect_list`` only at a sink).
    """
    cols = set(df.columns)
    if quality_filter and "mi_quality" in cols:
        df = df.filter(F.lower(F.col("mi_quality").cast("string")) == "high")
    tid = F.col("transcript_id") if "transcript_id" in cols else F.lit(None).cast("string")
    if "transcript_id" in cols:
        df = df.filter(F.col("transcript_id").isNotNull())
    role = interlocutor_role(F.col("interlocutor") if "interlocutor" in cols else F.lit(None))
    text = first_text(*[c for c in TEXT_COLUMNS if c in cols])
    order = []
    if "utterance_id" in cols:
        order.append(F.col("utterance_id").asc_nulls_last())
    if "input_pos" in cols:
        order.append(F.col("input_pos"))
    if not order:
        raise ValueError("need utterance_id or input_pos to order turns")
    # nulls sort last, in the order of the input
    by = F.col("input_pos") if "input_pos" in cols else F.lit(0)
    if "utterance_id" in cols:
        by = F.coalesce(F.col("utterance_id").cast("long"), F.lit(1 << 61) + by)
    base = df.select(tid.cast("string").alias("transcript_id"), role.alias("role"),
                     text.alias("text"), *[c for c in ("utterance_id", "input_pos") if c in cols])
    ranked = dense_position(base, ["transcript_id"], order, by, out="pos", block=block)
    return ranked.select("transcript_id", "pos", "role", "text")
