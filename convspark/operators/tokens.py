"""Token statistics and usage accounting (A5, A6, A12, X20, U-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_SEQ_LENGTH
from ..functions.text import pandas_token_counter, word_count  # noqa: F401 (U-4 re-export)
from .ordered import DEFAULT_BLOCK, lookback


def length_stats(df: DataFrame, length_col: str, group_cols=(), limit_over: int = MAX_SEQ_LENGTH,
                 sample_limit: int | None = None, order_cols=(), extra=()) -> DataFrame:
    """A5: count, min, max, mean, median and number over the context per group.

    ``sample_limit`` reproduces the source's first-N sampling (ordered top-N);
    the default is the whole table.  ``median`` is Spark's exact percentile,
    which keeps a value->count map per group (bounded by distinct lengths).  ``extra``
    are further aggregates of the same pass.
    """
    if sample_limit:
        df = df.orderBy(*order_cols).limit(sample_limit)
    L = F.col(length_col)
    aggs = [F.count(L).alias("sample_count"), F.min(L).alias("min_len"), F.max(L).alias("max_len"),
            F.avg(L).alias("mean_len"), F.median(L).alias("median_len"),
            F.count_if(L > limit_over).alias("n_over_max")]
    if sample_limit:
        # the sampled lengths themselves, in sample order (bounded by sample_limit)
        keyed = F.struct(*[F.col(c) for c in order_cols], L.alias("_len")) if order_cols else F.struct(L.alias("_len"))
        aggs.append(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["_len"]).alias("sample_lengths"))
    return df.groupBy(*group_cols).agg(*aggs, *extra)


def request_usage(turns: DataFrame, w: int, block: int = DEFAULT_BLOCK) -> DataFrame:
    """For every assistant turn, the request is the ``w`` turns before it and
    the completion is the turn; usage counts whitespace words like the server."""
    t = turns.withColumn("n_words", word_count("text"))
    framed = lookback(t, ["conv_id"], "turn", w, ["turn", "n_words"], out="req",
                      include_current=False, block=block)
    a = framed.filter(F.col("role") == "assistant")
    prompt = F.aggregate("req", F.lit(0).cast("long"), lambda acc, m: acc + F.coalesce(m["n_words"], F.lit(0)))
    return a.select("conv_id", "turn", prompt.alias("prompt_tokens"),
                    F.col("n_words").alias("completion_tokens"),
                    (prompt + F.col("n_words")).alias("total_tokens"))


def quality_keep(rows: DataFrame, column: str = "mi_quality", observe_name: str | None = "quality_filter"):
    """F1 + A7: keep ``lower(column) == 'high'`` when the column exists (else keep all).

    Kept/total counts are collected in the same pass with ``observe`` (read them
    from the query listener or ``Observation``), not by a second job.
    """
    if column not in rows.columns:
        return rows
    keep = F.lower(F.col(column).cast("string")) == "high"
    if observe_name:
        rows = rows.observe(observe_name, F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("kept"))
    return rows.filter(keep)
