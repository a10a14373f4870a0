"""Seeded conversation-level train/test split.

Contract kept from the source: conversation level, deterministic for a seed,
exactly ``int(n * train_frac)`` train conversations, disjoint and complete.
Members are chosen by ``md5('<seed>:<id>')`` order instead of a Mersenne
shuffle (which needs every id in one process).

No single-partition window: ids are counted per 4-hex-digit hash bucket
(at most 65,536 rows, broadcast with that proven bound), a running count
over buckets gives each bucket's offset, and ids are ranked only inside
their own bucket.  Global rank = offset + rank in bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SPLIT_SEED, TRAIN_FRAC

BUCKET_HEX = 4  # 16**4 = 65,536 buckets at most


def split_ids(ids: DataFrame, key: str = "conv_id", train_frac: float = TRAIN_FRAC,
              seed: int = SPLIT_SEED, materialize: bool = True) -> DataFrame:
    """``key, split`` with split in {'train', 'test'} for each distinct id.

    The assignment is read by several consumers (semi/anti joins, checks), so by
    default it is written once to the shared checkpoint folder (eager) and every
    consumer reads that, instead of re-deriving the ranking each time."""
    test_frac = 1.0 - train_frac
    if not 0.0 < test_frac < 1.0:
        raise ValueError(f"train_frac must leave rows on both sides, got {train_frac}")
    keep = 1.0 - test_frac  # the same float expression as the source (Q23)
    d = ids.select(key).distinct().filter(F.col(key).isNotNull())
    d = d.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    d = d.withColumn("_b", F.substring("_h", 1, BUCKET_HEX))
    buckets = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"))
    every = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = buckets.select("_b", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                          F.floor(F.sum("_cnt").over(every).cast("double") * F.lit(keep))
                          .cast("long").alias("_cut"))
    ranked = d.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h")))
    j = ranked.join(F.broadcast(offs), "_b")
    out = j.select(key, F.when(F.col("_off") + F.col("_r") <= F.col("_cut"), "train")
                   .otherwise("test").alias("split"))
    if materialize:
        from ..session import cut_lineage
        out = cut_lineage(out)
    return out


def split_rows(rows: DataFrame, splits: DataFrame, key: str = "conv_id"):
    """(train rows, test rows).  Rows without an id belong to neither side."""
    side = lambda name: splits.filter(F.col("split") == name).select(key)
    return rows.join(side("train"), key, "left_semi"), rows.join(side("test"), key, "left_semi")


def split_check(all_ids: DataFrame, splits: DataFrame, key: str = "conv_id") -> DataFrame:
    """O3: train ∩ test = ∅ and train ∪ test = all; one row of four counts."""
    tr = splits.filter(F.col("split") == "train").select(key)
    te = splits.filter(F.col("split") == "test").select(key)
    allk = all_ids.select(key).filter(F.col(key).isNotNull()).distinct()
    overlap = tr.intersect(te).agg(F.count(F.lit(1)).alias("n_overlap"))
    missing = allk.exceptAll(tr.unionByName(te)).agg(F.count(F.lit(1)).alias("n_missing"))
    counts = splits.agg(F.count_if(F.col("split") == "train").alias("n_train"),
                        F.count_if(F.col("split") == "test").alias("n_test"))
    return counts.crossJoin(overlap).crossJoin(missing)
