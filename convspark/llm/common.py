"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_path, cut_lineage
from ..sources.tables import table

__all__ = ["cut_lineage", "written", "load", "text_or_empty", "connected_components"]


def load(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    return df.select(*cols) if cols else df


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back: the lineage is cut as by a
    checkpoint, at a fraction of its bytes for wide rows of numbers.  The table stays there."""
    spark = df.sparkSession
    path = checkpoint_path(spark, f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; ``root`` is the smallest node reachable.

    Alternating large-star and small-star rounds: each node's neighbours are hooked to the
    smallest one.  A round is one grouped minimum plus one join on the node, written to the
    checkpoint folder; it ends when a round changes no edge.  Node ids may be any orderable type.
    """
    e = cut_lineage(edges.select("a", "b").where("a <> b")
                    .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sig = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: every larger neighbour hangs on the smallest of the neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: every smaller neighbour, and the node itself, hang on the smallest
        small_low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(small_low, "b")
                 .select(F.explode(F.array(F.col("a"), F.col("b"))).alias("b"), F.col("m").alias("a"))
                 .where("a <> b").select("a", "b").distinct())
        e = cut_lineage(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if sig == tuple(now):
            break
        sig = tuple(now)
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
