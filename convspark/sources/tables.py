"""The parquet tables every registered query reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily scan ``{sf_dir}/{name}.parquet``; Catalyst prunes columns and pushes filters."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn table ``(conv_id, turn, role, text)``."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
