"""The corpus pipeline: documents through five operators, each stage written and read again.

Part of the ``llm`` subpackage.  Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.llm import exact_dedup, langid, packing, secrets, simhash
from convspark.llm.common import load
from convspark.llm.queries import tokenizer_path
from convspark.session import checkpoint_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language's model accepts: without a letter, or with a cross-entropy
    beyond the bound that held-back documents of the best language set."""
    trusted = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return langid.predict(docs, langid.fit(trusted)).where("__accepted").select(*docs.columns)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (4-word shingles, 4 bits) the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become a mask; no document is dropped."""
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of power-of-two length."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [("language_id", language_id), ("exact_dedup", dedup_exact), ("simhash_near_dedup", dedup_near),
          ("secret_scan", mask_secrets), ("packing", pack)]

# language models and token ids have no SQL form; tests/llm checks run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and reread."""
    docs = load(spark, sf_dir, "documents")
    base = checkpoint_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
