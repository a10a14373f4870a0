"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

PREFIX_CHARS = 256
FILTER_WORDS = 1 << 16


def _survivors(keys: DataFrame, words: int) -> DataFrame:
    """Bit set of the keys seen at least twice: ``(__w, __bits)``, at most ``words`` rows.

    A fixed number of 64-bit words, so its size is bounded whatever the input; two keys on one
    bit only mean that some unique texts are refined once more.
    """
    return (keys.groupBy("__k").count().where("count > 1")
            .select(F.pmod("__k", F.lit(words * 64)).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("__w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("__bits")))


def _keep_flag(df: DataFrame, key: Column, bits: DataFrame, words: int) -> DataFrame:
    """Adds ``__hit``: whether the row's key may belong to a group of two or more."""
    p = F.pmod(key, F.lit(words * 64))
    return (df.withColumn("__p", p).withColumn("__w", F.shiftright("__p", 6))
            .join(F.broadcast(bits), "__w", "left")
            .withColumn("__hit", F.coalesce(F.expr("(shiftright(__bits, cast(__p % 64 as int)) & 1L) = 1L"),
                                            F.lit(False)))
            .drop("__w", "__p", "__bits"))


def _refinement(docs: DataFrame, text: Column, prefix_chars: int, words: int) -> tuple[Column, DataFrame]:
    """The prefix key of a row and the bit set of the prefix keys that may belong to a group: lengths
    seen twice first, then among those rows prefix hashes seen twice."""
    by_len = F.xxhash64(F.length(text))
    by_prefix = F.xxhash64(F.length(text), F.substring(text, 1, prefix_chars))
    lens = _survivors(docs.select(by_len.alias("__k")), words)
    first = _keep_flag(docs, by_len, lens, words).where("__hit")
    return by_prefix, _survivors(first.select(by_prefix.alias("__k")), words)


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    prefix_chars: int = PREFIX_CHARS, filter_words: int = FILTER_WORDS) -> DataFrame:
    """Every row of ``docs`` plus ``__keep_id``, ``__group_size`` and ``__kept``.

    Texts are equal when identical; null counts as empty.  Of equal texts the row with the
    largest id stays (a null id is smaller than any other; a group of null ids keeps all of its
    rows).  Rows that repeat both id and text are one document: they count in the group's size
    and are marked alike.  Extra columns are carried through; an empty table gives an empty one.

    Three scans, none of which shuffles a text: (1) lengths seen twice, (2) of those rows the
    prefix hashes seen twice, (3) of those rows the SHA-256 of the whole text, grouped.  What
    survives (1) and (2) is handed on as a bit set of fixed size (broadcast, 16 bytes a word).
    The last join carries every column of ``docs``; see ``exact_dedup`` for a filter that does not.
    """
    text = text_or_empty(text_col)
    by_prefix, prefixes = _refinement(docs.select(text_col), text, prefix_chars, filter_words)

    def refined(df: DataFrame) -> DataFrame:
        # a row without a group keeps its prefix hash as key, which no full hash equals: one null
        # key for all of them would send them to one task
        out = _keep_flag(df, by_prefix, prefixes, filter_words)
        return out.withColumn("__full", F.when(F.col("__hit"), F.sha2(text, 256)).otherwise(by_prefix.cast("string")))

    groups = (refined(docs.select(id_col, text_col)).where("__hit")
              .groupBy("__full").agg(F.max(id_col).alias("__keep_id"), F.count("*").alias("__group_size"))
              .where("__group_size > 1"))
    return (refined(docs).drop("__hit").join(groups, "__full", "left")
            .withColumn("__kept", F.col("__group_size").isNull() | F.col(id_col).eqNullSafe(F.col("__keep_id")))
            .withColumn("__keep_id", F.when(F.col("__group_size").isNull(), F.col(id_col))
                        .otherwise(F.col("__keep_id")))
            .withColumn("__group_size", F.coalesce("__group_size", F.lit(1).cast("long")))
            .drop("__full"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS, filter_words: int = FILTER_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns (``mark_duplicates`` says which).

    Rows that length and prefix set apart pass without a shuffle.  The others meet the kept ids on
    (full hash, id), so that a group of copies, however large, spreads over all tasks.
    """
    text = text_or_empty(text_col)
    by_prefix, prefixes = _refinement(docs.select(text_col), text, prefix_chars, filter_words)

    def suspects(df: DataFrame) -> DataFrame:
        return _keep_flag(df, by_prefix, prefixes, filter_words).where("__hit").withColumn("__full", F.sha2(text, 256))

    stays = (suspects(docs.select(id_col, text_col)).groupBy(F.col("__full").alias("__f"))
             .agg(F.max(id_col).alias("__keep_id")))
    some = suspects(docs).join(
        stays, (F.col("__full") == F.col("__f")) & F.col(id_col).eqNullSafe(F.col("__keep_id")), "left_semi")
    alone = _keep_flag(docs, by_prefix, prefixes, filter_words).where("not __hit")
    return alone.select(*docs.columns).unionByName(some.select(*docs.columns))
