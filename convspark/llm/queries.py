"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F
from pyspark.sql import Window

from . import (ann, bpe, chat_format, context_tree, exact_dedup, html_text, langid, packing, runs, secrets, simhash,
               substrings, variants)
from .common import load, text_or_empty

TOKENIZER_FILE = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_nearest_neighbours(spark, sf_dir):
    found = ann.nearest(load(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op2_secret_scan(spark, sf_dir):
    found = secrets.find_secrets(load(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("__spans", lambda s: s.ord < len(secrets.BASE))

    def count(kind):
        return F.size(F.filter("__spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(r.kind) for r in secrets.BASE],
                        F.sha2(secrets.spans_string(base), 256).alias("base_sha256"),
                        secrets.spans_string(F.col("__spans")).alias("spans"))


def op3_substring_dedup(spark, sf_dir):
    found = substrings.shared_passages(load(spark, sf_dir, "documents", "doc_id", "text"))
    return found.withColumnRenamed("doc", "doc_id").withColumnRenamed("rep_doc", "rep_doc_id")


def op4_simhash(spark, sf_dir):
    found = simhash.near_dedup(load(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


def op5_html_text(spark, sf_dir):
    text = html_text.extract_text(load(spark, sf_dir, "pages", "page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_exact_dedup(spark, sf_dir):
    # the digest is taken before the operator's join, which then carries no text
    docs = load(spark, sf_dir, "documents", "doc_id", "text").withColumn("text_sha256", F.sha2(text_or_empty("text"), 256))
    return exact_dedup.mark_duplicates(docs).select(
        "doc_id", F.col("__keep_id").alias("keep_id"), F.col("__group_size").alias("group_size"),
        F.col("__kept").alias("kept"), "text_sha256")


def op7_chat_format(spark, sf_dir):
    said = "\\### Assistant: </turn> ok"
    rows = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    events = (rows.unionByName(extra).withColumn("seq", seq).withColumn("msg", F.col("seq"))
              .withColumn("kind", F.lit("message")))
    chats = chat_format.format_chats(events)
    turns = chat_format.read_back(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return (chats.withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
            .select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))


def op8_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    ident = langid.fit(docs.where(~held_out))
    found = langid.predict(docs.select("doc_id", "text"), ident)
    return found.select("doc_id", held_out.alias("held_out"), F.col("__lang_pred").alias("lang_pred"),
                        F.col("__score").alias("score"), F.col("__entropy").alias("entropy"),
                        F.col("__accepted").alias("accepted"))


def op9_bpe(spark, sf_dir):
    return bpe.token_digests(load(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op10_packing(spark, sf_dir):
    return packing.pack(load(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_context_tree(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    return context_tree.score_texts(docs, ~held_out).withColumn("held_out", ~F.col("trained")).drop("trained")


def repeated_tail(docs, id_col="doc_id", text_col="text"):
    """The contract's input of op12: where 10 divides the id's crc32, the words from a on repeat the first p of them."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    changed = (docs.withColumn("__w", F.when(h % 10 == 0, F.regexp_extract_all(text_col, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))))
               .withColumn("__n", F.size("__w")).withColumn("__a", g % F.col("__n"))
               .withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + g % 8))))
    word = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.element_at(
        "__w", (1 + F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p"))).cast("int")))
    return changed.withColumn(text_col, F.when(F.col("__n") > 0, F.array_join(word, " ")).otherwise(F.col(text_col))
                              ).select(*docs.columns)


def op12_periodic_runs(spark, sf_dir):
    found = runs.find_runs(repeated_tail(load(spark, sf_dir, "documents", "doc_id", "text")))
    best = F.array_sort("runs", lambda x, y: F.when(x.length * y.period != y.length * x.period,
                                                    F.when(x.length * y.period > y.length * x.period, -1).otherwise(1))
                        .when(x.start != y.start, F.when(x.start < y.start, -1).otherwise(1))
                        .otherwise(F.when(x.period < y.period, -1).otherwise(1)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return (found.withColumn("best", F.get(best, 0))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


def drop_letters(doc_id):
    """The contract's misspellings of op13: of a run whose crc32 with its document 97 divides, one letter goes."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())

    def change(run):
        h = zlib.crc32(run.encode(), start)
        if h % 97:
            return run
        k = h % len(run)
        return run[:k] + run[k + 1:]

    return change


def op13_spelling_variants(spark, sf_dir):
    words = variants.count_words(load(spark, sf_dir, "documents", "doc_id", "text"), edit=drop_letters)
    return variants.group_variants(words)


QUERIES = {f.__name__: f for f in (
    op1_nearest_neighbours, op2_secret_scan, op3_substring_dedup, op4_simhash, op5_html_text, op6_exact_dedup,
    op7_chat_format, op8_language_id, op9_bpe, op10_packing, op11_context_tree,
    op12_periodic_runs, op13_spelling_variants)}
