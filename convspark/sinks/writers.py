"""Partitioned writers (K1-K7).  Output goes to the given (shared) folder."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MAX_SEQ_LENGTH
from ..functions.text import file_stamp, word_count
from ..operators.ordered import dense_position
from ..operators.runs import best_by_step, early_stop, eval_steps
from ..operators.scoring import (ModelFactory, materialized, render_prompts, run_model, score_replies,
                                 scores_by_conversation)
from ..operators.tokens import length_stats
from ..operators.transcripts import render_dialogue, transcript_lines
from ..sources.files import read_transcripts


def write_transcripts(turns: DataFrame, out: str, stamp_col: str = "ts", packed: bool = False) -> None:
    """K1: one transcript per conversation, ``experiment/conversation_profile<id>_<stamp>/part-*.txt``.

    ``turns`` has conv_id, turn, role, text, experiment, profile_id and a timestamp (the first turn's
    counts).  ``packed`` writes many transcripts to a Parquet file, partitioned by experiment, so that the
    number of files does not grow with that of conversations; ``read_transcripts(packed=True)`` reads them."""
    docs = render_dialogue(transcript_lines(turns), F.col("line"), "", out="transcript",
                           carry=[stamp_col, "experiment", "profile_id"])
    named = docs.select(
        "experiment", F.concat(F.lit("conversation_profile"), F.col("profile_id").cast("string"), F.lit("_"),
                               file_stamp(stamp_col)).alias("conversation"), "transcript")
    if packed:
        named.write.mode("overwrite").partitionBy("experiment").parquet(out)
        return
    # the text writer ends every value with "\n"; drop one so files end in exactly "\n\n"
    named.withColumn("transcript", F.regexp_replace("transcript", "\n\\z", "")) \
        .write.mode("overwrite").partitionBy("experiment", "conversation").text(out)


def write_run_dumps(dumps: DataFrame, out: str) -> None:
    """K2: run dumps as JSON with keys in sorted order."""
    dumps.select(*sorted(dumps.columns)).write.mode("overwrite").json(out)


def write_scores(scores: DataFrame, out: str, key: str = "conversation_file") -> None:
    """K3: one JSON line per conversation ``{conversation_file, scores: {metric: {...}}}``, in name order."""
    scores_by_conversation(scores, key).orderBy(key).write.mode("overwrite").option("ignoreNullFields", False).json(out)


def write_summary(scores: DataFrame, out: str, key: str = "conversation_file") -> None:
    """K4: ``{num_conversations, average_scores: {metric: mean or null}}`` (one row)."""
    scores = materialized(scores.select(key, "metric", "score"))
    per = scores.groupBy("metric").agg(F.avg("score").alias("avg"))
    n = scores.agg(F.countDistinct(key).alias("num_conversations"))
    summary = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "avg"))))
                      .alias("average_scores")).crossJoin(n)
    summary.select("num_conversations", "average_scores").write.mode("overwrite") \
        .option("ignoreNullFields", False).json(out)


def evaluate_folder(spark: SparkSession, root: str, templates: DataFrame, factory: ModelFactory, out: str,
                    partitions: int | None = None) -> DataFrame:
    """S1 -> J1 -> U-1 -> X8 -> K3 + K4: score every transcript under ``root`` with every template.

    The model is called once per prompt: its scored replies are written to the checkpoint folder
    and both files, ``<out>/scores`` and ``<out>/summary``, come from there.  Returns the scores."""
    docs = read_transcripts(spark, root).select(F.col("file").alias("conversation_file"), "transcript")
    replies = run_model(render_prompts(docs, templates, partitions=partitions), "prompt", factory, drop=("prompt", "transcript"))
    scores = materialized(score_replies(replies))
    write_scores(scores, f"{out}/scores")
    write_summary(scores, f"{out}/summary")
    return scores


def write_sft(samples: DataFrame, out: str) -> None:
    """K5: SFT samples partitioned by window size and split."""
    samples.write.mode("overwrite").partitionBy("window_size", "split").parquet(out)


def training_metadata(samples: DataFrame, text_col: str = "text", limit: int = MAX_SEQ_LENGTH) -> DataFrame:
    """K6: per (window_size, split): example counts and token-length stats as one nested row.

    ``num_examples`` counts all samples, ``num_formatted`` those with a rendered text."""
    stats = length_stats(samples.select("window_size", "split", word_count(text_col).alias("_n")), "_n",
                         ["window_size", "split"], limit, extra=[F.count(F.lit(1)).alias("num_examples")])
    return stats.select("window_size", "split", "num_examples", F.col("sample_count").alias("num_formatted"), F.struct(
        "sample_count", F.col("min_len").alias("min"), F.col("max_len").alias("max"), F.col("mean_len").alias("mean"),
        F.col("median_len").alias("median"), F.col("n_over_max").alias("num_exceeding_max_seq")).alias("token_length_stats"))


def write_training_metadata(samples: DataFrame, out: str, run_args: dict[str, object]) -> None:
    """K6: one JSON line per window size: ``run_args`` as given, raw and formatted counts and the
    token-length stats of both splits (null where a split has no sample)."""
    def side(name: str, pick) -> Column:
        return F.max(F.when(F.col("split") == name, pick))

    meta = training_metadata(samples)
    meta.groupBy("window_size").agg(
        *[c for split, name in (("train", "train"), ("test", "eval")) for c in (
            F.coalesce(side(split, F.col("num_examples")), F.lit(0)).alias(f"num_raw_{name}_examples"),
            F.coalesce(side(split, F.col("num_formatted")), F.lit(0)).alias(f"num_formatted_{name}_examples"),
            side(split, F.col("token_length_stats")).alias(f"{name}_token_length_stats"))]) \
        .select("*", *[F.lit(v).alias(k) for k, v in run_args.items()]) \
        .write.mode("overwrite").option("ignoreNullFields", False).json(out)


def write_prepared(samples: DataFrame, out: str, run_args: dict[str, object]) -> None:
    """K5 + K6 of ``prepare_sft``: ``<out>/samples`` and, read back from there, ``<out>/metadata``."""
    write_sft(samples, f"{out}/samples")
    write_training_metadata(samples.sparkSession.read.parquet(f"{out}/samples"), f"{out}/metadata", run_args)


def append_eval_history(history: DataFrame, out: str, batch_id: int | None = None) -> None:
    """K7: add the ``run, step, epoch, metrics...`` rows of one batch to the history table, exactly once: a batch
    is a folder of its own, so a batch that is written again replaces itself.  Without an id each call is
    a batch of its own, later than those before it."""
    if batch_id is None:
        batch_id = time.time_ns()
    history.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={int(batch_id)}")


def eval_history_stream(history: DataFrame, out: str, checkpoint: str):
    """K7 live: a writer that appends a stream of evaluations by its batch ids (start it with a trigger)."""
    return history.writeStream.foreachBatch(lambda rows, batch: append_eval_history(rows, out, batch)).option(
        "checkpointLocation", checkpoint)


def log_history(spark: SparkSession, out: str) -> DataFrame:
    """K7 read back: all rows of the history table with ``entry``, their 0-based place in the run's log (by step,
    then batch).  An evaluation that two batches hold alike counts once."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c != "batch"]
    first = rows.groupBy(*values).agg(F.min("batch").alias("batch"))
    return dense_position(first, ["run"], ["step", "batch"], F.col("step"), out="entry")


def write_log_history(spark: SparkSession, out: str, path: str) -> None:
    """K7: one JSON line per run: ``run`` and ``log_history``, its evaluations in order, as a trainer writes it."""
    log = log_history(spark, out)
    entry = F.struct("entry", F.struct(*[c for c in log.columns if c not in ("run", "entry", "batch")]).alias("e"))
    log.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("log_history")) \
        .write.mode("overwrite").json(path)


def write_best_checkpoints(history: DataFrame, out: str, loss: str = "eval_loss") -> None:
    """K7: per run of the eval history, the best checkpoint (A10: lowest loss, the first of equals) and
    where early stopping ends it (W8), as JSON lines ``run, n_evals, best_checkpoint, best_loss, stop_checkpoint``.

    The runs' steps are numbered 0, 1, ... per evaluation and mapped back to checkpoint names."""
    log = eval_steps(history, "run", "step", loss)
    best = best_by_step(log).select("run", "n_evals", "best_eval", "best_loss")
    stop = early_stop(log.select("run", F.col("eval").alias("step"), "loss")).select(F.col("run").alias("_run"), "stop_step")
    both = best.join(stop, F.col("run").eqNullSafe(F.col("_run"))).drop("_run")
    names = log.select(F.col("run").alias("_run"), "eval", F.concat(F.lit("checkpoint-"), F.col("step").cast("string")).alias("name"))
    for at, name in (("best_eval", "best_checkpoint"), ("stop_step", "stop_checkpoint")):
        n = names.withColumnRenamed("name", name)
        both = both.join(n, F.col("run").eqNullSafe(F.col("_run")) & (F.col(at) == F.col("eval")), "left").drop("_run", "eval")
    both.select("run", "n_evals", "best_checkpoint", "best_loss", "stop_checkpoint") \
        .write.mode("overwrite").option("ignoreNullFields", False).json(out)
