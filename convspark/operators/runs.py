"""Run accounting: simulation grid and coverage, process timing, elapsed time,
checkpoint choice and early stopping (J3, J6, J7, A8-A10, A13, W8, X24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import EARLY_STOPPING_PATIENCE, EXPERIMENTS, NUM_PROFILE_REPEATS, SAVE_TOTAL_LIMIT
from ..functions.text import elapsed_hms, local_stamp, window_size_from_model
from ..session import cut_lineage
from .ordered import DEFAULT_BLOCK, dense_position, lookback, running

def experiments_frame(spark: SparkSession) -> DataFrame:
    """The experiment table (14 rows: folder, doctor model, expand flag, window from name)."""
    df = spark.createDataFrame(EXPERIMENTS, "experiment string, doctor_model string, expand_history boolean")
    return df.withColumn("window_size", window_size_from_model("doctor_model"))


def run_grid(experiments: DataFrame, profiles: DataFrame, repeats: int = NUM_PROFILE_REPEATS) -> DataFrame:
    """Experiments x profiles x repeat.  The experiment side is a fixed 14-row
    table (broadcast); the profile side is whatever profile table is given."""
    from ..session import spread
    rep = profiles.sparkSession.range(repeats).select(F.col("id").alias("repeat"))
    return spread(profiles.select("profile_id")).crossJoin(F.broadcast(experiments)).crossJoin(F.broadcast(rep))


def coverage_counts(experiments: DataFrame, profiles: DataFrame, done: DataFrame,
                    repeats: int = NUM_PROFILE_REPEATS) -> DataFrame:
    """J7 counts without building the grid: planned = profiles x repeats per experiment,
    done = distinct finished runs whose experiment, profile and repeat are in the grid.

    Same numbers as ``coverage(run_grid(...), done)`` but the work is proportional to
    the profile and done tables, not to their 126-fold product."""
    n_prof = profiles.select("profile_id").distinct().agg(F.count(F.lit(1)).alias("_np"))
    valid = (done.select("experiment", "profile_id", "repeat").distinct()
             .filter((F.col("repeat") >= 0) & (F.col("repeat") < repeats))
             .join(profiles.select("profile_id").distinct(), "profile_id", "left_semi"))
    per = valid.groupBy("experiment").agg(F.count(F.lit(1)).alias("n_done"))
    out = F.broadcast(experiments.select("experiment")).crossJoin(n_prof).join(per, "experiment", "left")
    return out.select("experiment", (F.col("_np") * repeats).alias("n_planned"),
                      (F.col("_np") * repeats - F.coalesce("n_done", F.lit(0))).alias("n_missing"),
                      F.coalesce("n_done", F.lit(0)).alias("n_done"))


def coverage(grid: DataFrame, done: DataFrame, keys=("experiment", "profile_id", "repeat")) -> DataFrame:
    """Planned runs per experiment, done, and missing (left anti join)."""
    keys = list(keys)
    # one pass over the grid: left join the (deduplicated) done runs, count the gaps
    flagged = grid.join(done.select(*keys).distinct().withColumn("_done", F.lit(True)), keys, "left")
    return flagged.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("n_planned"), F.count_if(F.col("_done").isNull()).alias("n_missing"),
        F.count_if(F.col("_done")).alias("n_done"))


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def process_pairs(events: DataFrame, process: str = "process", kind: str = "kind", ts: str = "ts",
                  tie: str = "event_id", block: int = DEFAULT_BLOCK) -> DataFrame:
    """Pair each end with the start right before it (same process).

    Same as the in-memory registry: a start (re)sets the pending start, an end
    consumes it; an end whose previous event is not a start has no start
    ("orphan").  Returns one row per end event.
    """
    e = events.select(F.col(process).alias("process"), F.col(kind).alias("kind"),
                      F.col(ts).alias("ts"), F.col(tie).alias("tie"))
    framed = lookback(e, ["process"], ["ts", "tie"], 1, ["ts", "tie", "kind"], out="prev", include_current=False,
                      block=block, by=_micros("ts"))
    ends = framed.filter(F.col("kind") == "end")
    prev = F.try_element_at("prev", F.lit(-1))
    paired = (F.size("prev") == 1) & (prev["kind"] == "start")
    start = F.when(paired, prev["ts"])
    secs = (_micros("ts") - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)
    return ends.select("process", F.col("ts").alias("end_ts"), start.alias("start_ts"),
                       local_stamp(start).alias("start_local"),
                       secs.alias("elapsed_seconds"), elapsed_hms(secs).alias("elapsed_hms"),
                       F.when(paired, "ok").otherwise("orphan").alias("status"))


def eval_log(metrics: DataFrame, run: str, ts: str, tie: str, loss: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Evaluation log rows ``run, step (0-based, by time), loss``."""
    m = metrics.select(F.col(run).alias("run"), F.col(ts).alias("ts"), F.col(tie).alias("tie"),
                       F.col(loss).cast("double").alias("loss"))
    return dense_position(m, ["run"], ["ts", "tie"], _micros("ts"), out="step", block=block).select("run", "step", "loss")


def best_checkpoints(metrics: DataFrame, run: str, ts: str, tie: str, loss: str, keep: int = SAVE_TOTAL_LIMIT) -> DataFrame:
    """A10: best = lowest loss (first such evaluation); the ``keep`` newest plus the best are kept.

    No row is numbered: one aggregate finds each run's best evaluation, one join counts the
    evaluations before it, which is its step."""
    m = metrics.select(F.col(run).alias("run"), F.col(ts).alias("ts"), F.col(tie).alias("tie"),
                       F.col(loss).cast("double").alias("loss"))
    g = m.groupBy("run").agg(F.count(F.lit(1)).alias("n_evals"), F.min("loss").alias("best_loss"),
                             F.min(F.struct("loss", "ts", "tie")).alias("best"))
    g = g.select(F.col("run").alias("_run"), "n_evals", "best_loss", F.struct("best.ts", "best.tie").alias("at"))
    step = (m.join(g, F.col("run").eqNullSafe(F.col("_run")))
            .groupBy("run", "n_evals", "best_loss").agg(F.count_if(F.struct("ts", "tie") < F.col("at")).alias("best_step")))
    newest_has_best = F.col("best_step") >= F.col("n_evals") - keep
    return step.select("run", "n_evals", "best_step", "best_loss", (F.col("n_evals") - 1).alias("last_step"),
                       (F.least(F.col("n_evals"), F.lit(keep)) + F.when(newest_has_best, 0).otherwise(1)).alias("n_kept"))


def eval_steps(history: DataFrame, run: str, step: str, loss: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    """``run, step, loss, eval``: evaluations with training steps of any spacing, numbered per run."""
    h = history.select(F.col(run).alias("run"), F.col(step).cast("long").alias("step"), F.col(loss).cast("double").alias("loss"))
    return cut_lineage(dense_position(h, ["run"], ["step", "loss"], F.col("step"), out="eval", block=block)
                       .select("run", "step", "loss", "eval"))


def best_by_step(log: DataFrame) -> DataFrame:
    """A10 on ``eval_steps``: ``run, n_evals, best_eval, best_loss``; evaluations without a loss are never best."""
    best = F.min(F.when(F.col("loss").isNotNull(), F.struct("loss", "eval")))
    return log.groupBy("run").agg(F.count(F.lit(1)).alias("n_evals"), best.alias("b")).select(
        "run", "n_evals", F.col("b.eval").alias("best_eval"), F.col("b.loss").alias("best_loss"))


def early_stop(log: DataFrame, patience: int = EARLY_STOPPING_PATIENCE, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Stop at the first evaluation ``patience`` evaluations after the last
    strict improvement of the best loss; null when training would not stop.

    The prefix minimum of ``(loss, step)`` holds both the best loss and its first evaluation, which is
    the last strict improvement; before any loss every evaluation counts as one."""
    best = F.when(F.col("loss").isNotNull(), F.struct("loss", "step"))
    r = running(log, ["run"], "step", [("_best", "min", best, True)], block=block)
    waited = F.col("step") - F.coalesce(F.col("_best.step"), F.col("step"))
    return r.groupBy("run").agg(F.min(F.when(waited >= patience, F.col("step"))).alias("stop_step"), F.count(F.lit(1)).alias("n_evals"))
