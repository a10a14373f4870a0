"""End detection and run-accounting queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import END_CHECK_HEADER, EXPERIMENTS, NUM_PROFILE_REPEATS
from ..functions.text import file_stamp, iso_z, verdict_yes, elapsed_hms, word_count
from ..operators import endings as EN
from ..operators import runs as R
from ..operators.scoring import run_model
from ..session import checkpoint_path, cut_lineage
from ..sinks.writers import append_eval_history
from ..sinks.writers import log_history as read_log_history
from ..sources.tables import table, turns
from ..streaming.runner import remove_folder
from .registry import register
from .sqlbits import q, strip, words

NL = "chr(10)"

# ---------------------------------------------------------------- W4

_TAIL_SQL = f"""
WITH u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'),
l AS (SELECT u.conv_id, u.turn,
             string_agg(CASE c.role WHEN 'user' THEN 'Patient: ' ELSE 'Doctor: ' END || {strip('c.text')} || {NL}, ''
                        ORDER BY c.turn) AS body
      FROM u LEFT JOIN conversations c ON c.conv_id = u.conv_id AND c.turn BETWEEN u.turn - 6 AND u.turn - 1
                                       AND c.role IN ('user', 'assistant')
      GROUP BY u.conv_id, u.turn)
SELECT conv_id, turn, {q(END_CHECK_HEADER)} || coalesce(body, '') AS prompt FROM l
"""


@register("end_tail_prompt", _TAIL_SQL)
def end_tail_prompt(spark, sf_dir):
    return EN.end_check_prompts(turns(spark, sf_dir))


# ---------------------------------------------------------------- U-3 -> X21 -> W5 -> W6 -> W7

# the stand-in verdict model sees nothing but the rendered prompt
def _verdict_model():
    return lambda prompt: "Yes, it has ended." if len(prompt) % 3 else "No, keep going."


INSIST = "Let us come to a close."


def _streak_cte(checks: str) -> str:
    return f"""
c AS ({checks}),
g AS (SELECT *, sum(CASE WHEN verdict THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn
                                                              ROWS UNBOUNDED PRECEDING) AS grp FROM c),
st AS (SELECT conv_id, turn, verdict,
              CAST(CASE WHEN verdict THEN count(*) FILTER (WHERE verdict) OVER (PARTITION BY conv_id, grp ORDER BY turn
                                                                            ROWS UNBOUNDED PRECEDING)
                        ELSE 0 END AS BIGINT) AS streak FROM g)
"""


_STREAK_CTE = _streak_cte(f"SELECT conv_id, turn, length(prompt) % 3 <> 0 AS verdict FROM ({_TAIL_SQL}) p")


def _streaks(spark, sf_dir):
    t = turns(spark, sf_dir)
    replies = run_model(EN.end_check_prompts(t), "prompt", _verdict_model, drop=("prompt",))
    checks = cut_lineage(replies.select("conv_id", "turn", verdict_yes("reply").alias("verdict")))
    return t, EN.end_streaks(checks)


@register("end_streak", f"WITH {_STREAK_CTE} SELECT conv_id, turn, verdict, streak FROM st")
def end_streak(spark, sf_dir):
    return _streaks(spark, sf_dir)[1].select("conv_id", "turn", "verdict", "streak")


_TRUNC_SQL = f"""WITH {_STREAK_CTE},
e AS (SELECT conv_id, min(turn) FILTER (WHERE streak >= 2) AS end_turn FROM st GROUP BY conv_id),
x AS (SELECT c.conv_id, c.turn, c.role, c.text,
             sum(CASE WHEN c.role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id ORDER BY c.turn
                                                                  ROWS UNBOUNDED PRECEDING) AS exchange
      FROM conversations c),
k AS (SELECT x.*, e.end_turn, (x.role = 'assistant' AND EXISTS (SELECT 1 FROM st WHERE st.conv_id = x.conv_id
                                  AND st.turn + 1 = x.turn AND st.streak = 1)) AS insisted
      FROM x LEFT JOIN e ON e.conv_id = x.conv_id
      WHERE (e.end_turn IS NULL OR x.turn <= e.end_turn + 1) AND x.exchange <= 100)
SELECT conv_id, max(end_turn) AS end_turn, count(*) AS n_kept, count(*) FILTER (WHERE insisted) AS n_insist,
       md5(string_agg(coalesce(text, '') || CASE WHEN insisted THEN {NL} || {q(INSIST)} ELSE '' END, {NL} ORDER BY turn)) AS text_md5
FROM k GROUP BY conv_id"""


@register("end_truncate", _TRUNC_SQL)
def end_truncate(spark, sf_dir):
    t, st = _streaks(spark, sf_dir)
    kept = EN.truncate_at_end(t, st, insist=INSIST)
    ends = EN.end_points(st)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))),
                        lambda x: x.text)
    agg = kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_kept"), F.count_if("insisted").alias("n_insist"),
                                      F.md5(F.array_join(texts, "\n")).alias("text_md5"))
    return agg.join(ends, "conv_id", "left").select("conv_id", "end_turn", "n_kept", "n_insist", "text_md5")


# ---------------------------------------------------------------- J3 / J7 / F13

_EXP_VALUES = ", ".join(f"({q(e)}, {q(m)}, {str(x).upper()})" for e, m, x in EXPERIMENTS)
_EXP_CTE = f"exps AS (SELECT * FROM (VALUES {_EXP_VALUES}) v(experiment, doctor_model, expand_history))"

_GRID_SQL = f"""WITH {_EXP_CTE}
SELECT experiment, doctor_model, expand_history,
       TRY_CAST(NULLIF(regexp_extract(doctor_model, '_w(\\d+)', 1), '') AS INTEGER) AS window_size,
       (SELECT count(*) FROM customer) AS n_profiles,
       (SELECT count(*) FROM customer) * {NUM_PROFILE_REPEATS} AS n_runs
FROM exps"""


@register("run_grid", _GRID_SQL)
def run_grid(spark, sf_dir):
    # the plan per experiment; the grid rows themselves come from R.run_grid when needed
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"))
    n = profiles.distinct().agg(F.count(F.lit(1)).alias("n_profiles"))
    return F.broadcast(R.experiments_frame(spark)).crossJoin(n).select(
        "experiment", "doctor_model", "expand_history", "window_size", "n_profiles",
        (F.col("n_profiles") * NUM_PROFILE_REPEATS).alias("n_runs"))


_N_EXP = len(EXPERIMENTS)
_COV_SQL = f"""WITH {_EXP_CTE},
en AS (SELECT experiment, row_number() OVER () - 1 AS k FROM exps),
grid AS (SELECT e.experiment, c.c_custkey AS profile_id, r.repeat
         FROM exps e CROSS JOIN customer c CROSS JOIN range(0, {NUM_PROFILE_REPEATS}) r(repeat)),
done AS (SELECT DISTINCT en.experiment, ev.user_id AS profile_id, ev.event_id % {NUM_PROFILE_REPEATS} AS repeat
         FROM events ev JOIN en ON en.k = ev.user_id % {_N_EXP} WHERE ev.event_type = 'purchase'),
miss AS (SELECT * FROM grid g WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.experiment = g.experiment
                                                AND d.profile_id = g.profile_id AND d.repeat = g.repeat))
SELECT g.experiment, count(*) AS n_planned,
       coalesce((SELECT count(*) FROM miss m WHERE m.experiment = g.experiment), 0) AS n_missing,
       count(*) - coalesce((SELECT count(*) FROM miss m WHERE m.experiment = g.experiment), 0) AS n_done
FROM grid g GROUP BY g.experiment"""


@register("grid_coverage", _COV_SQL)
def grid_coverage(spark, sf_dir):
    names = F.array(*[F.lit(e) for e, _, _ in EXPERIMENTS])
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    done = ev.select(F.try_element_at(names, (F.col("user_id") % _N_EXP + 1).cast("int")).alias("experiment"),
                     F.col("user_id").alias("profile_id"),
                     (F.col("event_id") % NUM_PROFILE_REPEATS).alias("repeat"))
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"))
    return R.coverage_counts(R.experiments_frame(spark), profiles, done)


# ---------------------------------------------------------------- J6 / X24 / A8

_PAIRS_SQL = """
WITH e AS (SELECT user_id AS process, CASE event_type WHEN 'signup' THEN 'start' ELSE 'end' END AS kind, ts, event_id
           FROM events WHERE event_type IN ('signup', 'purchase')),
l AS (SELECT *, lag(kind) OVER w AS pk, lag(ts) OVER w AS pts FROM e
      WINDOW w AS (PARTITION BY process ORDER BY ts, event_id)),
p AS (SELECT process, ts AS end_ts, CASE WHEN pk = 'start' THEN pts END AS start_ts FROM l WHERE kind = 'end'),
s AS (SELECT *, (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 AS elapsed_seconds FROM p),
r AS (SELECT *, CAST(round_even(elapsed_seconds, 0) AS BIGINT) AS tot FROM s)
SELECT process, end_ts, start_ts, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_local, elapsed_seconds,
       CASE WHEN tot IS NULL THEN NULL ELSE printf('%02d:%02d:%02d', tot // 3600, (tot % 3600) // 60, tot % 60) END
         AS elapsed_hms,
       CASE WHEN start_ts IS NULL THEN 'orphan' ELSE 'ok' END AS status
FROM r"""


@register("process_pairs", _PAIRS_SQL)
def process_pairs(spark, sf_dir):
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "purchase"))
    ev = ev.select(F.col("user_id").alias("process"),
                   F.when(F.col("event_type") == "signup", "start").otherwise("end").alias("kind"),
                   "ts", "event_id")
    return R.process_pairs(ev)


# ---------------------------------------------------------------- A10 / W8 (events as an eval-loss log)

_LOG_CTE = """
lg AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
              value AS loss FROM events)
"""
_BEST_SQL = f"""WITH {_LOG_CTE},
g AS (SELECT run, count(*) AS n_evals, arg_min(step, (loss, step)) AS best_step, min(loss) AS best_loss,
             max(step) AS last_step FROM lg GROUP BY run)
SELECT run, n_evals, best_step, best_loss, last_step,
       least(n_evals, 3) + CASE WHEN best_step > last_step - 3 THEN 0 ELSE 1 END AS n_kept FROM g"""


def _log(spark, sf_dir):
    return R.eval_log(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value")


@register("best_checkpoint", _BEST_SQL)
def best_checkpoint(spark, sf_dir):
    return R.best_checkpoints(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value")


_STOP_SQL = f"""WITH {_LOG_CTE},
a AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb
      FROM lg),
b AS (SELECT *, max(CASE WHEN pb IS NULL OR loss < pb THEN step END)
                  OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS last_imp FROM a)
SELECT run, min(CASE WHEN step - last_imp >= 3 THEN step END) AS stop_step, count(*) AS n_evals
FROM b GROUP BY run"""


@register("early_stop", _STOP_SQL)
def early_stop(spark, sf_dir):
    return R.early_stop(_log(spark, sf_dir))


# ---------------------------------------------------------------- K7 (events as an eval history, written in three batches)

_HISTORY_SQL = """
WITH h AS (SELECT DISTINCT user_id AS run, epoch_us(ts) AS step, value AS eval_loss, event_id % 3 AS batch FROM events),
d AS (SELECT run, step, eval_loss, min(batch) AS batch FROM h GROUP BY 1, 2, 3)
SELECT run, step, eval_loss, row_number() OVER (PARTITION BY run ORDER BY step, batch) - 1 AS entry FROM d"""


@register("log_history", _HISTORY_SQL)
def log_history(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    rows = ev.select(F.col("user_id").alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("step"),
                     F.col("value").alias("eval_loss"), (F.col("event_id") % 3).alias("part"))
    folder = checkpoint_path(spark, "history-" + uuid.uuid4().hex[:12])
    for batch in (0, 1, 2, 1):  # a retried batch changes nothing
        append_eval_history(rows.where(F.col("part") == batch).drop("part"), folder, batch)
    out = cut_lineage(read_log_history(spark, folder).select("run", "step", "eval_loss", "entry"))
    remove_folder(spark, folder)
    return out


# ---------------------------------------------------------------- A8 / A9 / X23

_ELAPSED_SQL = f"""
WITH ev AS (SELECT user_id, min(ts) AS t0, max(ts) AS t1 FROM events GROUP BY user_id),
cv AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS turns_completed FROM conversations GROUP BY conv_id),
j AS (SELECT cv.conv_id, cv.turns_completed, ev.t0, ev.t1,
             (epoch_us(ev.t1) - epoch_us(ev.t0)) / 1e6 AS secs FROM cv JOIN ev ON ev.user_id = cv.conv_id),
r AS (SELECT *, CAST(round_even(secs, 0) AS BIGINT) AS tot FROM j)
SELECT conv_id,
  strftime(t0, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(t0) % 1000000 = 0 THEN '' ELSE strftime(t0, '.%f') END || 'Z'
    AS timestamp_init,
  strftime(t1, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(t1) % 1000000 = 0 THEN '' ELSE strftime(t1, '.%f') END || 'Z'
    AS timestamp_end,
  secs AS time_elapsed_seconds, turns_completed, strftime(t0, '%Y%m%dT%H%M%S') AS file_stamp,
  printf('%02d:%02d:%02d', tot // 3600, (tot % 3600) // 60, tot % 60) AS elapsed_hms
FROM r"""


@register("run_elapsed", _ELAPSED_SQL)
def run_elapsed(spark, sf_dir):
    ev = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    cv = turns(spark, sf_dir).groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns_completed"))
    j = cv.join(ev, cv.conv_id == ev.user_id)
    secs = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / F.lit(1e6)
    return j.select("conv_id", iso_z("t0").alias("timestamp_init"), iso_z("t1").alias("timestamp_end"),
                    secs.alias("time_elapsed_seconds"), "turns_completed",
                    file_stamp("t0").alias("file_stamp"), elapsed_hms(secs).alias("elapsed_hms"))


# ---------------------------------------------------------------- A13

_PROFILE_SQL = f"""
WITH c AS (SELECT conv_id, count(*) AS n_turns, sum({words('text')}) AS n_words FROM conversations GROUP BY conv_id)
SELECT 'exp_' || CAST(conv_id % 3 AS VARCHAR) AS experiment, count(*) AS n_conversations,
       CAST(sum(n_turns) AS BIGINT) AS n_turns, CAST(sum(n_words) AS BIGINT) AS n_words,
       min(n_turns) AS min_turns, median(n_turns) AS median_turns, max(n_turns) AS max_turns
FROM c GROUP BY 1"""


@register("corpus_profile", _PROFILE_SQL)
def corpus_profile(spark, sf_dir):
    c = turns(spark, sf_dir).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"),
                                                    F.sum(word_count("text")).alias("n_words"))
    c = c.withColumn("experiment", F.concat(F.lit("exp_"), (F.col("conv_id") % 3).cast("string")))
    return c.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("n_conversations"), F.sum("n_turns").alias("n_turns"),
        F.sum("n_words").alias("n_words"), F.min("n_turns").alias("min_turns"),
        F.median("n_turns").alias("median_turns"), F.max("n_turns").alias("max_turns"))
