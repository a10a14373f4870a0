"""Judge scoring queries: conversations x metric templates (J1, U-1, X8, A1-A3, A11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as J
from ..operators.transcripts import render_dialogue, transcript_lines
from ..sources.tables import turns
from ..session import default_partitions
from .registry import register
from .sqlbits import q, words
from .text import _CLEAN_SQL

_TPL_VALUES = ", ".join(
    f"({q(m)}, {q(J.template_pieces(t)[0])}, {q(J.template_pieces(t)[1])})"
    for m, t in sorted(J.DEFAULT_TEMPLATES.items()))

_JUDGE_CTE = f"""
lines AS ({_CLEAN_SQL}),
doc AS (SELECT conv_id, string_agg(line, '' ORDER BY turn) AS transcript FROM lines GROUP BY conv_id),
tpl AS (SELECT * FROM (VALUES {_TPL_VALUES}) v(metric, head, tail)),
p AS (SELECT conv_id, metric, head || transcript || tail AS prompt FROM doc CROSS JOIN tpl),
wc AS (SELECT conv_id, metric, {words('prompt')} AS n FROM p),
js AS (SELECT conv_id, metric, CAST(n % 7 AS DOUBLE) AS score,
              CAST(n % 7 AS VARCHAR) || ', words=' || CAST(n AS VARCHAR) AS raw FROM wc)
"""


def judged(spark, sf_dir):
    """Long score table: conv_id, metric, reply, score, explanation."""
    lines = transcript_lines(turns(spark, sf_dir))
    docs = render_dialogue(lines, F.col("line"), "", out="transcript")
    prompts = J.render_prompts(docs, J.templates_frame(spark), partitions=default_partitions(spark))
    replies = J.run_model(prompts, "prompt", J.word_count_judge, drop=("prompt", "transcript"))
    return J.score_replies(replies)


@register("judge_scores", f"WITH {_JUDGE_CTE} SELECT conv_id, metric, score, raw FROM js")
def judge_scores(spark, sf_dir):
    return judged(spark, sf_dir).select("conv_id", "metric", "score", F.col("reply").alias("raw"))


_SUMMARY_SQL = f"""WITH {_JUDGE_CTE}
SELECT metric, avg(score) AS avg_score, count(score) AS n_scored,
       (SELECT count(DISTINCT conv_id) FROM doc) AS n_conversations
FROM js GROUP BY metric"""


@register("score_summary", _SUMMARY_SQL)
def score_summary(spark, sf_dir):
    return J.metric_means(judged(spark, sf_dir))


_ROLLUP_SQL = f"""WITH {_JUDGE_CTE}
SELECT experiment, metric, avg(score) AS avg_score, count(score) AS n_scores
FROM (SELECT 'exp_' || CAST(conv_id % 3 AS VARCHAR) AS experiment, metric, score FROM js) s
GROUP BY ROLLUP (experiment, metric)"""


@register("score_rollup", _ROLLUP_SQL)
def score_rollup(spark, sf_dir):
    s = judged(spark, sf_dir).withColumn(
        "experiment", F.concat(F.lit("exp_"), (F.col("conv_id") % 3).cast("string")))
    return J.experiment_rollup(s)


_PIVOT_SQL = f"""WITH {_JUDGE_CTE}
SELECT 'exp_' || CAST(conv_id % 3 AS VARCHAR) AS experiment,
       {", ".join(f"avg(score) FILTER (WHERE metric = {q(m)}) AS {m}" for m in sorted(J.DEFAULT_TEMPLATES))}
FROM js GROUP BY 1"""


@register("score_pivot", _PIVOT_SQL)
def score_pivot(spark, sf_dir):
    s = judged(spark, sf_dir).withColumn(
        "experiment", F.concat(F.lit("exp_"), (F.col("conv_id") % 3).cast("string")))
    return J.experiment_pivot(s, sorted(J.DEFAULT_TEMPLATES))


@register("score_records", f"""WITH {_JUDGE_CTE}
SELECT conv_id, count(*) OVER (PARTITION BY conv_id) AS n_metrics, metric, score,
       'words=' || split_part(raw, 'words=', 2) AS explanation, raw FROM js""")
def score_records(spark, sf_dir):
    """A2: the score record of each conversation, its map opened again."""
    rec = J.scores_by_conversation(judged(spark, sf_dir))
    opened = rec.select("conv_id", F.size("scores").cast("long").alias("n_metrics"), F.explode("scores").alias("metric", "s"))
    return opened.select("conv_id", "n_metrics", "metric", "s.score", "s.explanation", "s.raw")
