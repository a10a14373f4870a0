"""SFT data products over the ``conversations`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SFT_SYSTEM_PROMPT
from ..operators import samples as S
from ..sources.tables import turns
from .registry import register
from .sqlbits import norm_role, q, strip

# ---------------------------------------------------------------- W1 / F4 / X25


def _sft_window_sql(w: int) -> str:
    return f"""
WITH t AS (SELECT conv_id, turn, {norm_role('role')} AS role, text FROM conversations),
g AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role FROM t),
targets AS (SELECT conv_id, turn FROM g WHERE role = 'assistant' AND prev_role = 'user')
SELECT conv_id, turn, CAST({w} AS INTEGER) AS window_size, CAST(0 AS BIGINT) AS pos,
       'system' AS role, {q(SFT_SYSTEM_PROMPT)} AS content
FROM targets
UNION ALL
SELECT g.conv_id, g.turn, CAST({w} AS INTEGER) AS window_size,
       CAST(c.turn - greatest(0, g.turn - {w}) + 1 AS BIGINT) AS pos,
       CASE WHEN c.turn = g.turn THEN 'assistant' WHEN c.role = 'user' THEN 'user' ELSE 'assistant' END AS role,
       {strip('c.text')} AS content
FROM targets g JOIN t c ON c.conv_id = g.conv_id AND c.turn BETWEEN g.turn - {w} AND g.turn
"""


def _sft_window(w: int):
    def build(spark, sf_dir):
        t = S.normalized_turns(turns(spark, sf_dir))
        return S.explode_messages(S.sft_samples(t, [w]))
    return build


register("sft_window_w1", _sft_window_sql(1))(_sft_window(1))
register("sft_window_w5", _sft_window_sql(5))(_sft_window(5))

# ---------------------------------------------------------------- W2 / F5

_MULTI_SQL = f"""
WITH t AS (SELECT conv_id, turn, {norm_role('role')} AS role, text FROM conversations),
g AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role FROM t),
targets AS (SELECT conv_id, turn FROM g WHERE role = 'assistant' AND prev_role = 'user'),
ws AS (SELECT * FROM (VALUES (1), (2), (5)) v(w))
SELECT g.conv_id, g.turn, CAST(ws.w AS INTEGER) AS window_size,
       CAST(count(*) + 1 AS INTEGER) AS n_messages,
       CAST(sum(length({strip('c.text')})) AS BIGINT) AS context_chars
FROM targets g CROSS JOIN ws
JOIN t c ON c.conv_id = g.conv_id AND c.turn BETWEEN g.turn - ws.w AND g.turn
GROUP BY g.conv_id, g.turn, ws.w
"""


def _sample_summary(s):
    return s.select("conv_id", "turn", "window_size",
                    F.size("messages").cast("int").alias("n_messages"),
                    F.aggregate(F.slice("messages", 2, F.size("messages")), F.lit(0).cast("long"),
                                lambda acc, m: acc + F.length(m["content"]))
                    .alias("context_chars"))


@register("sft_multi_window", _MULTI_SQL)
def sft_multi_window(spark, sf_dir):
    t = S.normalized_turns(turns(spark, sf_dir))
    return _sample_summary(S.sft_samples(t, [1, 2, 5]))


_FULL_SQL = f"""
SELECT * FROM ({_MULTI_SQL}) s WHERE n_messages - 2 = window_size
"""


@register("sft_full_window", _FULL_SQL)
def sft_full_window(spark, sf_dir):
    t = S.normalized_turns(turns(spark, sf_dir))
    return _sample_summary(S.full_windows(S.sft_samples(t, [1, 2, 5])))


# ---------------------------------------------------------------- W3 / F2

_INFER_W = 5
_INFER_SQL = f"""
WITH ns AS (SELECT conv_id, turn, role, text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k
            FROM conversations WHERE role <> 'system'),
sys AS (SELECT conv_id, arg_min(text, turn) AS system_text FROM conversations
        WHERE role = 'system' GROUP BY conv_id),
u AS (SELECT conv_id, turn, k FROM ns WHERE role = 'user')
SELECT u.conv_id, u.turn, CAST({_INFER_W} AS INTEGER) AS window_size, CAST(0 AS BIGINT) AS pos,
       'system' AS role, sys.system_text AS content
FROM u JOIN sys ON sys.conv_id = u.conv_id
UNION ALL
SELECT u.conv_id, u.turn, CAST({_INFER_W} AS INTEGER) AS window_size,
       CAST(c.k - greatest(1, u.k - {_INFER_W - 1}) + CASE WHEN sys.conv_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS pos,
       c.role, c.text AS content
FROM u JOIN ns c ON c.conv_id = u.conv_id AND c.k BETWEEN u.k - {_INFER_W - 1} AND u.k
LEFT JOIN sys ON sys.conv_id = u.conv_id
"""


@register("inference_context", _INFER_SQL)
def inference_context(spark, sf_dir):
    return S.explode_messages(S.inference_contexts(turns(spark, sf_dir), _INFER_W))


# ---------------------------------------------------------------- A7 stage counts

_STAGES_SQL = f"""
WITH t AS (SELECT conv_id, turn, {norm_role('role')} AS role FROM conversations),
g AS (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role, turn FROM t),
pairs AS (SELECT count(*) FILTER (WHERE role = 'assistant' AND prev_role = 'user') AS n FROM g),
full5 AS (SELECT count(*) FILTER (WHERE role = 'assistant' AND prev_role = 'user' AND turn >= 5) AS n FROM g),
q AS (SELECT count(*) AS n_in, count(*) FILTER (WHERE l.quality = 1) AS n_out
      FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT 'quality_filter' AS stage, q.n_in, q.n_out FROM q
UNION ALL SELECT 'samples_w' || CAST(w AS VARCHAR), (SELECT count(*) FROM conversations), pairs.n
          FROM pairs, (VALUES (1), (2), (5)) v(w)
UNION ALL SELECT 'full_windows_w5', pairs.n, full5.n FROM pairs, full5
"""


@register("stage_counts", _STAGES_SQL)
def stage_counts(spark, sf_dir):
    """Rows in and out of each preparation stage: one aggregate over the joined labels, one over the
    roles and positions of the turns (no text is read)."""
    from ..operators.ordered import lookback
    from ..sources.tables import table
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    doc = table(spark, sf_dir, "documents").select("doc_id")
    mi_quality = F.when(F.col("quality") == 1, "High").otherwise("low")
    q = lab.join(doc, "doc_id").agg(F.count(F.lit(1)).alias("n_in"),
                                    F.count_if(F.lower(mi_quality) == "high").alias("n_out")) \
        .select(F.lit("quality_filter").alias("stage"), "n_in", "n_out")
    t = S.normalized_turns(turns(spark, sf_dir)).drop("text")
    f = lookback(t, ["conv_id"], "turn", 1, ["turn", "role"], out="before", include_current=False)
    pair = (F.col("role") == "assistant") & (F.try_element_at("before", F.lit(-1))["role"] == "user")
    n = f.agg(F.count(F.lit(1)).alias("turns"), F.count_if(pair).alias("pairs"),
              F.count_if(pair & (F.col("turn") >= 5)).alias("full"))
    rows = [F.struct(F.lit(f"samples_w{w}").alias("stage"), F.col("turns").alias("n_in"), F.col("pairs").alias("n_out"))
            for w in (1, 2, 5)]
    rows.append(F.struct(F.lit("full_windows_w5").alias("stage"), F.col("pairs").alias("n_in"), F.col("full").alias("n_out")))
    return q.unionByName(n.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
