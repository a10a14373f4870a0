"""Streaming queries (T1-T7), drained with ``availableNow``; the oracle is the batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import scoring as J
from ..operators.transcripts import render_dialogue, transcript_lines
from ..session import checkpoint_path, cut_lineage
from ..sources.files import read_requests
from ..sources.tables import turns
from ..streaming import live as L
from ..streaming.runner import drain, remove_folder, run_to_table, session_time_zone, table_stream
from .judge import _JUDGE_CTE
from .registry import register
from .runs import _PAIRS_SQL, _streak_cte

def _events(spark, sf_dir, max_files=1):
    """Event stream with ``ts`` as TIMESTAMP (watermarks need it; session zone is UTC)."""
    return table_stream(spark, sf_dir, "events", max_files).withColumn("ts", F.col("ts").cast("timestamp"))


def _ntz(df):
    """Timestamps back to the tables' TIMESTAMP_NTZ (same wall clock in UTC)."""
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp_ntz"))
    return df


# the stand-in verdict depends on the turn's text
_CHECKS_SQL = "SELECT conv_id, turn, length(coalesce(text, '')) % 3 <> 0 AS verdict FROM conversations WHERE role = 'user'"


@register("stream_end_detect", f"""WITH {_streak_cte(_CHECKS_SQL)},
e AS (SELECT conv_id, min(turn) AS end_turn FROM st WHERE streak >= 2 GROUP BY conv_id)
SELECT e.conv_id, 'end' AS kind, e.end_turn, CAST(2 AS BIGINT) AS streak,
       (SELECT count(*) FROM st WHERE st.conv_id = e.conv_id AND st.turn > e.end_turn) AS ignored
FROM e""")
def stream_end_detect(spark, sf_dir):
    s = table_stream(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    checks = s.select("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))) % 3 != 0).alias("verdict"))
    return L.latest(run_to_table(L.live_end_detection(checks), "end_detect"), "conv_id")


@register("stream_process_pairs", f"SELECT process, end_ts, start_ts, status FROM ({_PAIRS_SQL}) p")
def stream_process_pairs(spark, sf_dir):
    with session_time_zone(spark):
        e = _events(spark, sf_dir).filter(F.col("event_type").isin("signup", "purchase"))
        e = e.select(F.col("user_id").alias("process"),
                     F.when(F.col("event_type") == "signup", "start").otherwise("end").alias("kind"),
                     "ts", "event_id")
        found = L.latest(run_to_table(L.live_process_pairs(e), "process_pairs"), "process", "event_id")
        return _ntz(found.drop("event_id"))


_CTX_SQL = """
WITH ns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role <> 'system'),
w AS (SELECT conv_id, turn, role, count(*) OVER x AS n_messages, sum(length(text)) OVER x AS context_chars,
             string_agg(role || ': ' || text, chr(10)) OVER x AS context FROM ns
      WINDOW x AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT conv_id, turn, CAST(n_messages AS INTEGER) AS n_messages, CAST(context_chars AS BIGINT) AS context_chars, context
FROM w WHERE role = 'user'"""


@register("stream_rolling_context", _CTX_SQL)
def stream_rolling_context(spark, sf_dir):
    s = table_stream(spark, sf_dir, "conversations")
    return L.latest(run_to_table(L.live_rolling_context(s, 5), "rolling_context"), "conv_id", "turn")


# request bodies made from every turn's role and text; some are broken, by text length and role
_T4_SQL = """
SELECT conv_id, turn,
  CASE WHEN length(text) % 5 = 0 THEN 'Invalid JSON' WHEN length(text) % 5 = 1 THEN 'Messages must be a list'
       WHEN length(text) % 5 = 2 AND turn = 0 THEN 'No messages provided'
       WHEN role = 'system' THEN 'Invalid message format at index 0' END AS error,
  CASE WHEN length(text) % 5 < 2 OR role = 'system' OR (length(text) % 5 = 2 AND turn = 0) THEN 'error' ELSE 'ok' END AS status
FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations) t"""


@register("stream_request_check", _T4_SQL)
def stream_request_check(spark, sf_dir):
    s = table_stream(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    k = F.length("text") % 5
    one = F.to_json(F.struct("role", F.when(F.col("role") != "system", F.col("text")).alias("content")))
    whole = F.concat(F.lit('{"messages": ['), one, F.lit("]}"))
    body = (F.when(k == 0, F.expr("substring(whole, 1, length(whole) - 2)"))
            .when(k == 1, F.concat(F.lit('{"messages": {"text": '), F.to_json(F.array("text")), F.lit("}}")))
            .when((k == 2) & (F.col("turn") == 0), F.lit('{"messages": []}'))
            .otherwise(F.col("whole")))
    out = L.live_request_check(s.withColumn("whole", whole).select("conv_id", "turn", body.alias("body")))
    return run_to_table(out.select("conv_id", "turn", "error", "status"), "request_check")


@register("stream_scores", f"""WITH {_JUDGE_CTE}
SELECT metric, avg(score) AS avg_score, count(score) AS n_scored FROM js GROUP BY metric""")
def stream_scores(spark, sf_dir):
    # the transcripts, many to a file, written first and then scored as a file stream
    lines = transcript_lines(turns(spark, sf_dir))
    docs = render_dialogue(lines, F.col("line"), "", out="transcript")
    folder = checkpoint_path(spark, "streams", "transcripts-" + uuid.uuid4().hex[:12])
    docs.select(F.col("conv_id").cast("string").alias("file"), "transcript").write.parquet(folder)
    files = (spark.readStream.schema("file string, transcript string").option("maxFilesPerTrigger", 4)
             .parquet(folder))
    scores = L.live_scores(files, J.templates_frame(spark))
    means = run_to_table(L.running_metric_means(scores), "scores", mode="complete")
    remove_folder(spark, folder)
    return means


# one request a conversation, all its turns as messages; some are broken, by the length of their texts
_REQ_SQL = """
WITH c AS (SELECT conv_id, count(*) AS n, sum(length(coalesce(text, ''))) AS chars FROM conversations GROUP BY conv_id)
SELECT CASE WHEN chars % 5 = 4 THEN 'accepted' ELSE 'rejected' END AS sink,
  CASE chars % 5 WHEN 0 THEN 'Invalid JSON' WHEN 1 THEN 'Messages must be a list' WHEN 2 THEN 'No messages provided'
                 WHEN 3 THEN 'Invalid message format at index ' || (n - 1) END AS error,
  count(*) AS n_requests, CAST(sum(CASE WHEN chars % 5 = 4 THEN n ELSE 0 END) AS BIGINT) AS n_messages,
  CAST(sum(CASE WHEN chars % 5 = 4 THEN chars ELSE 0 END) AS BIGINT) AS content_chars
FROM c GROUP BY 1, 2"""


def _request_bodies(t):
    """The turn table as request bodies ``(conv_id, body)``."""
    text = F.coalesce("text", F.lit(""))
    c = t.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", text.alias("content")))),
                    lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("m"),
        (F.sum(F.length(text)) % 5).alias("k"))
    last = F.struct(F.element_at("m", -1)["role"].alias("role"), F.lit(None).cast("string").alias("content"))
    broken = F.concat(F.slice("m", 1, F.size("m") - 1), F.array(last))
    whole = F.to_json(F.struct(F.when(F.col("k") == 3, broken).when(F.col("k") == 2, F.slice("m", 1, 0)).otherwise(F.col("m")).alias("messages")))
    one = F.to_json(F.struct(F.element_at("m", 1).alias("messages")))
    body = F.when(F.col("k") == 1, one).when(F.col("k") == 0, F.expr("left(whole, length(whole) - 2)")).otherwise(F.col("whole"))
    return c.withColumn("whole", whole).select("conv_id", body.alias("body"))


@register("stream_request_log", _REQ_SQL)
def stream_request_log(spark, sf_dir):
    # the bodies, many to a text file, written first and then read as a file stream
    folder = checkpoint_path(spark, "streams", "requests-" + uuid.uuid4().hex[:12])
    _request_bodies(turns(spark, sf_dir)).select("body").write.text(f"{folder}/in")
    requests = read_requests(spark, f"{folder}/in", stream=True, max_files=4)
    drain(L.request_log(requests, f"{folder}/out", f"{folder}/chk"))
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.length(m["content"]))
    ok = spark.read.parquet(f"{folder}/out/accepted").select(
        F.lit("accepted").alias("sink"), F.lit(None).cast("string").alias("error"), F.col("n_messages").cast("long").alias("n"), chars.alias("chars"))
    bad = spark.read.parquet(f"{folder}/out/rejected").select(
        F.lit("rejected").alias("sink"), "error", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("chars"))
    out = cut_lineage(ok.unionByName(bad).groupBy("sink", "error").agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum("n").alias("n_messages"), F.sum("chars").alias("content_chars")))
    remove_folder(spark, folder)
    return out


# an inference log made of the events: latency, tokens and limit from their value and properties
_INFER_SQL = """
WITH l AS (SELECT ts, event_type, length(props) AS input_tokens, CAST(floor(value) AS BIGINT) AS generated_tokens,
                  CAST(round(value * 100) AS BIGINT) AS ms FROM events),
e AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, greatest(length(bin(ms)) - 6, 0) AS low FROM l),
g AS (SELECT window_start, event_type, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
             CAST(sum(generated_tokens) AS BIGINT) AS generated_tokens,
             count(*) FILTER (WHERE generated_tokens >= 64) AS n_truncated, list((ms >> low) << low ORDER BY ms) AS ls
      FROM e GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, n, input_tokens, generated_tokens, n_truncated,
       n_truncated / n AS truncated_share, ls[(n * 50 + 99) // 100] AS latency_p50, ls[(n * 95 + 99) // 100] AS latency_p95,
       ls[(n * 99 + 99) // 100] AS latency_p99
FROM g, (SELECT max(ts) AS m FROM events) mx WHERE window_start + INTERVAL 1 HOUR <= m - INTERVAL 1 HOUR"""


@register("stream_inference_windows", _INFER_SQL)
def stream_inference_windows(spark, sf_dir):
    with session_time_zone(spark):
        log = _events(spark, sf_dir, None).select(
            "ts", "event_type", F.length("props").alias("input_tokens"), F.floor("value").alias("generated_tokens"),
            F.lit(64).alias("max_new_tokens"), F.round(F.col("value") * 100).cast("long").alias("latency_ms"))
        return _ntz(run_to_table(L.inference_windows(log, "event_type"), "inference_windows"))


_T6_SQL = """
WITH mx AS (SELECT max(ts) AS m FROM events),
g AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total
      FROM events GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, n, total
FROM g, mx WHERE window_start + INTERVAL 1 HOUR <= mx.m - INTERVAL 1 HOUR"""


@register("stream_usage_windows", _T6_SQL)
def stream_usage_windows(spark, sf_dir):
    with session_time_zone(spark):
        # a backfill: all files under one watermark, as their order says nothing about the rows' times
        return _ntz(run_to_table(L.windowed_usage(_events(spark, sf_dir, None), "event_type", "value"),
                                 "usage_windows"))


_T7_SQL = """
WITH mx AS (SELECT max(ts) AS m FROM events),
l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                               OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR
                          THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l),
g AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events
      FROM s GROUP BY user_id, sid)
SELECT user_id, session_start, session_end, n_events FROM g, mx WHERE session_end <= mx.m - INTERVAL 1 HOUR"""


@register("stream_sessions", _T7_SQL)
def stream_sessions(spark, sf_dir):
    with session_time_zone(spark):
        return _ntz(run_to_table(L.idle_sessions(_events(spark, sf_dir, None), "user_id"), "sessions"))
