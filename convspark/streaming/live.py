"""Live operators on Structured Streaming.

* T1 end detection, T2 process pairing, T3 rolling context: ordered folds (``fold``) with state per
  (key, block) and a node that joins the blocks' summaries.  Rows may arrive in any order and over
  any number of micro-batches; an answer that a batch changes is emitted again with a higher
  ``rev``, and the row with the highest ``rev`` counts (``latest``).  There is no watermark, so no
  row is dropped; ``idle`` optionally forgets state that had no row for so long.
* T4 request validation: stateless ``readStream`` + the F10 expression.
* T5 judge scoring of arriving transcripts: file source + stream-static template join + the
  model operator + a running mean per metric.
* T6 inference windows and T7 idle sessions: built-in ``window`` / ``session_window`` aggregations
  with a watermark, whose feature it is to leave out rows later than that.  The queries drain a
  table's files under one watermark, so there no row is late.

Every writer uses a checkpoint under the shared ``spark.checkpoint.dir`` so a
restarted query resumes exactly once.
"""

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import END_STREAK
from ..functions.jsonmsg import request_check
from ..operators import scoring as J
from .fold import EndWork, Fold, FrameWork, fold

TURNS = 1024  # turns per block
TEXT_TURNS = 128  # the same where the state holds their texts
HOUR = 3_600_000_000  # microseconds per block of events
PROCESS_BUCKETS = 8  # of processes, whose events of an hour are folded in one group


def latest(changes: DataFrame, *keys: str) -> DataFrame:
    """The last state of each answer: the rows with the highest ``rev`` per ``keys``, without those taken back
    (all values null)."""
    rest = [c for c in changes.columns if c not in (*keys, "rev")]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "rev").alias("_v")).select(*keys, "_v.*")
    return last.where(F.coalesce(*[F.col(c).cast("string") for c in rest]).isNotNull())


def _row(*cols: str) -> Column:
    """The columns as JSON text, nulls kept."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


# ---------------------------------------------------------------- T1 end detection

def live_end_detection(checks: DataFrame, idle: str | None = None, block: int = TURNS, levels: int = 0) -> Fold:
    """``checks`` stream (conv_id, turn, verdict) -> ``conv_id, kind, end_turn, streak, ignored`` once the
    streak reaches the threshold, and again whenever later or earlier turns change it (``ignored``
    counts the turns after the end); all null when a late turn undoes the end."""
    row = _row("turn", "verdict")
    return fold(checks, "conv_id", row, F.floor(F.col("turn") / block), EndWork(END_STREAK),
                "kind string, end_turn long, streak long, ignored long", levels=levels, idle=idle)


# ---------------------------------------------------------------- T2 process pairing

class _Pairs(FrameWork):
    """Each end event with the event before it: rows ``us, event_id, kind``."""

    def asks(self, row):
        return row[2] == "end"

    def name(self, row):
        return str(row[1])

    def answer(self, row, before):
        start = before[-1][0] if before and before[-1][2] == "start" else None
        return [row[1], row[0], start, "orphan" if start is None else "ok"]


def live_process_pairs(events: DataFrame, idle: str | None = None, block: int = HOUR, levels: int = 0,
                       buckets: int | None = PROCESS_BUCKETS) -> Fold:
    """``events`` stream (process, kind start|end, ts, event_id) -> ``process, event_id, end_ts, start_ts, status``
    per end event, and again when an event that belongs before it arrives later.  ``block``: microseconds."""
    rows = events.withColumn("us", F.unix_micros("ts"))
    row = _row("us", "event_id", "kind")
    found = fold(rows, "process", row, F.floor(F.col("us") / block), _Pairs(1),
                 "event_id long, end_us long, start_us long, status string", levels=levels, idle=idle, buckets=buckets)
    return Fold(found.leaves, found.levels, lambda last: found.answers(last).select(
        "process", "event_id", F.timestamp_micros("end_us").alias("end_ts"),
        F.timestamp_micros("start_us").alias("start_ts"), "status", "rev"))


# ---------------------------------------------------------------- T3 rolling context

class _Contexts(FrameWork):
    """Each user turn with the messages before it: rows ``turn, role, text``."""

    def asks(self, row):
        return row[1] == "user"

    def name(self, row):
        return f"{row[0]} {zlib.crc32((row[2] or '').encode())}"

    def answer(self, row, before):
        recent = [(r, t or "") for _, r, t in [*before, row]]
        return [row[0], len(recent), sum(len(t) for _, t in recent), "\n".join(f"{r}: {t}" for r, t in recent)]


def live_rolling_context(turns: DataFrame, w: int, idle: str | None = None, block: int = TEXT_TURNS,
                         levels: int = 0) -> Fold:
    """Turn stream -> at each user turn the last ``w`` non-system messages: ``conv_id, turn, n_messages,
    context_chars, context`` (``role: text`` lines)."""
    talk = turns.filter(F.col("role") != "system")
    row = _row("turn", "role", "text")
    return fold(talk, "conv_id", row, F.floor(F.col("turn") / block), _Contexts(w - 1),
                "turn long, n_messages int, context_chars long, context string", levels=levels, idle=idle)


# ---------------------------------------------------------------- T4 request validation

def live_request_check(requests: DataFrame, body: str = "body") -> DataFrame:
    """T4: stateless validation; ``status`` splits the stream into ok / error branches."""
    chk = request_check(body)
    return requests.withColumn("error", chk["error"]).withColumn("n_messages", chk["n_messages"]) \
        .withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))


def split_requests(requests: DataFrame, out: str, batch_id: int) -> None:
    """F10 on one batch of ``(body, file)``: accepted requests go to ``<out>/accepted`` as their messages, the others to
    ``<out>/rejected`` with the reason and the body as it came.  A batch that is written again replaces itself."""
    rows = live_request_check(requests).persist()
    try:
        messages = F.from_json("body", "struct<messages: array<struct<role: string, content: string>>>")["messages"]
        for sink, part in (("accepted", rows.where("status = 'ok'").select("file", "n_messages", messages.alias("messages"))),
                           ("rejected", rows.where("status <> 'ok'").select("file", "error", "body"))):
            part.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{sink}/batch={int(batch_id)}")
    finally:
        rows.unpersist()


def request_log(requests: DataFrame, out: str, checkpoint: str):
    """S9 + T4: a writer that validates a stream of request bodies into two sinks, accepted and rejected, each
    batch exactly once (start it with a trigger)."""
    return requests.writeStream.foreachBatch(lambda rows, batch: split_requests(rows, out, batch)).option(
        "checkpointLocation", checkpoint)


# ---------------------------------------------------------------- T5 scoring arriving transcripts

def live_scores(transcripts: DataFrame, templates: DataFrame, factory=J.word_count_judge) -> DataFrame:
    """T5: transcript-file stream (file, transcript) -> long scores (stream-static join)."""
    prompts = J.render_prompts(transcripts, templates)
    return J.score_replies(J.run_model(prompts, "prompt", factory, drop=("prompt", "transcript")))


def running_metric_means(scores: DataFrame) -> DataFrame:
    """T5 aggregate: running mean per metric (emit in complete or update mode)."""
    return scores.groupBy("metric").agg(F.avg("score").alias("avg_score"), F.count("score").alias("n_scored"))


# ---------------------------------------------------------------- T6 / T7

#: A latency keeps this many leading bits, so a percentile is exact to one part in 32.
LATENCY_BITS = 6
PERCENTILES = (50, 95, 99)


def latency_edge(ms: str) -> Column:
    """The lower edge of a whole latency's histogram bucket: its leading bits, the rest zero."""
    low = f"greatest(length(bin({ms})) - {LATENCY_BITS}, 0)"
    return F.when(F.col(ms) >= 0, F.expr(f"shiftleft(shiftright({ms}, {low}), {low})"))


def inference_windows(log: DataFrame, key: str, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """The inference log ``(ts, key, input_tokens, generated_tokens, max_new_tokens, latency_ms bigint)`` per
    window and key: requests, token sums, how many and which share hit their token limit, and percentiles of
    latency.

    The state is a histogram: sums per window, key and latency bucket, which merge by addition (some 32 buckets
    per power of two, whatever the traffic), then one row per window and key.  A percentile is the lower edge of
    the bucket that holds it, null without a latency.  Rows later than the watermark are left out and counted.
    """
    truncated = F.count_if(F.col("generated_tokens") >= F.col("max_new_tokens"))
    sums = ["n", "input_tokens", "generated_tokens", "n_truncated"]
    buckets = (log.withColumn("edge", latency_edge("latency_ms")).withWatermark("ts", delay)
               .groupBy(F.window("ts", size).alias("w"), key, "edge")
               .agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"),
                    F.sum("generated_tokens").alias("generated_tokens"), truncated.alias("n_truncated")))
    bars = F.array_sort(F.collect_list(F.when(F.col("edge").isNotNull(), F.struct("edge", "n"))))
    per = (buckets.groupBy(F.window(F.window_time("w"), size).alias("w"), key)
           .agg(*[F.sum(c).alias(c) for c in sums], bars.alias("bars")))
    total = F.aggregate("bars", F.lit(0).cast("bigint"), lambda n, b: n + b["n"])

    def percentile(q: int) -> Column:
        """The first bucket up to which the count reaches ``q`` percent of all."""
        rank = F.floor((total * q + 99) / 100)
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("edge"))
        return F.aggregate("bars", start, lambda s, b: F.struct(
            (s["n"] + b["n"]).alias("n"), F.when(s["n"] < rank, b["edge"]).otherwise(s["edge"]).alias("edge")))["edge"]

    return per.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, *sums,
                      (F.col("n_truncated") / F.col("n")).alias("truncated_share"),
                      *[percentile(q).alias(f"latency_p{q}") for q in PERCENTILES])


def windowed_usage(events: DataFrame, key: str, value: str, size: str = "1 hour",
                   delay: str = "1 hour") -> DataFrame:
    """Tumbling-window totals per key; rows later than the watermark are dropped."""
    return (events.withWatermark("ts", delay)
            .groupBy(F.window("ts", size).alias("w"), key)
            # doubles summed in arrival order: round so totals do not depend on that order
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "total"))


def idle_sessions(events: DataFrame, key: str, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions closed after ``gap`` without activity (session windows + watermark)."""
    return (events.withWatermark("ts", delay)
            .groupBy(F.session_window("ts", gap).alias("s"), key)
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events"))
