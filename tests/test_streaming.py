"""Streaming operators on small event files: state edge cases (FIXTURES §C)."""

import os
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from convspark.streaming import live as L
from convspark.streaming.runner import drain, run_to_table

from .conftest import SF_SMALL


def _stream(spark, tmp_path, rows, schema):
    d = str(tmp_path / f"src-{uuid.uuid4().hex[:8]}")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(d)
    return spark.readStream.schema(spark.read.parquet(d).schema).parquet(d)


def test_process_pairs_edge_cases(spark, tmp_path):
    base = 1704067200
    rows = [  # (process, kind, seconds, id)
        (1, "end", 10, 1),                      # end without start -> orphan
        (2, "start", 10, 2), (2, "start", 20, 3), (2, "end", 50, 4),   # start twice -> latest start
        (3, "start", 10, 5), (3, "end", 20, 6), (3, "end", 30, 7),     # two ends after one start
    ]
    df = _stream(spark, tmp_path, [(p, k, base + s, i) for p, k, s, i in rows],
                 "process long, kind string, secs long, event_id long")
    df = df.withColumn("ts", F.timestamp_seconds("secs"))
    out = L.latest(run_to_table(L.live_process_pairs(df), "t2-test"), "process", "event_id").orderBy("process", "end_ts").collect()
    got = [(r.process, r.status, None if r.start_ts is None else int(r.start_ts.timestamp()) - base,
            int(r.end_ts.timestamp()) - base) for r in out]
    assert got == [(1, "orphan", None, 10), (2, "ok", 20, 50), (3, "ok", 10, 20), (3, "orphan", None, 30)]


def test_end_detection_edge_cases(spark, tmp_path):
    base = 1704067200
    conv = {1: [0, 1, 0, 1, 1, 1, 0], 2: [0, 0, 0], 3: [1, 1, 0, 1]}
    rows = [(c, i * 2, bool(v), base + c * 10000 + i * 60) for c, vs in conv.items() for i, v in enumerate(vs)]
    df = _stream(spark, tmp_path, rows, "conv_id long, turn long, verdict boolean, secs long")
    df = df.withColumn("ts", F.timestamp_seconds("secs"))
    out = L.latest(run_to_table(L.live_end_detection(df), "t1-test"), "conv_id").orderBy("conv_id").collect()
    # conversation 1 ends at its 5th check (streak 2), 2 never ends, 3 ends on its second check;
    # later checks of an ended conversation are dropped and counted
    assert [(r.conv_id, r.kind, r.end_turn, r.ignored) for r in out] == [(1, "end", 8, 2), (3, "end", 2, 2)]


def test_rolling_context_keeps_w(spark, tmp_path):
    base = 1704067200
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x" * (t + 1), base + t) for t in range(7)]
    df = _stream(spark, tmp_path, rows, "conv_id long, turn long, role string, text string, secs long")
    df = df.withColumn("ts", F.timestamp_seconds("secs"))
    out = L.latest(run_to_table(L.live_rolling_context(df, 3), "t3-test"), "conv_id", "turn").orderBy("turn").collect()
    assert [(r.turn, r.n_messages, r.context_chars) for r in out] == [(0, 1, 1), (2, 3, 6), (4, 3, 12), (6, 3, 18)]
    assert os.path.isdir(str(tmp_path))


def test_late_and_early_turns_over_several_batches(spark, tmp_path):
    """Two files, one batch each, in either order: the same end, and a null conversation is one too."""
    schema = "conv_id long, turn long, verdict boolean"
    parts = [[(1, 0, True), (1, 2, True), (None, 0, True)], [(1, 4, False), (1, 6, True), (None, 1, True)]]
    for name, order in (("a", parts), ("b", parts[::-1])):
        d = str(tmp_path / name)
        for n, rows in enumerate(order):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{n}")
            time.sleep(1.1)  # file times order the batches
        src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/*"))
        out = L.latest(run_to_table(L.live_end_detection(src), "t1-late"), "conv_id").collect()
        assert {(r.conv_id, r.end_turn, r.ignored) for r in out} == {(1, 2, 2), (None, 1, 0)}


STATEFUL = ["stream_end_detect", "stream_process_pairs", "stream_rolling_context", "stream_request_check", "stream_scores",
            "stream_usage_windows", "stream_sessions"]


@pytest.fixture(scope="module")
def split_tables(spark, tmp_path_factory):
    """Each table as a directory of five part files, rows dealt out without regard to keys or order
    (events in time order, as their watermark asks for)."""
    d = str(tmp_path_factory.mktemp("dirs"))
    for name in ("conversations", "events"):
        t = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        t = t.repartitionByRange(5, "ts").sortWithinPartitions("ts") if name == "events" else t.repartition(5)
        for n, rows in enumerate(np.array_split(t.toPandas(), 5) if name == "events" else []):
            spark.createDataFrame(rows, t.schema).coalesce(1).write.mode("append").parquet(f"{d}/{name}.parquet")
            time.sleep(1.1)
        if name != "events":
            t.write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", STATEFUL)
def test_directory_tables_lose_nothing(spark, split_tables, name):
    from convspark.plans.catalog import QUERIES
    def rows(df):
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert rows(QUERIES[name](spark, split_tables)) == rows(QUERIES[name](spark, SF_SMALL))


@pytest.mark.parametrize("order", ["reverse", "mixed"])
@pytest.mark.parametrize("name", ["stream_usage_windows", "stream_sessions"])
def test_files_out_of_time_order_lose_nothing(spark, tmp_path, name, order):
    """Later events in earlier files, and files that each span the whole time."""
    from convspark.plans.catalog import QUERIES
    rows = spark.read.parquet(f"{SF_SMALL}/events.parquet").toPandas().sort_values("ts", ascending=False)
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    parts = np.array_split(rows, 3) if order == "reverse" else [rows[n::3] for n in range(3)]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(1.1)  # file times order the batches
    def values(df):
        return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert values(QUERIES[name](spark, str(tmp_path))) == values(QUERIES[name](spark, SF_SMALL))


def test_late_rows_are_reported(spark, tmp_path, caplog):
    for n, secs in enumerate((1704067200 + 86400, 1704067200 + 90000, 1704067200)):
        spark.createDataFrame([(secs, "k", 1.0)], "secs long, k string, value double").coalesce(1).write.parquet(f"{tmp_path}/{n}")
        time.sleep(1.1)
    src = (spark.readStream.schema("secs long, k string, value double").option("maxFilesPerTrigger", 1)
           .parquet(f"{tmp_path}/*").withColumn("ts", F.timestamp_seconds("secs")))
    run_to_table(L.windowed_usage(src, "k", "value"), "late")
    assert "1 rows later than the watermark" in caplog.text


def test_inference_windows(spark, tmp_path):
    base = 1704067200
    rows = [("a", base + 60 * k, 10, k, 40, 10 * k) for k in range(50)] + [("a", base, None, None, 40, None), ("b", base, 1, 40, 40, 0)]
    rows += [("a", base + 9000, 1, 1, 40, 5)]  # moves the watermark past the first hour
    src = _stream(spark, tmp_path, rows, "model string, secs long, input_tokens long, generated_tokens long, max_new_tokens long, latency_ms long")
    log = src.withColumn("ts", F.timestamp_seconds("secs"))
    got = {r["model"]: r for r in run_to_table(L.inference_windows(log, "model"), "t6").collect()}
    a, b = got["a"], got["b"]
    assert (a["n"], a["input_tokens"], a["generated_tokens"], a["n_truncated"]) == (51, 500, sum(range(50)), 10)
    assert a["truncated_share"] == 10 / 51

    def edge(x):
        low = max(x.bit_length() - 6, 0)
        return x >> low << low

    assert [a[f"latency_p{q}"] for q in (50, 95, 99)] == [edge(240), edge(470), edge(490)]
    assert (b["latency_p50"], b["n_truncated"]) == (0, 1)
    assert a["window_end"] - a["window_start"] == __import__("datetime").timedelta(hours=1)


def test_late_inference_rows_are_counted(spark, tmp_path):
    for n, secs in enumerate((1704067200 + 86400, 1704067200 + 90000, 1704067200)):
        spark.createDataFrame([("m", secs, 1, 1, 2, 5)], "model string, secs long, input_tokens long, generated_tokens long, "
                              "max_new_tokens long, latency_ms long").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        time.sleep(1.1)
    src = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/0").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    w = L.inference_windows(src.withColumn("ts", F.timestamp_seconds("secs")), "model")
    late = drain(w.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/chk"))
    assert late == 1


def test_requests_go_to_two_sinks_once(spark, tmp_path):
    from convspark.sources.files import read_requests
    good = '{"messages": [{"role": "user", "content": "hé"}]}'
    files = [[good, "{oops", ""], ['{"messages": 3}', good, good], ['{"messages": [{"role": "user"}]}']]
    (tmp_path / "in").mkdir()
    for n, lines in enumerate(files):
        (tmp_path / "in" / f"{n}.log").write_text("\n".join(lines) + "\n")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def sinks():
        ok = spark.read.parquet(f"{out}/accepted").select("n_messages", "messages")
        bad = spark.read.parquet(f"{out}/rejected").select("error", "body")
        return sorted(map(str, ok.collect())), sorted(map(str, bad.collect()))

    def run():
        drain(L.request_log(read_requests(spark, src, stream=True, max_files=1), out, str(tmp_path / "chk")))

    run()
    before = sinks()
    batch = L.live_request_check(read_requests(spark, src))
    assert len(before[0]) == batch.where("status = 'ok'").count() == 3
    assert before[1] == sorted(map(str, batch.where("status <> 'ok'").select("error", "body").collect()))
    run()  # a restart finds nothing new
    assert sinks() == before
    L.split_requests(read_requests(spark, f"{src}/1.log"), out, 1)  # a batch that is written again replaces itself
    first = sinks()
    L.split_requests(read_requests(spark, f"{src}/1.log"), out, 1)
    assert sinks() == first
    (tmp_path / "in" / "9.log").write_text(good + "\n")
    run()
    assert len(sinks()[0]) == len(first[0]) + 1
