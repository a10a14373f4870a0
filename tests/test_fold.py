"""Ordered folds: blocks and levels change no answer, and a block's summary does not grow."""

import json
import random

import pytest
from pyspark.sql import functions as F

from convspark.streaming import live as L
from convspark.streaming.fold import EndWork, FrameWork, in_order
from convspark.streaming.runner import drain, fold_writers


class Frames(FrameWork):
    def asks(self, row):
        return row[1]

    def name(self, row):
        return str(row[0])

    def answer(self, row, before):
        return [row[0], [r[0] for r in before]]


def folded(work, rows, block, fan, levels):
    """The operators' answers, without Spark."""
    answers, nodes = {}, {}
    for r in rows:
        nodes.setdefault(r[0] // block, []).append(r)
    for k in nodes:
        got, nodes[k] = work.leaf(sorted(nodes[k], key=in_order))
        answers |= got
    for level in range(levels + 1):
        above = {}
        for k, s in sorted(nodes.items()):
            above.setdefault(0 if level == levels else k // fan, []).append(s)
        for k, children in above.items():
            got, above[k] = work.join(json.loads(json.dumps(children)), level == levels)
            answers |= got
        nodes = above
    return answers


def test_blocks_and_levels_change_no_answer():
    rng = random.Random(1)
    for _ in range(300):
        at = rng.sample(range(400), rng.randrange(1, 60))
        rows = [[a, rng.random() < rng.choice((0.3, 0.6))] for a in sorted(at)]
        k, back = rng.randint(1, 4), rng.randrange(5)
        block, fan, levels = rng.choice((1, 3, 16, 500)), rng.choice((2, 5)), rng.randrange(3)
        ends = [i for i in range(k - 1, len(rows)) if all(r[1] for r in rows[i - k + 1:i + 1])]
        want = ["end", rows[ends[0]][0], k, len(rows) - ends[0] - 1] if ends else [None] * 4
        assert folded(EndWork(k), rows, block, fan, levels) == {"end": want}
        want = {str(r[0]): [r[0], [x[0] for x in rows[max(0, i - back):i]]] for i, r in enumerate(rows) if r[1]}
        assert folded(Frames(back), rows, block, fan, levels) == want


def test_summaries_do_not_grow():
    for work, size in ((EndWork(2), 160), (Frames(4), 400)):
        parts = [work.leaf([[n, n % 3 > 0] for n in range(k * 50, k * 50 + 50)])[1] for k in range(2000)]
        assert len(json.dumps(work.join(parts, False)[1])) < size


def batches(spark, folder, parts, schema, live):
    """The changes after each part, which comes as a file of its own; the levels stop and resume in between."""
    out, seen = [], 0
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{n}")
        f = live(spark.readStream.schema(schema).parquet(f"{folder}/in/*"))
        for w in fold_writers(f, f"{folder}/out", f"{folder}/chk"):
            drain(w)
        changes = f.answers(spark.read.schema(f.leaves.schema).parquet(f"{folder}/out/{len(f.levels)}")).cache()
        out.append((changes.count() - seen, changes))
        seen = changes.count()
    return out


@pytest.mark.parametrize("levels", [0, 1])
def test_a_late_no_takes_the_end_back(spark, tmp_path, levels):
    (first, a), (second, b) = batches(
        spark, tmp_path, [[(1, 0, True), (1, 9, True), (2, 0, True), (2, 1, True), (3, 0, True)], [(1, 5, False), (2, 7, True)]],
        "conv_id long, turn long, verdict boolean", lambda s: L.live_end_detection(s, block=4, levels=levels))
    assert {tuple(r) for r in L.latest(a, "conv_id").collect()} == {(1, "end", 9, 2, 0), (2, "end", 1, 2, 0)}
    assert [tuple(r) for r in L.latest(b, "conv_id").collect()] == [(2, "end", 1, 2, 1)]
    assert (first, second) == (2, 2)  # both ends, then one taken back and one more turn after the other


def test_a_batch_answers_only_what_it_changes(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, t, "user", "x" * (t % 7)) for t in range(0, 600, 2)]
    (first, _), (second, changes) = batches(spark, tmp_path, [rows, [(1, 301, "assistant", "late"), (None, 3, "user", None)]], schema,
                                            lambda s: L.live_rolling_context(s, 4, block=10))
    assert (first, second) == (300, 3 + 1)  # the late row lies in the frames of three user turns
    got = {(r["conv_id"], r["turn"]): r for r in L.latest(changes, "conv_id", "turn").collect()}
    assert got[(1, 302)]["context"].split("\n")[-2] == "assistant: late" and got[(None, 3)]["context"] == "user: "
    assert got[(1, 600 - 2)]["n_messages"] == 4 and len(got) == 301


def test_pairs_over_blocks_and_batches(spark, tmp_path):
    at = 1704067200
    parts = [[(1, "end", at + 7300, 2), (1, "start", at, 1)], [(1, "start", at + 7200, 3), (1, "end", at + 20_000, 4)]]
    _, (_, changes) = batches(spark, tmp_path, parts, "process long, kind string, secs long, event_id long",
                              lambda s: L.live_process_pairs(s.withColumn("ts", F.timestamp_seconds("secs")), levels=1))
    got = L.latest(changes, "process", "event_id").collect()
    assert {(r["event_id"], r["status"], r["start_ts"] and int(r["start_ts"].timestamp()) - at) for r in got} == {(2, "ok", 7200), (4, "orphan", None)}


def test_processes_share_groups_of_state(spark, tmp_path):
    """200 processes with two events of one hour each: a group of state per bucket, not per process."""
    at, schema = 1704067200, "process long, kind string, secs long, event_id long"
    big = 1 << 60  # a null beside it must not turn it into a double
    rows = [r for n in [*range(200), None] for p in [None if n is None else big + n]
            for r in ((p, "end", at + 60, 1000 + (n or 0) * 2), (p, "start", at, 1001 + (n or 0) * 2))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    f = L.live_process_pairs(spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("secs")))
    groups = []
    for w in fold_writers(f, f"{tmp_path}/out", f"{tmp_path}/chk"):
        q = w.trigger(availableNow=True).start()
        q.awaitTermination()
        groups.append(sum(s["numRowsTotal"] for s in q.recentProgress[0]["stateOperators"]))
    assert groups[0] <= L.PROCESS_BUCKETS and groups[1] == 201
    got = f.answers(spark.read.schema(f.leaves.schema).parquet(f"{tmp_path}/out/1")).collect()
    assert {r["process"] for r in got} == {None, *range(big, big + 200)} and all(r["status"] == "ok" for r in got)
