"""No row is lost on null keys, and a model is called once per prompt."""

import json
import os

import pytest
from pyspark.sql import functions as F

from convspark.operators import ordered as O
from convspark.operators import scoring as J
from convspark.operators.runs import process_pairs
from convspark.operators.split import split_check, split_ids, split_rows
from convspark.operators.transcripts import labelled_rows_to_turns
from convspark.session import ensure_checkpoint_dir
from convspark.sinks.writers import evaluate_folder, training_metadata, write_summary
from convspark.sources.files import read_dialogue_rows, transcript_turns


@pytest.mark.parametrize("kind,values", [("string", ["a", None, "0"]), ("long", [1, None, 0]), ("date", None), ("timestamp", None)])
def test_null_keys_are_a_key(spark, kind, values):
    values = values or [None, "1970-01-01", "2020-02-02"]
    rows = [(v if v is None or kind in ("long",) else str(v), i) for i in range(7) for v in values]
    df = spark.createDataFrame(rows, "k string, p long" if kind != "long" else "k long, p long").withColumn("k", F.col("k").cast(kind))
    pos = O.dense_position(df, ["k"], ["p"], F.floor(F.col("p") / 2), out="pos")
    assert pos.count() == len(rows) and pos.filter("pos <> p").count() == 0
    run = O.running(pos, ["k"], "pos", [("n", "count", F.lit(1), True)], block=2)
    assert run.columns == ["k", "p", "pos", "n"]
    assert run.count() == len(rows) and run.filter("n <> pos + 1").count() == 0


def test_ends_of_a_null_process_stay(spark):
    rows = [(None, "start", 1, 1), (None, "end", 2, 2), (7, "end", 3, 3)]
    df = spark.createDataFrame(rows, "process long, kind string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s"))
    got = process_pairs(df).select("process", "status").collect()
    assert sorted((str(r["process"]), r["status"]) for r in got) == [("7", "orphan"), ("None", "ok")]


def test_rows_without_transcript_id_are_one_group(spark):
    df = spark.createDataFrame([(1, "client", "hi"), (0, "therapist", "hello")], "utterance_id long, interlocutor string, utterance_text string")
    got = labelled_rows_to_turns(df).orderBy("pos").collect()
    assert [(r["transcript_id"], r["pos"], r["role"], r["text"]) for r in got] == [(None, 0, "assistant", "hello"), (None, 1, "user", "hi")]


def test_null_ids_are_on_neither_side(spark):
    ids = spark.createDataFrame([(i,) for i in range(10)] + [(None,), (None,)], "conv_id long")
    splits = split_ids(ids)
    train, test = split_rows(ids, splits)
    assert (train.count(), test.count()) == (9, 1)
    assert split_check(ids, splits).first()["n_missing"] == 0


def counting(acc):
    def factory():
        def judge(prompt):
            acc.add(1)
            return f"{len(prompt.split()) % 7}, ok"
        return judge
    return factory


def test_one_model_call_per_prompt(spark, tmp_path):
    for n in range(5):
        os.makedirs(tmp_path / "in" / "exp", exist_ok=True)
        (tmp_path / "in" / "exp" / f"conversation_profile{4 - n}_20240101T00000{n}.txt").write_text("Clinician: hi\n\nClient: " + "word " * n + "\n\n")
    calls = spark.sparkContext.accumulator(0)
    out = str(tmp_path / "out")
    scores = evaluate_folder(spark, str(tmp_path / "in"), J.templates_frame(spark), counting(calls), out)
    assert calls.value == scores.count() == 5 * len(J.DEFAULT_TEMPLATES)
    lines = [json.loads(x) for f in sorted(os.listdir(f"{out}/scores")) if f.startswith("part") for x in open(f"{out}/scores/{f}")]
    names = [x["conversation_file"] for x in lines]
    assert names == sorted(names) and len(names) == 5
    (summary,) = [json.loads(x) for f in os.listdir(f"{out}/summary") if f.startswith("part") for x in open(f"{out}/summary/{f}")]
    assert summary["num_conversations"] == 5
    for metric, mean in summary["average_scores"].items():
        vals = [x["scores"][metric]["score"] for x in lines]
        assert abs(mean - sum(vals) / 5) < 1e-12


def test_means_and_summary_call_the_model_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b " * i) for i in range(4)], "conv_id long, transcript string")
    for use in (J.metric_means, lambda s: write_summary(s, str(tmp_path / "s"), "conv_id")):
        calls = spark.sparkContext.accumulator(0)
        prompts = J.render_prompts(docs, J.templates_frame(spark))
        got = use(J.score_replies(J.run_model(prompts, "prompt", counting(calls))))
        if got is not None:
            got.collect()
        assert calls.value == 4 * len(J.DEFAULT_TEMPLATES)


def test_missing_ids_are_row_positions(spark, tmp_path):
    p = tmp_path / "rows.json"
    p.write_text("\n".join(json.dumps(r) for r in ({"dialogue": None}, {"dialogue": "Client: a"}, {"id": "x", "dialogue": "Client: b"}, {"dialogue": "Client: c"})))
    assert sorted(r["id"] for r in read_dialogue_rows(spark, str(p)).collect()) == ["1", "3", "x"]


def test_turns_are_dense(spark):
    df = spark.createDataFrame([("Clinician: a\n\n\n\n\n\nClient: b\n\n",)], "transcript string")
    assert [r["turn"] for r in transcript_turns(df).collect()] == [0, 1]


def test_metadata_counts_words_like_the_token_stats(spark):
    df = spark.createDataFrame([(1, "train", ""), (1, "train", "a\u00a0b c")], "window_size int, split string, text string")
    stats = training_metadata(df).first()["token_length_stats"]
    assert (stats["min"], stats["max"]) == (0, 3)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        def getConf(self):
            return {}
        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
