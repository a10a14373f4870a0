"""Labelled rows and dialogue exports to SFT files; run histories; packed transcripts."""

import json
import os

from pyspark.sql import functions as F

from convspark.operators.prepare import conversation_turns, prepare_sft
from convspark.operators.transcripts import labelled_rows_to_turns
from convspark.sinks import writers as W
from convspark.sources import files as SRC
from convspark.sources.tables import turns

from .conftest import SF_SMALL

RUN = {"eval_steps": 100, "use_early_stopping": True, "early_stopping_patience": 3}


def lines(folder):
    return [json.loads(x) for f in sorted(os.listdir(folder)) if f.endswith(".json") for x in open(f"{folder}/{f}")]


def test_csv_to_sft_files(spark, tmp_path):
    p = tmp_path / "rows.csv"
    rows = ["mi_quality,transcript_id,utterance_id,interlocutor,utterance_text"]
    for conv in range(10):
        for n in range(4):
            rows.append(f"high,{conv},{n},{'client' if n % 2 == 0 else 'therapist'},say {conv} {n} <think>x</think>")
    rows.append("low,99,0,client,dropped")
    p.write_text("\n".join(rows) + "\n")
    t = conversation_turns(labelled_rows_to_turns(SRC.read_labelled_csv(spark, str(p))))
    out = str(tmp_path / "sft")
    W.write_prepared(prepare_sft(t, [1, 3], require_full_window=True), out, RUN)
    got = spark.read.parquet(f"{out}/samples").collect()
    # two pairs a conversation at window 1, one full window of 3
    assert sum(r.window_size == 1 for r in got) == 20 and sum(r.window_size == 3 for r in got) == 10
    assert len({r.conv_id for r in got if r.split == "train"}) == 9
    one = next(r for r in got if r.conv_id == "4" and r.window_size == 1 and r.turn == 3)
    assert one.text.endswith("<|im_start|>user\nsay 4 2 <|im_end|>\n<|im_start|>assistant\nsay 4 3 <|im_end|>")
    meta = {m["window_size"]: m for m in lines(f"{out}/metadata")}
    assert set(meta) == {1, 3}
    assert (meta[1]["num_raw_train_examples"], meta[1]["num_raw_eval_examples"]) == (18, 2)
    assert meta[3]["num_formatted_train_examples"] == 9 and meta[3]["early_stopping_patience"] == 3
    n = [len(r.text.split()) for r in got if r.window_size == 1 and r.split == "test"]
    stats = meta[1]["eval_token_length_stats"]
    assert (stats["min"], stats["max"], stats["sample_count"]) == (min(n), max(n), 2)


def test_json_to_samples_and_one_group_without_ids(spark, tmp_path):
    p = tmp_path / "rows.json"
    p.write_text("\n".join(json.dumps({"dialogue": f"Client: a{i}\nCounselor: b{i}"}) for i in range(10)))
    got = prepare_sft(conversation_turns(SRC.read_dialogue_rows(spark, str(p))), [1]).collect()
    assert sorted(r.conv_id for r in got) == [str(i) for i in range(10)]
    assert sum(r.split == "train" for r in got) == 9
    df = spark.createDataFrame([(0, "client", "hi"), (1, "therapist", "yes")], "utterance_id long, interlocutor string, utterance_text string")
    (only,) = prepare_sft(conversation_turns(labelled_rows_to_turns(df)), [1]).collect()
    assert (only.conv_id, only.turn, only.split) == ("", 1, "test")


def test_a_side_without_samples_has_zero_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "a b")], "window_size int, split string, text string")
    W.write_training_metadata(df, str(tmp_path / "m"), {})
    (m,) = lines(tmp_path / "m")
    assert (m["num_raw_eval_examples"], m["eval_token_length_stats"]) == (0, None)


def test_best_and_stop_checkpoints(spark, tmp_path):
    losses = {"w1": [3.0, 2.0, 2.0, 2.5, 2.1, 1.0], "w5": [1.0, 0.5], None: [2.0, 1.0]}
    rows = [(run, 100 * (n + 1), v) for run, vs in losses.items() for n, v in enumerate(vs)] + [("bad", 100, None)]
    df = spark.createDataFrame(rows, "run string, step long, eval_loss double")
    W.append_eval_history(df, str(tmp_path / "h"))
    W.write_best_checkpoints(spark.read.parquet(str(tmp_path / "h")), str(tmp_path / "b"))
    got = {m["run"]: m for m in lines(tmp_path / "b")}
    assert (got["w1"]["best_checkpoint"], got["w1"]["stop_checkpoint"], got["w1"]["n_evals"]) == ("checkpoint-600", "checkpoint-500", 6)
    assert (got["w5"]["best_checkpoint"], got["w5"]["stop_checkpoint"], got["w5"]["best_loss"]) == ("checkpoint-200", None, 0.5)
    assert got[None]["best_checkpoint"] == "checkpoint-200"
    assert (got["bad"]["best_checkpoint"], got["bad"]["n_evals"]) == (None, 1)


def test_packed_transcripts_hold_the_same_texts(spark, tmp_path):
    t = turns(spark, SF_SMALL).withColumn("experiment", F.concat(F.lit("exp"), (F.col("conv_id") % 2).cast("string"))) \
        .withColumn("profile_id", (F.col("conv_id") % 12).cast("int")) \
        .withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 100 + F.col("turn")))
    W.write_transcripts(t, str(tmp_path / "one"))
    W.write_transcripts(t.coalesce(1), str(tmp_path / "many"), packed=True)
    cols = ["experiment", "profile_id", "ts", "transcript"]

    def rows(df):
        return sorted((r.asDict().items() for r in df.select(*cols).collect()), key=str)

    packed = SRC.read_transcripts(spark, str(tmp_path / "many"), packed=True)
    one = SRC.read_transcripts(spark, str(tmp_path / "one"))
    assert packed.count() == t.select("conv_id").distinct().count()
    assert [dict(r) for r in rows(one)] == [dict(r) for r in rows(packed)]
