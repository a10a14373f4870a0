"""File sources and sinks: round trips in a temp folder."""

import json
import os

from pyspark.sql import functions as F

from convspark.operators import scoring as J
from convspark.sinks import writers as W
from convspark.sources import files as SRC
from convspark.sources.tables import turns

from .conftest import SF_SMALL


def test_transcripts_round_trip(spark, tmp_path):
    t = turns(spark, SF_SMALL).withColumn("experiment", F.concat(F.lit("exp"), (F.col("conv_id") % 2).cast("string"))) \
        .withColumn("profile_id", (F.col("conv_id") % 12).cast("int")) \
        .withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id")))
    out = str(tmp_path / "data_out")
    W.write_transcripts(t, out)
    docs = SRC.read_transcripts(spark, out)
    assert docs.count() == t.select("conv_id").distinct().count()
    row = docs.filter("profile_id = 1").collect()[0]
    assert row.experiment == "exp1" and str(row.ts) == "2024-01-01 00:00:01"
    back = SRC.transcript_turns(docs)
    assert back.filter(F.col("role").isNull()).count() == 0
    # every non-system turn comes back, in order, with cleaned text
    assert back.count() == t.filter("role in ('user', 'assistant')").count()
    assert SRC.read_transcripts(spark, str(tmp_path / "missing")).count() == 0


def test_transcript_name_parsing(spark, tmp_path):
    d = tmp_path / "one_shot"
    d.mkdir()
    (d / "conversation_profile3_20250102T030405_original.txt").write_text(
        "Clinician: Hello\n\nClient: I feel: tired\n\n")
    (d / "notes.md").write_text("ignored")
    docs = SRC.read_transcripts(spark, str(tmp_path)).collect()
    assert len(docs) == 1 and docs[0].experiment == "one_shot" and docs[0].profile_id == 3
    assert str(docs[0].ts) == "2025-01-02 03:04:05"
    turns_ = SRC.transcript_turns(SRC.read_transcripts(spark, str(tmp_path))).orderBy("turn").collect()
    assert [(r.role, r.text) for r in turns_] == [("assistant", "Hello"), ("user", "I feel: tired")]


def test_labelled_csv_na_tokens(spark, tmp_path):
    p = tmp_path / "annomi.csv"
    p.write_text('mi_quality,transcript_id,utterance_id,interlocutor,utterance_text,text\n'
                 'high,1,2,client,None,fallback\n'
                 'HIGH,1,1,therapist,"multi\nline",x\n'
                 'low,2,1,client,skip,x\n'
                 'high,,3,client,no id,x\n'
                 'high,3,1,client,NA,\n')
    from convspark.operators.transcripts import labelled_rows_to_turns
    rows = labelled_rows_to_turns(SRC.read_labelled_csv(spark, str(p))).orderBy("transcript_id", "pos").collect()
    assert [(r.transcript_id, r.pos, r.role, r.text) for r in rows] == [
        ("1", 0, "assistant", "multi\nline"), ("1", 1, "user", "fallback"), ("3", 0, "user", "")]


def test_dialogue_rows_and_profiles(spark, tmp_path):
    p = tmp_path / "cactus.json"
    p.write_text(json.dumps({"id": "a", "dialogue": "Counselor: hi\nClient: hello"}) + "\n"
                 + json.dumps({"dialogue": None}) + "\n")
    rows = SRC.read_dialogue_rows(spark, str(p)).collect()
    assert [(r.id, r.turn, r.role, r.text) for r in rows] == [("a", 0, "assistant", "hi"), ("a", 1, "user", "hello")]
    prof = tmp_path / "profiles.json"
    prof.write_text(json.dumps([
        {"profile": {"name": "Ann", "symptom severity": {"Sleep": "mild"}, "cognition distortion exhibition": {}},
         "cognitive profile": {"life_history": "h", "cognitive_models": [{"situation": "s"}]},
         "conversation": [1, 2]},
        {"profile": {"name": "Bo"}, "cognitive profile": {}}]))
    from convspark.operators.profiles import patient_prompts
    df = SRC.read_profiles(spark, str(prof))
    assert "conversation" not in df.columns
    out = patient_prompts(df).orderBy("profile_id").collect()
    assert out[0].patient_profile.startswith("## PROFILE\n\n- name: ann\n")
    assert "  - sleep: mild\n" in out[0].patient_profile
    assert "${cognition_distortion_exhibition}" in out[0].patient_profile  # Q13
    assert "Model 1:\n  - Situation: s\n\n" in out[0].prompt


def test_scores_and_summary_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "m1", "4, good"), ("a.txt", "m2", "none"), ("b.txt", "m1", "2, ok")],
                               "conversation_file string, metric string, reply string")
    s = J.score_replies(df)
    W.write_scores(s, str(tmp_path / "scores"))
    W.write_summary(s, str(tmp_path / "summary"))
    recs = [json.loads(line) for f in os.listdir(tmp_path / "scores") if f.endswith(".json")
            for line in open(tmp_path / "scores" / f)]
    a = [r for r in recs if r["conversation_file"] == "a.txt"][0]
    assert a["scores"]["m1"] == {"score": 4.0, "explanation": "good", "raw": "4, good"}
    assert a["scores"]["m2"]["score"] is None
    summ = [json.loads(line) for f in os.listdir(tmp_path / "summary") if f.endswith(".json")
            for line in open(tmp_path / "summary" / f)][0]
    assert summ == {"num_conversations": 2, "average_scores": {"m1": 3.0, "m2": None}}


def test_run_dumps_and_requests(spark, tmp_path):
    dump = {"profile_id": 1, "timestamp_init": "2025-01-01T00:00:00Z", "timestamp_end": "2025-01-01T00:01:00Z",
            "time_elapsed_seconds": 60.0, "turns_max": 100, "turns_completed": 3, "doctor_model": "qwen3",
            "expand_history": False, "stopping_detection": True, "instructions_doctor": "d",
            "instructions_patient": "p", "history_patient": [{"role": "system", "content": "p"}],
            "history_doctor": [{"role": "assistant", "content": "hi"}]}
    (tmp_path / "d.json").write_text(json.dumps(dump, indent=2))
    d = SRC.read_run_dumps(spark, str(tmp_path / "d.json")).collect()[0]
    assert d.turns_completed == 3 and d.history_doctor[0].content == "hi"
    W.write_run_dumps(SRC.read_run_dumps(spark, str(tmp_path / "d.json")).drop("file"), str(tmp_path / "dumps"))
    (tmp_path / "req.log").write_text('{"messages": [{"role": "user", "content": "x"}]}\n{oops\n{"messages": 3}\n')
    from convspark.functions.jsonmsg import request_check
    r = SRC.read_requests(spark, str(tmp_path / "req.log")).select(request_check("body").alias("c")).collect()
    assert [x.c.error for x in r] == [None, "Invalid JSON", "Messages must be a list"]


def test_templates_folder(spark, tmp_path):
    (tmp_path / "b_metric.txt").write_text("Rate {{x}}: {conversation} end")
    (tmp_path / "panas_before.txt").write_text("skip {intake_form}")
    t = J.load_templates(spark, str(tmp_path)).collect()
    assert [(r.metric, r.pieces) for r in t] == [("b_metric", ["Rate {x}: ", " end"])]


def test_sft_sinks(spark, tmp_path):
    from convspark.functions.chat import chat_text
    from convspark.operators import samples as S
    from convspark.operators.split import split_ids
    t = turns(spark, SF_SMALL)
    s = S.sft_samples(S.normalized_turns(t), [1, 5]).join(split_ids(t.select("conv_id")), "conv_id")
    s = s.withColumn("text", chat_text("messages"))
    out = str(tmp_path / "sft")
    W.write_sft(s, out)
    back = spark.read.parquet(out)
    assert set(back.columns) >= {"window_size", "split", "messages", "text"}
    assert back.count() == s.count()
    meta = W.training_metadata(back).collect()
    assert {(r.window_size, r.split) for r in meta} <= {(1, "train"), (1, "test"), (5, "train"), (5, "test")}
    assert sum(r.num_examples for r in meta) == s.count()
    hist = spark.createDataFrame([("w1", 100, 0.5, 1.2)], "run string, step int, epoch double, eval_loss double")
    W.append_eval_history(hist, str(tmp_path / "hist"))
    W.append_eval_history(hist, str(tmp_path / "hist"))
    assert spark.read.parquet(str(tmp_path / "hist")).count() == 2


def test_dialogue_rows_list_shapes(spark, tmp_path):
    p = tmp_path / "lists.json"
    p.write_text(json.dumps({"id": "m", "dialogue": [{"speaker": "therapist", "utterance": "hi"},
                                                      {"role": "client", "content": "yo"}]}) + "\n")
    rows = SRC.read_dialogue_rows(spark, str(p)).orderBy("turn").collect()
    assert [(r.role, r.text) for r in rows] == [("assistant", "hi"), ("user", "yo")]
    rows = SRC.read_dialogue_rows(spark, str(p), schema="id string, dialogue array<map<string,string>>") \
        .orderBy("turn").collect()
    assert [(r.role, r.text) for r in rows] == [("assistant", "hi"), ("user", "yo")]
    q = tmp_path / "pairs.json"
    q.write_text(json.dumps({"id": "p", "dialogue": [["Client", "a"], ["Counselor", "b"]]}) + "\n")
    rows = SRC.read_dialogue_rows(spark, str(q)).orderBy("turn").collect()
    assert [(r.role, r.text) for r in rows] == [("user", "a"), ("assistant", "b")]


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    """Files of mixed size, split and packed into tasks: numbered by name, then by place."""
    want = []
    for name, n in (("a", 1), ("b", 400), ("c", 0), ("d", 3), ("e", 200)):
        rows = [{"id": None if k % 2 else f"{name}{k}", "dialogue": f"Counselor: {name}{k} {'x' * (k % 90)}"} for k in range(n)]
        (tmp_path / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        want += [r["id"] or str(len(want) + k) for k, r in enumerate(rows)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "4096"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = SRC.read_dialogue_rows(spark, str(tmp_path), schema="id string, dialogue string").collect()
            assert sorted(r["id"] for r in got) == sorted(want)
            assert all(r["id_generated"] == r["id"].isdigit() for r in got)
            by = {r["id"]: r["text"].split(" ")[0] for r in got}
            assert all(by[i] == t for i, t in zip(want, [f"{n}{k}" for n, c in (("a", 1), ("b", 400), ("d", 3), ("e", 200)) for k in range(c)]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_labelled_files_keep_their_order(spark, tmp_path):
    for name, n in (("x", 5), ("y", 2)):
        (tmp_path / f"{name}.csv").write_text("interlocutor,utterance_text\n" + "".join(f'client,"{name}\n{k}"\n' for k in range(n)))
    got = SRC.read_labelled_csv(spark, str(tmp_path)).orderBy("input_pos").collect()
    assert [(r["input_pos"], r["utterance_text"]) for r in got] == [
        (i, t) for i, t in enumerate([f"x\n{k}" for k in range(5)] + [f"y\n{k}" for k in range(2)])]


def test_generated_ids_never_meet_real_ones(spark, tmp_path):
    from convspark.operators.prepare import conversation_turns
    rows = [{"dialogue": "Counselor: a"}, {"id": "0", "dialogue": "Counselor: b"}, {"id": "#0", "dialogue": "Counselor: c"}]
    (tmp_path / "r.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    got = conversation_turns(SRC.read_dialogue_rows(spark, str(tmp_path / "r.json"))).collect()
    assert {(r["conv_id"], r["text"]) for r in got} == {("0", "a"), ("#0", "b"), ("##0", "c")}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "h")
    parts = [[("w1", 200, 0.2, 1.0), ("w5", 100, 0.1, 2.0)], [("w1", 100, 0.1, 3.0), ("w1", 300, 0.3, 0.5)]]
    schema = "run string, step int, epoch double, eval_loss double"
    for batch in (0, 1, 1, 0):
        W.append_eval_history(spark.createDataFrame(parts[batch], schema), out, batch)
    got = W.log_history(spark, out).orderBy("run", "entry").collect()
    assert [(r["run"], r["step"], r["entry"]) for r in got] == [("w1", 100, 0), ("w1", 200, 1), ("w1", 300, 2), ("w5", 100, 0)]
    W.write_log_history(spark, out, str(tmp_path / "log"))
    logs = {m["run"]: m["log_history"] for f in os.listdir(tmp_path / "log") if f.endswith(".json")
            for m in map(json.loads, open(tmp_path / "log" / f))}
    assert [e["step"] for e in logs["w1"]] == [100, 200, 300] and logs["w5"] == [{"step": 100, "epoch": 0.1, "eval_loss": 2.0}]


def test_history_stream_resumes(spark, tmp_path):
    from convspark.streaming.runner import drain
    schema = "run string, step int, epoch double, eval_loss double"
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    for n in range(2):
        spark.createDataFrame([("w", n, 0.0, 1.0)], schema).write.mode("append").parquet(src)
        drain(W.eval_history_stream(spark.readStream.schema(schema).parquet(src), out, chk))
    assert [r["step"] for r in W.log_history(spark, out).orderBy("entry").collect()] == [0, 1]


def test_large_template_folders_are_not_broadcast(spark):
    docs = spark.createDataFrame([(k, f"talk {k}") for k in range(30)] + [(99, None)], "conv_id long, transcript string")
    templates = J.templates_frame(spark, {f"m{k}": "x" * 300 + " {conversation} " + str(k) for k in range(40)})
    small = J.render_prompts(docs, templates)
    large = J.render_prompts(docs, templates, broadcast_bytes=2000)
    assert large.columns == small.columns and sorted(map(str, large.collect())) == sorted(map(str, small.collect()))
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan and "Cross" not in plan
