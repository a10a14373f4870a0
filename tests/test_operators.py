"""Operator invariants on the driver tables and on small in-memory cases."""

import pytest
from pyspark.sql import functions as F

from convspark.operators import endings as EN
from convspark.operators import samples as S
from convspark.operators import split as SP
from convspark.sources.tables import turns

from .conftest import SF_CHECK


def test_sample_count_equals_pairs(spark):
    t = S.normalized_turns(turns(spark, SF_CHECK))
    pairs = t.alias("a").join(t.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id"))
                              & (F.col("b.turn") == F.col("a.turn") + 1)) \
        .filter((F.col("a.role") == "user") & (F.col("b.role") == "assistant")).count()
    s = S.sft_samples(t, [1, 2, 5, 10])
    counts = {r["window_size"]: r["count"] for r in s.groupBy("window_size").count().collect()}
    assert counts == {1: pairs, 2: pairs, 5: pairs, 10: pairs}
    full = S.full_windows(s)
    assert full.join(s, ["conv_id", "turn", "window_size"], "left_anti").count() == 0
    # every sample: system first, assistant last, at most w context turns
    bad = s.filter((F.col("messages")[0]["role"] != "system")
                   | (F.try_element_at("messages", F.lit(-1))["role"] != "assistant")
                   | (F.size("messages") > F.col("window_size") + 2))
    assert bad.count() == 0


def test_window_rejects_zero(spark):
    with pytest.raises(ValueError):
        S.sft_samples(turns(spark, SF_CHECK), [0])


def test_edge_windows(spark):
    rows = [(1, 0, "assistant", "a"), (1, 1, "user", "u"), (1, 2, "user", "u2"), (1, 3, "assistant", " t "),
            (2, 0, "user", "only"), (3, 0, "user", "x"), (3, 1, "assistant", "y")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    s = S.sft_samples(t, [1, 5]).orderBy("conv_id", "window_size").collect()
    got = [(r.conv_id, r.window_size, [(m.role, m.content) for m in r.messages][1:]) for r in s]
    assert got == [(1, 1, [("user", "u2"), ("assistant", "t")]),
                   (1, 5, [("assistant", "a"), ("user", "u"), ("user", "u2"), ("assistant", "t")]),
                   (3, 1, [("user", "x"), ("assistant", "y")]),
                   (3, 5, [("user", "x"), ("assistant", "y")])]


def test_streak_sequence(spark):
    v = [0, 1, 0, 1, 1, 1, 0]
    checks = spark.createDataFrame([(1, i * 2, bool(x)) for i, x in enumerate(v)],
                                   "conv_id long, turn long, verdict boolean")
    for block in (2, 1 << 16):
        got = [r.streak for r in EN.end_streaks(checks, block=block).orderBy("turn").collect()]
        assert got == [0, 1, 0, 1, 2, 3, 0]


def test_truncate_never_keeps_after_end(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(12)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    checks = t.filter("role = 'user'").select("conv_id", "turn", (F.col("turn") >= 4).alias("verdict"))
    st = EN.end_streaks(checks)
    kept = EN.truncate_at_end(t, st, insist="again").orderBy("turn").collect()
    assert [r.turn for r in kept] == list(range(8))  # ends at user turn 6 (streak 2), keeps reply 7
    assert [r.text for r in kept if r.insisted] == ["t5\nagain"]
    capped = EN.truncate_at_end(t, st, max_turns=2).count()
    assert capped == 4


def test_split_properties(spark):
    ids = spark.range(1000).select(F.col("id").alias("conv_id"))
    sp = SP.split_ids(ids, train_frac=0.8, seed=7)
    assert sp.filter("split = 'train'").count() == int(1000 * (1.0 - (1.0 - 0.8)))
    chk = SP.split_check(ids, sp).collect()[0]
    assert (chk.n_overlap, chk.n_missing, chk.n_train + chk.n_test) == (0, 0, 1000)
    # equals a global md5 order cut
    order = sorted(range(1000), key=lambda i: __import__("hashlib").md5(f"7:{i}".encode()).hexdigest())
    want = set(order[:800])
    got = {r.conv_id for r in sp.filter("split = 'train'").collect()}
    assert got == want
    with pytest.raises(ValueError):
        SP.split_ids(ids, train_frac=1.0)


def test_run_model_errors_and_checkpoint(spark):
    from convspark.operators.scoring import run_model

    def factory():
        def model(p):
            if "boom" in p:
                raise RuntimeError("model failed")
            return p.upper()
        return model

    df = spark.createDataFrame([("a",), ("boom",)], "prompt string")
    out = run_model(df, "prompt", factory, checkpoint=True).orderBy("prompt").collect()
    assert [(r.reply, r.reply_error) for r in out] == [("A", None), ("", "RuntimeError: model failed")]


def test_length_stats_sampled(spark):
    from convspark.operators.tokens import length_stats
    df = spark.createDataFrame([(i, (i * 37) % 11) for i in range(50)], "i int, n int")
    r = length_stats(df, "n", sample_limit=5, order_cols=["i"], limit_over=5).collect()[0]
    first = [(i * 37) % 11 for i in range(5)]
    assert r.sample_lengths == first and r.sample_count == 5 and r.max_len == max(first)
    assert r.median_len == sorted(first)[2] and r.n_over_max == sum(x > 5 for x in first)


def test_sft_gapped_turns(spark):
    t = S.normalized_turns(turns(spark, SF_CHECK))
    gapped = t.withColumn("turn", F.col("turn") * 10 + 7)
    a = S.sft_samples(gapped, [1, 5]).withColumn("turn", (F.col("turn") - 7) / 10)
    b = S.sft_samples(t, [1, 5])
    key = lambda r: (r.conv_id, int(r.turn), r.window_size, str(r.messages))
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_coverage_counts_equal_grid_anti_join(spark):
    from convspark.operators import runs as R
    profiles = spark.range(7).select(F.col("id").alias("profile_id"))
    exps = R.experiments_frame(spark)
    done = spark.createDataFrame([("one_shot", 1, 0), ("one_shot", 1, 0), ("one_shot", 2, 8), ("one_shot", 99, 1),
                                  ("zero_shot_expand_2", 3, 4), ("unknown", 1, 1), ("one_shot", 1, 9)],
                                 "experiment string, profile_id long, repeat long")
    a = R.coverage(R.run_grid(exps, profiles), done).select("experiment", "n_planned", "n_missing", "n_done")
    b = R.coverage_counts(exps, profiles, done)
    assert sorted(a.collect()) == sorted(b.collect())
