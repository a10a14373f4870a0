"""Skew-safe ordered helpers: tiny block sizes must give the plain-window answers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from convspark.operators.ordered import dense_position, lookback, order_blocks, running


def _turns(spark):
    rows = [(c, t, float((c * 7 + t * 3) % 5)) for c in range(3) for t in range(0, 23 if c == 0 else 5)]
    return spark.createDataFrame(rows, "conv_id long, turn long, v double")


def test_dense_position_blocks(spark):
    df = _turns(spark).withColumn("turn", F.col("turn") * 10 + 3)  # gaps in the order key
    for block in (2, 3, 1000):
        got = dense_position(df, ["conv_id"], ["turn"], F.col("turn"), out="pos", block=block)
        exp = df.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
        assert sorted(got.select("conv_id", "turn", "pos").collect()) == \
            sorted(exp.select("conv_id", "turn", F.col("pos").cast("long")).collect())


def test_running_blocks(spark):
    df = _turns(spark)
    w_in = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    w_ex = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    exp = df.select("conv_id", "turn", F.sum("v").over(w_in).alias("s"), F.max("v").over(w_ex).alias("m"),
                    F.min("v").over(w_in).alias("n"))
    for block in (1, 2, 4, 1 << 16):
        got = running(df, ["conv_id"], "turn", [("s", "sum", F.col("v"), True), ("m", "max", F.col("v"), False),
                                                ("n", "min", F.col("v"), True)], block=block)
        assert sorted(got.select("conv_id", "turn", "s", "m", "n").collect()) == sorted(exp.collect())


def test_lookback_blocks(spark):
    df = _turns(spark)
    for w in (1, 2, 3):
        exp = df.select("conv_id", "turn", F.collect_list("turn").over(
            Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-w, 0)).alias("f"))
        for block in (w + 1, 5, 1 << 16):
            got = lookback(df, ["conv_id"], "turn", w, ["turn"], out="fr", block=block)
            got = got.select("conv_id", "turn", F.transform("fr", lambda x: x["turn"]).alias("f"))
            assert sorted(got.collect()) == sorted(exp.collect()), (w, block)


def test_blocked_plans_equal_default_on_real_turns(spark):
    """A hot conversation is processed in blocks: with blocks of 2-6 turns (so every
    conversation spans several blocks) the products equal the single-block ones."""
    from convspark.operators import endings as EN
    from convspark.operators import samples as S
    from convspark.sources.tables import turns

    t = turns(spark, "/root/testdata/sf0.01")
    nt = S.normalized_turns(t)
    a = S.sft_samples(nt, [1, 2, 5], block=6).collect()
    b = S.sft_samples(nt, [1, 2, 5]).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    a = S.inference_contexts(t, 5, block=5).collect()
    b = S.inference_contexts(t, 5).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    checks = t.filter("role = 'user'").select("conv_id", "turn", (F.col("turn") % 3 != 0).alias("verdict"))
    a = EN.end_streaks(checks, block=2).collect()
    b = EN.end_streaks(checks).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def _gapped(spark):
    """Turn ids of any spacing, null turns, a large and small conversations, a null one."""
    rows = []
    for c, n in ((0, 40), (1, 3), (2, 1), (None, 9)):
        at = 5
        for k in range(n):
            at += (k * 37 % 11) ** 3 + 1
            role = ("system", "user", "assistant", "user")[(k * 7 + n) % 4]
            rows.append((c, at if k else None, role, f" t{k} "[: 1 + k % 5], bool((k * 5 + n) % 3)))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, verdict boolean")


def test_large_keys_are_cut_into_even_blocks(spark):
    rows = [(0, 3_600 * 5 + k % 3_000) for k in range(20_000)] + [(0, k * 100_000) for k in range(50)] + [(1, k) for k in range(90)]
    b = order_blocks(spark.createDataFrame(rows, "p long, t long"), ["p"], F.col("t"), block=1000)
    sizes = {(r["p"], r["_blk"]): r["n"] for r in b.df.groupBy("p", "_blk").agg(F.count("*").alias("n")).collect()}
    assert sizes[(1, 0)] == 90 and b.hot
    hot = [n for (p, _), n in sizes.items() if p == 0]
    # one dense hour, spread evenly; the sparse rest shares blocks with it
    assert 15 <= len(hot) <= 25 and max(hot) < 2000 and sum(hot) == 20_050


def test_gapped_positions_equal_plain_windows(spark):
    """W1, W3, W4, A6 and the ordered helpers with blocks of 2 to 12 rows."""
    from convspark.operators import endings as EN
    from convspark.operators import samples as S
    from convspark.operators.tokens import request_usage

    df = _gapped(spark).cache()
    nt = S.normalized_turns(df)

    def run(block):
        st = EN.end_streaks(df.where("role = 'user'").select("conv_id", "turn", "verdict"), block=block)
        return {"w1": S.sft_samples(nt, [1, 2, 5], block=block), "w3": S.inference_contexts(df, 3, block=block),
                "w4": EN.end_check_prompts(df, block=block), "a6": request_usage(df, 4, block=block), "w5": st,
                "w6": EN.truncate_at_end(df.drop("verdict"), st, insist="!", max_turns=12, block=block),
                "pos": dense_position(df, ["conv_id"], ["turn"], F.col("turn"), block=block)}

    want = {k: sorted(map(str, v.select(*sorted(v.columns)).collect())) for k, v in run(1 << 16).items()}
    assert all(want.values())
    for block in (2, 7):
        for k, v in run(block).items():
            assert sorted(map(str, v.select(*sorted(v.columns)).collect())) == want[k], (k, block)


def test_a_hot_hour_changes_no_pair_and_no_stop(spark):
    from convspark.operators.runs import early_stop, process_pairs
    rows = [(p, "start" if (k * 3 + p) % 5 < 3 else "end", 1_704_067_200 + (k % 50 if p == 0 else k * 4000), k, float((k * 7) % 23))
            for p, n in ((0, 200), (1, 5), (2, 40)) for k in range(n)]
    ev = spark.createDataFrame(rows, "process long, kind string, s long, event_id long, loss double") \
        .withColumn("ts", F.timestamp_seconds("s")).cache()
    want = sorted(map(str, process_pairs(ev).collect()))
    log = ev.select(F.col("process").alias("run"), F.col("event_id").alias("step"),
                    F.when(F.col("event_id") % 9 != 0, F.col("loss")).alias("loss"))
    stops = sorted(map(str, early_stop(log).collect()))
    for block in (2, 16):
        assert sorted(map(str, process_pairs(ev, block=block).collect())) == want
        assert sorted(map(str, early_stop(log, block=block).collect())) == stops


def test_an_ordinary_table_is_exchanged_once(spark):
    import re

    from convspark.operators import endings as EN
    from convspark.operators.runs import early_stop
    df = _gapped(spark)
    st = EN.end_streaks(df.select("conv_id", "turn", "verdict"))
    log = df.select(F.col("conv_id").alias("run"), F.col("turn").alias("step"), F.col("turn").cast("double").alias("loss"))
    for plan, exchanges in ((st, 1), (early_stop(log), 1), (EN.truncate_at_end(df, st), 2)):  # the last: streaks, turns with streaks
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", text)) == exchanges
