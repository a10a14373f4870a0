import random

from convspark.llm.chat_format import fold_events, format_chats, loss_text, read_back
from pyspark.sql import functions as F

EVENTS = "conv_id long, seq long, kind string, msg long, role string, text string, span string"


def fold(events):
    """Event-sourced reconstruction, one event at a time."""
    log = {}
    for e in sorted(events, key=lambda e: (e[1], e[2] or "delta", e[5] or "")):
        conv, seq, kind, msg, role, text = e[:6]
        ms = log.setdefault(conv, {})
        kind, text = kind or "delta", text or ""
        old = ms.get(msg, [None, ""])
        if kind in ("message", "edit", "regenerate"):
            ms[msg] = [role if role is not None else old[0], text]
        else:
            ms[msg] = [role if role is not None else old[0], old[1] + text]
        if kind == "regenerate":
            for m in [m for m in ms if m > msg]:
                ms[m] = [ms[m][0], "", "gone"]
        elif len(old) > 2 and kind == "delta":
            ms[msg].append("gone")
    return {(c, m): (v[0], v[1]) for c, ms in log.items() for m, v in ms.items() if len(v) < 3}


def test_fold(spark):
    ev = [(1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "Hel"), (1, 3, "delta", 1, None, "lo"),
          (1, 4, "message", 2, "user", "more"), (1, 5, "message", 3, "assistant", "old reply"),
          (1, 6, "regenerate", 1, "assistant", "Hey"), (1, 7, "delta", 1, None, " you"),
          (1, 8, "message", 2, "user", "again"), (1, 9, "edit", 0, None, "hi!"),
          (2, 1, None, 0, None, None), (None, 1, "message", 0, "user", "x")]
    df = spark.createDataFrame([(*e, "clash") for e in ev], EVENTS)
    got = {(r["conv_id"], r["msg"]): (r["role"], r["text"]) for r in fold_events(df).collect()}
    assert got == fold(ev)
    assert got[(1, 1)] == ("assistant", "Hey you") and (1, 3) not in got and got[(1, 2)] == ("user", "again")


def test_round_trip(spark):
    rng = random.Random(2)
    bits = ["\\", "<", "#", ":", ": ", "</turn>", "</turn>\n", "### Assistant: ", "\\b", "\\l", "\\h", "\\c", "é", "😀", "\n", " ", "ok", ""]
    roles = ["user", "assistant", "system", "a: b#<\\", None, "Assistant"]
    ev = []
    for c in range(30):
        for t in range(rng.randint(1, 6)):
            ev.append((c, t, "message", t, rng.choice(roles), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) if rng.random() > .1 else None))
    df = spark.createDataFrame([(*e, "clash") for e in ev], EVENTS)
    out = format_chats(df).select("*", read_back(F.col("formatted")).alias("back"),
                                  loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in out:
        mine = [e for e in ev if e[0] == r["conv_id"]]
        assert [(x["role"], x["text"]) for x in r["back"]] == [(e[4] or "", e[5] or "") for e in mine]
        assert r["loss"] == "".join(e[5] or "" for e in mine if e[4] == "assistant")
        assert r["n_turns"] == len(mine)
    assert len(out) == 30


def test_native_and_empty(spark):
    df = format_chats(spark.createDataFrame([], EVENTS))
    assert df.collect() == []
    assert "Python" not in df._jdf.queryExecution().optimizedPlan().toString()
