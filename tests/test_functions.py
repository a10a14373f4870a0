"""Column expressions on edge-case strings: expected values, and properties on random ones."""

import pytest
from pyspark.sql import functions as F

from convspark.functions import dialogue as D
from convspark.functions.scores import parse_score
from convspark.functions.text import (elapsed_hms, normalize_role, py_strip, strip_tags_dataset,
                                      strip_tags_generation, verdict_yes, with_clean_text, word_count)


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


ROLES = {"Assistant": "assistant", "BOT": "assistant", "counselor": "assistant", "Counselor 1": "user", "doctor smith": "user",
         "client's therapist": "user", "system": "user", None: "user", "": "user", "Therapist": "assistant",
         "my agent": "assistant", "HUMAN being": "user", "patient x": "user"}


def test_normalize_role(spark):
    assert one_col(spark, list(ROLES), normalize_role("v")) == list(ROLES.values())


SCORES = {"4, good\nyes": (4.0, "good\nyes"), "  3.5 ,x": (3.5, "x"), "Score: 4, ok": (4.0, "Score: 4, ok"), "-1, neg": (1.0, "-1, neg"),
          "4.": (4.0, "4."), "10,": (10.0, ""), "1e3, z": (1.0, "1e3, z"), "4 good": (4.0, "4 good"), "none": (None, "none"),
          "": (None, ""), "   ": (None, ""), None: (None, ""), "\x1c5, tail\x1f": (5.0, "tail")}


def test_parse_score(spark):
    got = one_col(spark, list(SCORES), parse_score("v"))
    assert [(r["score"], r["explanation"]) for r in got] == list(SCORES.values())


DIALOGUES = {
    "T: hi\nC: hello\nT: one thing: focus": [("user", "hi"), ("user", "hello"), ("user", "focus")],
    "preamble\nTherapist: a\nClient: b": [("assistant", "a"), ("user", "b")],
    "x" * 70 + " 10:30": [("user", "30")], "::a: b": [("user", "b")], "a:b:c:": [], "": [], " : x": [("user", "x")],
    "A - x\nB\ty\nplain line\n\n\r\nClient - z": [("user", "x"), ("user", "y"), ("user", "plain line"), ("user", "z")],
    "Client - a\r\nTherapist - b": [("user", "a"), ("assistant", "b")], "a\ue000b: c": [("user", "c")]}


def test_dialogue_text(spark):
    got = one_col(spark, list(DIALOGUES), D.parse_dialogue_text("v"))
    assert [[(t["role"], t["text"]) for t in g] for g in got] == list(DIALOGUES.values())


def test_dialogue_text_properties(spark):
    """Turns are stripped, never empty and in order of appearance."""
    import random
    rnd = random.Random(5)
    alphabet = ["a", "b", " ", ":", "\n", "x" * 30, "\r", "Client", "T", "::"]
    vals = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    for v, g in zip(vals, one_col(spark, vals, D.parse_dialogue_text("v"))):
        at = 0
        for t in g:
            assert t["role"] in ("user", "assistant") and t["text"] and t["text"] == t["text"].strip()
            at = v.index(t["text"], at) + len(t["text"])


def test_written_dialogue_reads_back(spark):
    turns = [("Therapist", "how are you"), ("Client", "fine"), ("Therapist", "good"), ("Client", "bye now")]
    got = one_col(spark, ["\n".join(f"{s}: {t}" for s, t in turns)], D.parse_dialogue_text("v"))[0]
    assert [(t["role"], t["text"]) for t in got] == [("assistant" if s == "Therapist" else "user", t) for s, t in turns]


def test_dialogue_items(spark):
    # maps built with create_map keep key order (Python dicts may not survive as ordered maps)
    df = spark.sql("""SELECT m FROM VALUES
        (map('speaker', 'Client', 'utterance', 'a')),
        (map('role', 'x', 'text', CAST(NULL AS STRING), 'other', 'z')),
        (map('sender', 'bot', 'message', 'm', 'content', 'c')),
        (map('foo', CAST(NULL AS STRING))) AS t(m)""")
    got = [(r[0]["role"], r[0]["text"]) for r in df.select(D.item_from_map("m")).collect()]
    assert got == [("user", "a"), ("user", "x"), ("assistant", "m"), ("user", "")]
    pairs = spark.createDataFrame([(["therapist", "hi"],), (["a", "b", "c"],)], "p array<string>")
    got = [(r[0]["role"], r[0]["text"]) for r in pairs.select(D.item_from_pair("p")).collect()]
    assert got == [("assistant", "hi"), ("user", "['a', 'b', 'c']")]
    sc = spark.createDataFrame([("ab",), ("hello",)], "s string")
    got = [(r[0]["role"], r[0]["text"]) for r in sc.select(D.item_from_scalar("s")).collect()]
    assert got == [("user", "b"), ("user", "hello")]


CLEAN = {"“quoted” — dash – en": '"quoted" - dash - en', "é ü ß ﬁ ½ ²": "e u fi 12 2", "emoji 😀 here": "emoji here",
         "nb\xa0sp\ttab": "nb sp tab", "ctl\x1cx": "ctl x", "plain  text ": "plain text", "Ａｚ 中": "Az", "ﬀ ǅ Ω": "ff Dz"}


def test_clean_text(spark):
    df = spark.createDataFrame(list(enumerate(CLEAN)), "i int, v string")
    got = [r["c"] for r in with_clean_text(df, "v", "c").orderBy("i").collect()]
    assert got == list(CLEAN.values())


def test_clean_text_properties(spark):
    """ASCII only, single blanks, idempotent, and ASCII words come through untouched."""
    import random
    rnd = random.Random(11)
    pool = ([chr(c) for c in range(0x20, 0x7F)] + [chr(c) for c in range(0x80, 0x370)]
            + [chr(c) for c in range(0x2000, 0x2160)] + [chr(c) for c in range(0xFB00, 0xFB07)]
            + ["Ａ", "ｚ", "中", "😀", "ﬀ", "Ω", "ǅ", "\u0301", "\u00a0", "\x1c"])
    vals = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(400)] + ["only ASCII words here"]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v string")
    once = with_clean_text(df, "v", "c")
    rows = with_clean_text(once, "c", "c2").orderBy("i").collect()
    assert all(r["c"].isascii() and r["c"] == " ".join(r["c"].split()) == r["c2"] for r in rows)
    assert all(ch in r["c"] for r in rows for ch in r["v"] if ch.isascii() and ch.isalnum())
    assert rows[-1]["c"] == vals[-1]


TAGS = {"<think>a</think>\n\nb": ("b", "b"), "x <think>nested <think>y</think> z</think> w": ("x  z w", "x  z w"),
        "<think>unclosed": ("unclosed", "unclosed"), "<tool_call id=1>q</tool_call>\nrest": ("q\nrest", "qrest"),
        " \n<tool_call>{}</tool_call>\n\nend ": ("end", "end")}


@pytest.mark.parametrize("eat", [False, True])
def test_strip_tags(spark, eat):
    fn = strip_tags_dataset if eat else strip_tags_generation
    assert one_col(spark, list(TAGS), fn("v")) == [t[eat] for t in TAGS.values()]


def test_strip_and_words(spark):
    vals = ["\x1c a b \x1f", " x　", "", "a\x85b c"]
    assert one_col(spark, vals, py_strip("v")) == [v.strip() for v in vals]
    assert one_col(spark, vals, word_count("v")) == [len(v.split()) for v in vals]


def test_elapsed_hms(spark):
    secs = [0.5, 1.5, 2.5, 3599.6, 360000.0]
    def model(s):
        t = int(round(s))
        return f"{t // 3600:02d}:{(t % 3600) // 60:02d}:{t % 60:02d}"
    assert one_col(spark, secs, elapsed_hms("v"), "double") == [model(s) for s in secs]


def test_verdict(spark):
    vals = ["Yes.", "yes", "YES", "no", "yesterday"]
    assert one_col(spark, vals, verdict_yes("v")) == [("Yes" in v or "yes" in v) for v in vals]


def test_pluggable_token_counter(spark):
    from convspark.operators.tokens import pandas_token_counter
    count = pandas_token_counter(lambda s: s.split())
    vals = ["a b  c", "", " x\ty ", None]
    assert one_col(spark, vals, count("v")) == [3, 0, 2, None]


def test_clean_text_equals_unicodedata(spark):
    """Texts with several characters of several images, next to ones that only Python knows."""
    import unicodedata
    vals = ["½ ¼½ ﬁﬂ x½", "①㎏ ½ an", "ﬀ" * 50 + "½", " \t½\n\n é  \x1f", "", "\x1c \x1d", "  a  b ", "中½中", "a \tb\x0b c"]
    df = spark.createDataFrame([*enumerate(vals), (len(vals), None)], "i int, v string")
    want = [" ".join(unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().split()) for v in vals]
    assert [r["c"] for r in with_clean_text(df, "v", "c").orderBy("i").collect()] == [*want, None]
