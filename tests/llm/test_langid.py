import numpy as np

from convspark.llm import langid, queries
from convspark.sources.tables import table
from pyspark.sql import functions as F

from ..conftest import SF_CHECK
from .helpers import doc, docs_of


def test_letters():
    assert langid.letters("Ab, c!  9Ä_") == " ab c ä "
    assert langid.letters(" 1 2 ") == "" == langid.letters(None) == langid.letters("")
    assert langid.letters("²³ ½ ① Ⅷ ٣ 〇_") == "" and langid.letters("x²y½ 中Ⅷ文") == " x y 中 文 "


def test_probabilities_sum_to_one():
    """After any context the interpolated probabilities of all next characters add up to one."""
    rng = np.random.default_rng(0)
    codes = rng.integers(1, 6, 400).astype(np.uint64)
    m = langid.train(langid._grams(codes)[langid.ORDER:])
    every = np.arange(1 << langid.BITS, dtype=np.uint64)
    for at in (10, 50, 300):
        ctx = langid._grams(codes)[at] << np.uint64(langid.BITS) & langid._mask(langid.ORDER)
        assert abs(np.exp(m.score(ctx | every)).sum() - 1) < 1e-6
    fresh = np.uint64(9) << np.uint64(langid.BITS)
    assert abs(np.exp(m.score(fresh | every)).sum() - 1) < 1e-6


def test_score_matches_plain_recursion():
    text = "the cat sat on the mat and the bat"
    codes = np.array([ord(c) - 31 for c in text], np.uint64)
    m = langid.train(langid._grams(codes)[langid.ORDER - 1:])
    packed = lambda t: sum(int(c) << (langid.BITS * i) for i, c in enumerate(reversed(t)))
    table = [dict(zip(k.tolist(), p.tolist())) for k, p in zip(m.keys, m.logp)]
    back = [dict(zip(k.tolist(), p.tolist())) for k, p in zip(m.ctx, m.back)]

    def slow(gram):
        if not gram:
            return m.floor
        if packed(gram) in table[len(gram) - 1]:
            return table[len(gram) - 1][packed(gram)]
        return back[len(gram) - 1].get(packed(gram[:-1]), 0.0) + slow(gram[1:])

    for g in (codes[:5], codes[3:8], codes[[1, 5, 2, 9, 4]], codes[[0, 0, 0, 0, 0]]):
        assert abs(m.score(np.array([packed(g.tolist())], np.uint64))[0] - slow(tuple(g.tolist()))) < 1e-9


def test_held_out_accuracy(spark):
    out = queries.op8_language_id(spark, SF_CHECK).join(table(spark, SF_CHECK, "documents").select("doc_id", "lang"), "doc_id")
    n, right, ok = out.where("held_out").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred")), F.count_if("accepted")).first()
    assert n > 100 and right >= 0.97 * n and ok >= 0.98 * n
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_edges(spark):
    train = docs_of(spark, [doc(i, "the cat sat on the mat " * 5, "en") for i in range(10)]
                    + [doc(50 + i, "der hund liegt auf dem bett " * 5, "de") for i in range(10)]
                    + [doc(90, None, "en"), doc(91, "???", "fr"), doc(92, "unlabelled text", None)])
    ident = langid.fit(train)
    assert ident.langs == ["de", "en"]
    df = docs_of(spark, [doc(1, None), doc(2, ""), doc(3, "123 !!"), doc(4, "the mat"), doc(4, "the mat"), doc(5, "der hund " * 30_000),
                         doc(6, "щщщ жжж ыыы ююю"), doc(None, "dem hund")])
    out = langid.predict(df, ident)
    assert out.columns[:len(df.columns)] == df.columns
    got = sorted((str(r["doc_id"]), r["__lang_pred"], r["__accepted"]) for r in out.collect())
    assert got[:3] == [("1", "und", False), ("2", "und", False), ("3", "und", False)]
    assert [g[1] for g in got[3:6]] == ["en", "en", "de"] and not got[6][2] and got[7][1] == "de"


def test_no_labels(spark):
    df = docs_of(spark, [doc(1, "text", None)])
    assert langid.fit(df) is None
    assert [r["__lang_pred"] for r in langid.predict(df, None).collect()] == ["und"]
    assert langid.predict(docs_of(spark, []), None).collect() == []
