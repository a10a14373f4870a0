import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from convspark.llm.queries import op12_periodic_runs, repeated_tail
from convspark.llm.runs import Extensions, document_runs, find_runs, keep_first_period, runs_of, stretches
from convspark.sources.tables import table

from ..conftest import SF_SMALL
from .helpers import doc, docs_of


def slow_runs(t, min_length, min_exponent):
    out = {}
    n = len(t)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if t[i] != t[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            length = j + q - i
            if length >= min_exponent * q and length >= min_length and not any(
                    q % p == 0 and all(t[x] == t[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out[(i, q)] = length
            i = j
    return [(s, n, q) for (s, q), n in sorted(out.items())]


def sequences():
    rng = random.Random(2)
    for _ in range(250):
        kind, n = rng.randrange(4), rng.randrange(0, 60)
        if kind == 0:
            yield [rng.randint(1, 2) for _ in range(n)]
        elif kind == 1:
            p = [rng.randint(1, 3) for _ in range(rng.randint(1, 9))]
            yield ([rng.randint(1, 4) for _ in range(rng.randrange(5))] + p * rng.randint(1, 9)
                   + [rng.randint(1, 3) for _ in range(rng.randrange(9))])
        elif kind == 2:
            a, b = [1], [1, 2]
            for _ in range(rng.randint(1, 6)):
                a, b = b, b + a
            yield b
        else:
            yield [1] * n


def test_extensions_are_common_prefixes():
    for t in [*sequences()][:80]:
        t = [*t, 0]
        e = Extensions(t)
        n = len(t)
        assert sorted(range(n), key=lambda i: t[i:]) == np.argsort(e.rank).tolist()
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j][:400]
        if pairs:
            i, j = np.array(pairs).T
            want = [next((k for k in range(n) if max(a, b) + k >= n or t[a + k] != t[b + k]), 0) for a, b in pairs]
            assert e.common(i, j).tolist() == want


@pytest.mark.parametrize("least", [(2, 2), (4, 2), (6, 3)])
def test_all_runs_are_found(least):
    for t in sequences():
        assert runs_of(t, *least) == slow_runs(t, *least), t


def test_stretches_hold_every_run():
    rng = random.Random(3)
    texts = []
    for _ in range(120):
        t = [rng.choice("abcdefgh") for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            p = [rng.choice("abcd") for _ in range(rng.randint(1, 30))]
            t += (p * 40)[:rng.randint(20, 130)] + [rng.choice("abcdefgh") for _ in range(rng.randrange(30))]
        texts.append(t)
    sizes = [len(t) for t in texts]
    mark = stretches(np.array([hash(w) for t in texts for w in t], np.int64), np.repeat(np.arange(len(texts)), sizes), 16)
    found = 0
    for t, m in zip(texts, np.split(mark, np.cumsum(sizes)[:-1])):
        want = slow_runs(t, 24, 3)
        assert document_runs(t, m) == want
        found += len(want)
    assert found > 60


def check(i, text, query):
    """The contract, word by word."""
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    n, h = len(words), zlib.crc32(str(i).encode())
    if query and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[x] if x < a else words[a + (x - a) % p] for x in range(n)]
    runs = slow_runs(words, 24, 3)
    dropped = {x for s, k, q in runs for x in range(s + q, s + k)}
    kept = " ".join(w for x, w in enumerate(words) if x not in dropped)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{k},{q}\n" for s, k, q in runs), kept)]
    return (i, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *sha)


ROWS = [doc(1, None), doc(2, ""), doc(3, " \t\n"), doc(4, "a " * 30), doc(4, "a " * 30), doc(5, "x " + "a b c " * 9 + "a b y"),
        doc(6, "a b c d " * 40), doc(8, ("p q r " * 10 + "s ") * 4), doc(9, "w " * 23), doc(10, "one two"),
        doc(11, "É é " * 12 + "É"), doc(12, " ".join(f"w{k % 11}" for k in range(33)))]


def test_query_is_the_contract(spark, tmp_path):
    base = [r for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    rows = [r for r in base if r["text"] is None or len(r["text"]) < 6000]
    hot = [doc(k, " ".join(f"w{x % 50}" for x in range(k % 300))) for k in range(1000, 1300)]
    docs_of(spark, [*ROWS, *[doc(r["doc_id"] + 10_000, r["text"]) for r in rows], *hot]).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path)).collect()
    want = [check(r[0], r[1], True) for r in [*ROWS, *[(r["doc_id"] + 10_000, r["text"]) for r in rows], *hot]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r["n_runs"] > 0 for r in got) > 30


def test_operator_edges(spark):
    rows = [*ROWS, doc(None, "a " * 24), doc(7, "m n " * 60_000)]
    got = find_runs(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [tuple(x) for x in by[None]["runs"]] == [(0, 24, 1)] and by[None]["collapsed"] == "a"
    assert [tuple(x) for x in by[7]["runs"]] == [(0, 120_000, 2)] and by[7]["collapsed"] == "m n"
    assert by[1]["runs"] == [] and by[1]["collapsed"] == "" and by[1]["n_words"] == 0
    assert find_runs(docs_of(spark, [])).collect() == []
    short = find_runs(docs_of(spark, [doc(1, "a b a b c")]), min_length=4, min_exponent=2).collect()
    assert [tuple(x) for x in short[0]["runs"]] == [(0, 4, 2)]
    with pytest.raises(ValueError):
        find_runs(docs_of(spark, []), min_exponent=1)


def test_repeated_tail_without_an_id(spark):
    got = repeated_tail(docs_of(spark, [doc(None, "a b"), doc(None, None)])).collect()
    assert {r["text"] for r in got} == {"a b", None}


def test_keep_first_period():
    assert keep_first_period(list("xabababy"), [(1, 6, 2)]) == list("xaby")
