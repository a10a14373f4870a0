import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from convspark.llm.queries import op13_spelling_variants
from convspark.llm.variants import FMIndex, count_words, group_variants, letter_runs, neighbours
from convspark.sources.tables import table

from ..conftest import SF_SMALL
from .helpers import doc, docs_of


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def edits(w, letters):
    """All strings one edit away."""
    out = {w[:k] + w[k + 1:] for k in range(len(w))}
    out |= {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
    return (out | {w[:k] + c + w[k + 1:] for k in range(len(w)) for c in letters}) - {w}


def slow_groups(vocab, ratio=2):
    letters = {c for w in vocab for c in w}
    near = {w: [x for x in edits(w, letters) if x in vocab] for w in vocab}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= ratio * vocab[w] else None
    out = []
    for w in vocab:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, vocab[w], len(near[w]), vocab[form[w]] if form[w] is not None else None))
    return sorted(out)


def slow_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def vocabulary(seed, size, letters="abcé"):
    rng = random.Random(seed)
    words = set()
    while len(words) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(5, 9)))
        words.add(w)
        words.update(rng.sample(sorted(x for x in edits(w, letters) if len(x) >= 5), 2))
    return {w: rng.choice((3, 3, 4, 7, 20, 90)) for w in sorted(words)}


def test_letter_runs():
    text = "AbÉ c×dİ中 e-f ퟿ÿ\x85x\xa0yĀZ?"
    want = ["".join(c.lower() if "A" <= c <= "Z" else c for c in r) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]
    assert [w for w in letter_runs(text) if w] == want


def test_index_counts_every_letter():
    words = ["abracad", "b", "bab", "ab", "zz", "z"]
    ix = FMIndex(words)
    for code in range(ix.sigma):
        for i in range(ix.n + 1):
            assert ix.rank(np.array([code]), np.array([i]))[0] == (ix.before[:i] == code).sum()


@pytest.mark.parametrize("seed", range(4))
def test_both_schemes_together_find_each_pair_once(seed):
    words = [*vocabulary(seed, 300, "ab" if seed == 3 else "abcé")]
    extra = ["a" * 40, "a" * 41, "a" * 42, "ab" * 20, "ab" * 20 + "a", "qqqqq", "xyzxyz"]
    ask = words + extra
    got = Counter()
    for reverse in (False, True):
        p, w = neighbours(words + extra[:5], ask, reverse)
        got.update(zip([ask[i] for i in p], [(words + extra[:5])[j] for j in w]))
    want = {(a, b) for a in ask for b in words + extra[:5] if one_edit(a, b)}
    assert set(got) == want and set(got.values()) <= {1}


@pytest.mark.parametrize("shard", [65_536, 40])
def test_groups_whatever_the_shards(spark, shard):
    vocab = vocabulary(9, 400) | {"aaaaa": 3, "aaaaab": 6, "aaaaabb": 12, "aaaaabbc": 24, "aaaaabbcc": 48}
    got = group_variants(spark.createDataFrame([*vocab.items()], "word string, n long"), shard=shard).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == slow_groups(vocab)


def test_query_is_the_contract(spark, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF_SMALL, "documents").collect()]
    rows += [(1, None), (2, ""), (3, "aaaaa " * 5), (3, "aaaaa " * 5), (None, "words Words WORDS wordz wordz wordz"), (4, "x" * 30_000 + " y")]
    docs_of(spark, [doc(*r) for r in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n"))
           for r in op13_spelling_variants(spark, str(tmp_path)).collect()]
    want = slow_groups(slow_counts([("" if i is None else i, t) for i, t in rows]))
    assert sorted(got) == want
    assert sum(r[1] is not None for r in got) > 50


def test_long_words_and_empty_tables(spark):
    rows = [doc(1, f"{'a' * 3000} {'a' * 3001} {'ab' * 2000} " * 3), doc(2, "short word")]
    got = group_variants(count_words(docs_of(spark, rows))).collect()
    assert sorted((len(r["word"]), r["n_near"]) for r in got) == [(3000, 1), (3001, 1), (4000, 0)]
    assert group_variants(count_words(docs_of(spark, []))).collect() == []
    with pytest.raises(ValueError):
        group_variants(count_words(docs_of(spark, [])), ratio=1)
