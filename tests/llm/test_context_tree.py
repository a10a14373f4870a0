import math
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from convspark.llm import context_tree as ct
from convspark.llm.queries import op11_context_tree
from convspark.sources.tables import table
from pyspark.sql import functions as F

from ..conftest import SF_SMALL
from .helpers import doc, docs_of


class SlowTree:
    """The weighted tree, node by node."""

    def __init__(self, texts, depth):
        self.depth = depth
        self.counts = defaultdict(lambda: [0, 0])
        self.longer = defaultdict(set)
        for t in texts:
            b = b"\xff" * depth + t + b"\xff"
            for i in range(depth, len(b)):
                for bit in range(8):
                    prefix = (1 << bit) | b[i] >> 8 - bit
                    for d in range(depth + 1):
                        c = b[i - d:i]
                        self.counts[c, prefix][b[i] >> 7 - bit & 1] += 1
                        if d < depth:
                            self.longer[c, prefix].add(b[i - d - 1:i])
        self.log_w = lru_cache(None)(self._log_w)

    def kt(self, node):
        n0, n1 = self.counts[node] if node in self.counts else (0, 0)
        return math.lgamma(n0 + .5) + math.lgamma(n1 + .5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    def product(self, c, prefix):
        return sum(self.log_w(x, prefix) for x in sorted(self.longer.get((c, prefix), ())))

    def _log_w(self, c, prefix):
        own = self.kt((c, prefix))
        return own if len(c) == self.depth else math.log(.5) + float(np.logaddexp(own, self.product(c, prefix)))

    def one(self, c, prefix, d=0):
        """Probability of a one after the whole context ``c``, from depth ``d`` on."""
        node = (c[len(c) - d:], prefix)
        n0, n1 = self.counts[node] if node in self.counts else (0, 0)
        own = (n1 + .5) / (n0 + n1 + 1)
        if d == self.depth:
            return own
        odds = math.exp(min(700, self.kt(node) - self.product(*node)))
        return (odds * own + self.one(c, prefix, d + 1)) / (odds + 1)

    def score(self, t):
        b, out = b"\xff" * self.depth + t + b"\xff", 0.0
        for i in range(self.depth, len(b)):
            for bit in range(8):
                p = self.one(b[i - self.depth:i], (1 << bit) | b[i] >> 8 - bit)
                out += math.log10(p if b[i] >> 7 - bit & 1 else 1 - p)
        return out


def base(texts, train):
    counts, n = Counter(), 0
    for t in train:
        counts.update([*t.lower().split(), b"\xff"])
    n, v = sum(counts.values()), len(counts)
    rows = []
    for t in texts:
        tokens = [*t.lower().split(), b"\xff"]
        rows.append((len(tokens), sum(counts[w] > 0 for w in tokens), n,
                     sum(math.log10((counts[w] + .1) / (n + .1 * (v + 1))) for w in tokens)))
    return rows


def texts():
    rng = random.Random(5)
    words = "the cat sat on a mat É 中 The\tTHE x=1 \n".split(" ")
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(25))) for _ in range(40)] + ["", " ", "\x00\x01", "aaaa" * 30]


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_scores_are_the_weighted_tree(spark, depth):
    rows = [doc(i, t) for i, t in enumerate(texts())] + [doc(100, None), doc(3, "the cat"), doc(3, "the cat"), doc(None, "a mat")]
    docs = docs_of(spark, rows)
    got = ct.score_texts(docs, F.col("doc_id") % 3 != 0, depth=depth, block_bytes=300).collect()
    train = [(r[1] or "").encode() for r in rows if r[0] is not None and r[0] % 3 != 0]
    tree = SlowTree(train, depth)
    raw = [(r[1] or "").encode() for r in rows]
    want = sorted((str(r[0]), len(t), *b, tree.score(t)) for r, t, b in zip(rows, raw, base(raw, train)))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-5, abs=1e-5)


def test_query_whatever_the_blocks(spark, monkeypatch, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF_SMALL, "documents").collect()]
    docs_of(spark, [doc(*r) for r in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    one = {r["doc_id"]: r for r in op11_context_tree(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(ct, "SHARES", 2)
    monkeypatch.setattr(ct, "CHUNK_BYTES", 5000)
    docs = table(spark, str(tmp_path), "documents")
    many = ct.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0, block_bytes=50_000).collect()
    assert len(many) == len(one) == len(rows)
    train = [(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    want = dict(zip([i for i, _ in rows], base([(t or "").encode() for _, t in rows], train)))
    for r in many:
        o = one[r["doc_id"]]
        assert o["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) != r["trained"]
        assert r["score"] == pytest.approx(o["score"], rel=1e-6)
        assert (o["n_tokens"], o["n_known"], o["train_tokens"]) == want[r["doc_id"]][:3]
        assert o["base_score"] == pytest.approx(want[r["doc_id"]][3], rel=1e-9)
    held = [r for r in one.values() if r["held_out"] and r["n_bytes"] > 100]
    assert 0.5 < sum(r["bits_per_byte"] for r in held) / len(held) < 4.5


def test_bytes_after_a_context_sum_to_one():
    rng = np.random.default_rng(1)
    seen = [bytes(rng.choice([97, 98, 32, 200], 400).astype(np.uint8))]
    keys, counts = np.unique(ct.windows(seen)[0], return_counts=True)
    for context in (b"aba ", b"zzzz", b"zzab"):
        asked = ct.windows([context + bytes([x]) for x in range(256)])[0].reshape(256, 6)[:, 4]
        k, c = ct.merge([keys, np.unique(asked)], [counts, np.zeros(256, np.int64)])
        ids, *sums = ct.summary(k, c)
        top = ct.top_of(ids, *sums)
        p = 10 ** ct.log_probabilities(k, c, top)[np.searchsorted(k, np.sort(asked))]
        assert p.sum() == pytest.approx(1)


def test_packing_and_tables():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 56, 5000))
    assert (ct.unpack(ct.pack(keys)) == keys).all() and (ct.unpack_counts(ct.pack_counts(keys)) == keys).all()
    assert len(ct.unpack(ct.pack(keys[:0]))) == 0
    at = rng.integers(0, len(keys), 20_000)
    assert (ct.Table(keys, np.arange(len(keys))).get(keys[at]) == at).all()
    big = np.array([0.0, 3, 70_000, 1e7])
    assert ct.log_kt(big, big[::-1]) == pytest.approx(
        [math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(big, big[::-1])])


def test_empty_tables_and_no_training(spark):
    assert ct.score_texts(docs_of(spark, []), F.lit(True)).collect() == []
    (r,) = ct.score_texts(docs_of(spark, [doc(1, "ab c")]), F.lit(None).cast("boolean")).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
    assert r["score"] == pytest.approx(5 * 8 * math.log10(.5)) and r["bits_per_byte"] == pytest.approx(10)
    with pytest.raises(ValueError):
        ct.score_texts(docs_of(spark, []), F.lit(True), depth=1)
