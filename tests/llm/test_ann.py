import math
import random

import numpy as np
import pytest

from convspark.llm.ann import SHARD_ROWS, Forest, nearest
from convspark.llm.queries import op1_nearest_neighbours
from convspark.sources.tables import table

from ..conftest import SF_SMALL

VECTORS = "vec_id long, embedding array<float>, rank int"


def brute(rows, k=20):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            ok[i] = min(ok.get(i, v), v)
    out = []
    for q in sorted(i for i in ok if i % 20 == 0):
        near = sorted((-float(np.dot(ok[q], ok[i])), i) for i in ok if i != q and len(ok[i]) == len(ok[q]))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return out


def found(df, **kw):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in nearest(df, lambda c: c % 20 == 0, **kw).collect())


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want))


def test_edges(spark):
    rng = random.Random(0)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(6)], 0) for i in range(1, 70)]
    rows += [(20, rows[0][1], 1), (100, None, 0), (120, [0.0] * 6, 0), (140, [1.0, float("nan")] * 3, 0), (160, [float("inf")] * 6, 0),
             (180, [None, 1.0], 0), (200, [1.0, 2.0], 0), (201, [3.0, 1.0], 0), (None, [1.0] * 6, 0), (220, [], 0), (240, [7.0], 0)]
    same(found(spark.createDataFrame(rows, VECTORS)), brute(rows))
    same(found(spark.createDataFrame(rows, VECTORS), shard_rows=10, query_rows=2), brute(rows))
    assert found(spark.createDataFrame([], VECTORS)) == []


def test_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = found(spark.createDataFrame(rows, VECTORS), trees=32, candidates=2500, shard_rows=4000)
    want = brute(rows)
    a, b = {g[::2][:2] for g in got}, {w[::2][:2] for w in want}
    assert len(got) == len(want) and len(a & b) >= 0.9 * len(b)


@pytest.mark.parametrize("copies", [0, 1 / 3])
def test_recall_on_a_full_shard(spark, copies):
    """Production values on 16,384 rows, spread evenly or with a third of them copies of one vector that
    half of the other queries lie next to."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((SHARD_ROWS, 64))
    hot = rng.standard_normal(64)
    n = int(copies * SHARD_ROWS)
    if n:
        x[n:n + 4000] = hot + 0.7 * rng.standard_normal((4000, 64))
        x[:n] = hot
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x[rng.permutation(len(x))].astype(np.float32).astype(float)
    got = nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS), lambda c: c % 100 == 0).collect()
    assert len(got) == 20 * len(range(0, len(x), 100))
    mine = {}
    for r in got:
        mine.setdefault(r["query_id"], []).append(r["score"])
    hits = []
    for q, scores in mine.items():
        want = np.sort(np.delete(x @ x[q], q))[-20]
        hits.append(np.mean(np.array(scores) >= want - 1e-9))
    far = [h for q, h in zip(mine, hits) if not np.allclose(x[q], hot / np.linalg.norm(hot), atol=1e-6)]
    assert np.mean(hits) >= 0.9 and np.mean(far) >= 0.9


def test_forest_ranges_share_prefixes():
    rng = np.random.default_rng(2)
    f = Forest(rng.standard_normal((500, 8)), trees=4, bits=16)
    low, high = f.ranges(rng.standard_normal((9, 8)), 40)
    assert ((high - low).sum(axis=0) >= 40).all()


def test_query_is_exact_on_a_small_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF_SMALL, "embeddings").collect()]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op1_nearest_neighbours(spark, SF_SMALL).collect())
    same(got, brute(rows))
