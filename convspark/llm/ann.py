"""Approximate nearest neighbours by inner product: a hash-prefix forest.

The index is cut into shards by a hash of the id.  In a shard every tree keeps the vectors' long
hash strings (signs of random projections) in a sorted array.  A query descends each tree by binary
search to its longest prefix match; then all trees ascend together, one prefix bit at a time,
until the prefixes hold enough candidates: index entries, and distinct vectors in proportion to the
shard.  Candidates are scored exactly.  Equal vectors of a shard are one entry of its index, and
their ids are put back after scoring.

A cell of the plan is a shard against a block of queries.  Both have a bounded number of rows, so a
cell's memory does not grow with the table; cells grow with rows times queries, as the
candidates do at a fixed recall.  The best ``k`` of a query's cells are ranked at the end.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 16384
QUERY_ROWS = 2048
TREES = 32
HASH_BITS = 32
CANDIDATES = 8000
# of a shard's distinct vectors
SHARE = 0.55
K = 20


@lru_cache(maxsize=8)
def _projections(dim: int, trees: int, bits: int) -> np.ndarray:
    """``trees * bits`` unit directions, orthogonal within runs of ``dim``; the same in every task."""
    rng = np.random.default_rng(dim)
    need = trees * bits
    runs = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-need // dim))]
    return np.ascontiguousarray(np.hstack(runs)[:, :need].astype(np.float32))


def _hashes(x: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """Hash strings as numbers, one row per tree."""
    r = _projections(x.shape[1], trees, bits)
    out = np.empty((trees, len(x)), np.uint64)
    x = x.astype(np.float32)
    for t in range(trees):
        signs = x @ r[:, t * bits:(t + 1) * bits] > 0
        packed = np.packbits(signs, axis=1)
        out[t] = np.pad(packed, ((0, 0), (8 - packed.shape[1], 0))).view(">u8")[:, 0]
    return out


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = HASH_BITS):
        if bits % 8 or bits > 56:
            raise ValueError("bits must be a multiple of 8, 56 at most")
        self.x, self.trees, self.bits = vectors, trees, bits
        # inner product as an angle: a last component makes all vectors equally long
        norms = np.einsum("ij,ij->i", vectors, vectors)
        rest = np.sqrt(np.maximum(norms.max() - norms, 0))
        h = _hashes(np.hstack([vectors, rest[:, None]]), trees, bits)
        self.order = np.argsort(h, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(h, self.order, axis=1)

    def ranges(self, queries: np.ndarray, wanted: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query, the run ``[low, high)`` of the sorted array at the query's depth:
        the largest common prefix length at which all trees together hold ``wanted`` entries
        (one number, or one per query)."""
        wanted = np.broadcast_to(wanted, len(queries))
        hq = _hashes(np.hstack([queries, np.zeros((len(queries), 1))]), self.trees, self.bits)
        low = np.zeros(hq.shape, np.int64)
        high = np.full(hq.shape, len(self.x), np.int64)
        todo = np.arange(len(queries))
        for short in range(0, self.bits):  # prefix length: bits - short
            s, one = np.uint64(short), np.uint64(1)
            lo, hi = (np.empty((self.trees, len(todo)), np.int64) for _ in range(2))
            for t in range(self.trees):
                stem = hq[t, todo] >> s
                lo[t] = np.searchsorted(self.sorted[t], stem << s)
                hi[t] = np.searchsorted(self.sorted[t], (stem + one) << s)
            full = (hi - lo).sum(axis=0) >= wanted[todo]
            low[:, todo[full]], high[:, todo[full]] = lo[:, full], hi[:, full]
            todo = todo[~full]
            if not len(todo):
                break
        return low, high

    def search(self, queries: np.ndarray, k: int, wanted: int, share: float = SHARE):
        """For each query, in no order, its number, the positions of its candidates' best and their
        inner products (a few more than ``k`` where the last place is tied).

        Candidates are ``wanted`` index entries or more, and ``share`` of the rows (a quarter of
        ``wanted`` at least): a query with fewer distinct rows ascends further."""
        n = len(self.x)
        least = max(int(np.ceil(share * n)), min(n, wanted // 4))
        need = np.full(len(queries), max(wanted, least))
        seen, todo = np.zeros(n, bool), np.arange(len(queries))
        while len(todo):
            low, high = self.ranges(queries[todo], need[todo])
            few = []
            for at, q in enumerate(todo):
                seen[:] = False
                for t in range(self.trees):
                    seen[self.order[t, low[t, at]:high[t, at]]] = True
                rows = np.flatnonzero(seen)
                if len(rows) < least:
                    need[q] = (high[:, at] - low[:, at]).sum() + 1
                    few.append(q)
                    continue
                scores = self.x[rows] @ queries[q]
                if len(rows) > k:
                    best = scores >= np.partition(scores, -k)[-k]
                    rows, scores = rows[best], scores[best]
                yield q, rows, scores
            todo = np.array(few, int)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)``: one row per id; null ids and vectors that are null, empty, zero or hold a
    null or non-finite component are left out.  Of rows that repeat an id the smallest array counts."""
    ok = (F.col(id_col).isNotNull()
          & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
          & F.exists(vec_col, lambda x: x != 0))
    return vectors.where(ok).groupBy(F.col(id_col).alias("id")).agg(F.min(vec_col).alias("vec"))


def nearest(vectors: DataFrame, query_filter, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding",
            shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, trees: int = TREES,
            bits: int = HASH_BITS, candidates: int = CANDIDATES) -> DataFrame:
    """``(query_id, rank, id, score)``: for every row that ``query_filter`` (a condition on ``id``)
    takes, the ``k`` largest inner products found among all other rows, ties to the smaller id.

    Scores are exact, in double precision on the original vectors.  Vectors of different length
    are never compared.  A query with fewer than ``k`` candidates has fewer rows; an empty table
    gives an empty result.
    """
    rows = usable(vectors, id_col, vec_col).withColumn("dim", F.size("vec"))
    queries = rows.where(query_filter(F.col("id")))
    n, nq = rows.agg(F.count("*"), F.count(F.when(query_filter(F.col("id")), 1))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-nq // query_rows))
    kind = vectors.schema[id_col].dataType.simpleString()
    left = (rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))

    def cell(xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "id": [], "score": []}
        if len(xs) and len(qs):
            ids, qids = xs["id"].to_numpy(), qs["id"].to_numpy()
            x, group = np.unique(np.array(xs["vec"].tolist(), float), axis=0, return_inverse=True)
            ids = ids[np.lexsort((ids, group.ravel()))]
            sizes = np.bincount(group.ravel())
            starts = np.cumsum(sizes) - sizes
            # of equal vectors the k + 1 smallest ids: enough for any answer, the query's own left out
            sizes = np.minimum(sizes, k + 1)
            found = Forest(x, trees, bits).search(np.array(qs["vec"].tolist(), float), k + 1, candidates)
            for n, at, scores in found:
                q = qids[n]
                names = np.concatenate([ids[a:a + m] for a, m in zip(starts[at], sizes[at])])
                scores = np.repeat(scores, sizes[at])
                other = names != q
                names, scores = names[other], scores[other]
                top = np.lexsort((names, -scores))[:k]
                out["query_id"].append(np.full(len(top), q))
                out["id"].append(names[top])
                out["score"].append(scores[top])
        if not out["id"]:
            return pd.DataFrame({c: [] for c in out})
        return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    keys = ("dim", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        cell, f"query_id {kind}, id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))
