"""SimHash near-dedup with bit-sliced comparison.

A text's fingerprint has the majority bits of the XXH64 hashes of its word shingles.  Fingerprints
within a few bits of each other are linked; linked documents form components.

Candidates: 64 bits are cut into ``radius + 2`` blocks; two fingerprints at ``radius`` or less
agree on at least two whole blocks, so they meet in a bucket of some pair of blocks.  A bucket
beyond ``CELL`` rows is dealt out as a grid of cells, each of which compares two of its
parts, so that no task gets a whole hot bucket and no pair is left out.

Comparison, within a run of buckets sorted by key: each of the 64 bits is a plane over the rows.
Shifted by ``d`` a plane meets itself, and its difference is a bit for each pair of rows ``d``
apart; a carry-save adder counts the differing bits of 64 pairs per machine word.  Words in
which every pair is past the radius (or in different buckets, or connected already) are abandoned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut_lineage, text_or_empty

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
CELL = 2048
RUN_ROWS = 1 << 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash; A-Z count as a-z, words end at ASCII white space, fewer words than a
    shingle are one shingle, and a text without words has fingerprint zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[:len(words) - shingle_words + 1].tolist(), ends[shingle_words - 1:].tolist()
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(first), 8192):  # bounded working memory for long texts
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[lo:lo + 8192], last[lo:lo + 8192])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * counts > len(first)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(id, fp)`` per row, ``fp`` as a signed long of the same bits."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("__t"))
    schema = rows.select("id").schema.add("fp", "long")

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, schema)


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row ``b`` holds bit ``b`` of every fingerprint, 64 to a word, two spare words."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    return _words(bits, n)


def _words(bits: np.ndarray, n: int) -> np.ndarray:
    packed = np.packbits(bits, axis=-1, bitorder="little")
    width = (n + 63) // 64 * 8 + 16
    pad = [(0, 0)] * (packed.ndim - 1) + [(0, width - packed.shape[-1])]
    return np.ascontiguousarray(np.pad(packed, pad)).view("<u8")


def _over(c: list[np.ndarray], beyond: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count (or the sticky overflow) is past ``radius``."""
    more, same = beyond.copy(), np.full_like(beyond, FULL)
    for k in (2, 1, 0):
        if radius >> k & 1:
            same &= c[k]
        else:
            more |= same & c[k]
            same &= ~c[k]
    return more


def near_pairs(bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links within buckets: positions ``(i, j)`` in the order given.

    ``bucket`` is sorted; rows of one bucket whose fingerprints differ in ``radius`` bits or less
    (at most 7) are linked.  Any two linked rows end up connected by the pairs returned.
    """
    n = len(fps)
    if n < 2:
        return []
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    largest = int(np.diff(np.r_[starts, n]).max())
    planes = _planes(fps)
    parent = np.arange(n)
    out: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    for d in range(1, largest):
        lanes = (bucket[d:] == bucket[:-d]) & (parent[d:] != parent[:-d])
        if not lanes.any():
            continue
        mask = _words(lanes, n - d)
        act = np.flatnonzero(mask)
        alive = mask[act]
        q, r = divmod(d, 64)
        down, up = np.uint64(r), np.uint64(64 - r if r else 0)

        def diff(b: int) -> np.ndarray:
            p = planes[b]
            far = p[act + q] if not r else (p[act + q] >> down) | (p[act + q + 1] << up)
            return p[act] ^ far

        c = [np.zeros(len(act), np.uint64) for _ in range(3)]
        beyond = np.zeros(len(act), np.uint64)
        for b in range(0, 64, 2):
            x, y = diff(b), diff(b + 1)
            u = c[0] ^ x                      # carry-save: c0 + x + y
            carry = (c[0] & x) | (u & y)
            c[0] = u ^ y
            t = c[1] & carry
            c[1] = c[1] ^ carry
            beyond |= c[2] & t
            c[2] = c[2] ^ t
            if b % 8 == 6:
                alive &= ~_over(c, beyond, radius)
                keep = np.flatnonzero(alive)
                if len(keep) < len(act):      # abandon words in which no pair is left
                    act, alive, beyond = act[keep], alive[keep], beyond[keep]
                    c = [x[keep] for x in c]
                    if not len(act):
                        break
        if not len(act):
            continue
        hits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for w, k in zip(*np.nonzero(hits)):
            i = int(act[w]) * 64 + int(k)
            a, b = root(i), root(i + d)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, i + d))
        while True:
            flat = parent[parent]
            if (flat == parent).all():
                break
            parent = flat
    return out


def _cuts(radius: int) -> list[int]:
    """Masks of each pair of blocks, as signed longs."""
    k = radius + 2
    edges = [64 * i // k for i in range(k + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [int(np.uint64(x | y).astype(np.int64)) for x, y in combinations(blocks, 2)]


def links(fps: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """``(a, b)``: pairs of the distinct fingerprints ``fps(fp)`` within ``radius`` bits, at least a
    spanning forest of every bucket's links."""
    cuts = F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(m).alias("mask")) for i, m in enumerate(_cuts(radius))])
    rows = (fps.select("fp", F.explode(cuts).alias("c"))
            .select("fp", F.col("c.cut").alias("cut"), F.col("fp").bitwiseAND(F.col("c.mask")).alias("part")))
    size = rows.groupBy("cut", "part").count().where("count > 1")
    parts = F.ceil(F.col("count") / cell).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("parts")).cast("int")
    cells = (rows.join(size, ["cut", "part"]).withColumn("parts", parts).withColumn("mine", mine)
             .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
             .select("cut", "part", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp"))
    keys = ["cut", "part", "i", "j"]

    def run(batches):
        held = None

        def pairs(rows: pa.Table):
            cols = [rows.column(k).to_numpy() for k in keys]
            fp = rows.column("fp").to_numpy()
            new = np.zeros(len(fp), bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            got = near_pairs(np.cumsum(new), fp.view(np.uint64), radius)
            at = np.array(got, np.int64).reshape(-1, 2)
            a, b = fp[at[:, 0]], fp[at[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= RUN_ROWS:
                # all but the last bucket are complete
                last = [held.column(k)[held.num_rows - 1].as_py() for k in keys]
                same = np.ones(held.num_rows, bool)
                for k, v in zip(keys, last):
                    same &= held.column(k).to_numpy() == v
                whole = int(np.argmax(same))
                if whole:
                    yield pairs(held.slice(0, whole))
                    held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield pairs(held)

    return cells.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
               radius: int = RADIUS) -> DataFrame:
    """``(id, fp, component_id)`` per row of ``docs``: the smallest id reachable over links.

    Null and empty texts have fingerprint zero and link like any other.  Copies share a
    fingerprint and are one node of the graph; repeated rows each keep their row.  Null ids
    never name a component unless all of its ids are null.  Extra columns are not carried.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, shingle_words))
    nodes = marked.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(links(nodes.select("fp"), radius))
    rooted = (nodes.join(roots, nodes["fp"] == roots["node"], "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(names, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that name their component: one document of each group, smallest id.

    Rows without an id stay (nothing names them).  Of rows that repeat an id with different texts,
    each is judged by its own fingerprint."""
    found = cut_lineage(near_dedup(docs, id_col, text_col, shingle_words, radius))
    away = found.where("id <> component_id").select("id")
    kept = docs.join(away, docs[id_col] == away["id"], "left_anti").select(*docs.columns)
    # ids that go by one text and name a component by another: the fingerprint tells these rows apart
    named = found.where("id = component_id").select("id", "fp").distinct().join(away, "id", "left_semi")
    named = cut_lineage(named)
    if named.isEmpty():
        return kept
    split = docs.join(named, docs[id_col] == named["id"], "left_semi").select(
        F.struct(*docs.columns).alias("row"), F.col(text_col).alias("__text"))
    marked = fingerprints(split, "row", "__text", shingle_words).withColumnRenamed("id", "row")
    again = marked.join(named, (marked[f"row.{id_col}"] == named["id"]) & (marked["fp"] == named["fp"]), "left_semi")
    return kept.unionByName(again.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
