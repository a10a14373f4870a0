"""Substring near-dedup with compact windows.

Words make shingles, shingles make hashes.  Under one hash function the Cartesian tree over a text's
hashes has, at each position, the subsequence (the node's subtree) in which that position is the
minimum.  Only subtrees of a passage's length or more matter; all passages inside one share their
min-hash, so a text of ``n`` shingles needs about ``2 n / width`` windows per hash function.  The
windows of two functions are joined where they overlap: a joint window stands for all passages
with the same two min-hashes, and its key is that signature.  Joint windows with equal keys in different
documents are near-duplicate candidates; each is aligned with its key's first document and
verified by the Jaccard similarity of the shingles.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import text_or_empty, written

SHINGLE_WORDS = 5
MIN_WORDS = 50
SEED = 42
# fixed odd multipliers: one hash function each
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
          0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xA0761D6478BD642F)
# one window at similarity s shares a signature with chance 1 - (1 - s**2)**4: 0.983 at 0.8
BANDS = ((0, 1), (2, 3), (4, 5), (6, 7))
SIMILARITY = 0.8
RUN_CHARS = 200_000
ARRAY_BYTES = 255
XXH64_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
CELL = 1024


def shingles(text: str, k: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each run of ``k`` words (A-Z as a-z, cut at ASCII white space); empty if fewer."""
    return shingle_lists([text], k)[0]


def shingle_lists(texts: list[str], k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The shingles of each text; those of all texts are hashed together."""
    lists = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array(list(map(len, lists)), np.int64)
    words = list(chain.from_iterable(lists))
    if len(words) < k:
        return [np.zeros(0, np.uint64)] * len(texts)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.r_[0, ends[:len(words) - k] + 1]
    h = _xxh64(b" ".join(words), first, ends[k - 1:])
    starts = (np.cumsum(counts) - counts).tolist()
    return [h[a:a + max(n - k + 1, 0)] for a, n in zip(starts, counts.tolist())]


def _xxh64(data: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """XXH64 of each ``data[first:last]``: by array operations up to ``ARRAY_BYTES``, longer ones one by one."""
    h = np.empty(len(first), np.uint64)
    short = last - first <= ARRAY_BYTES
    for i in np.flatnonzero(~short).tolist():
        h[i] = xxhash.xxh64_intdigest(data[first[i]:last[i]], SEED)
    padded = data + bytes(8)
    eights, fours = (np.ndarray(len(data) + 1, t, padded, strides=(1,)) for t in ("<u8", "<u4"))
    rows = np.flatnonzero(short)
    for c in range(0, len(rows), 8192):
        part = rows[c:c + 8192]
        h[part] = _xxh64_short(eights, fours, first[part], last[part])
    return h


def _xxh64_short(eights: np.ndarray, fours: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    p1, p2, p3, p4, p5 = XXH64_PRIMES

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return x << np.uint64(n) | x >> np.uint64(64 - n)

    h = np.full(len(at), np.uint64(SEED) + p5)
    size, at = (last - at).astype(np.uint64), at.copy()
    big = np.flatnonzero(last - at >= 32)
    if len(big):
        sums = np.empty((4, len(big)), np.uint64)
        sums[:] = np.array([(SEED + int(p1) + int(p2)) % 2**64, (SEED + int(p2)) % 2**64, SEED, (SEED - int(p1)) % 2**64], np.uint64)[:, None]
        more = np.arange(len(big))
        while len(more):
            lanes = eights[at[big[more]] + np.arange(0, 32, 8)[:, None]]
            sums[:, more] = turn(sums[:, more] + lanes * p2, 31) * p1
            at[big[more]] += 32
            more = more[last[big[more]] - at[big[more]] >= 32]
        x = turn(sums[0], 1) + turn(sums[1], 7) + turn(sums[2], 12) + turn(sums[3], 18)
        for lane in sums:
            x = (x ^ turn(lane * p2, 31) * p1) * p1 + p4
        h[big] = x
    h += size
    for _ in range(3):
        m = np.flatnonzero(last - at >= 8)
        h[m] = turn(h[m] ^ turn(eights[at[m]] * p2, 31) * p1, 27) * p1 + p4
        at[m] += 8
    m = np.flatnonzero(last - at >= 4)
    h[m] = turn(h[m] ^ fours[at[m]].astype(np.uint64) * p1, 23) * p2 + p3
    at[m] += 4
    for _ in range(3):
        m = np.flatnonzero(at < last)
        h[m] = turn(h[m] ^ (fours[at[m]] & np.uint32(255)).astype(np.uint64) * p5, 11) * p1
        at[m] += 1
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def _mix(h: np.ndarray, mult: int) -> np.ndarray:
    v = h * np.uint64(mult)
    v ^= v >> np.uint64(29)
    return v * np.uint64(0xBF58476D1CE4E5B9)


def window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each run of ``width`` values: the nodes of the Cartesian
    tree whose subtree spans ``width`` or more, each over the starts it covers."""
    at = np.arange(len(v), dtype=np.int32)
    w = 1
    while w < width:
        step = min(w, width - w)
        a, b = at[:-step], at[step:]
        at = np.where(v[step:] < v[:-step], b, a)
        v = np.minimum(v[step:], v[:-step])
        w += step
    return at


def compact_windows(h: np.ndarray, ends: np.ndarray, width: int):
    """Per band: ``(key, text, anchor, first, last)`` arrays of the joint windows of its two hashes.

    ``h`` holds the shingles of several texts, ``ends`` where each ends.  All subsequences of ``width``
    shingles that start in ``first..last`` have the same two min-hashes; the first one is at
    ``anchor`` for the earliest of them.  (Equal neighbours count as one window even where the
    minimum moves on to a copy of itself, so that a line repeated over and over is one window.)
    """
    if len(h) < width:
        return
    starts = np.r_[0, ends[:-1]]
    ok = np.zeros(len(h) - width + 1, bool)
    head = np.zeros(len(ok), bool)
    for a, b in zip(starts, ends):
        if b - a >= width:
            ok[a:b - width + 1] = True
            head[a] = True
    minima = [window_minima(_mix(h, m), width) for m in HASHES]
    for n, (i, j) in enumerate(BANDS):
        a, b = h[minima[i]], h[minima[j]]
        new = head.copy()
        new[1:] |= ok[1:] & ((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        first = np.flatnonzero(new)
        if not len(first):
            continue
        end = np.empty(len(ok), bool)
        end[-1], end[:-1] = True, ~ok[1:] | new[1:]
        last = np.flatnonzero(end & ok)
        key = _mix(a[first] ^ np.uint64(n + 1), HASHES[2]) + _mix(b[first], HASHES[3])
        text = np.searchsorted(ends, first, side="right")
        yield key, text, minima[i][first], first, last


def window_rows(docs: DataFrame, min_words: int, k: int) -> DataFrame:
    """``(key, doc, anchor, first, last)`` of all joint windows of ``docs(doc, text)``; positions are
    shingle (that is, word) numbers."""
    width = min_words - k + 1
    schema = docs.select("doc").schema
    schema = type(schema)([*type(schema)().add("key", "long").fields, *schema.fields]).add(
        "anchor", "long").add("first", "long").add("last", "long")
    names = schema.names

    def emit(ids, hs):
        ends = np.cumsum([len(x) for x in hs])
        starts = np.r_[0, ends[:-1]]
        for key, text, anchor, first, last in compact_windows(np.concatenate(hs), ends, width):
            at = starts[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), ids.take(pa.array(text)), *[pa.array(x - at) for x in (anchor.astype(np.int64), first, last)]],
                names=names)

    def run(batches):
        for b in batches:
            held, at, size = [], 0, 0
            for n, t in enumerate(b.column(1).to_pylist()):
                held.append(t)
                size += len(t)
                if size >= RUN_CHARS or n == b.num_rows - 1:
                    yield from emit(b.column(0).slice(at, len(held)), shingle_lists(held, k))
                    held, at, size = [], n + 1, 0

    return docs.select("doc", "text").mapInArrow(run, schema)


def _island(df: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    """Numbers the runs of overlapping or touching ``[start, end)`` of each group of ``keys``."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True))
    return df.withColumn("__new", fresh.cast("int")).withColumn(
        name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def _regions(docs: DataFrame, shared: DataFrame, k: int) -> DataFrame:
    """``(doc, region, at, hashes)``: the shingles (32 bits each) of the parts of the documents that
    lie in shared windows.  The only step that joins texts."""
    need = shared.groupBy("doc", "region").agg(F.min("first").alias("at"), F.max("stop").alias("stop"))
    rows = need.join(docs, "doc").select("doc", "region", "at", "stop", "text")
    schema = rows.select("doc", "region", "at").schema.add("hashes", ArrayType(IntegerType()))

    def run(batches):
        for b in batches:
            texts = b.column(4).to_pylist()
            out, asked, parts, size = [], [], [], 0
            for n, (t, a, z) in enumerate(zip(texts, b.column(2).to_pylist(), b.column(3).to_pylist())):
                if not asked or t != asked[-1]:
                    asked.append(t)
                    size += len(t)
                parts.append((len(asked) - 1, a, z))
                if size >= RUN_CHARS or n == b.num_rows - 1:
                    hs = [h.astype(np.uint32).view(np.int32) for h in shingle_lists(asked, k)]
                    out += [hs[i][a:z] for i, a, z in parts]
                    asked, parts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.list_(pa.int32()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _similarity(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _sides(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """``spans`` with the shingles of both sides, ``__a`` and ``__b``."""
    def part(start: str, end: str) -> Column:
        return F.slice("hashes", (F.col(start) - F.col("at") + 1).cast("int"), (F.col(end) - F.col(start)).cast("int"))

    left = (spans.join(regions, ["doc", "region"])
            .withColumn("__a", part("start", "end")).drop("at", "hashes"))
    other = regions.select(F.col("doc").alias("rdoc"), F.col("region").alias("rregion"), "at", "hashes")
    return (left.join(other, ["rdoc", "rregion"])
            .withColumn("__b", part("rstart", "rend")).drop("at", "hashes"))


def _verified(spans: DataFrame, regions: DataFrame, least: float) -> DataFrame:
    """``spans`` with the similarity of its two sides as wholes, and whether that is enough."""
    return (_sides(spans, regions).withColumn("similarity", _similarity(F.col("__a"), F.col("__b")))
            .withColumn("ok", F.col("similarity") >= least).drop("__a", "__b"))


def _among_themselves(rows: DataFrame, regions: DataFrame, width: int, least: float, cell: int = CELL) -> DataFrame:
    """Verified pairs among the windows ``rows`` of each key, at least a spanning forest of them.

    Windows of a key hold the same shingle at their anchors; two of them are compared around these: first
    place by place, all later rows at once, and where that is not enough each ``width``-long slice of one with
    each of the other, so that words put in or left out move nothing out of reach.  Rows that are ``linked`` already, to one another by way of the key's first
    window, are compared with the rest only.  A key beyond ``cell`` rows is dealt out as a grid of cells, each of
    which compares two of its parts, so that no task gets a whole hot key and no pair is left out.
    """
    if "linked" not in rows.columns:
        rows = rows.withColumn("linked", F.lit(False))
    size = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    mine = F.pmod(F.xxhash64("doc", "anchor"), F.col("parts")).cast("int")
    cells = (rows.select("key", "doc", "region", "anchor", "first", "stop", "linked").join(size, "key")
             .withColumn("parts", F.ceil(F.col("n") / cell).cast("int")).withColumn("mine", mine)
             .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
             .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")))
    # the shingles come last, so that they are shuffled once
    lo = F.greatest(F.col("first"), F.col("anchor") - (width - 1))
    hi = F.least(F.col("stop"), F.col("anchor") + width)
    near = F.slice("hashes", (F.col("lo") - F.col("at") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    cells = (cells.join(regions, ["doc", "region"]).withColumn("lo", lo).withColumn("hi", hi)
             .select("key", "i", "j", "doc", "anchor", "lo", "linked", near.alias("near")))
    keys = ["key", "i", "j"]
    kind = rows.schema["doc"].dataType.simpleString()
    out = f"doc {kind}, start long, end long, rdoc {kind}, rstart long, rend long, similarity double"

    alike = math.ceil(2 * width * least / (1 + least) - 1e-9)  # of two slices without repeats, at one diagonal

    def side_by_side(t: pa.Table):
        """The rows' shingles with the anchors in one column, where they stand, and where a whole slice begins:
        equal shingles of two slices lie on one diagonal there."""
        lists = t.column("near").combine_chunks()
        offsets = lists.offsets.to_numpy()
        sizes, flat = np.diff(offsets), lists.flatten().to_numpy()
        before = (t.column("anchor").to_numpy() - t.column("lo").to_numpy()).astype(np.int64)
        level = np.zeros((t.num_rows, 2 * width - 1), np.int32)
        held = np.zeros(level.shape, bool)
        row = np.repeat(np.arange(t.num_rows), sizes)
        col = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0] - (width - 1 - before), sizes)
        level[row, col], held[row, col] = flat, True
        sums = np.cumsum(held, axis=1, dtype=np.int16)
        full = sums[:, width - 1:].copy()
        full[:, 1:] -= sums[:, :-width]
        return level, held, full == width

    def agreement(level, held, full, i, j):
        """For rows ``i`` and ``j``, how many places agree in each pair of whole slices on the anchors' diagonal
        (-1 where one is not whole)."""
        sums = np.cumsum((level[i] == level[j]) & held[i] & held[j], axis=1, dtype=np.int16)
        same = sums[:, width - 1:].copy()
        same[:, 1:] -= sums[:, :-width]
        same[~(full[i] & full[j])] = -1
        return same

    def pairs(keys_of: np.ndarray, level, held, full, who: np.ndarray, root: np.ndarray, place: list, got: list) -> None:
        """Links the rows, of documents ``who``, that ``root`` leaves apart; ``keys_of`` numbers their keys.  The keys
        are gone through in step, so that one row of each meets all the later rows of its key at once."""
        edges = np.r_[0, np.flatnonzero(np.diff(keys_of)) + 1, len(keys_of)]
        begin, end = edges[:-1], edges[1:]
        of = np.repeat(np.arange(len(begin)), end - begin)
        bounds = list(zip(begin.tolist(), end.tolist()))
        # the distinct shingles of each row, numbered by key; where there are fewer, a number that no row has
        seen, numbers = np.unique((of[:, None] << 32 | level.view(np.uint32))[held], return_inverse=True)
        none = len(seen)
        code = np.full(level.shape, none, np.int32)
        code[held] = numbers
        distinct = np.sort(code, axis=1)
        again = (distinct[:, 1:] == distinct[:, :-1]) & (distinct[:, 1:] != none)
        distinct[:, 1:][again] = none
        repeats = again.any(axis=1)
        slices = {}

        def sliced(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The distinct shingles of row ``i``, which of them each of its whole slices holds, and how many."""
            if i not in slices:
                mine = code[i][held[i]]
                own = np.unique(mine)
                sums = np.zeros((len(mine) + 1, len(own)), np.int32)
                sums[np.arange(1, len(mine) + 1), np.searchsorted(own, mine)] = 1
                sums = np.cumsum(sums, axis=0)
                inside = sums[width:] > sums[:-width]
                slices[i] = own, inside, inside.sum(axis=1)
            return slices[i]

        fewest = np.full(len(level), width)
        for i in np.flatnonzero(repeats).tolist():
            fewest[i] = sliced(i)[2].min()
        at_place = np.full(none + 1, -1, np.int16)

        def join(i: int, j: int) -> None:
            a, z = bounds[of[i]]
            mine = root[a:z]
            mine[mine == root[j]] = root[i]

        def compare(i: int, j: int) -> None:
            """Links two rows by their best slices, of which some hold a shingle more than once."""
            (u, x, nx), (v, y, ny) = sliced(i), sliced(j)
            both, p, q = np.intersect1d(u, v, assume_unique=True, return_indices=True)
            common = x[:, p].astype(np.float32) @ y[:, q].T.astype(np.float32)
            sims = common / (nx[:, None] + ny - common.astype(float))
            a, b = divmod(int(sims.argmax()), len(ny))
            if sims[a, b] >= least:
                extend(i, j, a + int(held[i].argmax()), b + int(held[j].argmax()), float(sims[a, b]),
                       np.diagonal(sims, b - a) >= least, min(a, b))

        def extend(i: int, j: int, a: int, b: int, sim: float, run: np.ndarray, at: int) -> None:
            """Links two rows by the slices at columns ``a`` and ``b``, place ``at`` of their diagonal ``run``, and
            those before and after them that are near enough."""
            lo = hi = at
            while lo and run[lo - 1]:
                lo -= 1
            while hi + 1 < len(run) and run[hi + 1]:
                hi += 1
            before = place[2]
            link(i, j, a + lo - at - (width - 1 - before[i]), b + lo - at - (width - 1 - before[j]), hi - lo, sim, place, got)
            join(i, j)

        def in_window(hits: np.ndarray, whole: np.ndarray) -> np.ndarray:
            """The most hits that a whole slice of each row has."""
            sums = np.cumsum(hits, axis=1, dtype=np.int16)
            inside = sums[:, width - 1:].copy()
            inside[:, 1:] -= sums[:, :-width]
            return np.where(whole, inside, -1).max(axis=1)

        def all_slices(i: np.ndarray, j: np.ndarray) -> None:
            """Compares every slice of rows ``i`` with every slice of rows ``j``, pairs without repeats all at once."""
            column = at_place[code[j]]
            hits = column >= 0
            plain = ~(repeats[i] | repeats[j])
            mine = np.zeros(hits.shape, bool)
            which, _ = np.nonzero(hits)
            mine[which, column[hits]] = True
            ask = ~plain | ((in_window(hits, full[j]) >= alike) & (in_window(mine, full[i]) >= alike))
            i, j, column, plain = i[ask], j[ask], column[ask], plain[ask]
            starts = np.arange(width, dtype=np.int16)[:, None]
            size = max(1, 600_000 // (width * level.shape[1]))
            for c in range(0, len(i), size):
                ii, jj, col = i[c:c + size], j[c:c + size], column[c:c + size, None, :]
                sums = np.cumsum((col >= starts) & (col < starts + width), axis=2, dtype=np.int16)
                common = sums[:, :, width - 1:].copy()
                common[:, :, 1:] -= sums[:, :, :-width]
                common[~(full[ii][:, :, None] & full[jj][:, None, :])] = -1
                flat = common.reshape(len(ii), -1)
                best = flat.argmax(axis=1)
                most = flat[np.arange(len(ii)), best]
                for n in np.flatnonzero(~plain[c:c + size] | (most >= alike)).tolist():
                    one, two = int(ii[n]), int(jj[n])
                    if root[one] == root[two]:
                        continue
                    if not plain[c + n]:
                        compare(one, two)
                        continue
                    a, b = divmod(int(best[n]), width)
                    extend(one, two, a, b, int(most[n]) / (2 * width - int(most[n])),
                           np.diagonal(common[n], b - a) >= alike, min(a, b))

        for step in range(int((end - begin).max()) - 1):
            more = end - begin > step + 1
            begin, end = begin[more], end[more]
            sizes = end - begin - step - 1
            i = np.repeat(begin + step, sizes)
            j = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + i + 1
            apart = root[i] != root[j]
            alive = np.bincount(np.repeat(np.arange(len(begin)), sizes)[apart], minlength=len(begin)) > 0
            begin, end = begin[alive], end[alive]
            if not len(begin):
                return
            apart &= who[i] != who[j]
            i, j = i[apart], j[apart]
            for c in range(0, len(i), 4096):
                same = agreement(level, held, full, i[c:c + 4096], j[c:c + 4096])
                hit = np.flatnonzero(same.max(axis=1) >= alike)
                for one, two, *slices_of in on_diagonal(level, i[c + hit], j[c + hit], same[hit], place):
                    if root[one] != root[two]:
                        link(one, two, *slices_of, place, got)
                        join(one, two)
            # others may have words put in or left out: every slice of one against every slice of the other
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            if not len(i):
                continue
            heads = begin + step
            at_place[code[heads]] = np.arange(level.shape[1], dtype=np.int16)
            at_place[none] = -1
            for c in range(0, len(i), 4096):
                ii, jj = i[c:c + 4096], j[c:c + 4096]
                shared = (at_place[distinct[jj]] >= 0).sum(axis=1)
                ask = shared >= np.ceil(least * (fewest[jj] + fewest[ii]) / (1 + least) - 1e-9)
                if ask.any():
                    all_slices(ii[ask], jj[ask])
            at_place[code[heads]] = -1

    def link(i: int, j: int, a: int, b: int, last: int, sim: float, place: list, got: list) -> None:
        """Slices ``a`` of row ``i`` and ``b`` of row ``j`` up to ``last`` further ones are near duplicates."""
        doc, lows, _ = place
        at = {i: (lows[i] + a, lows[i] + a + last + width), j: (lows[j] + b, lows[j] + b + last + width)}
        one, two = ((i, j) if doc[i] > doc[j] else (j, i))
        got.append((doc[one], *at[one], doc[two], *at[two], sim))

    def on_diagonal(level, i: np.ndarray, j: np.ndarray, same: np.ndarray, place: list):
        """The pairs of rows ``i`` and ``j`` whose best whole slices on the diagonal are near enough as sets, each with
        the arguments of its link."""
        best = same.argmax(axis=1)
        x, y = (level[r[:, None], best[:, None] + np.arange(width)] for r in (i, j))

        def distinct(v: np.ndarray) -> np.ndarray:
            v = np.sort(v, axis=1)
            return 1 + (v[:, 1:] != v[:, :-1]).sum(axis=1)

        union = distinct(np.hstack([x, y]))
        sims = (distinct(x) + distinct(y) - union) / union
        col = np.arange(same.shape[1])
        low = same < alike
        lo = np.where(low & (col < best[:, None]), col, -1).max(axis=1) + 1
        hi = np.where(low & (col > best[:, None]), col, len(col)).min(axis=1) - 1
        before = place[2]
        near = sims >= least
        for one, two, first, last, sim in zip(*(v[near].tolist() for v in (i, j, lo, hi, sims))):
            yield one, two, first - (width - 1 - before[one]), first - (width - 1 - before[two]), last - first, sim

    def all_keys(t: pa.Table, edges: np.ndarray) -> list[tuple]:
        """Links the rows of each stretch of ``edges``.  Most near duplicates agree place by place around the
        anchor: all rows of all keys meet their key's first row at once, and those left over the first of them.  Then
        one row stands for those of other documents with the same shingles, and all that are still apart are compared."""
        level, held, full = side_by_side(t)
        doc, n = t.column("doc").to_pylist(), t.num_rows
        who = t.column("doc").combine_chunks().dictionary_encode().indices.to_numpy()
        lows = t.column("lo").to_pylist()
        place = [doc, lows, [a - b for a, b in zip(t.column("anchor").to_pylist(), lows)]]
        linked = t.column("linked").to_numpy(zero_copy_only=False)
        sizes = np.diff(edges)
        group = np.repeat(np.arange(len(sizes)), sizes)
        head = edges[:-1].copy()  # the first linked row, else the first
        seen = np.flatnonzero(linked)
        which, first = np.unique(group[seen], return_index=True)
        head[which] = seen[first]
        root = np.where(linked, head[group], np.arange(n))
        got: list[tuple] = []

        def meet(ask: np.ndarray, other: np.ndarray) -> None:
            """Links each row of ``ask`` with its row of ``other`` where they agree place by place."""
            for at in range(0, len(ask), 4096):
                part, heads = ask[at:at + 4096], other[at:at + 4096]
                same = agreement(level, held, full, heads, part)
                hit = np.flatnonzero((same.max(axis=1) >= alike) & (who[heads] != who[part]))
                for i, j, *slices in on_diagonal(level, heads[hit], part[hit], same[hit], place):
                    link(i, j, *slices, place, got)
                    root[j] = root[i]

        ask = np.flatnonzero(root != head[group])
        meet(ask, head[group[ask]])
        for _ in range(2):  # the rows left over meet the first of them
            ask = np.flatnonzero((root != head[group]) & (root == np.arange(n)))
            which, first = np.unique(group[ask], return_index=True)
            heads = ask[first]
            rest = np.setdiff1d(ask, heads)
            meet(rest, heads[np.searchsorted(which, group[rest])])
        # rows of a key with the same shingles in the same places: one of them stands for those of other documents
        mixed = _mix((np.where(held, level.astype(np.int64) + (1 << 33), 0).view(np.uint64)
                      * (np.arange(1, level.shape[1] + 1, dtype=np.uint64) * np.uint64(HASHES[0]))), HASHES[1]).sum(axis=1)
        opened = np.isin(group, np.unique(group[root != head[group]]))
        rows = np.flatnonzero(opened)
        order = rows[np.lexsort((rows, mixed[rows], group[rows]))]
        first = np.ones(len(order), bool)
        first[1:] = (group[order[1:]] != group[order[:-1]]) | (mixed[order[1:]] != mixed[order[:-1]])
        model = np.arange(n)
        model[order] = order[np.flatnonzero(first)][np.cumsum(first) - 1]
        copies = np.flatnonzero(model != np.arange(n))
        equal = (level[copies] == level[model[copies]]).all(axis=1) & (held[copies] == held[model[copies]]).all(axis=1)
        copies = copies[equal]
        apart = copies[root[copies] != root[model[copies]]]
        meet(apart, model[apart])
        keep = opened.copy()
        other_doc = np.array([doc[j] != doc[m] for j, m in zip(copies.tolist(), model[copies].tolist())], bool)
        keep[copies[other_doc & (root[copies] == root[model[copies]])]] = False
        at = np.flatnonzero(keep)
        if len(at):
            pairs(group[at], level[at], held[at], full[at], who[at], root[at], [[x[k] for k in at.tolist()] for x in place], got)
        return got

    def run(batches):
        held = None

        def emit(t: pa.Table):
            t = t.combine_chunks()
            key = np.stack([t.column(k).to_numpy() for k in keys])
            got = all_keys(t, np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, t.num_rows])
            cols = list(zip(*got)) or [()] * 7
            kinds = [t.schema.field("doc").type, pa.int64(), pa.int64()] * 2 + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=["doc", "start", "end", "rdoc", "rstart", "rend", "similarity"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= 4 * cell:
                key = np.stack([held.column(k).to_numpy() for k in keys])
                whole = int(np.argmax((key == key[:, -1:]).all(axis=0)))  # where the last group begins
                if whole:
                    yield emit(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield emit(held)

    return cells.repartition(*keys).sortWithinPartitions(*keys, "doc", "anchor").mapInArrow(run, out).distinct()


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                    similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc, start_word, end_word, rep_doc, rep_start_word, rep_end_word, similarity)``: passages of
    ``min_words`` words or more that near-duplicate one of another document (ends exclusive).

    A document's passage is paired with the one of its class's representative, the smallest id that has
    the signature: pairs with representatives, not all pairs, so copies give one row each.  Runs
    of windows that do not verify as wholes are compared passage by passage, among themselves and
    with all other windows of their signatures; ``similarity`` is then that of the best passage in the run.

    Null texts are empty; texts shorter than ``min_words`` and rows without an id take no part;
    rows that repeat an id are never compared with each other.  Extra columns are not carried.
    """
    width = min_words - shingle_words + 1
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    by_key = Window.partitionBy("key")
    shared = (window_rows(texts, min_words, shingle_words)
              .withColumn("__low", F.min("doc").over(by_key)).withColumn("__high", F.max("doc").over(by_key))
              .where("__low < __high").drop("__low", "__high")
              .withColumn("stop", F.col("last") + width))
    shared = written(_island(shared, ["doc"], "first", "stop", "region"))
    regions = written(_regions(texts, shared, shingle_words))

    rep = F.first(F.struct("doc", "region", "anchor", "first", "last", "stop")).over(
        Window.partitionBy("key").orderBy("doc", "first"))
    # all but the first window of each key; the first document's own take no part until a run fails
    edges = (shared.withColumn("rep", rep).where("doc <> rep.doc or first <> rep.first or anchor <> rep.anchor")
             .withColumn("low", F.greatest(F.expr("first - anchor"), F.expr("rep.first - rep.anchor")))
             .withColumn("high", F.least(F.expr("last - anchor"), F.expr("rep.last - rep.anchor"))))
    # aligned at the anchors where the windows allow it, else each side's own first passage
    aligned = F.col("low") <= F.col("high")
    edges = edges.select(
        "key", "doc", "region", "anchor", "first", "stop", "rep",
        F.when(aligned, F.expr("anchor + low")).otherwise(F.col("first")).alias("start"),
        (F.when(aligned, F.expr("anchor + high")).otherwise(F.col("first")) + width).alias("end"),
        F.when(aligned, F.expr("rep.anchor + low")).otherwise(F.col("rep.first")).alias("rstart"))
    edges = edges.withColumn("diag", F.expr("start - rstart")).drop("rstart").withColumns(
        {"rdoc": F.col("rep.doc"), "rregion": F.col("rep.region")})
    side = ["doc", "region", "rdoc", "rregion", "diag"]
    edges = written(_island(edges, side, "start", "end", "isle"))
    isles = (edges.where("doc <> rdoc").groupBy(*side, "isle").agg(F.min("start").alias("start"), F.max("end").alias("end"))
             .withColumn("rstart", F.expr("start - diag")).withColumn("rend", F.expr("end - diag")))
    isles = written(_verified(isles, regions, similarity))
    # where a run fails as a whole, all windows of its keys meet again, passage by passage: also those
    # that verified and all of the first document, as a failing window may be near one of these
    own = ["key", "doc", "region", "anchor", "first", "stop"]
    judged = edges.join(isles.select(*side, "isle", "ok"), [*side, "isle"], "left")
    missed = written(judged.where("not ok").select("key", "rep").distinct())
    again = (judged.select(*own, F.expr("coalesce(ok, false)").alias("linked"))
             .join(missed.select("key"), "key", "left_semi")
             .unionByName(missed.select("key", *[f"rep.{c}" for c in own[1:]], F.lit(True).alias("linked"))))
    rest = _among_themselves(written(again), regions, width, similarity)
    cols = ["doc", "start", "end", "rdoc", "rstart", "rend", "similarity"]
    k = shingle_words - 1
    return isles.where("ok").select(*cols).unionByName(rest.select(*cols)).select(
        "doc", F.col("start").alias("start_word"), (F.col("end") + k).alias("end_word"), F.col("rdoc").alias("rep_doc"),
        F.col("rstart").alias("rep_start_word"), (F.col("rend") + k).alias("rep_end_word"), "similarity")
