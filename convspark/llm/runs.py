"""Periodic runs of words by longest common extensions in suffix trees.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no
neighbouring word extends.  Runs of at least ``min_length`` words and ``min_exponent`` periods are found.

Per document: Ukkonen trees of the words and of their reversal; the Euler tour of each tree, folded to one
entry between neighbouring leaves (the shallowest node the tour passes there), under a sparse table, answers a
longest common extension in constant time.  Every run has a Lyndon root in one of the two word orders: the
longest Lyndon word at each position reaches to the next smaller suffix, so each position gives one candidate
period an order, and each candidate is extended both ways by one query to each tree.

The trees span the stretches that may hold a run.  With K = length - period at the least allowed sizes, every
word of a run lies in a K-gram that occurs again one period away (the run holds min_exponent >= 2 periods), so
words outside all repeated K-grams belong to no run, and a run with its neighbours that could extend it lies
within one stretch.  Repeated K-grams are found by hash, where a collision only lengthens a stretch.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructType

from .common import text_or_empty

MIN_LENGTH, MIN_EXPONENT = 24, 3


def suffix_tree(text: list[int]) -> tuple[list[int], list[int], dict[int, int], list[int], int]:
    """Ukkonen's tree of ``text`` (its last symbol occurs once): edge starts and stops per node, child by
    ``node * width + symbol``, leaves in the order of their suffixes, and ``width``."""
    n, width = len(text), max(text) + 1
    start, stop, link, child, leaves = [0], [0], [0], {}, []
    node = length = at = pending = 0
    for i, c in enumerate(text):
        pending += 1
        last = -1
        while pending:
            if length == 0:
                at = i
            key = node * width + text[at]
            v = child.get(key)
            if v is None:
                child[key] = len(start)
                leaves.append(len(start))
                start.append(i), stop.append(n), link.append(0)
                if last >= 0:
                    link[last] = node
                last = -1
            else:
                s, e = start[v], stop[v]
                span = (e if e <= i else i + 1) - s
                if length >= span:
                    at, length, node = at + span, length - span, v
                    continue
                if text[s + length] == c:
                    length += 1
                    if last >= 0:
                        link[last] = node
                    break
                m = len(start)
                child[key] = m
                start.append(s), stop.append(s + length), link.append(0)
                child[m * width + c] = m + 1
                leaves.append(m + 1)
                start.append(i), stop.append(n), link.append(0)
                start[v] = s + length
                child[m * width + text[s + length]] = v
                if last >= 0:
                    link[last] = m
                last = m
            pending -= 1
            if node == 0:
                if length:
                    length -= 1
                    at = i - pending + 1
            else:
                node = link[node]
    return start, stop, child, leaves, width


class Extensions:
    """Longest common extensions of the suffixes of ``text``, whose last symbol occurs once."""

    def __init__(self, text: list[int]):
        self.n = n = len(text)
        start, stop, child, leaves, self.width = suffix_tree(text)
        nodes = len(start)
        self.span = (np.array(stop) - np.array(start)).tolist()
        self.suffix = np.full(nodes, -1, np.int64)
        self.suffix[leaves] = np.arange(n)
        self.suffix = self.suffix.tolist()
        self.keys = np.fromiter(child.keys(), np.int64, len(child))
        self.kids = np.fromiter(child.values(), np.int64, len(child))
        order, low = self.tour(self.keys)
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.table = [np.array(low, np.int32)]  # entry k: the shallowest node between leaves k - 1 and k
        while 2 << len(self.table) - 1 <= n:
            t, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(t[:-half], t[half:]))

    def tour(self, keys: np.ndarray) -> tuple[list[int], list[int]]:
        """Suffixes in the order of the tour, and the least string depth passed before each of them."""
        at = np.argsort(keys)
        parent = keys[at] // self.width
        first = np.searchsorted(parent, np.arange(len(self.span) + 1)).tolist()
        kids = self.kids[at].tolist()
        span, suffix = self.span, self.suffix
        depth, above = [0] * len(span), [0] * len(span)
        order, low, here, stack = [], [], 0, [0]
        leaf_before = False
        while stack:
            v = stack.pop()
            if leaf_before:  # the tour comes back to the parent of v
                here, leaf_before = above[v], False
            s = suffix[v]
            if s >= 0:
                order.append(s)
                low.append(here)
                leaf_before = True
                continue
            d = depth[v]
            for w in reversed(kids[first[v]:first[v + 1]]):
                above[w] = d
                depth[w] = d + span[w]
                stack.append(w)
        return order, low

    def rank_last(self, symbol: int) -> np.ndarray:
        """Ranks of the suffixes where ``symbol`` is the largest of all."""
        move = self.keys % self.width == symbol
        # one more symbol than the tree has: widen the keys
        wide = self.keys // self.width * (self.width + 1) + np.where(move, self.width, self.keys % self.width)
        self.width += 1
        order, _ = self.tour(wide)
        self.width -= 1
        rank = np.empty(self.n, np.int64)
        rank[order] = np.arange(self.n)
        return rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and ``j``, all ``i != j``."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1  # entries a..b-1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            x = np.nonzero(level == k)[0]
            t = self.table[k]
            out[x] = np.minimum(t[a[x]], t[b[x] - (1 << int(k))])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For each position the next one with a smaller rank, or the length."""
    n = len(rank)
    out, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return out


def runs_of(symbols: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a sequence of positive integers, in order."""
    n = len(symbols)
    if n < max(2, min_length):
        return []
    right = Extensions([*symbols, 0])
    left = Extensions([*symbols[::-1], 0])
    found = []
    # a suffix that is a prefix of another is the smaller one in both orders
    for rank in (right.rank, -right.rank_last(0)):
        i = np.arange(n)
        j = np.array(next_smaller(rank[:n].tolist()), np.int64)
        i, j = i[j < n], j[j < n]
        if len(i) == 0:
            continue
        q = j - i
        ahead = right.common(i, j)
        back = np.zeros(len(i), np.int64)
        inner = i > 0
        back[inner] = left.common(n - i[inner], n - j[inner])  # words before i and before j
        start, length = i - back, back + q + ahead
        ok = (length >= min_length) & (length >= min_exponent * q)
        found.append(np.stack([start[ok], q[ok], length[ok]], axis=1))
    if not found:
        return []
    return [(s, k, q) for s, q, k in np.unique(np.concatenate(found), axis=0).tolist()]


def stretches(hashes: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """True at the words that lie in a k-gram which occurs twice in its document (or seems to, by hash)."""
    n = len(hashes)
    mark = np.zeros(n, bool)
    if n < k:
        return mark
    with np.errstate(over="ignore"):
        g, size, mix = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1, np.uint64(0xD1B54A32D192ED03)
        while size < k:
            step = min(size, k - size)
            g = (g[:len(g) - step] * mix) ^ (g[step:] + (g[:len(g) - step] >> np.uint64(29)))
            size += step
        g = g ^ (doc[:len(g)].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    inside = np.nonzero(doc[:len(g)] == doc[k - 1:])[0]
    v = g[inside]
    s = np.sort(v)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice) == 0:
        return mark
    twice = np.unique(twice)
    at = np.searchsorted(twice, v)
    hit = inside[(at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == v)]
    cover = np.zeros(n + 1, np.int64)
    cover[hit] += 1
    np.add.at(cover, hit + k, -1)
    return np.cumsum(cover[:n]) > 0


def document_runs(words: list, mark: np.ndarray, min_length: int = MIN_LENGTH,
                  min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """Runs of one document, whose words may hold runs where ``mark`` is true."""
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    parts = [(a, b) for a, b in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist())
             if b - a >= min_length]
    if not parts:
        return []
    number: dict = {}
    ids, origin, bars = [], [], []
    for a, b in parts:
        ids += [number.setdefault(w, len(number)) for w in words[a:b]]
        origin += range(a, b)
        bars.append(len(ids))
        ids.append(-len(bars))  # parts are divided by symbols that occur once
        origin.append(b)
    ids.pop(), bars.pop()
    shift = len(parts)
    return [(origin[s], n, q) for s, n, q in runs_of([x + shift for x in ids], min_length, min_exponent)]


def keep_first_period(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    return [w for w, d in zip(words, np.cumsum(change[:-1]).tolist()) if d == 0]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``(id_col, n_words, runs, collapsed)`` per row: ``runs`` as an array of ``(start, length, period)`` in
    words, by start and then period; ``collapsed`` is the text without the words that any run contains after
    its first period, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``, exact as written.  Null and empty texts have no word, no run and an
    empty ``collapsed``; repeated rows and null ids each give a row; other columns are not carried.  One text
    is one piece of work, of linear size: some 400 bytes of working memory per word of its repeated
    stretches, 100 per word of the others.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    one = StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = StructType(list(docs.select(id_col).schema.fields)).add("n_words", "long").add(
        "runs", ArrayType(one)).add("collapsed", "string")
    # length - period is at least this, whatever the period
    k = min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))
    pair = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def piece(ids: pa.Array, words: list[list[bytes]]):
        sizes = np.array([len(w) for w in words], np.int64)
        hashes = np.fromiter(map(hash, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        mark = stretches(hashes, np.repeat(np.arange(len(words)), sizes), k)
        runs, kept = [], []
        for w, m in zip(words, np.split(mark, np.cumsum(sizes)[:-1])):
            r = document_runs(w, m, min_length, min_exponent) if m.any() else []
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in r])
            kept.append(b" ".join(keep_first_period(w, r)).decode("utf-8", "surrogatepass"))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes), pa.array(runs, pa.list_(pair)), pa.array(kept, pa.string())], names=schema.names)

    def run(batches):
        for b in batches:
            at, words, n = 0, [], 0
            for i in range(b.num_rows):  # pieces of bounded size, or one long text
                t = b.column(1)[i].as_py()
                words.append(t.encode("utf-8", "surrogatepass").split())  # bytes split on exactly these six characters
                n += len(words[-1])
                if n >= 200_000 or i == b.num_rows - 1:
                    yield piece(b.column(0).slice(at, len(words)), words)
                    at, words, n = i + 1, [], 0

    return docs.select(id_col, text_or_empty(text_col).alias("__t")).mapInArrow(run, schema)
