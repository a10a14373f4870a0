"""Spelling variants: words one edit apart, found by search schemes over an FM-index of the vocabulary.

The vocabulary is indexed as text with a delimiter after every word, once as written and once with every word
reversed: the two directions of a bidirectional FM-index.  One edit leaves either the right or the left half of
a word whole, so two search schemes find every neighbour: match one half exactly, starting at its delimiter,
then extend across the other half allowing one insertion, deletion or replacement, and end at the other
delimiter.  A state is an interval of suffix ranks; all words of a block advance together.

A neighbour shares the first (or last) characters of the half that is whole.  The vocabulary is dealt by them
to index shards; a key with more words than a shard becomes a grid of cells, a shard of its words against a
block of its words, so no task holds more than a shard and a block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, text_or_empty, written

SHARD = 65_536
FLUSH = 200_000
BLOCK = 4096
STEP = 16

# letters of A-Za-z and U+00C0 to U+00FF, A-Z in lower case; all other characters part words
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def letter_runs(text: str) -> list[str]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_LETTERS).decode("latin-1").split(" ")


def count_words(docs: DataFrame, min_chars: int = 5, min_count: int = 3, edit: Callable | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: the letter runs of all texts with at least ``min_chars`` code points and ``min_count``
    occurrences.  ``edit(id)`` may return a function that changes each run of that row.  Null texts have no
    run; repeated rows count each.  Counts are summed in the task first, in tables of bounded size."""

    def run(batches):
        total: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([*total.values()], pa.int64())],
                                              names=["word", "n"])

        for b in batches:
            for i, text in zip(b.column(0), b.column(1)):
                words = Counter(letter_runs(text.as_py()))
                change = edit(i.as_py()) if edit else None
                for w, n in words.items():
                    if change is not None and w:
                        w = change(w)
                    if len(w) >= min_chars:
                        total[w] += n
                if len(total) >= FLUSH:
                    yield out()
                    total.clear()
        yield out()

    parts = docs.select(id_col, text_or_empty(text_col).alias("__t")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class FMIndex:
    """Backward search over distinct words, each followed by a delimiter (code 0)."""

    def __init__(self, words: list[str]):
        points = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet, text = np.unique(points, return_inverse=True)
        self.sigma = len(self.alphabet)
        self.words, self.n = len(words), len(text)
        ends = np.nonzero(text == 0)[0]
        word_of = np.searchsorted(ends, np.arange(self.n))
        # delimiters differ, in the order of the words, so no two suffixes are equal
        rank = np.where(text == 0, word_of, self.words + text).astype(np.int64)
        step = 1
        while True:
            after = np.zeros(self.n, np.int64)
            after[:-step] = rank[step:]
            values, rank = np.unique(rank * (max(self.n, self.words + self.sigma) + 1) + after, return_inverse=True)
            if len(values) == self.n:
                break
            step *= 2
        suffixes = np.argsort(rank)
        before = text[suffixes - 1]  # the first word's start meets the last delimiter
        kind = np.uint8 if self.sigma < 256 else np.uint32
        rows = -(-self.n // STEP) + 1
        padded = np.full(rows * STEP, 0, kind)
        padded[:self.n] = before
        self.rows = padded.reshape(rows, STEP)
        counts = np.bincount(np.arange(self.n) // STEP * self.sigma + before, minlength=rows * self.sigma)
        counts = counts.reshape(rows, self.sigma)
        self.seen = (np.cumsum(counts, axis=0) - counts).astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.before = before
        self.starts = np.nonzero(before == 0)[0]  # ranks of whole words
        self.start_word = word_of[suffixes[self.starts]]
        self.low = np.arange(STEP) < np.arange(STEP)[:, None]

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``code`` stands in the transform before ``i``."""
        row = i // STEP
        part = (self.rows[row] == code[:, None].astype(self.rows.dtype)) & self.low[i % STEP]
        eight = part.view(np.uint64)  # counts bytes by one multiplication
        return self.seen[row, code] + (((eight[:, 0] + eight[:, 1]) * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)

    def extend(self, lo, hi, code):
        """The intervals of ``code`` before each interval, and which of them hold a suffix."""
        ok = code >= 0
        safe = np.where(ok, code, 0)
        base = self.first[safe]
        a, b = base + self.rank(safe, lo), base + self.rank(safe, hi)
        return a, b, ok & (a < b)

    def letters(self, lo, hi):
        """All letters before each of the distinct intervals: ``(interval, code, lo, hi)`` by interval."""
        size = hi - lo
        few = np.nonzero(size <= 4 * STEP)[0]
        many = np.nonzero(size > 4 * STEP)[0]
        at = np.repeat(few, size[few])
        spot = np.arange(len(at)) - np.repeat(np.cumsum(size[few]) - size[few], size[few]) + lo[at]
        pairs = np.unique(at * self.sigma + self.before[spot])
        which = np.concatenate([pairs // self.sigma, np.repeat(many, self.sigma - 1)])
        code = np.concatenate([pairs % self.sigma, np.tile(np.arange(1, self.sigma), len(many))])
        which, code = which[code > 0], code[code > 0]
        a, b, ok = self.extend(lo[which], hi[which], code)
        order = np.argsort(which[ok], kind="stable")
        return which[ok][order], code[ok][order], a[ok][order], b[ok][order]

    def near(self, patterns: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(pattern, word)`` of all words one edit from a pattern whose last ``exact`` characters they end with
        (the edit lies before or at their border)."""
        size = np.array([len(p) for p in patterns])
        points = np.frombuffer("".join(patterns).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.minimum(np.searchsorted(self.alphabet, points), self.sigma - 1)
        code = np.where(self.alphabet[code] == points, code, -1).astype(np.int64)
        last = np.cumsum(size) - 1
        q = np.arange(len(patterns))
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), self.words, np.int64)  # all delimiters
        none = np.zeros(0, np.int64)
        wq, wlo, whi = none, none, none  # states with the edit behind them
        found_q, found_w = [], []
        for t in range(int(size.max(initial=0)) + 1):
            free = np.nonzero(exact[q] <= t)[0]
            nq, nlo, nhi = [], [], []
            if len(free):
                key, back = np.unique(lo[free] * (self.n + 1) + hi[free], return_inverse=True)
                iv, x, xlo, xhi = self.letters(key // (self.n + 1), key % (self.n + 1))
                first = np.searchsorted(iv, np.arange(len(key) + 1))
                n = (first[1:] - first[:-1])[back]
                fq = np.repeat(q[free], n)
                at = np.arange(len(fq)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[back], n)
                # the word has one letter more
                wq, wlo, whi = np.concatenate([wq, fq]), np.concatenate([wlo, xlo[at]]), np.concatenate([whi, xhi[at]])
                more = size[fq] > t
                swap = np.nonzero(more)[0][code[last[fq[more]] - t] != x[at[more]]]
                skip = free[size[q[free]] > t]
                nq, nlo, nhi = [fq[swap], q[skip]], [xlo[at[swap]], lo[skip]], [xhi[at[swap]], hi[skip]]
            done = size[wq] == t
            if done.any():
                a, b = np.searchsorted(self.starts, wlo[done]), np.searchsorted(self.starts, whi[done])
                hit = a < b  # words are distinct: at most one is whole here
                found_q.append(wq[done][hit])
                found_w.append(self.start_word[a[hit]])
            on = ~done
            wq, wlo, whi = wq[on], wlo[on], whi[on]
            wlo, whi, ok = self.extend(wlo, whi, code[last[wq] - t])
            wq, wlo, whi = (np.concatenate([v[ok], *w]) for v, w in ((wq, nq), (wlo, nlo), (whi, nhi)))
            if t % 8 == 7 and len(wq):  # equal states of a pattern meet again at repeated letters
                order = np.lexsort((whi, wlo, wq))
                wq, wlo, whi = wq[order], wlo[order], whi[order]
                new = np.concatenate([[True], (wq[1:] != wq[:-1]) | (wlo[1:] != wlo[:-1]) | (whi[1:] != whi[:-1])])
                wq, wlo, whi = wq[new], wlo[new], whi[new]
            go = size[q] > t
            q, lo, hi = q[go], lo[go], hi[go]
            lo, hi, ok = self.extend(lo, hi, code[last[q] - t])
            q, lo, hi = q[ok], lo[ok], hi[ok]
            if len(q) == 0 and len(wq) == 0:
                break
        pair = np.unique(np.concatenate([*found_q, none]) * self.words + np.concatenate([*found_w, none]))
        return pair // self.words, pair % self.words


def neighbours(words: list[str], patterns: list[str], reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(pattern, word)`` pairs one edit apart that one scheme has to report: all that end with the pattern's
    right half or, reversed, that begin with its left half and don't end with its right half."""
    index = FMIndex([w[::-1] for w in words] if reverse else words)
    ps, ws = [], []
    for at in range(0, len(patterns), BLOCK):
        part = patterns[at:at + BLOCK]
        exact = np.array([len(p) // 2 if reverse else len(p) - len(p) // 2 for p in part])
        p, w = index.near([x[::-1] for x in part] if reverse else part, exact)
        if reverse:
            new = np.array([not words[j].endswith(part[i][len(part[i]) // 2:]) for i, j in zip(p.tolist(), w.tolist())], bool)
            p, w = p[new], w[new]
        ps.append(p + at)
        ws.append(w)
    none = np.zeros(0, np.int64)
    return np.concatenate([*ps, none]), np.concatenate([*ws, none])


def near_words(vocabulary: DataFrame, min_chars: int, shard: int = SHARD) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words of ``vocabulary(word, n)`` that have a near word: how many,
    and the most frequent one (ties: the smallest in code-point order)."""
    total = vocabulary.count()
    buckets = max(1, -(-total // shard))
    width = max(1, min(2, min_chars // 2))
    parts = []
    for reverse in (False, True):
        key = F.substring("word", 1, width) if reverse else F.expr(f"right(word, {width})")
        words = vocabulary.withColumn("key", key)
        # a number of cells a side for each key: words of a key beyond a shard
        cells = words.groupBy("key").agg(F.ceil(F.count("*") / shard).cast("int").alias("side"))
        words = words.join(cells, "key").withColumn("own", F.pmod(F.xxhash64("word"), "side").cast("int"))
        words = words.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))

        def cell(i, j):
            shared = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("string")
            return F.when(F.col("side") == 1, shared).otherwise(F.concat_ws("\0", "key", i, j))

        for indexed in (True, False):
            at = cell("own", "other") if indexed else cell("other", "own")
            parts.append(words.select(F.lit(reverse).alias("reverse"), at.alias("cell"), F.lit(indexed).alias("indexed"), "word", "n"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    def search(rows: pa.Table) -> pa.Table:
        indexed = rows["indexed"].to_numpy()
        both, counts = rows["word"].to_pylist(), rows["n"].to_numpy()
        words, n = [both[i] for i in np.nonzero(indexed)[0]], counts[indexed]
        patterns = [both[i] for i in np.nonzero(~indexed)[0]]
        p, w = neighbours(words, patterns, rows["reverse"][0].as_py()) if words and patterns else (np.zeros(0, int),) * 2
        place = np.empty(len(words), np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((place[w], -n[w], p))
        p, w = p[order], w[order]
        asked, first, count = np.unique(p, return_index=True, return_counts=True)
        best = w[first]
        return pa.table([pa.array([patterns[i] for i in asked], pa.string()), pa.array(count, pa.int64()),
                         pa.array(n[best], pa.int64()), pa.array([words[i] for i in best], pa.string())],
                        names=["word", "n_near", "best_n", "best"])

    found = rows.groupBy("reverse", "cell").applyInArrow(search, "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top"))
            .select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the end of each word's chain in ``forms(word, form)``, which has no cycle.  Each
    round doubles the steps taken, so the rounds are the logarithm of the longest chain."""
    to = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = cut_lineage(to.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if to.where("moved").isEmpty():
            return to.select("word", "root")
        to = to.drop("moved")


def group_variants(vocabulary: DataFrame, min_chars: int = 5, ratio: int = 2, shard: int = SHARD) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` per row of ``vocabulary(word, n)``, whose words are distinct,
    not null and hold no character U+0000.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point.  ``form`` is the
    near word of largest n (ties: smallest in code-point order) if that n is at least ``ratio`` (over 1) times
    the word's, else null; ``root`` is the last word along the forms, the word itself without one.
    ``min_chars`` is a lower bound of the words' lengths (2 or more).
    """
    if ratio <= 1 or min_chars < 2:
        raise ValueError("forms need a ratio over 1 and words of two characters")
    vocabulary = written(vocabulary.select("word", "n"))
    near = near_words(vocabulary, min_chars, shard)
    has_form = F.col("best_n") >= ratio * F.col("n")
    rows = written(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n")))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                  "n", "n_near", "form_n")
