"""Scores texts by context-tree weighting over bytes, trained on the whole corpus.

Each byte is eight binary decisions, a path in a tree of bit prefixes, made in the context of the bytes before
it.  A node (context of d bytes, bit prefix) estimates its next bit by Krichevsky-Trofimov, (ones + 1/2) / (all +
1), and the weighted probability of all training bits at a context of less than the full depth is

    P_w = 1/2 P_KT + 1/2 (product of P_w over the contexts one byte longer).

A prediction mixes the estimates of all depths along the context: at each depth the node's own estimate has the
weight P_KT / (P_KT + product), the longer contexts share the rest.  The trained counts stay as they are while
texts are scored.  A text is preceded by ``depth`` bytes 0xFF and followed by one, which is predicted too: no
UTF-8 text holds that byte, so probabilities of all texts sum to at most one.

How it runs.  Texts are dealt by hash into blocks of about 16 MB.  A block gives its distinct windows (context and
next byte, one integer with the nearest byte first) with training counts, cut into buckets by the two nearest
bytes; one row holds a block's share of a bucket, as packed arrays.  A bucket merges the shares of all blocks and
holds whole subtrees of depth two, at most 256^(depth - 1) windows each; the nodes above, 257 contexts of 255 bit
prefixes, are one small table.  Each bucket then answers each block's share with log probabilities, and blocks
score their texts from the answers.  Words' counts for the unigram base go the same way.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import text_or_empty, written

DEPTH = 4
BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 2 << 20
#: Shares of a bucket that one task merges or answers.
SHARES = 512
EDGE = b"\xff"
GRAMS, WORDS = 0, 1

_SMALL = 1 << 16
_n = np.arange(1, _SMALL)
_HALF = np.concatenate([[0.5 * math.log(math.pi)], 0.5 * math.log(math.pi) + np.cumsum(np.log(_n - 0.5))])
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(_n))])


def _lgamma(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """ln gamma(n + shift) of whole n: a table, then Stirling's series."""
    out = table[np.minimum(n, _SMALL - 1).astype(np.int64)]
    big = n >= _SMALL
    if big.any():
        x = n[big] + shift
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of ``n0`` zeros and ``n1`` ones in any order."""
    return _lgamma(n0, _HALF, 0.5) + _lgamma(n1, _HALF, 0.5) - _lgamma(n0 + n1, _WHOLE, 1.0) - math.log(math.pi)


def _share(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -700, 700)))


def windows(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts in turn: their windows as integers, and how many each has (bytes and one end)."""
    b = np.frombuffer(b"".join([EDGE * depth + t + EDGE for t in texts]), np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    n = len(b) - depth
    key = np.zeros(max(n, 0), np.int64)
    for k in range(1, depth + 1):
        key = key << 8 | b[depth - k:len(b) - k]
    key = key << 8 | b[depth:]
    # windows that would predict a leading edge fall out: the first depth of each text but the first
    keep = np.ones(len(key), bool)
    starts = np.cumsum(sizes + depth)[:-1] - depth
    for k in range(depth):
        keep[starts + k] = False
    return key[keep], sizes


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0] if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def pack(values: np.ndarray) -> bytes:
    """Rising whole numbers as differences, byte plane after byte plane (equal planes compress well)."""
    return np.diff(values, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def pack_counts(values: np.ndarray) -> bytes:
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _levels(keys: np.ndarray, counts: np.ndarray, bit: int, depth: int):
    """The nodes that choose bit ``bit`` of a byte, from contexts of ``depth`` bytes up to two: ``(ids, zeros,
    ones, log odds of the own estimate, index of each longer node)`` and ln P_w of the last."""
    byte = keys & 255
    ids = (keys >> 8 << 8) | 1 << bit | byte >> 8 - bit
    one = (byte >> 7 - bit & 1) * counts
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    back = np.cumsum(first) - 1
    ids = ids[first]
    n1 = np.bincount(back, one, len(ids))
    n0 = np.bincount(back, counts, len(ids)) - n1
    log_w = log_kt(n0, n1)
    levels = [(ids, n0, n1, None, back)]
    for _ in range(depth - 2):
        ids, back = np.unique((ids >> 16 << 8) | ids & 255, return_inverse=True)
        n0, n1, longer = (np.bincount(back, x, len(ids)) for x in (n0, n1, log_w))
        own = log_kt(n0, n1)
        log_w = np.logaddexp(own, longer) - math.log(2)
        levels.append((ids, n0, n1, own - longer, back))
    return levels, log_w


def summary(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """What a bucket adds to the nodes of one byte of context: ``(id, zeros, ones, sum of ln P_w)``."""
    parts = []
    for bit in range(8):
        levels, log_w = _levels(keys, counts, bit, depth)
        ids, n0, n1, _, _ = levels[-1]
        up, back = np.unique((ids >> 16 << 8) | ids & 255, return_inverse=True)
        parts.append((up, *(np.bincount(back, x, len(up)) for x in (n0, n1, log_w))))
    return tuple(np.concatenate(x) for x in zip(*parts))


def top_of(ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the summed contributions to the nodes of one byte of context: for each such node the part of its
    prediction that contexts of no and one byte make, and the weight left for longer ones."""
    z, o, s = np.zeros(1 << 16), np.zeros(1 << 16), np.zeros(1 << 16)
    z[ids], o[ids], s[ids] = n0, n1, longer
    own = log_kt(z, o)
    w1 = _share(own - s)
    log_w = np.logaddexp(own, s) - math.log(2)
    z0, o0, s0 = (x.reshape(256, 256).sum(0) for x in (z, o, log_w))
    w0 = _share(log_kt(z0, o0) - s0)
    known, rest = np.tile(w0 * (o0 + 0.5) / (z0 + o0 + 1), 256), np.tile(1 - w0, 256)
    return known + rest * w1 * (o + 0.5) / (z + o + 1), rest * (1 - w1)


def log_probabilities(keys: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, np.ndarray],
                      depth: int = DEPTH) -> np.ndarray:
    """log10 of the probability of each window's byte after its context; ``keys`` holds whole buckets."""
    out = np.zeros(len(keys))
    for bit in range(8):
        levels, _ = _levels(keys, counts, bit, depth)
        ids = levels[-1][0]
        above = (ids >> 16 << 8) | ids & 255
        known, rest = top[0][above], top[1][above]
        for at in range(len(levels) - 1, -1, -1):
            _, n0, n1, odds, back = levels[at]
            w = 1.0 if odds is None else _share(odds)
            known = (known + rest * w * (n1 + 0.5) / (n0 + n1 + 1))[back]
            rest = (rest * (1 - w))[back]
        p = np.where(keys >> 7 - bit & 1, known, 1 - known)
        out += np.log10(np.maximum(p, 1e-300))
    return out


class Table:
    """Values by key in an open hash table, asked for whole arrays; every asked key is held."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self.spot(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            on = self.slots[at] != todo
            todo, at = todo[on], at[on] + 1 & (1 << self.bits) - 1

    def spot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.spot(keys)
        found = self.slots[at]
        miss = np.nonzero(self.keys[found] != keys)[0]
        while len(miss):
            at[miss] = at[miss] + 1 & (1 << self.bits) - 1
            found[miss] = self.slots[at[miss]]
            miss = miss[self.keys[found[miss]] != keys[miss]]
        return self.values[found]


def _bucket(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    near = keys >> 8 * (depth - 1)
    return (near * 40503 & 0xFFFF) % buckets


def _shares(depth: int, buckets: int):
    """Rows ``(block, train, text)`` in order of blocks -> ``(block, kind, bucket, keys, counts)``."""
    names = ["block", "kind", "bucket", "keys", "counts"]

    def finish(block, keys, counts, words):
        rows = []
        k, c = merge(keys, counts)
        bucket = _bucket(k, depth, buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for j in range(buckets):
            x = order[cuts[j]:cuts[j + 1]]
            if len(x):
                rows.append((block, GRAMS, j, pack(k[x]), pack_counts(c[x])))
        by: dict[int, list] = {}
        for w in words:
            by.setdefault(zlib.crc32(w) % buckets, []).append(w)
        for j, ws in by.items():
            rows.append((block, WORDS, j, b" ".join(ws), pack_counts(np.array([words[w] for w in ws], np.int64))))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (
            pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=names)

    def run(batches):
        now, keys, counts, words, held = None, [], [], Counter(), {True: [], False: []}

        def count():
            for train, texts in held.items():
                if texts:
                    k, c = np.unique(windows(texts, depth)[0], return_counts=True)
                    keys.append(k)
                    counts.append(c if train else np.zeros(len(k), np.int64))
                    texts.clear()

        size = 0
        for b in batches:
            for block, train, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if block != now:
                    if now is not None:
                        count()
                        yield finish(now, keys, counts, words)
                    now, keys, counts, words, size = block, [], [], Counter(), 0
                t = text.as_py().encode("utf-8", "surrogatepass")
                tokens = t.lower().split()  # bytes: A-Z only, and exactly the six white-space characters
                words.update(tokens if train else dict.fromkeys(tokens, 0))
                held[train].append(t)
                size += len(t)
                if size >= CHUNK_BYTES:
                    count()
                    size = 0
                    if len(keys) >= 8:
                        k, c = merge(keys, counts)
                        keys, counts = [k], [c]
        if now is not None:
            count()
            yield finish(now, keys, counts, words)

    return run


def _merged(depth: int, last: bool):
    """The shares of one bucket as one; ``last``: with what the bucket adds to the nodes above."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = int(pdf["kind"].iloc[0]), int(pdf["bucket"].iloc[0])
        top = [b""] * 4
        distinct = total = 0
        if kind == GRAMS:
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for at in range(0, len(pdf), 16):
                part = pdf.iloc[at:at + 16]
                keys, counts = merge([keys, *map(unpack, part["keys"])], [counts, *map(unpack_counts, part["counts"])])
            if last:
                top = [x.tobytes() for x in summary(keys, counts, depth)]
            raw = pack(keys)
        else:
            words: dict[bytes, int] = {}
            for ks, cs in zip(pdf["keys"], pdf["counts"]):
                for w, c in zip(bytes(ks).split(b" "), unpack_counts(cs).tolist()):
                    words[w] = words.get(w, 0) + c
            counts = np.fromiter(words.values(), np.int64, len(words))
            distinct, total = int((counts > 0).sum()), int(counts.sum())
            raw = b" ".join(words)
        return pd.DataFrame({"kind": [kind], "bucket": [bucket], "keys": [raw], "counts": [pack_counts(counts)],
                             "distinct": [distinct], "total": [total], "top": [top]})

    return run


def _answers(depth: int, top):
    """A bucket's shares and the merged bucket -> ``(block, kind, keys, counts)`` with values for counts."""

    def run(shares: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
        kind = int(whole["kind"].iloc[0])
        out = []
        if kind == GRAMS:
            keys = unpack(whole["keys"].iloc[0])
            values = log_probabilities(keys, unpack_counts(whole["counts"].iloc[0]), top.value, depth).astype("<f4")
            for ks in shares["keys"]:
                out.append(values[np.searchsorted(keys, unpack(ks))].tobytes())
        else:
            counts = dict(zip(bytes(whole["keys"].iloc[0]).split(b" "), unpack_counts(whole["counts"].iloc[0]).tolist()))
            for ks in shares["keys"]:
                out.append(pack_counts(np.array([counts[w] for w in bytes(ks).split(b" ")], np.int64)))
        return pd.DataFrame({"block": shares["block"], "kind": kind, "keys": shares["keys"], "counts": out})

    return run


def _scores(depth: int, n_train: int, v_train: int, end_count: int, schema: StructType):
    """Rows ``(id, block, kind, keys, counts, train, text)``, a block's answers before its texts -> scores."""
    under = n_train + 0.1 * (v_train + 1)
    unknown = math.log10(0.1 / under)
    end = math.log10((end_count + 0.1) / under)

    def run(batches):
        now, keys, values, words, table = None, [], [], {}, None
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4)))
            texts, at = [], []

            def flush():
                nonlocal table, keys, values
                if table is None:
                    k, v = np.concatenate(keys), np.concatenate(values)
                    table, keys, values = Table(k, v), [], []
                w, sizes = windows([t for t, _ in texts], depth)
                score = np.add.reduceat(table.get(w).astype(np.float64), np.cumsum(sizes) - sizes)
                cols = [[], [], [], []]
                for t, _ in texts:
                    logs = [words[x] for x in t.lower().split()]
                    for c, v in zip(cols, (len(logs) + 1, len(logs) - logs.count(unknown) + (end_count > 0),
                                           sum(logs) + end, len(t))):
                        c.append(v)
                got = pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array([x for _, x in texts], pa.bool_()),
                     pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                     pa.array([n_train] * len(at), pa.int64()), pa.array(cols[2], pa.float64()), pa.array(score),
                     pa.array(cols[3], pa.int64()), pa.array(-score * math.log2(10) / np.maximum([*map(len, [t for t, _ in texts])], 1))],
                    names=schema.names)
                texts.clear(), at.clear()
                return got

            size = 0
            for i, (block, kind, ks, cs) in enumerate(rows):
                if block != now:
                    if texts:
                        yield flush()
                        size = 0
                    now, keys, values, words, table = block, [], [], {}, None
                if kind == GRAMS:
                    keys.append(unpack(ks))
                    values.append(np.frombuffer(cs, "<f4"))
                elif kind == WORDS:
                    n = unpack_counts(cs)
                    words.update(zip(bytes(ks).split(b" "), np.where(n == 0, unknown, np.log10((n + 0.1) / under)).tolist()))
                else:
                    texts.append((b.column(6)[i].as_py().encode("utf-8", "surrogatepass"), b.column(5)[i].as_py()))
                    at.append(i)
                    size += len(texts[-1][0])
                    if size >= CHUNK_BYTES:
                        yield flush()
                        size = 0
            if texts:
                yield flush()

    return run


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id_col, trained, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)`` per row.

    Trained on the rows where ``train`` is true (null: false).  ``score`` is log10 of the model's probability of
    the whole text and its end; the windows' logs are kept in 32 bits, so it is exact to some seven digits.
    ``bits_per_byte`` is its code length over the text's bytes (over one for an empty text).  ``base_score`` is the unigram score
    of the lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` and one end, add-0.1 smoothed over V + 1 words.

    Null texts are empty.  Repeated rows and null ids each count and give a row; other columns are not carried.
    Without a training row every bit has probability 1/2 and the base score is 0.  Spark has one pass for the
    sizes, one that counts and one that scores; both of these shuffle the texts.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth is between 2 and 6 bytes")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(train, F.lit(False)).alias("train"), text_or_empty(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1).alias("bytes"), F.sum(F.col("train").cast("long")).alias("ends")).first()
    blocks = max(1, -(-(size["bytes"] or 0) // block_bytes))
    buckets = min(1 << 16, max(16, blocks))
    salts = max(1, -(-blocks // SHARES))
    rows = rows.select("__id", F.pmod(F.xxhash64("__id", "text"), F.lit(blocks)).alias("block"), "train", "text")

    dealt = rows.select("block", "train", "text").repartition(blocks, "block").sortWithinPartitions("block")
    shares = written(dealt.mapInArrow(_shares(depth, buckets), "block long, kind int, bucket int, keys binary, counts binary"))
    shares = shares.withColumn("salt", F.pmod("block", F.lit(salts)).cast("int"))
    whole_schema = "kind int, bucket int, keys binary, counts binary, distinct long, total long, top array<binary>"
    whole = shares
    if salts > 1:
        whole = whole.groupBy("kind", "bucket", "salt").applyInPandas(_merged(depth, False), whole_schema)
    whole = written(whole.groupBy("kind", "bucket").applyInPandas(_merged(depth, True), whole_schema))

    counted = whole.where(F.col("kind") == WORDS).agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    ends = int(size["ends"] or 0)
    n_train, v_train = int(counted["n"] or 0) + ends, int(counted["v"] or 0) + (ends > 0)

    def contributions(batches):
        for b in batches:
            for blobs in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(blobs[0], np.int64)), *(pa.array(np.frombuffer(x, np.float64)) for x in blobs[1:])],
                    names=["id", "n0", "n1", "longer"])

    # at most 256 contexts x 255 bit prefixes
    above = (whole.where(F.col("kind") == GRAMS).select("top")
             .mapInArrow(contributions, "id long, n0 double, n1 double, longer double")
             .groupBy("id").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("longer").alias("longer")).toPandas())
    top = spark.sparkContext.broadcast(top_of(above["id"].to_numpy(np.int64), *(above[c].to_numpy(np.float64) for c in ("n0", "n1", "longer"))))

    copies = whole.select("kind", "bucket", "keys", "counts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    by = ["kind", "bucket", "salt"]
    answers = shares.select(*by, "block", "keys").groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(
        _answers(depth, top), "block long, kind int, keys binary, counts binary")

    id_type = rows.schema["__id"].dataType
    empty = F.lit(None)
    both = (answers.select(empty.cast(id_type).alias("__id"), "block", "kind", "keys", "counts",
                           empty.cast("boolean").alias("train"), empty.cast("string").alias("text"))
            .unionByName(rows.withColumns({"kind": F.lit(WORDS + 1), "keys": empty.cast("binary"), "counts": empty.cast("binary")})))
    schema = StructType(list(docs.select(id_col).schema.fields)).add("trained", "boolean")
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"),
                       ("score", "double"), ("n_bytes", "long"), ("bits_per_byte", "double")):
        schema = schema.add(name, kind)
    return (both.select("__id", "block", "kind", "keys", "counts", "train", "text").repartition(blocks, "block")
            .sortWithinPartitions("block", "kind").mapInArrow(_scores(depth, n_train, v_train, ends, schema), schema))
