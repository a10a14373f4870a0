"""BPE encoding and decoding with contiguous rank arrays, and a cache of words.

``Encoder`` reads a tokenizer file (vocabulary, merges, special tokens) of the lower-casing word
BPE kind.  A short word holds its parts and the merge ranks of neighbouring parts in two lists:
the smallest rank is found by a scan, its boundary is deleted and the two neighbouring ranks are
read anew.  Words beyond ``SHORT`` bytes keep the ranks in a heap over linked parts, as a scan
per merge would be quadratic there.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import text_or_empty

SHORT = 96
CACHE_WORDS = 400_000
NONE = 1 << 30

# fixed value: the tokenizer's word pattern
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# the same for texts of common Latin characters only, on the faster engine
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
NOT_LATIN = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ɏ]")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        assert array("I").itemsize == 4 and sys.byteorder == "little"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = _byte_chars()
        self.base = [vocab.get(c, -1) for c in chars]
        self.last = [vocab.get(c + suffix, -1) for c in chars]
        self.rank, self.made = {}, []
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.rank.setdefault(vocab[a] << 20 | vocab[b], r)
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.cache: dict[str, tuple] = {}

    def merge(self, word: str) -> list[int]:
        """Token ids of one word."""
        raw = word.encode()
        ids = [self.base[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if -1 in ids:  # a byte that the vocabulary lacks
            ids = [i for i in ids if i >= 0]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get, made = self.rank.get, self.made
        ranks = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == NONE:
                break
            i = ranks.index(r)
            ids[i] = made[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, made = self.rank.get, self.made
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(get(ids[i] << 20 | ids[i + 1], NONE), i) for i in range(n - 1)]
        heap = [x for x in heap if x[0] < NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i] if ids[i] >= 0 else -1
            if j < 0 or get(ids[i] << 20 | ids[j], NONE) != r:
                continue
            ids[i], ids[j], right[i] = made[r], -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a in (left[i], i):
                b = right[a] if a >= 0 else -1
                if b >= 0 and (q := get(ids[a] << 20 | ids[b], NONE)) < NONE:
                    heapq.heappush(heap, (q, a))
        return [t for t in ids if t >= 0]

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if NOT_LATIN.search(text) is None:
            return LATIN_WORDS.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words.findall(text.lower())

    def pieces(self, text: str):
        """``(is_special, string)`` in order."""
        if self.split_special is None or "<|" not in text:
            yield False, text
            return
        for k, part in enumerate(self.split_special.split(text)):
            if part:
                yield bool(k % 2), part

    def entry(self, ids: list[int]) -> tuple:
        """``(number of ids, decimal ids, tokens, ids as little-endian bytes)``."""
        return (len(ids), " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]),
                array("I", ids).tobytes())

    def word(self, word: str) -> tuple:
        """The entry of one word, kept if the word is short."""
        e = self.cache.get(word)
        if e is None:
            e = self.entry(self.merge(word))
            if len(word) <= SHORT:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[word] = e
        return e

    def entries(self, text: str) -> list[tuple]:
        """Entries of a text in order.  No word holds white space, so a Latin text is cut there
        first: a run that is a known word needs no pattern."""
        get, word, out = self.cache.get, self.word, []
        for special, part in self.pieces(text):
            if special:
                out.append(self.entry([self.special[part]]))
            elif NOT_LATIN.search(part) is None:
                for run in part.lower().split():
                    e = get(run)
                    if e is not None:
                        out.append(e)
                    elif run.isalpha():
                        out.append(word(run))
                    else:
                        for w in LATIN_WORDS.findall(run):
                            out.append(get(w) or word(w))
            else:
                out += [get(w) or word(w) for w in self.split(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return memoryview(b"".join([e[3] for e in self.entries(text)])).cast("I").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, which is how a file without a decoder decodes."""
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder, with its cache of words, per Python worker."""
    return Encoder(path)


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids, decoded)`` per row: token ids and the text decoded from them.

    Null and empty texts give no id and an empty string; repeated rows each give a row; other
    columns are not carried.  Special tokens' strings inside a text are those tokens.
    ``tokenizer`` is the path of a tokenizer file that every worker can open.
    """
    schema = docs.select(F.col(id_col)).schema.add("n_tokens", "long").add("ids", ArrayType(IntegerType())).add("decoded", "string")

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            es = [enc.entries(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([sum([e[0] for e in x]) for x in es], pa.int64()),
                pa.array([memoryview(b"".join([e[3] for e in x])).cast("I").tolist() for x in es], pa.list_(pa.int32())),
                pa.array([" ".join([e[2] for e in x if e[0]]) for x in es], pa.string())],
                names=schema.names)

    return docs.select(id_col, text_or_empty(text_col).alias("__t")).mapInArrow(run, schema)


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_texts`` reduced inside the task to ``n_tokens, ids_sha256, decoded_sha256``."""
    schema = docs.select(F.col(id_col)).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def sha(parts) -> str:
        return hashlib.sha256(" ".join(parts).encode()).hexdigest()

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            n, ids, dec = [], [], []
            for t in b.column(1).to_pylist():
                x = enc.entries(t)
                n.append(sum([e[0] for e in x]))
                ids.append(sha([e[1] for e in x if e[0]]))
                dec.append(sha([e[2] for e in x if e[0]]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())],
                names=schema.names)

    return docs.select(id_col, text_or_empty(text_col).alias("__t")).mapInArrow(run, schema)
