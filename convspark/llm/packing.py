"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of the longest as
fit, then the binary digits of the rest, from long to short.  Pieces of equal length form a bucket;
each piece is a sequence of its own, so no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .bpe import Encoder, _byte_chars
from .common import text_or_empty


class _Library(Encoder):
    """The word splitting and caches of ``Encoder``; the ids of an unseen word are the library's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__(path)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chars = dict(enumerate(_byte_chars()))

    def merge(self, word: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(word.encode().decode("latin-1").translate(self.chars))]

    def entry(self, ids: list[int]) -> tuple:
        return (array("I", ids).tobytes(),)


@lru_cache(maxsize=4)
def _library(path: str) -> _Library:
    """One per Python worker."""
    return _Library(path)


def decompose(n: int, longest: int) -> list[int]:
    """Piece lengths of ``n`` ids: ``longest`` as often as it fits, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and
    ``ids``, array<int>, unless ``with_ids`` is false).  ``length`` is also the piece's bucket.

    ``longest`` is a power of two.  Null and empty texts are one piece, the end id alone.
    Repeated rows are packed each on their own; other columns are not carried.  ``sequence_id`` is
    unique over the result and not dense: a partition number and a running number.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = docs.select(F.col(id_col)).schema
    for name, kind in (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"),
                       *([("ids", ArrayType(IntegerType()))] if with_ids else [])):
        schema = schema.add(name, kind)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        lib = _library(tokenizer)
        for b in batches:
            for lo in range(0, b.num_rows, 512):  # bounded working memory
                part = b.slice(lo, 512)
                docs_of, cols, ids = [], [[], [], [], []], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    raw = b"".join([e[0] for e in lib.entries(text)]) + end
                    n, at = len(raw) // 4, 0
                    for size in decompose(n, longest):
                        piece = raw[4 * at:4 * (at + size)]
                        docs_of.append(k)
                        for c, v in zip(cols, (at, size, zlib.crc32(piece), n)):
                            c.append(v)
                        if with_ids:
                            ids.append(memoryview(piece).cast("I").tolist())
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(docs_of, pa.int64())), *[pa.array(c, pa.int64()) for c in cols],
                     *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=schema.names)

    pieces = docs.select(id_col, text_or_empty(text_col).alias("__t")).mapInArrow(run, schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
