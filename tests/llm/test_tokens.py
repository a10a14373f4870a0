import random
import zlib

import pytest
from tokenizers import Tokenizer

from convspark.llm.bpe import Encoder, encode_texts, token_digests
from convspark.llm.packing import decompose, pack
from convspark.llm.queries import tokenizer_path
from convspark.sources.tables import table

from ..conftest import SF_SMALL
from .helpers import doc, docs_of

POOL = ["'s", "’s", "É", "İ", "Σ", "ς", "ß", "中", "文", "²", "½", "Ⅷ", "٣", "é", "́", "_", "__", " ", "\x1c", "\x1f", "\x85", " ",
        "​", "　", "<|endoftext|>", "<|startoftext|>", "<|", "🙂", "A" * 120, "ab" * 70, "!" * 200, "'", "'re", "ﬁ", "Å", "한글",
        "ᄒ", "\n\t", "ǅ", "ª", "º", "µ", "\x00", "﻿", "words", "and"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(4)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 12))) for _ in range(500)] + ["", "x" * 50_000, "ab " * 40_000]


def test_encoder_is_the_library(library):
    enc = Encoder(tokenizer_path())
    for _ in range(2):  # with a cold and a warm cache
        for t in texts():
            ids = library.encode(t, add_special_tokens=False).ids
            assert enc.encode(t) == ids
            assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words_merge_alike():
    enc = Encoder(tokenizer_path())
    rng = random.Random(1)
    for _ in range(50):
        w = "".join(rng.choice("thearndio") for _ in range(97 + rng.randrange(60)))
        raw = w.encode()
        ids = [enc.base[b] for b in raw[:-1]] + [enc.last[raw[-1]]]
        import convspark.llm.bpe as bpe
        old, bpe.SHORT = bpe.SHORT, 1 << 20
        try:
            short = enc.merge(w)
        finally:
            bpe.SHORT = old
        assert enc._merge_long(ids) == short == enc.merge(w)


def test_encode_texts(spark, library):
    rows = [doc(i, t) for i, t in enumerate(texts()[:60])] + [doc(None, "null id"), doc(7, None), doc(7, None)]
    got = encode_texts(docs_of(spark, rows), tokenizer_path()).collect()
    assert len(got) == len(rows)
    for r, d in zip(got, rows):
        ids = library.encode(d[1] or "", add_special_tokens=False).ids
        assert (r["doc_id"], r["n_tokens"], list(r["ids"])) == (d[0], len(ids), ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert encode_texts(docs_of(spark, []), tokenizer_path()).collect() == []
    assert token_digests(docs_of(spark, []), tokenizer_path()).collect() == []


def test_decompose():
    for n in range(1, 3000):
        parts = decompose(n, 256)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 256 for p in parts) and parts == sorted(parts, reverse=True)
    with pytest.raises(ValueError):
        pack(None, "x", longest=100)


def test_pack_covers_every_id_once(spark, library):
    rows = [(r["doc_id"], r["text"], "en", "s", 0) for r in table(spark, SF_SMALL, "documents").collect()]
    rows += [doc(10**9, None), doc(10**9, None), doc(None, "null id"), doc(5_000_000, "ab " * 9000)]
    got = pack(docs_of(spark, rows), tokenizer_path()).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 for r in got)
    by = {}
    for r in got:
        assert r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0 and len(r["ids"]) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        copies = sum(x[0] == i for x in rows)
        pieces = sorted(by[i], key=lambda r: r["start"])
        if copies == 1:
            assert [x for p in pieces for x in p["ids"]] == ids
        assert sum(p["length"] for p in pieces) == copies * len(ids) and {p["doc_tokens"] for p in pieces} == {len(ids)}
    assert pack(docs_of(spark, []), tokenizer_path()).collect() == []
