import corpus_pipeline as P
from convspark.llm import langid
from convspark.llm.queries import QUERIES, tokenizer_path
from convspark.llm.secrets import BASE
from convspark.sources.tables import table
from tokenizers import Tokenizer

from ..conftest import SF_SMALL
from .test_secrets import brute as secret_spans
from .test_simhash import slow_fingerprint
from .helpers import components, doc, docs_of


def test_every_operator_has_one_query():
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 11))


def test_run_equals_brute_force(spark):
    docs = {r["doc_id"]: r for r in table(spark, SF_SMALL, "documents").collect()}
    ident = langid.fit(table(spark, SF_SMALL, "documents").where("crc32(cast(doc_id as string)) % 5 != 0"))
    kept = [i for i, p in zip(docs, ident.predict([d["text"] for d in docs.values()])) if p[3]]
    assert len(kept) >= 0.95 * len(docs)
    last = {}
    for i in sorted(kept):
        last[docs[i]["text"] or ""] = i
    kept = sorted(last.values())
    fps = [slow_fingerprint(docs[i]["text"]) for i in kept]
    root = components(len(kept), [(a, b) for a in range(len(kept)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4])
    kept = [i for n, i in enumerate(kept) if root[n] == n]
    tok = Tokenizer.from_file(tokenizer_path())
    tok.no_truncation()
    want = {}
    for i in kept:
        out, at, text = "", 0, docs[i]["text"] or ""
        for s in filter(None, secret_spans(text).split(",")):
            a, b = map(int, s.split(":")[1:])
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        want[i] = tok.encode(out + text[at:], add_special_tokens=False).ids + [1]
    got = {}
    for r in sorted(P.run(spark, SF_SMALL).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == want


def test_stages_on_empty_and_odd_tables(spark):
    odd = [doc(1, None), doc(2, ""), doc(None, "a b c"), doc(3, "the end"), doc(3, "the end"), doc(4, "x " * 60_000)]
    for rows in ([], odd):
        df = docs_of(spark, rows)
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, df, SF_SMALL)
            assert out.columns == df.columns, name
            out.collect()
        P.STAGES[-1][1](spark, df, SF_SMALL).collect()


def test_base_kinds_stay():
    assert [r.kind for r in BASE] == ["assign", "access", "hex"]
