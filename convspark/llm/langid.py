"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays.

One model per language, trained on a bounded sample of labelled rows; a text goes to the language
with the lowest cross-entropy per character, and is rejected when even that one is above what
the language's own held-back texts show.

Texts are lower-cased and everything that is no letter becomes a space (runs of them one), so
mark-up, digits and punctuation do not count.  An n-gram of up to five characters is one 64-bit
number (twelve bits a character from the learned alphabet); a model is, per order, a sorted array of
these with parallel arrays of log-probabilities and back-off weights.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

ORDER = 5
BITS = 12  # 5 * 12 = 60 bits
OTHER = (1 << BITS) - 1  # a letter outside the learned alphabet
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 3_500_000
MAX_LANGS = 512
HELD_BACK = 5  # every fifth sampled document sets the rejection bound instead of counts
SLACK = 1.25
SIGMAS = 4.0
SHARPNESS = 12.0
UNDETERMINED = "und"

def _signs() -> str:
    """Ranges of the characters that count as word characters but are neither letters nor digits (such as ²½①Ⅷ)."""
    at = [c for c in range(0x80, 0x20000) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()]
    starts = [c for c, before in zip(at, [-1, *at]) if c != before + 1]
    ends = [c for c, after in zip(at, [*at[1:], -1]) if c + 1 != after]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


LETTERLESS = re.compile(r"[\W\d_]+")
SIGNS = re.compile(f"[{_signs()}]+")


def letters(text: str | None) -> str:
    """Lower case, every run of non-letters one space, one space at either end; '' without a letter."""
    if text and not text.isascii() and SIGNS.search(text):
        text = SIGNS.sub(" ", text)
    t = LETTERLESS.sub(" ", text.lower()).strip() if text else ""
    return f" {t} " if t else ""


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (BITS * k)) - 1)


def _grams(codes: np.ndarray) -> np.ndarray:
    """The packed ``ORDER``-gram that ends at each position; the caller pads with spaces."""
    g = np.zeros(len(codes), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        g <<= np.uint64(BITS)
        g[back:] |= codes[:len(codes) - back]
    return g


def _codes(texts: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Alphabet codes of all texts, each led by ``ORDER - 1`` spaces, and the texts' bounds."""
    pad = " " * (ORDER - 1)
    joined = pad + pad.join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.searchsorted(alphabet, points)
    at[at == len(alphabet)] = 0
    codes = np.where(alphabet[at] == points, at + 1, OTHER).astype(np.uint64)
    ends = np.cumsum([len(t) + len(pad) for t in texts])
    return codes, ends


@dataclass
class Model:
    keys: list[np.ndarray]   # per order, sorted
    logp: list[np.ndarray]   # natural log, interpolated
    ctx: list[np.ndarray]    # per order, sorted contexts (n - 1 characters)
    back: list[np.ndarray]   # log of the weight left to the shorter context
    floor: float             # log-probability of a character never seen

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of the last character of each packed n-gram given those before it."""
        out = np.full(len(grams), self.floor)
        for k in range(1, ORDER + 1):
            g = grams & _mask(k)
            keys, ctxs = self.keys[k - 1], self.ctx[k - 1]
            c = g >> np.uint64(BITS)
            i = np.minimum(np.searchsorted(ctxs, c), len(ctxs) - 1)
            out = out + np.where(ctxs[i] == c, self.back[k - 1][i], 0.0)
            j = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            out = np.where(keys[j] == g, self.logp[k - 1][j], out)
        return out


def train(grams: np.ndarray) -> Model:
    """Interpolated Kneser-Ney: raw counts at the highest order, numbers of distinct left
    neighbours below it, one absolute discount per order (n1 / (n1 + 2 n2))."""
    keys, counts = np.unique(grams, return_counts=True)
    levels = [(keys, counts)]
    for k in range(ORDER - 1, 0, -1):
        levels.insert(0, np.unique(levels[0][0] & _mask(k), return_counts=True))
    floor = -np.log(1 << BITS)
    m = Model([], [], [], [], floor)
    lower = None
    for k, (keys, counts) in enumerate(levels, 1):
        n1, n2 = (counts == 1).sum(), (counts == 2).sum()
        disc = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ctx, inv, kinds = np.unique(keys >> np.uint64(BITS), return_inverse=True, return_counts=True)
        total = np.bincount(inv, weights=counts)
        weight = disc * kinds / total
        if k == 1:
            shorter = np.full(len(keys), np.exp(floor))
        else:
            shorter = lower[np.searchsorted(levels[k - 2][0], keys & _mask(k - 1))]
        lower = (counts - disc) / total[inv] + weight[inv] * shorter
        m.keys.append(keys)
        m.logp.append(np.log(lower))
        m.ctx.append(ctx)
        m.back.append(np.log(weight))
    return m


@dataclass
class Identifier:
    """Models of all languages with one table for the n-grams that any of them knows."""
    langs: list[str]
    alphabet: np.ndarray
    models: list[Model]
    bounds: np.ndarray       # per language, the cross-entropy beyond which a long text is rejected
    spread: np.ndarray       # per language, the standard deviation of a character's log-probability
    keys: np.ndarray         # sorted highest-order n-grams of all languages
    table: np.ndarray        # their log-probability in every language

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probability of every character in every language (pads count nothing), and where each
        text starts and ends.  Texts come from ``letters`` and are not empty."""
        codes, ends = _codes(texts, self.alphabet)
        grams = _grams(codes)
        at = np.searchsorted(self.keys, grams)
        at[at == len(self.keys)] = 0
        scores = self.table[at]
        unseen = np.flatnonzero(self.keys[at] != grams)
        if len(unseen):
            kinds, inv = np.unique(grams[unseen], return_inverse=True)
            scores[unseen] = np.stack([m.score(kinds) for m in self.models], axis=1)[inv]
        pad = ORDER - 1
        starts = np.concatenate([[0], ends[:-1]]) + pad
        for s in range(pad):
            scores[starts - 1 - s] = 0
        return scores, starts, ends

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character in every language, one row per text, and the texts' lengths."""
        scores, starts, ends = self.scores(texts)
        # a sum runs up to the next text's start, over a pad that counts nothing
        sums = np.add.reduceat(scores, starts, axis=0, dtype=np.float64)
        return -sums / (ends - starts)[:, None], ends - starts

    def accepts(self, lang: np.ndarray, entropy: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether a text's cross-entropy is within its language's bound; the bound is wider for short
        texts, by ``SIGMAS`` standard errors of a mean over that many characters."""
        return entropy <= self.bounds[lang] + SIGMAS * self.spread[lang] / np.sqrt(length)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """``(language, score, cross-entropy, accepted)`` of each text."""
        out = [(UNDETERMINED, 0.0, None, False)] * len(texts)
        clean = [letters(t) for t in texts]
        batch, size = [], 0
        todo = [i for i, t in enumerate(clean) if t]
        for n, i in enumerate(todo):
            batch.append(i)
            size += len(clean[i])
            if size > 250_000 or n == len(todo) - 1:
                h, length = self.entropies([clean[j] for j in batch])
                best = h.argmin(axis=1)  # ties: the first language by name
                low = h.min(axis=1)
                share = 1.0 / np.exp(-SHARPNESS * (h - low[:, None])).sum(axis=1)
                fits = self.accepts(best, low, length)
                for j, b, e, p, ok in zip(batch, best, low, share, fits):
                    out[j] = (self.langs[b], float(p), float(e), bool(ok))
                batch, size = [], 0
        return out


def sample(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, docs: int) -> DataFrame:
    """``(lang, text)`` of the ``docs`` rows of each language with the smallest hash of their id.

    A language's counts set a hash threshold first, so that the ranking sees few more rows than
    it keeps whatever the language's share of the table."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    h = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    counts = {r["l"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "l").limit(MAX_LANGS).collect()}
    if not counts:
        return rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("false")
    cut = F.create_map(*[x for lang, n in counts.items()
                         for x in (F.lit(lang), F.lit(int(min(1.0, 2.0 * docs / n + 50.0 / n) * (1 << 30))))])
    near = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h"),
                       F.col(id_col).alias("id")).where(F.col("h") < F.element_at(cut, F.col("lang")))
    w = Window.partitionBy("lang").orderBy("h", "id", "text")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= docs).select("lang", "text", "r")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Identifier | None:
    """Train on at most ``sample_docs`` whole documents and ``sample_chars`` characters per
    language (a bounded sample by hash of the id).  ``None`` if no row has a language and a letter.

    Each language is counted in its own task; the models come to the driver (a few MB each,
    bounded by the sample, at most 512 languages) and go back to the tasks with the operator.
    """
    rows = sample(labelled, text_col, lang_col, id_col, sample_docs)
    per = "lang string, grams binary, held array<string>, alphabet binary"

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r").drop_duplicates("text")
        texts, held, size = [], [], 0
        for k, t in enumerate(pdf["text"]):
            t = letters(t)
            if not t or size and size + len(t) > sample_chars:
                continue
            size += len(t)
            (held if k % HELD_BACK == HELD_BACK - 1 else texts).append(t)
        texts, held = (texts or held), (held or texts)
        joined = "".join(texts).encode("utf-32-le", "surrogatepass")
        alphabet, n = np.unique(np.frombuffer(joined, np.uint32), return_counts=True)
        alphabet = alphabet[np.argsort(-n, kind="stable")][:(1 << BITS) // 2]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "grams": ["\0".join(texts).encode("utf-8", "surrogatepass")],
                             "held": [held], "alphabet": [np.sort(alphabet).tobytes()]})

    got = sorted((r for r in rows.groupBy("lang").applyInPandas(gather, per).collect() if r["held"]),
                 key=lambda r: r["lang"])
    if not got:
        return None
    points, n = np.unique(np.concatenate([np.frombuffer(r["alphabet"], np.uint32) for r in got]), return_counts=True)
    alphabet = np.sort(points[np.argsort(-n, kind="stable")][:OTHER - 1])
    models = []
    for r in got:
        codes, ends = _codes(r["grams"].decode("utf-8", "surrogatepass").split("\0"), alphabet)
        keep = np.ones(len(codes), bool)
        starts = np.concatenate([[0], ends[:-1]])
        for s in range(ORDER - 1):
            keep[starts + s] = False
        models.append(train(_grams(codes)[keep]))
    keys = np.unique(np.concatenate([m.keys[-1] for m in models]))
    table = np.stack([m.score(keys) for m in models], axis=1).astype(np.float32)
    ident = Identifier([r["lang"] for r in got], alphabet, models, np.zeros(len(got)), np.zeros(len(got)), keys, table)
    for k, r in enumerate(got):
        scores, starts, ends = ident.scores(list(r["held"]))
        own = [scores[a:b, k] for a, b in zip(starts, ends)]
        ident.bounds[k] = SLACK * max(-x.mean() for x in own)
        ident.spread[k] = np.concatenate(own).std()
    return ident


def predict(docs: DataFrame, ident: Identifier | None, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` plus ``__lang_pred, __score, __entropy, __accepted``.

    The whole text counts.  Null texts and texts without a letter (and every text, if there is
    no model) are ``und``, score 0, not accepted.  Ties go to the first language by name.
    """
    from pyspark.sql.types import StructType
    schema = StructType(list(docs.schema.fields))
    for name, kind in (("__lang_pred", "string"), ("__score", "double"), ("__entropy", "double"), ("__accepted", "boolean")):
        schema = schema.add(name, kind)
    model = docs.sparkSession.sparkContext.broadcast(ident)
    at = docs.columns.index(text_col)

    def run(batches):
        ident = model.value
        for b in batches:
            texts = b.column(at).to_pylist()
            got = ident.predict(texts) if ident else [(UNDETERMINED, 0.0, None, False)] * len(texts)
            cols = list(zip(*got)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()),
                 pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], names=schema.names)

    return docs.mapInArrow(run, schema)
