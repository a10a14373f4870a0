"""Secret scan over a trigram inverted index, in DataFrame functions only.

For every rule a Boolean trigram query is derived from its regex: an OR of alternatives, each an
AND of trigrams that any match must hold (in lower case).  Postings ``(trigram, row)`` are kept
for the trigrams that some rule asks for; a row whose postings satisfy a rule's query is that
rule's candidate and is verified with the regex itself.  Rules without mandatory trigrams
(``hex``) scan every text.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """``regex``: matched leftmost, non-overlapping.  A match counts only if group ``group`` of it
    (0: all) has ``least`` characters or more."""
    kind: str
    regex: str
    group: int = 0
    least: int = 1


# fixed values: the base kinds, in the order in which ties are listed
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# kinds that this scan adds
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def _runs(tokens) -> list[list[str]]:
    """Alternatives of a parsed pattern; each is its literal runs, ``None`` standing for a gap."""
    alts: list[list] = [[]]
    for op, arg in tokens:
        name = str(op)
        if name == "LITERAL":
            nxt = [[chr(arg).lower()]]
        elif name == "SUBPATTERN":
            nxt = _runs(arg[-1])
        elif name == "BRANCH":
            nxt = [a for branch in arg[1] for a in _runs(branch)]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            nxt = [[chr(v).lower()] for _, v in arg]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[:2] == (0, 1):
            nxt = [[]] + _runs(arg[2])
        else:
            nxt = [[None]]
        if len(alts) * len(nxt) > MAX_ALTERNATIVES:
            nxt = [[None]]
        alts = [a + b for a in alts for b in nxt]
    return alts


def trigram_query(regex: str) -> list[frozenset[str]]:
    """OR of ANDs of lower-case trigrams; empty: no mandatory trigram, the rule scans fully."""
    out = set()
    for alt in _runs(sre.parse(regex)):
        runs = "".join("\0" if c is None else c for c in alt).split("\0")
        grams = frozenset(r[i:i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return []
        out.add(grams)
    return sorted((a for a in out if not any(b < a for b in out)), key=sorted)


def _row_key(id_col: str, text: Column) -> Column:
    return F.xxhash64(F.col(id_col), text)


def postings(docs: DataFrame, grams: list[str], id_col: str, text_col: str) -> DataFrame:
    """The inverted index: ``(gram, row)`` for each of ``grams`` that a row's lower-cased text has.

    ``row`` addresses a row by a 64-bit hash of id and text; if two rows shared it, both would
    merely be verified.
    """
    text = text_or_empty(text_col)
    low = docs.select(_row_key(id_col, text).alias("row"), F.lower(text).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return low.select(F.explode(present).alias("gram"), "row")


def candidates(index: DataFrame, grams: list[str], queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Rows whose postings satisfy some rule: ``(row, rules)``, a bit per rule of ``queries``.

    The intersection is one grouped OR over posting bits, pre-aggregated before the shuffle."""
    at = {g: i for i, g in enumerate(grams)}
    words = range((len(grams) + 62) // 63)
    per_row = index.groupBy("row").agg(*[
        F.expr(f"bit_or(CASE WHEN gram DIV 63 = {w} THEN shiftleft(1L, gram % 63) ELSE 0L END)").alias(f"w{w}")
        for w in words])

    def holds(clause: frozenset[str]) -> str:
        masks = [sum(1 << (at[g] % 63) for g in clause if at[g] // 63 == w) for w in words]
        return " AND ".join(f"(w{w} & {m}L) = {m}L" for w, m in enumerate(masks) if m)

    bits = " + ".join("CASE WHEN " + " OR ".join(f"({holds(c)})" for c in q) + f" THEN {1 << i} ELSE 0 END"
                      for i, q in enumerate(queries.values()))
    return per_row.select("row", F.expr(bits).alias("rules")).where("rules > 0")


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Matches of one rule as ``(start, end, order, kind)``, in code points.

    The pieces between matches and the matches themselves add up to the text, which gives the
    positions: a match starts where the pieces and matches before it end.
    """
    jre = F.lit(rule.regex)
    whole = F.regexp_extract_all(text, jre, F.lit(0))
    sized = F.arrays_zip(
        F.split(text, rule.regex, -1).alias("gap"), whole.alias("hit"),
        F.regexp_extract_all(text, jre, F.lit(rule.group)).alias("key"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,ord:int,kind:string>>").alias("out"))

    def step(acc, x):
        start = acc.at + F.length(x.gap)
        end = start + F.coalesce(F.length(x.hit), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"))
        ok = x.hit.isNotNull() & (F.length(x.key) >= rule.least)
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc.out, F.array(span))).otherwise(acc.out).alias("out"))

    return F.aggregate(sized, zero, step, lambda acc: acc.out)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """Every row of ``docs`` plus ``__spans``, an array of ``(start, end, ord, kind)`` sorted by start,
    then rule order; empty where nothing is found.

    Null texts count as empty; repeated rows and null ids each get their own result; extra columns
    are carried through.  Positions are code points of the whole text, end exclusive.
    """
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    grams = sorted({g for q in indexed.values() for c in q for g in c})
    text = text_or_empty(text_col)
    df = docs
    if indexed:
        cand = candidates(postings(docs, grams, id_col, text_col), grams, indexed)
        df = (docs.withColumn("__row", _row_key(id_col, text))
              .join(cand.select(F.col("row").alias("__row"), F.col("rules").alias("__rules")), "__row", "left")
              .drop("__row"))
    none = F.array().cast("array<struct<start:int,end:int,ord:int,kind:string>>")
    parts = []
    for order, rule in enumerate(rules):
        if rule.kind in indexed:
            bit = list(indexed).index(rule.kind)
            todo = F.coalesce(F.col("__rules"), F.lit(0)).bitwiseAND(1 << bit) > 0
        else:
            todo = text.rlike(rule.regex)
        parts.append(F.when(todo, _spans(text, rule, order)).otherwise(none))
    out = df.withColumn("__spans", F.array_sort(F.concat(*parts)))
    return out.drop("__rules") if indexed else out


def spans_string(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span found replaced by ``mask`` (spans that overlap become one).

    Rows without a span keep their text, null texts included; no row is dropped."""
    cols = docs.columns
    found = find_secrets(docs, id_col, text_col)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        fresh = s.start >= acc.at
        piece = F.concat(F.substring(F.col(text_col), acc.at + 1, s.start - acc.at), F.lit(mask))
        return F.struct(F.greatest(acc.at, s.end).alias("at"),
                        F.when(fresh, F.concat(acc.out, F.array(piece))).otherwise(acc.out).alias("out"))

    rest = F.aggregate("__spans", zero, step, lambda a: F.concat(
        F.array_join(a.out, ""), F.substring(F.col(text_col), a.at + 1, F.lit(1 << 30))))
    masked = F.when(F.size("__spans") > 0, rest).otherwise(F.col(text_col))
    return found.withColumn(text_col, masked).select(*cols)
