"""Judge reply parsing (X8) and PANAS reply parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import J_WS, PANAS_FEELINGS
from .text import _c, py_strip

# Fixed patterns: leading "<number> , <explanation>", else the first number anywhere.
NUMBER = "([0-9]+(?:\\.[0-9]+)?)"
LEAD_RE = f"(?sU)^{J_WS}*{NUMBER}{J_WS}*,{J_WS}*(.*)"


def parse_score(c) -> Column:
    """Reply -> struct(score DOUBLE, explanation STRING).

    '4, good' -> (4.0, 'good'); 'Score: 4, ok' -> (4.0, whole text); '-1, x' -> 1.0
    through the fallback; empty/null -> (null, ''); no clamp to the 0-6 scale (Q7).
    """
    t = _c(c)
    st = py_strip(t)
    lead = st.rlike(LEAD_RE)
    anywhere = t.rlike(NUMBER)
    score = (F.when(t.isNull() | (t == ""), F.lit(None))
             .when(lead, F.regexp_extract(st, LEAD_RE, 1))
             .when(anywhere, F.regexp_extract(t, NUMBER, 1))).cast("double")
    expl = (F.when(t.isNull() | (t == ""), F.lit(""))
            .when(lead, py_strip(F.regexp_extract(st, LEAD_RE, 2)))
            .otherwise(st))
    return F.struct(score.alias("score"), expl.alias("explanation"))


# PANAS lines: "feeling, score, explanation" (example order) or
# "feeling, explanation, score" (instruction order) — both accepted (Q20).
PANAS_LINE = (f"(?U)^{J_WS}*([A-Za-z]+){J_WS}*,"
              f"(?:{J_WS}*([1-5]){J_WS}*(?:,(.*))?|(.*),{J_WS}*([1-5]){J_WS}*)$")


def parse_panas(c) -> Column:
    """Reply -> ARRAY<STRUCT<feeling, score INT, explanation>>, known feelings only."""
    lines = F.split(_c(c), "\\r\\n|\\n")
    # one match lays a line's groups out, those of the other order empty: feeling, score, explanation
    laid = F.transform(F.filter(lines, lambda x: x.rlike(PANAS_LINE)),
                       lambda x: F.split(F.regexp_replace(x, PANAS_LINE, "$1\x01$2$5\x01$3$4"), "\x01", 3))
    parsed = F.transform(laid, lambda p: F.struct(
        F.element_at(p, 1).alias("feeling"), F.element_at(p, 2).cast("int").alias("score"),
        py_strip(F.element_at(p, 3)).alias("explanation")))
    known = F.array(*[F.lit(f) for f in PANAS_FEELINGS])
    return F.filter(parsed, lambda r: F.array_contains(known, r["feeling"]))


def panas_delta(before, after, positive=None) -> Column:
    """X29 inside one row: after - before per feeling present in both replies.

    struct(n_feelings, positive_delta, negative_delta, total_delta).  Both parsed
    replies (X28 arrays, at most 20 items each) sit in the same row, so the
    per-feeling match is an array lookup rather than a shuffled equi-join; use a
    join on (conversation, feeling) only when the two replies live in different
    tables.  A feeling repeated in ``before`` matches its first occurrence.
    """
    from ..constants import PANAS_POSITIVE
    pos = F.array(*[F.lit(f) for f in (positive or PANAS_POSITIVE)])
    b = _c(before)
    pairs = F.transform(_c(after), lambda x: F.struct(
        x["feeling"].alias("feeling"),
        (x["score"] - F.try_element_at(F.filter(b, lambda y: y["feeling"] == x["feeling"]), F.lit(1))["score"])
        .alias("d")))
    matched = F.filter(pairs, lambda p: p["d"].isNotNull())

    def total(cond):
        return F.aggregate(matched, F.lit(0).cast("long"),
                           lambda acc, p: acc + F.when(cond(p), p["d"]).otherwise(0).cast("long"))

    return F.struct(F.size(matched).cast("long").alias("n_feelings"),
                    total(lambda p: F.array_contains(pos, p["feeling"])).alias("positive_delta"),
                    total(lambda p: ~F.array_contains(pos, p["feeling"])).alias("negative_delta"),
                    total(lambda p: F.lit(True)).alias("total_delta"))
