"""Chat rendering and token arithmetic (X17-X20, F12) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import IGNORE_INDEX, IM_END, IM_START, J_NON_WS, MAX_SEQ_LENGTH
from .text import _c


def chat_text(messages, add_generation_prompt: bool = False) -> Column:
    """ChatML rendering of ARRAY<STRUCT<role, content>>."""
    body = F.array_join(F.transform(_c(messages), lambda m: F.concat(
        F.lit(IM_START), m["role"], F.lit("\n"), m["content"], F.lit(IM_END + "\n"))), "")
    if add_generation_prompt:
        body = F.concat(body, F.lit(IM_START + "assistant\n"))
    return body


def whitespace_tokens(c) -> Column:
    """U-4 default tokenizer: whitespace words (as the usage accounting counts them)."""
    return F.regexp_extract_all(_c(c), F.lit(f"(?U)({J_NON_WS}+)"), 1)


def token_ids(tokens) -> Column:
    """Deterministic ids for whitespace tokens: code point of the first char * 1000 + length."""
    return F.transform(_c(tokens), lambda t: (F.ascii(t) * 1000 + F.length(t)).cast("int"))


def last_subsequence_start(ids, marker) -> Column:
    """1-based start of the last occurrence of the ``marker`` id sequence in ``ids`` (0 if none).

    Pass materialised columns (names), not expressions: ``ids`` is referenced
    inside a lambda and an inlined expression would be re-evaluated per element."""
    ids, marker = _c(ids), _c(marker)
    m = F.size(marker)
    # single-token marker (the common case): one reverse scan, O(n)
    rpos = F.array_position(F.reverse(ids), F.try_element_at(marker, F.lit(1)))
    single = F.when(rpos == 0, F.lit(0)).otherwise(F.size(ids) - rpos + 1)
    starts = F.sequence(F.lit(1), F.greatest(F.size(ids) - m + 1, F.lit(1)))
    hits = F.filter(starts, lambda i: F.slice(ids, i, m) == marker)
    multi = F.when(F.size(ids) < m, F.lit(0)).otherwise(F.coalesce(F.array_max(hits), F.lit(0)))
    return F.when(m == 1, single).otherwise(multi)


def loss_labels(ids, marker, newline_id=None) -> Column:
    """labels = ids with everything up to and including the last response
    marker (and one following newline token, if any) set to -100; no marker ->
    everything -100."""
    ids, marker = _c(ids), _c(marker)
    start = last_subsequence_start(ids, marker)
    upto = (start + F.size(marker) - 1).cast("int")  # number of masked leading tokens (1-based end)
    if newline_id is not None:
        upto = F.when(F.try_element_at(ids, upto + 1) == F.lit(newline_id), upto + 1).otherwise(upto)
    # no per-element lambda: the mask boundary is computed once per row, then
    # labels = [-100] * upto ++ ids[upto:]
    upto = F.when(start == 0, F.size(ids)).otherwise(upto).cast("int")
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), upto),
                    F.slice(ids, upto + 1, F.greatest(F.size(ids) - upto, F.lit(0))))


def token_budget(n_tokens, ctx: int = MAX_SEQ_LENGTH) -> Column:
    """struct(n_kept, pct_ctx, over_limit) for a prompt of ``n_tokens``."""
    n = _c(n_tokens)
    kept = F.least(n, F.lit(ctx))
    return F.struct(kept.cast("long").alias("n_kept"),
                    F.bround(kept.cast("double") * 100.0 / F.lit(float(ctx)), 1).alias("pct_ctx"),
                    (n > F.lit(ctx)).alias("over_limit"))


def generation_flags(total_tokens, input_tokens, max_new_tokens) -> Column:
    """generated = max(0, total - input); truncated when generated >= max_new_tokens."""
    gen = F.greatest(F.lit(0), _c(total_tokens) - _c(input_tokens))
    return F.struct(gen.alias("generated_tokens"), (gen >= _c(max_new_tokens)).alias("truncated"))
