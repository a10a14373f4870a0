"""Chat rendering, token and usage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import IGNORE_INDEX, JUDGE_MAX_NEW_TOKENS, MAX_SEQ_LENGTH, RESPONSE_MARKER
from ..functions import chat as C
from ..functions.text import strip_tags_dataset, window_size_from_model, word_count
from ..operators import samples as S
from ..operators.tokens import length_stats, request_usage
from ..sources.tables import table, turns
from ..session import spread
from .registry import register
from .sft import _sft_window_sql
from .sqlbits import NON_WS_CLASS, q, words
from .text import _tags_sql

NL = "chr(10)"
_MSG_SQL = f"'<|im_start|>' || role || {NL} || content || '<|im_end|>' || {NL}"


def _samples5(spark, sf_dir):
    return S.sft_samples(S.normalized_turns(turns(spark, sf_dir)), [5])


_CHAT_SQL = f"""
SELECT conv_id, turn, window_size, {_tags_sql(f"string_agg({_MSG_SQL}, '' ORDER BY pos)", True)} AS text
FROM ({_sft_window_sql(5)}) m GROUP BY conv_id, turn, window_size
"""


def _chat(spark, sf_dir):
    s = _samples5(spark, sf_dir)
    return s.select("conv_id", "turn", "window_size",
                    strip_tags_dataset(C.chat_text("messages")).alias("text"))


register("chat_template", _CHAT_SQL)(_chat)

_PT_CTE = f"""
m AS ({_sft_window_sql(5)}),
pt AS (SELECT conv_id, turn,
              string_agg({_MSG_SQL}, '' ORDER BY pos) FILTER (WHERE pos < last_pos)
                || '<|im_start|>assistant' || {NL} AS prompt,
              max(content) FILTER (WHERE pos = last_pos AND role = 'assistant') AS target
       FROM (SELECT *, max(pos) OVER (PARTITION BY conv_id, turn) AS last_pos FROM m) x
       GROUP BY conv_id, turn)
"""


def _prompt_target(spark, sf_dir):
    s = S.prompt_target(_samples5(spark, sf_dir))
    return s.select("conv_id", "turn", C.chat_text("prompt_messages", True).alias("prompt"), "target")


register("prompt_target", f"WITH {_PT_CTE} SELECT conv_id, turn, prompt, target FROM pt")(_prompt_target)

_BUDGET_SQL = f"""WITH {_PT_CTE}, n AS (SELECT conv_id, turn, {words('prompt')} AS n_tokens FROM pt)
SELECT conv_id, turn, n_tokens, least(n_tokens, {MAX_SEQ_LENGTH}) AS n_kept,
       round_even(CAST(least(n_tokens, {MAX_SEQ_LENGTH}) AS DOUBLE) * 100.0 / {float(MAX_SEQ_LENGTH)}, 1) AS pct_ctx,
       n_tokens > {MAX_SEQ_LENGTH} AS over_limit
FROM n"""


@register("token_budget", _BUDGET_SQL)
def token_budget(spark, sf_dir):
    p = _prompt_target(spark, sf_dir).withColumn("n_tokens", word_count("prompt"))
    b = C.token_budget("n_tokens")
    return p.select("conv_id", "turn", "n_tokens", b["n_kept"].alias("n_kept"),
                    b["pct_ctx"].alias("pct_ctx"), b["over_limit"].alias("over_limit"))


_STATS_SQL = f"""
WITH d AS (SELECT lang, {words('text')} AS n FROM documents)
SELECT lang, count(n) AS sample_count, min(n) AS min_len, max(n) AS max_len, avg(n) AS mean_len,
       median(n) AS median_len, count(*) FILTER (WHERE n > {MAX_SEQ_LENGTH}) AS n_over_max
FROM d GROUP BY lang"""


@register("token_stats", _STATS_SQL)
def token_stats(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("lang", "text")).select("lang", word_count("text").alias("n"))
    return length_stats(d, "n", ["lang"])


_MARK_ID = f"(ascii({q(RESPONSE_MARKER)}) * 1000 + length({q(RESPONSE_MARKER)}))"
_MASK_SQL = f"""
WITH c AS ({_CHAT_SQL}),
t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '({NON_WS_CLASS}+)', 1),
                                           lambda x: CAST(ascii(x) * 1000 + length(x) AS INTEGER)) AS ids FROM c),
p AS (SELECT conv_id, turn, ids, list_position(list_reverse(ids), {_MARK_ID}) AS rpos FROM t),
k AS (SELECT conv_id, turn, ids, CASE WHEN rpos IS NULL OR rpos = 0 THEN len(ids)
                                      ELSE len(ids) - rpos + 1 END AS n_masked FROM p)
SELECT conv_id, turn, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(n_masked AS BIGINT) AS n_masked,
       CAST(coalesce(list_sum(ids[n_masked + 1:]), 0) AS BIGINT) AS label_sum
FROM k"""


@register("loss_mask", _MASK_SQL)
def loss_mask(spark, sf_dir):
    c = _chat(spark, sf_dir)
    ids = C.token_ids(C.whitespace_tokens("text"))
    marker = C.token_ids(C.whitespace_tokens(F.lit(RESPONSE_MARKER)))
    t = c.select("conv_id", "turn", ids.alias("ids"), marker.alias("marker"))
    t = t.select("conv_id", "turn", "ids", C.loss_labels("ids", "marker").alias("labels"))
    return t.select("conv_id", "turn", F.size("ids").cast("long").alias("n_tokens"),
                    F.size(F.filter("labels", lambda x: x == IGNORE_INDEX)).cast("long").alias("n_masked"),
                    F.aggregate("labels", F.lit(0).cast("long"),
                                lambda a, x: a + F.when(x == IGNORE_INDEX, 0).otherwise(x)).alias("label_sum"))


# tokens that tell marker, role word and line breaks apart: the marker is two tokens, and the line
# break after it belongs to the masked part
_PIECES = r"<\|im_start\|>|<\|im_end\|>|\n|[^\s<]+|<"
_PAIR_MASK_SQL = f"""
WITH c AS ({_CHAT_SQL}),
t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, {q(_PIECES)}, 0),
                                           lambda x: CAST(ascii(x) * 1000 + length(x) AS INTEGER)) AS ids FROM c),
p AS (SELECT conv_id, turn, ids, coalesce(list_max(list_filter(range(1, len(ids)),
             lambda i: ids[i] = ascii('<') * 1000 + 12 AND ids[i + 1] = ascii('a') * 1000 + 9)), 0) AS start FROM t),
k AS (SELECT conv_id, turn, ids, CASE WHEN start = 0 THEN len(ids) WHEN ids[start + 2] = 10001 THEN start + 2
                                      ELSE start + 1 END AS n_masked FROM p)
SELECT conv_id, turn, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(n_masked AS BIGINT) AS n_masked,
       CAST(coalesce(list_sum(ids[n_masked + 1:]), 0) AS BIGINT) AS label_sum
FROM k"""


@register("loss_mask_newline", _PAIR_MASK_SQL)
def loss_mask_newline(spark, sf_dir):
    """X19 with a marker of two tokens and the newline rule."""
    pieces = F.regexp_extract_all("text", F.lit(f"({_PIECES})"), 1)
    t = _chat(spark, sf_dir).select("conv_id", "turn", C.token_ids(pieces).alias("ids"),
                                    C.token_ids(F.array(F.lit("<|im_start|>"), F.lit("assistant"))).alias("marker"))
    t = t.select("conv_id", "turn", "ids", C.loss_labels("ids", "marker", newline_id=10001).alias("labels"))
    return t.select("conv_id", "turn", F.size("ids").cast("long").alias("n_tokens"),
                    F.size(F.filter("labels", lambda x: x == IGNORE_INDEX)).cast("long").alias("n_masked"),
                    F.aggregate("labels", F.lit(0).cast("long"),
                                lambda a, x: a + F.when(x == IGNORE_INDEX, 0).otherwise(x)).alias("label_sum"))


_USAGE_CTE = f"""
u AS (SELECT conv_id, turn, role, {words('text')} AS n FROM conversations),
r AS (SELECT conv_id, turn, role, n AS completion_tokens,
             coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)
               AS prompt_tokens FROM u),
usage AS (SELECT conv_id, turn, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, completion_tokens,
                 CAST(prompt_tokens + completion_tokens AS BIGINT) AS total_tokens FROM r WHERE role = 'assistant')
"""


@register("usage_accounting", f"WITH {_USAGE_CTE} SELECT * FROM usage")
def usage_accounting(spark, sf_dir):
    return request_usage(turns(spark, sf_dir), 5)


_MODELS = ["qwen3", "models/models_1e/qwen-annomi-therapist_w1",
           "models/models_3e/qwen-cactus-therapist_w5"]
_MODEL_SQL = "CASE conv_id % 3 " + " ".join(
    f"WHEN {i} THEN {q(m)}" for i, m in enumerate(_MODELS)) + " END"
_TRUNC_SQL = f"""WITH {_USAGE_CTE}
SELECT model, TRY_CAST(NULLIF(regexp_extract(model, '_w(\\d+)', 1), '') AS INTEGER) AS window_size,
       count(*) AS n_calls, count(*) FILTER (WHERE completion_tokens >= {JUDGE_MAX_NEW_TOKENS}) AS n_truncated,
       avg(CASE WHEN completion_tokens >= {JUDGE_MAX_NEW_TOKENS} THEN 1.0 ELSE 0.0 END) AS truncation_rate,
       CAST(sum(prompt_tokens) AS BIGINT) AS input_tokens, CAST(sum(completion_tokens) AS BIGINT) AS generated_tokens
FROM (SELECT {_MODEL_SQL} AS model, * FROM usage) x GROUP BY model"""


@register("truncation_rate", _TRUNC_SQL)
def truncation_rate(spark, sf_dir):
    u = request_usage(turns(spark, sf_dir), 5)
    model = F.try_element_at(F.array(*[F.lit(m) for m in _MODELS]), (F.col("conv_id") % 3 + 1).cast("int"))
    g = C.generation_flags(F.col("prompt_tokens") + F.col("completion_tokens"), "prompt_tokens",
                           F.lit(JUDGE_MAX_NEW_TOKENS))
    u = u.select(model.alias("model"), "prompt_tokens", g["generated_tokens"].alias("gen"),
                 g["truncated"].alias("truncated"))
    agg = u.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if("truncated").alias("n_truncated"),
        F.avg(F.col("truncated").cast("double")).alias("truncation_rate"),
        F.sum("prompt_tokens").alias("input_tokens"), F.sum("gen").alias("generated_tokens"))
    return agg.withColumn("window_size", window_size_from_model("model"))


_PICK_N = 5
_PICK_SQL = f"""WITH {_PT_CTE},
full_w AS (SELECT conv_id, turn FROM m GROUP BY conv_id, turn HAVING count(*) - 2 = 5)
SELECT pt.conv_id, pt.turn, pt.prompt, pt.target FROM pt JOIN full_w USING (conv_id, turn)
ORDER BY pt.conv_id, pt.turn LIMIT {_PICK_N}"""


@register("eval_pick", _PICK_SQL)
def eval_pick(spark, sf_dir):
    picked = S.prompt_target(S.eval_pick(_samples5(spark, sf_dir), _PICK_N, window_size=5))
    return picked.select("conv_id", "turn", C.chat_text("prompt_messages", True).alias("prompt"), "target")


# ---------------------------------------------------------------- K6 / A5 per window and split

def _sft_meta_sql():
    from .splits import _SPLIT_CTE
    msgs = " UNION ALL ".join(f"SELECT * FROM ({_sft_window_sql(w)}) m{w}" for w in (1, 2, 5))
    return f"""WITH {_SPLIT_CTE},
m AS ({msgs}),
c AS (SELECT conv_id, turn, window_size,
             {_tags_sql(f"string_agg({_MSG_SQL}, '' ORDER BY pos)", True)} AS text
      FROM m GROUP BY conv_id, turn, window_size),
lens AS (SELECT c.window_size, sp.split, {words('c.text')} AS n FROM c JOIN sp ON sp.conv_id = c.conv_id)
SELECT window_size, split, count(*) AS num_examples, min(n) AS min_len, max(n) AS max_len,
       avg(n) AS mean_len, median(n) AS median_len,
       count(*) FILTER (WHERE n > {MAX_SEQ_LENGTH}) AS n_over_max
FROM lens GROUP BY window_size, split"""


@register("sft_metadata", _sft_meta_sql())
def sft_metadata(spark, sf_dir):
    from ..operators.split import split_ids
    from ..sinks.writers import training_metadata
    t = turns(spark, sf_dir)
    s = S.sft_samples(S.normalized_turns(t), [1, 2, 5])
    s = s.join(split_ids(t.select("conv_id")), "conv_id")
    meta = training_metadata(s.select("window_size", "split", strip_tags_dataset(C.chat_text("messages")).alias("text")))
    L = "token_length_stats"
    return meta.select("window_size", "split", "num_examples", F.col(f"{L}.min").alias("min_len"),
                       F.col(f"{L}.max").alias("max_len"), F.col(f"{L}.mean").alias("mean_len"),
                       F.col(f"{L}.median").alias("median_len"), F.col(f"{L}.num_exceeding_max_seq").alias("n_over_max"))
