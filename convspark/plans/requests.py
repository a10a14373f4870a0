"""Chat-log, PANAS, quality-filter and corpus-union queries
(F1, F3, F10, F11, X27, X28, X29, O1, O2, A7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import PANAS_FEELINGS, PANAS_POSITIVE
from ..functions import jsonmsg as JM
from ..functions.scores import panas_delta as panas_delta_row, parse_panas
from ..functions.text import word_count
from ..operators.ordered import lookback
from ..sources.tables import table, turns
from .registry import register
from .sqlbits import q, strip, words

NL = "chr(10)"


def _requests(spark, sf_dir):
    t = turns(spark, sf_dir)
    framed = lookback(t, ["conv_id"], "turn", 5, ["turn", "role", "text"], out="req", include_current=False)
    a = framed.filter(F.col("role") == "assistant").withColumn("said", F.coalesce("text", F.lit("")))
    msgs = F.transform("req", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    k = F.col("conv_id") % 7
    bad_item = F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("content"))
    body = (F.when(k == 0, F.concat(F.lit('{"messages": '), F.to_json(msgs)))
            .when(k == 1, F.to_json(F.struct(F.col("said").alias("messages"))))
            .when(k == 2, F.to_json(F.struct(F.concat(msgs, F.array(bad_item)).alias("messages"))))
            .when(k == 3, F.to_json(F.struct(F.col("said").alias("model"))))
            .when(k == 4, F.to_json(F.struct(F.slice(msgs, 1, 0).alias("messages"), F.col("said").alias("last"))))
            .otherwise(F.to_json(F.struct(msgs.alias("messages")))))
    prompt_tokens = F.aggregate("req", F.lit(0).cast("long"), lambda s, m: s + word_count(m["text"]))
    return a.select("conv_id", "turn", "text", "said", body.alias("body"), prompt_tokens.alias("prompt_tokens"))


_REQ_CTE = f"""
w AS (SELECT conv_id, turn, role, text,
             list(struct_pack(role := role, content := text)) OVER (PARTITION BY conv_id ORDER BY turn
                  ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS req,
             sum({words('text')}) OVER (PARTITION BY conv_id ORDER BY turn
                  ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pt
      FROM conversations),
rq AS (SELECT conv_id, turn, text, CAST(coalesce(pt, 0) AS BIGINT) AS prompt_tokens,
         CASE conv_id % 7
           WHEN 0 THEN '{{"messages": ' || CAST(to_json(coalesce(req, [])) AS VARCHAR)
           WHEN 1 THEN CAST(json_object('messages', coalesce(text, '')) AS VARCHAR)
           WHEN 2 THEN '{{"messages": ' || rtrim(CAST(to_json(coalesce(req, [])) AS VARCHAR), ']')
                       || CASE WHEN len(coalesce(req, [])) = 0 THEN '' ELSE ',' END || '{{"role": "user"}}]}}'
           WHEN 3 THEN CAST(json_object('model', coalesce(text, '')) AS VARCHAR)
           WHEN 4 THEN '{{"messages": [], "last": ' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || '}}'
           ELSE '{{"messages": ' || CAST(to_json(coalesce(req, [])) AS VARCHAR) || '}}' END AS body
       FROM w WHERE role = 'assistant')
"""

_VALID_SQL = f"""WITH {_REQ_CTE},
j AS (SELECT conv_id, turn, body, json_valid(body) AS ok_json FROM rq),
m AS (SELECT *, CASE WHEN ok_json THEN json_extract(body, '$.messages') END AS msgs FROM j),
c AS (SELECT *, CASE WHEN ok_json AND json_type(msgs) = 'ARRAY' THEN
          list_position(list_transform(json_extract(msgs, '$[*]'), lambda x: json_type(x) = 'OBJECT'
                          AND json_exists(x, '$.role') AND json_exists(x, '$.content')), false) END AS bad
      FROM m),
e AS (SELECT conv_id, turn, msgs,
        CASE WHEN NOT ok_json THEN 'Invalid JSON'
             WHEN msgs IS NULL OR json_type(msgs) = 'NULL'
                  OR (json_type(msgs) = 'ARRAY' AND json_array_length(msgs) = 0)
                  OR (json_type(msgs) = 'VARCHAR' AND json_extract_string(msgs, '$') = '')
                  OR (json_type(msgs) = 'OBJECT' AND CAST(msgs AS VARCHAR) = '{{}}') THEN 'No messages provided'
             WHEN json_type(msgs) <> 'ARRAY' THEN 'Messages must be a list'
             WHEN bad IS NOT NULL AND bad > 0 THEN 'Invalid message format at index ' || CAST(bad - 1 AS VARCHAR)
        END AS error FROM c)
SELECT conv_id, turn, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error,
       CASE WHEN error IS NULL THEN CAST(json_array_length(msgs) AS INTEGER) END AS n_messages
FROM e"""


@register("request_validation", _VALID_SQL)
def request_validation(spark, sf_dir):
    r = _requests(spark, sf_dir)
    chk = JM.request_check("body")
    return r.select("conv_id", "turn", F.when(chk["error"].isNull(), "ok").otherwise("error").alias("status"),
                    chk["error"].alias("error"), chk["n_messages"].alias("n_messages"))


_COMP_SQL = f"""WITH {_REQ_CTE},
rec AS (SELECT conv_id, turn,
          CASE conv_id % 5
            WHEN 0 THEN CAST(json_object('id', coalesce(text, '')) AS VARCHAR)
            WHEN 1 THEN '{{"choices": [], "text": ' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || '}}'
            WHEN 2 THEN '{{"choices": [{{"index": 0, "text": ' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || '}}]}}'
            WHEN 3 THEN 'oops ' || coalesce(text, '')
            ELSE CAST(json_object('id', 'chatcmpl-' || md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)),
                   'object', 'chat.completion', 'created', 1700000000 + turn, 'model', 'patient-sim',
                   'choices', json_array(json_object('index', 0, 'message',
                        json_object('role', 'assistant', 'content', text), 'finish_reason', 'stop')),
                   'usage', json_object('prompt_tokens', prompt_tokens, 'completion_tokens', {words('text')},
                        'total_tokens', prompt_tokens + {words('text')})) AS VARCHAR) END AS response
        FROM rq),
e AS (SELECT conv_id, turn, response,
        CASE WHEN NOT json_valid(response) THEN 'Invalid JSON returned by server'
             WHEN json_type(response) <> 'OBJECT' OR NOT json_exists(response, '$.choices')
               THEN 'Unexpected response from server'
             WHEN json_type(response, '$.choices') <> 'ARRAY' OR json_array_length(response, '$.choices') = 0
               THEN 'No completion choices returned by server'
             WHEN NOT json_exists(response, '$.choices[0].message.content')
               THEN 'Invalid completion format from server' END AS error
      FROM rec)
SELECT conv_id, turn,
       CASE WHEN error IS NULL THEN {strip("json_extract_string(response, '$.choices[0].message.content')")} END
         AS content,
       error,
       CASE WHEN error IS NULL THEN CAST(json_extract(response, '$.usage.total_tokens') AS BIGINT) END AS total_tokens
FROM e"""


@register("completion_extract", _COMP_SQL)
def completion_extract(spark, sf_dir):
    r = _requests(spark, sf_dir)
    rid = F.concat(F.lit("chatcmpl-"), F.md5(F.concat_ws(":", F.col("conv_id").cast("string"),
                                                         F.col("turn").cast("string"))))
    ct = word_count("text")
    rec = JM.completion_record(rid, F.lit(1700000000) + F.col("turn"), F.lit("patient-sim"), F.col("text"),
                               F.col("prompt_tokens"), ct)
    k = F.col("conv_id") % 5
    none = F.array().cast("array<string>")
    one = F.array(F.struct(F.lit(0).alias("index"), F.col("said").alias("text")))
    resp = (F.when(k == 0, F.to_json(F.struct(F.col("said").alias("id"))))
            .when(k == 1, F.to_json(F.struct(none.alias("choices"), F.col("said").alias("text"))))
            .when(k == 2, F.to_json(F.struct(one.alias("choices"))))
            .when(k == 3, F.concat(F.lit("oops "), "said")).otherwise(rec))
    r = r.withColumn("response", resp)
    out = JM.completion_content("response")
    total = F.try_variant_get(F.try_parse_json("response"), "$.usage.total_tokens", "bigint")
    return r.select("conv_id", "turn", out["content"].alias("content"), out["error"].alias("error"),
                    F.when(out["error"].isNull(), total).alias("total_tokens"))


# ---------------------------------------------------------------- X28 / X29

_FEEL_SQL = "[" + ", ".join(q(f) for f in PANAS_FEELINGS) + "]"
_N_POS = len(PANAS_POSITIVE)
_PANAS_SQL = f"""
WITH s AS (SELECT l.doc_id, l.quality, i, {_FEEL_SQL}[i + 1] AS feeling FROM labels l, range(0, 20) r(i)),
v AS (SELECT doc_id, feeling, i, (doc_id + i) % 5 + 1 AS before_s, (doc_id * 3 + i + quality) % 5 + 1 AS after_s FROM s)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_feelings,
       CAST(sum(CASE WHEN i < {_N_POS} THEN after_s - before_s ELSE 0 END) AS BIGINT) AS positive_delta,
       CAST(sum(CASE WHEN i >= {_N_POS} THEN after_s - before_s ELSE 0 END) AS BIGINT) AS negative_delta,
       CAST(sum(after_s - before_s) AS BIGINT) AS total_delta
FROM v GROUP BY doc_id"""


@register("panas_delta", _PANAS_SQL)
def panas_delta(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    feelings = F.array(*[F.lit(f) for f in PANAS_FEELINGS])
    before = F.array_join(F.transform(feelings, lambda f, i: F.concat(
        f, F.lit(", "), ((F.col("doc_id") + i) % 5 + 1).cast("string"), F.lit(", because "), F.lower(f))), "\n")
    after = F.array_join(F.transform(feelings, lambda f, i: F.concat(
        f, F.lit(", seems "), F.lower(f), F.lit(" now, "),
        ((F.col("doc_id") * 3 + i + F.col("quality")) % 5 + 1).cast("string"))), "\n")
    replies = lab.select("doc_id", before.alias("before"), after.alias("after"))
    # both replies are in the same row: the per-feeling match needs no shuffle
    # parse once into columns: the lookup lambda must see a column, not the parser
    parsed = replies.select("doc_id", parse_panas("before").alias("b"), parse_panas("after").alias("a"))
    d = panas_delta_row("b", "a")
    return parsed.select("doc_id", d["n_feelings"].alias("n_feelings"),
                          d["positive_delta"].alias("positive_delta"),
                          d["negative_delta"].alias("negative_delta"), d["total_delta"].alias("total_delta"))


# ---------------------------------------------------------------- F1 / A7

_QUALITY_SQL = """
SELECT d.doc_id, d.lang, d.n_chars, CASE WHEN l.quality = 1 THEN 'High' ELSE 'low' END AS mi_quality
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
WHERE lower(CASE WHEN l.quality = 1 THEN 'High' ELSE 'low' END) = 'high'"""


@register("quality_filter", _QUALITY_SQL)
def quality_filter(spark, sf_dir):
    from ..operators.tokens import quality_keep
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    doc = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = lab.join(doc, "doc_id").select(
        "doc_id", "lang", "n_chars", F.when(F.col("quality") == 1, "High").otherwise("low").alias("mi_quality"))
    return quality_keep(rows)


# ---------------------------------------------------------------- O1 / O2 / F3

_UNION_SQL = """
SELECT dataset, conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (
  SELECT 'conversations' AS dataset, conv_id, text FROM conversations
  UNION ALL BY NAME
  SELECT 'documents' AS dataset, doc_id AS conv_id, text FROM documents WHERE text IS NOT NULL) u
GROUP BY dataset, conv_id"""


@register("union_corpora", _UNION_SQL)
def union_corpora(spark, sf_dir):
    conv = turns(spark, sf_dir).select(F.lit("conversations").alias("dataset"), "conv_id", "turn", "role", "text")
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select(
        F.lit("documents").alias("dataset"), F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"),
        F.lit("user").alias("role"), "text")
    u = conv.unionByName(docs)
    return u.groupBy("dataset", "conv_id").agg(F.count(F.lit(1)).alias("n_turns"),
                                               F.sum(F.length("text")).cast("long").alias("n_chars"))
