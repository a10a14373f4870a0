"""Parsing and text-cleaning queries (X2-X10, A4, W9, K1 rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import LINE_BREAK_RE, WS_CLASS
from ..functions import dialogue as D
from ..functions.scores import parse_score
from ..functions.text import file_stem, strip_tags_dataset, strip_tags_generation, with_clean_text
from ..operators.transcripts import labelled_rows_to_turns, render_dialogue, transcript_lines
from ..sources.tables import table, turns
from ..session import spread
from .registry import register
from .sqlbits import norm_role, strip

NL = "chr(10)"

# ---------------------------------------------------------------- X2 labelled text


def _exploded(df, arr):
    return df.select("conv_id", F.posexplode(arr).alias("idx", "t")).select(
        "conv_id", F.col("idx").cast("long").alias("idx"), F.col("t.role").alias("role"),
        F.col("t.text").alias("text"))


_PARSE_SQL = f"""
WITH d AS (SELECT conv_id, string_agg(role || ': ' || text, {NL} ORDER BY turn) AS s
           FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, regexp_extract_all(s, '([^\\n:]{{1,50}}?):', 1) AS labels,
             string_split_regex(s, '[^\\n:]{{1,50}}?:') AS pieces FROM d),
z AS (SELECT conv_id, labels, pieces, unnest(range(1, len(labels) + 1)) AS i FROM p),
r AS (SELECT conv_id, i, {strip('labels[i]')} AS label, {strip('pieces[i + 1]')} AS body FROM z)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS BIGINT) AS idx,
       {norm_role('label')} AS role, body AS text
FROM r WHERE body <> ''
"""


@register("dialogue_parse", _PARSE_SQL)
def dialogue_parse(spark, sf_dir):
    t = turns(spark, sf_dir)
    docs = render_dialogue(t, F.concat("role", F.lit(": "), "text"), "\n")
    return _exploded(docs, D.parse_dialogue_text("dialogue"))


# ---------------------------------------------------------------- X3 line fallback

_LINES_SQL = f"""
WITH d AS (SELECT conv_id, string_agg(role || ' - ' || text, {NL} ORDER BY turn) AS s
           FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, list_filter(list_transform(string_split_regex(s, '{LINE_BREAK_RE}'),
                                                 lambda x: {strip('x')}), lambda x: x <> '') AS lines FROM d),
z AS (SELECT conv_id, i, lines[i] AS line FROM (SELECT conv_id, lines,
             unnest(range(1, len(lines) + 1)) AS i FROM l))
SELECT conv_id, CAST(i - 1 AS BIGINT) AS idx,
       CASE WHEN regexp_matches(line, '{D.LINE_RE}')
            THEN {norm_role(strip(f"regexp_extract(line, '{D.LINE_RE}', 1)"))} ELSE 'user' END AS role,
       CASE WHEN regexp_matches(line, '{D.LINE_RE}')
            THEN {strip(f"regexp_extract(line, '{D.LINE_RE}', 2)")} ELSE line END AS text
FROM z
"""


@register("dialogue_lines", _LINES_SQL)
def dialogue_lines(spark, sf_dir):
    t = turns(spark, sf_dir)
    docs = render_dialogue(t, F.concat("role", F.lit(" - "), "text"), "\n")
    return _exploded(docs, D.parse_dialogue_text("dialogue"))


# ---------------------------------------------------------------- X4 item lists

_LIST_SQL = f"""
SELECT conv_id, turn,
  CASE turn % 5 WHEN 4 THEN 'user' ELSE {norm_role('role')} END AS map_role,
  CASE turn % 5 WHEN 3 THEN role ELSE coalesce(text, '') END AS map_text,
  {norm_role('role')} AS pair_role, coalesce(text, 'None') AS pair_text,
  CASE WHEN length(text) = 2 THEN {norm_role('substr(text, 1, 1)')} ELSE 'user' END AS scalar_role,
  CASE WHEN length(text) = 2 THEN substr(text, 2, 1) ELSE text END AS scalar_text
FROM conversations
"""


@register("dialogue_list", _LIST_SQL)
def dialogue_list(spark, sf_dir):
    t = turns(spark, sf_dir)
    k = F.col("turn") % 5
    item = (F.when(k == 0, F.create_map(F.lit("role"), "role", F.lit("text"), "text"))
            .when(k == 1, F.create_map(F.lit("speaker"), "role", F.lit("utterance"), "text"))
            .when(k == 2, F.create_map(F.lit("sender"), "role", F.lit("content"), "text"))
            .when(k == 3, F.create_map(F.lit("role"), "role", F.lit("text"), F.lit(None).cast("string"),
                                       F.lit("note"), "text"))
            .otherwise(F.create_map(F.lit("interlocutor"), "role", F.lit("message"), "text")))
    m = D.item_from_map(item)
    p = D.item_from_pair(F.array("role", "text"))
    s = D.item_from_scalar(F.col("text"))
    return t.select("conv_id", "turn", m["role"].alias("map_role"), m["text"].alias("map_text"),
                    p["role"].alias("pair_role"), p["text"].alias("pair_text"),
                    s["role"].alias("scalar_role"), s["text"].alias("scalar_text"))


# ---------------------------------------------------------------- A4 / W9 / X5 / X6

_GROUP_SQL = f"""
WITH rows AS (
  SELECT CAST(conv_id AS VARCHAR) AS transcript_id, turn * 3 + conv_id % 3 AS utterance_id,
         CASE role WHEN 'user' THEN 'client' WHEN 'assistant' THEN 'therapist' ELSE role END AS interlocutor,
         CASE WHEN turn % 3 = 0 THEN NULL ELSE text END AS utterance_text,
         CASE WHEN turn % 3 = 0 THEN text END AS text,
         CASE WHEN conv_id % 4 = 0 THEN 'low' ELSE 'High' END AS mi_quality
  FROM conversations)
SELECT transcript_id,
       CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY utterance_id) - 1 AS BIGINT) AS pos,
       CASE lower(interlocutor) WHEN 'client' THEN 'user' WHEN 'therapist' THEN 'assistant'
            ELSE {norm_role('lower(interlocutor)')} END AS role,
       coalesce(utterance_text, text, '') AS text
FROM rows WHERE lower(mi_quality) = 'high'
"""


def labelled_fixture(t):
    """Labelled-CSV shaped rows derived from the turn table (R3 columns)."""
    return t.select(
        F.col("conv_id").cast("string").alias("transcript_id"),
        (F.col("turn") * 3 + F.col("conv_id") % 3).alias("utterance_id"),
        F.when(F.col("role") == "user", "client").when(F.col("role") == "assistant", "therapist")
        .otherwise(F.col("role")).alias("interlocutor"),
        F.when(F.col("turn") % 3 == 0, None).otherwise(F.col("text")).alias("utterance_text"),
        F.when(F.col("turn") % 3 == 0, F.col("text")).alias("text"),
        F.when(F.col("conv_id") % 4 == 0, "low").otherwise("High").alias("mi_quality"))


@register("group_turns", _GROUP_SQL)
def group_turns(spark, sf_dir):
    return labelled_rows_to_turns(labelled_fixture(turns(spark, sf_dir)))


# ---------------------------------------------------------------- X7 / F7 / K1

_ASCII_WS = "[\\t\\n\\x{b}\\x{c}\\r\\x{1c}-\\x{1f} ]"
_CLEAN_SQL = f"""
WITH t AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'Clinician' WHEN 'user' THEN 'Client' END AS speaker,
                  regexp_replace(strip_accents(translate(text, '“”‘’—–', '""''''--')), '[^\\x00-\\x7F]', '', 'g') AS a
           FROM conversations),
c AS (SELECT conv_id, turn, speaker,
             regexp_replace(regexp_replace(a, '{_ASCII_WS}+', ' ', 'g'), '^ | $', '', 'g') AS clean FROM t
      WHERE speaker IS NOT NULL)
SELECT conv_id, turn, speaker, speaker || ': ' || clean || {NL} || {NL} AS line FROM c
"""


@register("clean_transcript", _CLEAN_SQL)
def clean_transcript(spark, sf_dir):
    return transcript_lines(turns(spark, sf_dir)).select("conv_id", "turn", "speaker", "line")


# the documents with characters that the JVM table has with two images (½) and that only NFKD knows (①㎏ and Ⅳ)
_UNICODE_SQL = f"""
WITH t AS (SELECT doc_id, regexp_replace(strip_accents(translate(replace(replace(text, 'ti', '1kg'), 'an', 'IV12'), '“”‘’—–', '""''''--')),
                                         '[^\\x00-\\x7F]', '', 'g') AS a FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(a, '{_ASCII_WS}+', ' ', 'g'), '^ | $', '', 'g')) AS clean_md5 FROM t"""


@register("clean_unicode", _UNICODE_SQL)
def clean_unicode(spark, sf_dir):
    wide = F.replace(F.replace("text", F.lit("ti"), F.lit("①㎏")), F.lit("an"), F.lit("Ⅳ½"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", wide.alias("text")))
    return with_clean_text(docs, "text", "clean").select("doc_id", F.md5("clean").alias("clean_md5"))


# ---------------------------------------------------------------- X9 / X10

_WRAP_SQL = f"""
CASE doc_id % 4
  WHEN 0 THEN '<think>plan ' || doc_id || '</think>' || {NL} || {NL} || text
  WHEN 1 THEN text || {NL} || '<tool_call>{{"name": "lookup"}}</tool_call>' || {NL}
  WHEN 2 THEN '<think>unclosed ' || text
  ELSE '<tool_call id=1>' || text || '</think>' || {NL} END"""


def _wrap(df):
    k = F.col("doc_id") % 4
    nl = F.lit("\n")
    return (F.when(k == 0, F.concat(F.lit("<think>plan "), F.col("doc_id").cast("string"),
                                    F.lit("</think>"), nl, nl, "text"))
            .when(k == 1, F.concat("text", nl, F.lit('<tool_call>{"name": "lookup"}</tool_call>'), nl))
            .when(k == 2, F.concat(F.lit("<think>unclosed "), "text"))
            .otherwise(F.concat(F.lit("<tool_call id=1>"), "text", F.lit("</think>"), nl)))


def _tags_sql(x: str, eat_nl: bool) -> str:
    n = "\\n*" if eat_nl else ""
    s = f"regexp_replace({x}, '(?s)<think>.*?</think>{n}', '', 'g')"
    s = f"regexp_replace({s}, '(?s)<tool_call>.*?</tool_call>{n}', '', 'g')"
    s = f"regexp_replace({s}, '</?(think|tool_call)[^>]*>{n}', '', 'g')"
    return strip(s)


_TAGS_SQL = f"""
WITH w AS (SELECT doc_id, {_WRAP_SQL} AS raw FROM documents)
SELECT doc_id, {_tags_sql('raw', False)} AS gen_text, {_tags_sql('raw', True)} AS data_text FROM w
"""


@register("strip_tags", _TAGS_SQL)
def strip_tags(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    w = d.select("doc_id", _wrap(d).alias("raw"))
    return w.select("doc_id", strip_tags_generation("raw").alias("gen_text"),
                    strip_tags_dataset("raw").alias("data_text"))


# ---------------------------------------------------------------- X8

_NUM = "([0-9]+(?:\\.[0-9]+)?)"
_LEAD = f"(?s)^{WS_CLASS}*{_NUM}{WS_CLASS}*,{WS_CLASS}*(.*)"
_REPLY_SQL = """
CASE d.doc_id % 5
  WHEN 0 THEN CAST(l.quality * 3 AS VARCHAR) || ', ' || d.text
  WHEN 1 THEN '  ' || CAST(l.quality + 2 AS VARCHAR) || '.5 ,' || d.text
  WHEN 2 THEN 'Score: ' || CAST(l.quality AS VARCHAR) || ', ' || d.text
  WHEN 3 THEN d.text
  ELSE '-' || CAST(l.quality + 1 AS VARCHAR) || ', neg ' || d.text END"""

_SCORE_SQL = f"""
WITH r AS (SELECT d.doc_id, {_REPLY_SQL} AS reply FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
s AS (SELECT doc_id, reply, {strip('reply')} AS st FROM r)
SELECT doc_id,
  CASE WHEN reply IS NULL OR reply = '' THEN NULL
       WHEN regexp_matches(st, '{_LEAD}') THEN CAST(regexp_extract(st, '{_LEAD}', 1) AS DOUBLE)
       WHEN regexp_matches(reply, '{_NUM}') THEN CAST(regexp_extract(reply, '{_NUM}', 1) AS DOUBLE) END AS score,
  CASE WHEN reply IS NULL OR reply = '' THEN ''
       WHEN regexp_matches(st, '{_LEAD}') THEN {strip(f"regexp_extract(st, '{_LEAD}', 2)")}
       ELSE st END AS explanation
FROM s
"""


def judge_reply_fixture(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    doc = table(spark, sf_dir, "documents").select("doc_id", "text")
    j = lab.join(spread(doc), "doc_id")
    k = F.col("doc_id") % 5
    q = F.col("quality")
    reply = (F.when(k == 0, F.concat((q * 3).cast("string"), F.lit(", "), "text"))
             .when(k == 1, F.concat(F.lit("  "), (q + 2).cast("string"), F.lit(".5 ,"), "text"))
             .when(k == 2, F.concat(F.lit("Score: "), q.cast("string"), F.lit(", "), "text"))
             .when(k == 3, F.col("text"))
             .otherwise(F.concat(F.lit("-"), (q + 1).cast("string"), F.lit(", neg "), "text")))
    return j.select("doc_id", reply.alias("reply"))


@register("score_parse", _SCORE_SQL)
def score_parse(spark, sf_dir):
    r = judge_reply_fixture(spark, sf_dir)
    p = parse_score("reply")
    return r.select("doc_id", p["score"].alias("score"), p["explanation"].alias("explanation"))


@register("file_stems", """
WITH n AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages)
SELECT page_id, CASE WHEN contains(name, '.') THEN left(name, length(name) - length(split_part(name, '.', -1)) - 1)
                     ELSE name END AS stem FROM n""")
def file_stems(spark, sf_dir):
    """X22 on the paths of the pages."""
    return table(spark, sf_dir, "pages").select("page_id", file_stem("url").alias("stem"))
