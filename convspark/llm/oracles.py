"""DuckDB SQL for the operators that SQL can express; the others are tested against brute force."""

from __future__ import annotations

_ANY_CASE = {w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
             for w in ("password", "passwd", "secret", "token", "api_?key")}

# (kind, regex, group, least) in the order in which ties are listed; the first three are the base
_RULES = (
    ("assign", "(" + "|".join(_ANY_CASE.values()) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)


def _secret_rule(ord_: int, kind: str, regex: str, group: int, least: int) -> str:
    r = "'" + regex.replace("'", "''") + "'"
    return f"""
SELECT rid, {ord_} AS ord, '{kind}' AS kind,
       list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s,
       length(hits[i]) AS n
FROM (SELECT rid, gaps, hits, keys, unnest(generate_series(1, len(hits))) AS i
      FROM (SELECT rid, string_split_regex(t, {r}) AS gaps, regexp_extract_all(t, {r}) AS hits,
                   regexp_extract_all(t, {r}, {group}) AS keys
            FROM docs WHERE regexp_matches(t, {r})))
WHERE length(keys[i]) >= {least}"""


_SECRETS = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(_secret_rule(i, *r) for i, r in enumerate(_RULES))}),
per AS (SELECT rid,
               count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
               string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, ord) FILTER (ord < 3) AS base,
               string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, ord) AS spans
        FROM found GROUP BY rid)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per p ON p.rid = d.rid
"""

_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def _escaped(col: str) -> str:
    return f"(2 * length({col}) - length(translate({col}, '\\<#', '')))"


_CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
             CAST(sum(4 + length(role) + 2 + {_escaped('text')} + 8) AS BIGINT) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars FROM g
"""

ORACLES = {"op2_secret_scan": _SECRETS, "op6_exact_dedup": _DEDUP, "op7_chat_format": _CHAT}
