"""DuckDB SQL fragments that mirror the Spark column expressions.

Written independently of the Spark code: they state the same rules in
DuckDB's dialect (RE2 regexes, list functions) so the oracle is a second
implementation, not a copy of the plan.
"""

from __future__ import annotations

from ..constants import (NON_WS_CLASS, ROLE_EXACT_ASSISTANT, ROLE_EXACT_USER,
                         ROLE_SUBSTR_ASSISTANT, ROLE_SUBSTR_USER, WS_CLASS)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{NON_WS_CLASS}+')) AS BIGINT)"


def norm_role(x: str) -> str:
    lx = f"lower({x})"
    sub_u = " OR ".join(f"contains({lx}, {q(w)})" for w in ROLE_SUBSTR_USER)
    sub_a = " OR ".join(f"contains({lx}, {q(w)})" for w in ROLE_SUBSTR_ASSISTANT)
    return (f"(CASE WHEN {x} IS NULL THEN 'user' "
            f"WHEN {lx} IN {in_list(ROLE_EXACT_ASSISTANT)} THEN 'assistant' "
            f"WHEN {lx} IN {in_list(ROLE_EXACT_USER)} THEN 'user' "
            f"WHEN {sub_u} THEN 'user' WHEN {sub_a} THEN 'assistant' ELSE 'user' END)")
