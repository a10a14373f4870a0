"""Prompt building from patient profiles (F8, F9, X12-X16, J5 splice)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (COGNITIVE_MODEL_FIELDS, PROFILE_BLANK_EXACT, PROFILE_BLANK_SUBSTR,
                         PROFILE_HISTORY_END, PROFILE_HISTORY_START, PROFILE_SECTION_END,
                         PROFILE_SECTION_START)
from .text import _c

_SLOT = re.compile(r"\$(?:(\$)|([_a-z][_a-z0-9]*)|\{([_a-z][_a-z0-9]*)\})", re.IGNORECASE)


def validate(c) -> Column:
    """F8: blank out non-informative values ('' for null, 'unknown', 'n/a', ...)."""
    v = _c(c)
    low = F.lower(v)
    blank = v.isNull() | low.isin(*PROFILE_BLANK_EXACT)
    for s in PROFILE_BLANK_SUBSTR:
        blank = blank | low.contains(s)
    return F.when(blank, F.lit("")).otherwise(v)


def keys_with(m, word: str, negate: bool = False) -> Column:
    """lower-cased keys of a MAP<STRING,STRING> whose lower-cased value
    contains ``word`` (or does not, with ``negate``), in map order."""
    picked = F.map_filter(_c(m), (lambda k, v: ~F.lower(v).contains(word)) if negate
                          else (lambda k, v: F.lower(v).contains(word)))
    return F.transform(F.map_keys(picked), lambda k: F.lower(k))


def bullet(label: str, value) -> Column:
    """``- label: value\\n`` when the validated value is non-empty, else ''."""
    v = validate(value)
    return F.when(v == "", F.lit("")).otherwise(F.concat(F.lit(f"- {label}: "), v, F.lit("\n")))


def sub_list(label: str, groups: list[tuple[Column, str]]) -> Column:
    """``- label\\n`` + ``  - item: tag\\n`` lines for each (items, tag) group; '' when no items."""
    def line(tag):
        return lambda k: F.concat(F.lit("  - "), k, F.lit(f": {tag}\n"))
    items = F.concat(*[F.array_join(F.transform(arr, line(tag)), "") for arr, tag in groups])
    return F.when(items == "", F.lit(None)).otherwise(F.concat(F.lit(f"- {label}\n"), items))


def safe_substitute(template: str, values: dict[str, Column]) -> Column:
    """``string.Template.safe_substitute`` as a column.

    The template is split into literal pieces and slots once, on the driver;
    a slot with a value becomes that column (inserted as-is, never re-scanned),
    a slot without a value stays in the text literally, ``$$`` becomes ``$``.
    A value column that is null also leaves its slot in place.
    """
    parts: list[Column] = []
    pos = 0
    for m in _SLOT.finditer(template):
        parts.append(F.lit(template[pos:m.start()]))
        if m.group(1):
            parts.append(F.lit("$"))
        else:
            name = m.group(2) or m.group(3)
            if name in values:
                parts.append(F.coalesce(values[name], F.lit(m.group(0))))
            else:
                parts.append(F.lit(m.group(0)))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def profile_section(prompt) -> Column:
    """X14: '## PROFILE\\n' + text between the last 'YOUR PROFILE:' and the next 'YOUR TASK:'."""
    after = F.substring_index(_c(prompt), PROFILE_SECTION_START, -1)
    return F.concat(F.lit("## PROFILE\n"), F.substring_index(after, PROFILE_SECTION_END, 1))


def cognitive_models_block(models) -> Column:
    """Numbered 'Model i:' blocks; empty fields skipped; blank line after each."""
    def one(m, i):
        lines = [F.when(F.coalesce(m[f], F.lit("")) == "", F.lit(""))
                 .otherwise(F.concat(F.lit(f"  - {label}: "), m[f], F.lit("\n")))
                 for f, label in COGNITIVE_MODEL_FIELDS]
        return F.concat(F.lit("Model "), (i + 1).cast("string"), F.lit(":\n"), *lines, F.lit("\n"))
    return F.array_join(F.transform(F.coalesce(_c(models), F.array()), one), "")


_HISTORY_RE = f"(?s){re.escape(PROFILE_HISTORY_START)}(.*?){re.escape(PROFILE_HISTORY_END)}"


def history_section(prompt) -> Column:
    """Text between 'Patient History:' and the next 'In the upcoming conversation'; '' if absent."""
    return F.regexp_extract(_c(prompt), _HISTORY_RE, 1)


def splice_history(prompt, new_history) -> Column:
    """Replace that whole span with 'Patient History: <new>\\n\\nIn the upcoming conversation'.

    Spliced literally (no regex replacement escapes), first span only; a prompt
    without the span is returned unchanged (Q12)."""
    p = _c(prompt)
    start = F.instr(p, PROFILE_HISTORY_START)
    rest = F.substring(p, start + len(PROFILE_HISTORY_START), 1 << 30)
    end_rel = F.instr(rest, PROFILE_HISTORY_END)
    tail = F.substring(rest, end_rel + len(PROFILE_HISTORY_END), 1 << 30)
    new = F.concat(F.lit(f"{PROFILE_HISTORY_START} "), _c(new_history),
                   F.lit(f"\n\n{PROFILE_HISTORY_END}"))
    found = (start > 0) & (end_rel > 0)
    return F.when(found, F.concat(F.substring(p, 1, start - 1), new, tail)).otherwise(p)
