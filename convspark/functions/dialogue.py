"""Dialogue parsing (X2-X4): free text or item lists -> ARRAY<STRUCT<role, text>>.

Everything is a higher-order column expression (``transform``/``filter``),
so a dialogue is parsed inside the task that holds its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import LINE_BREAK_RE, ROLE_KEYS, TEXT_KEYS
from .text import _c, normalize_role, py_strip

# Fixed patterns: a label is up to 50 non-newline, non-colon chars before a colon;
# the line fallback splits "speaker<sep>text" on ':', '-' or tab runs.
LABEL_RE = "([^\\n:]{1,50}?):"
LABEL_SPLIT_RE = "[^\\n:]{1,50}?:"
LINE_RE = "^([^:\\-\\t]+)[:\\-\\t]+(.+)$"


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


LABEL_MAX = 50
# Private-use character marking label positions; texts holding it take the regex path.
_SEP = "\ue000"


def _label_of(segment: Column) -> Column:
    """Label ending at the colon that follows ``segment``: the last (at most 50)
    characters after the segment's last newline; '' when there is none."""
    cand = F.substring_index(segment, "\n", -1)
    n = F.length(cand)
    return F.when(n > LABEL_MAX, F.substring(cand, n - (LABEL_MAX - 1), LABEL_MAX)).otherwise(cand)


def _labels_linear(s: Column):
    """(labels, pieces) of the label scan in one linear pass over the colons.

    A label can only end at a colon and cannot contain a colon or newline, so the
    leftmost lazy match for each colon is exactly ``_label_of`` the text between it
    and the previous colon.  Splitting on ':' once replaces the per-position
    50-character regex probe.  ``s + '\n'`` makes the last segment label-free.
    """
    segs = F.split(F.concat(s, F.lit("\n")), ":", -1)
    labels = F.filter(F.transform(segs, _label_of), lambda x: x != "")

    def emit(g):
        lab = _label_of(g)
        return F.concat(F.substring(g, F.lit(1), F.length(g) - F.length(lab)),
                        F.when(lab != "", F.lit(_SEP)).otherwise(F.lit(":")))

    joined = F.array_join(F.transform(segs, emit), "")
    body = F.substring(joined, F.lit(1), F.length(joined) - 2)  # drop the added "\n" and ':'
    return labels, F.split(body, _SEP, -1)


def parse_labelled(c) -> Column:
    """X2: 'Speaker: text' runs. Labels may sit anywhere (Q5); text before the
    first label is dropped; empty texts are dropped."""
    s = _c(c)
    fast_labels, fast_pieces = _labels_linear(s)
    use_regex = s.contains(_SEP)
    labels = F.when(use_regex, F.regexp_extract_all(s, F.lit(LABEL_RE), 1)).otherwise(fast_labels)
    pieces = F.when(use_regex, F.split(s, LABEL_SPLIT_RE, -1)).otherwise(fast_pieces)
    texts = F.slice(pieces, 2, F.size(labels))
    zipped = F.arrays_zip(labels.alias("label"), texts.alias("body"))
    turns = F.transform(zipped, lambda z: _turn(normalize_role(py_strip(z["label"])),
                                                py_strip(z["body"])))
    return F.filter(turns, lambda t: t["text"] != "")


def parse_lines(c) -> Column:
    """Per non-blank line, 'speaker[:-\\t]+text' else the whole line as user."""
    lines = F.filter(F.transform(F.split(_c(c), LINE_BREAK_RE, -1), lambda x: py_strip(x)),
                     lambda x: x != "")

    def one(line):
        hit = line.rlike(LINE_RE)
        role = F.when(hit, normalize_role(py_strip(F.regexp_extract(line, LINE_RE, 1)))) \
            .otherwise(F.lit("user"))
        text = F.when(hit, py_strip(F.regexp_extract(line, LINE_RE, 2))).otherwise(line)
        return _turn(role, text)

    return F.transform(lines, one)


def parse_dialogue_text(c) -> Column:
    """X2 with the X3 fallback: labels if any label matches, else lines; null -> []."""
    s = _c(c)
    empty = F.array().cast("array<struct<role:string,text:string>>")
    return (F.when(s.isNull(), empty)
            .when(F.size(_labels_linear(s)[0]) > 0, parse_labelled(s))
            .otherwise(parse_lines(s)))


def item_from_map(m) -> Column:
    """X4 for one dict item: first present text key (null value -> first string
    value of the item, Q6), first present role key, role normalised."""
    m = _c(m)
    text = F.lit(None).cast("string")
    for k in reversed(TEXT_KEYS):
        text = F.when(F.map_contains_key(m, k), F.try_element_at(m, F.lit(k))).otherwise(text)
    first_val = F.try_element_at(F.filter(F.map_values(m), lambda v: v.isNotNull()), F.lit(1))
    text = F.coalesce(text, first_val, F.lit(""))
    role = F.lit(None).cast("string")
    for k in reversed(ROLE_KEYS):
        role = F.when(F.map_contains_key(m, k), F.try_element_at(m, F.lit(k))).otherwise(role)
    return _turn(normalize_role(role), text)


def item_from_pair(a) -> Column:
    """X4 for a list item: a 2-element item is (speaker, text); anything else is user text
    rendered the way Python prints a list."""
    a = _c(a)
    rendered = F.concat(F.lit("["), F.array_join(
        F.transform(a, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    return F.when(F.size(a) == 2, _turn(normalize_role(a[0]), F.coalesce(a[1], F.lit("None")))) \
        .otherwise(_turn(F.lit("user"), rendered))


def item_from_scalar(s) -> Column:
    """X4 for a string item: a 2-character string unpacks as (speaker, text) (Q6)."""
    s = _c(s)
    return F.when(F.length(s) == 2,
                  _turn(normalize_role(F.substring(s, 1, 1)), F.substring(s, 2, 1))) \
        .otherwise(_turn(F.lit("user"), s))


def parse_dialogue_list(c, kind: str = "map") -> Column:
    """X4 on a whole list column: kind in {'map', 'pair', 'scalar'}."""
    fn = {"map": item_from_map, "pair": item_from_pair, "scalar": item_from_scalar}[kind]
    return F.transform(_c(c), fn)
