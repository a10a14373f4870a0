"""String functions on columns: roles, stripping, cleaning, tags, stamps.

All of these stay JVM-side (codegen'd built-ins) except ``nfkd_ascii``,
an Arrow pandas UDF applied only to rows that hold non-ASCII text.
"""


from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (CLEAN_REPLACEMENTS, J_NON_WS, PY_WHITESPACE, ROLE_EXACT_ASSISTANT,
                         ROLE_EXACT_USER, ROLE_SUBSTR_ASSISTANT, ROLE_SUBSTR_USER)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace incl. \\x1c-\\x1f on both ends (Q2)."""
    return F.trim(_c(c), F.lit(PY_WHITESPACE))


def word_count(c) -> Column:
    """``len(str(x).split())`` — whitespace word count; 0 for empty, null stays null."""
    return F.regexp_count(_c(c), F.lit(f"(?U){J_NON_WS}+")).cast("long")


def normalize_role(c) -> Column:
    """Free-form role/speaker label -> 'user' | 'assistant'.

    Exact lists first, then substrings, everything else (system, unknown,
    null) is 'user' — the same precedence as the source behaviour (Q4).
    """
    r = F.lower(_c(c).cast("string"))

    def any_sub(words):
        return reduce(lambda a, b: a | b, [r.contains(w) for w in words])
    return (F.when(_c(c).isNull(), F.lit("user"))
            .when(r.isin(*ROLE_EXACT_ASSISTANT), F.lit("assistant"))
            .when(r.isin(*ROLE_EXACT_USER), F.lit("user"))
            .when(any_sub(ROLE_SUBSTR_USER), F.lit("user"))
            .when(any_sub(ROLE_SUBSTR_ASSISTANT), F.lit("assistant"))
            .otherwise(F.lit("user")))


def interlocutor_role(c) -> Column:
    """Labelled-CSV interlocutor -> role (client/therapist, else X1).

    ``str(NaN).lower()`` is 'nan', which X1 maps to user; null behaves the same.
    """
    r = F.lower(F.coalesce(_c(c).cast("string"), F.lit("nan")))
    return (F.when(r == "client", F.lit("user"))
            .when(r == "therapist", F.lit("assistant"))
            .otherwise(normalize_role(r)))


def first_text(*cols) -> Column:
    """First non-null of the given text columns, else ''."""
    return F.coalesce(*[_c(c).cast("string") for c in cols], F.lit(""))


def sample_role(c) -> Column:
    """X25 role rule: 'user' stays, any other role becomes 'assistant'."""
    return F.when(_c(c) == "user", F.lit("user")).otherwise(F.lit("assistant"))


# ---------------------------------------------------------------- X7 cleaning
def _nfkd_ascii_udf():
    import pandas as pd

    @F.pandas_udf("string")
    def nfkd_ascii(s: pd.Series) -> pd.Series:
        import unicodedata
        return s.map(lambda x: None if x is None else
                     unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii"))
    return nfkd_ascii


_NFKD = None


def nfkd_ascii(c) -> Column:
    """NFKD then drop non-ASCII (no Spark built-in does NFKD): Arrow pandas UDF."""
    global _NFKD
    if _NFKD is None:
        _NFKD = _nfkd_ascii_udf()
    return _NFKD(_c(c))


def pandas_token_counter(encode):
    """U-4: wrap any tokenizer ``encode(text) -> ids`` as an Arrow pandas UDF that
    returns the token count.  The default everywhere is the JVM-side whitespace
    count (``word_count``), which needs no Python."""
    import pandas as pd

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else len(encode(x))).astype("Int64")

    return lambda c: count(_c(c))


def _pre_clean(c) -> Column:
    src = "".join(CLEAN_REPLACEMENTS.keys())
    dst = "".join(CLEAN_REPLACEMENTS.values())
    return F.translate(_c(c), src, dst)


_ASCII_WS = "[\\t\\n\\x{b}\\x{c}\\r\\x{1c}-\\x{1f} ]"


def _post_clean(c) -> Column:
    # a single space stays as it is, so only other runs are matched; then nothing but spaces is left to trim
    collapsed = F.regexp_replace(_c(c), f"[\\t\\n\\x{{b}}\\x{{c}}\\r\\x{{1c}}-\\x{{1f}}]{_ASCII_WS}*| {_ASCII_WS}+", " ")
    return F.trim(collapsed)


def clean_text_ascii(c) -> Column:
    """X7 for text that is already ASCII after the quote/dash replacements."""
    return _post_clean(_pre_clean(c))


# Blocks whose NFKD-then-ASCII image is tabulated for the JVM: Latin-1 and Latin
# Extended A/B, IPA, spacing modifiers and combining marks, general punctuation,
# super/subscripts, currency, letterlike symbols, number forms, Latin ligatures and
# fullwidth ASCII.  Text with characters outside them goes to the Python UDF.
NFKD_BLOCKS = [(0x0080, 0x036F), (0x2000, 0x215F), (0xFB00, 0xFB06), (0xFF01, 0xFF5E)]


def _nfkd_table():
    """Per-character NFKD+ASCII images, derived from Python's own ``unicodedata``.

    Applying them character by character is exact: NFKD only decomposes, and the
    canonical reordering it adds moves combining marks, which are non-ASCII and
    dropped anyway.  Returns (single-char sources, their images, dropped chars,
    multi-char (source, image) pairs)."""
    import unicodedata
    src, dst, drop, multi = [], [], [], []
    for lo, hi in NFKD_BLOCKS:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            img = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")
            if len(img) == 1:
                src.append(ch)
                dst.append(img)
            elif not img:
                drop.append(ch)
            else:
                multi.append((ch, img))
    return "".join(src), "".join(dst), "".join(drop), multi


_TABLE = None


def nfkd_ascii_jvm(c) -> Column:
    """NFKD + drop non-ASCII for the tabulated blocks as one ``translate``.

    Characters outside the blocks, and the few with multi-character images, are
    left untouched (still non-ASCII)."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _nfkd_table()
    src, dst, drop, _multi = _TABLE
    # one translate: single-character images map, empty images are deleted (source
    # characters past the end of the target string)
    return F.translate(_c(c), src + drop, dst)


def nfkd_multi_jvm(c) -> Column:
    """The tabulated characters with images of several characters (fractions, ligatures, digraphs) written out,
    one replacement of the whole text for each such character that it holds."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _nfkd_table()
    images = F.create_map(*[F.lit(x) for pair in _TABLE[3] for x in pair])
    found = F.array_distinct(F.regexp_extract_all(_c(c), F.lit("([^\\x00-\\x7F])"), F.lit(1)))
    known = F.filter(found, lambda ch: F.try_element_at(images, ch).isNotNull())
    return F.aggregate(known, _c(c), lambda text, ch: F.replace(text, ch, F.try_element_at(images, ch)))


#: A character outside ASCII and the tabulated blocks.
UNTABLED = "[^\\x00-\\x7F" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in NFKD_BLOCKS) + "]"


def with_clean_text(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """X7 on a DataFrame: quotes/dashes -> ASCII, NFKD, drop non-ASCII, collapse spaces, strip.

    NFKD runs in the JVM for the tabulated blocks (all European Latin text).  The Arrow UDF gets the texts
    that hold other characters, and nulls for all others, so the input is scanned once; a text takes one
    of the two ways only, and ASCII neither.
    """
    pre = df.withColumn("_pre", _pre_clean(text_col))
    pre = pre.withColumn("_py", nfkd_ascii(F.when(F.col("_pre").rlike(UNTABLED), F.col("_pre"))))
    # an array of one: the lambda's variable holds the translated text, so that it is made once
    jvm = F.transform(F.array(nfkd_ascii_jvm("_pre")), nfkd_multi_jvm)[0]
    plain = F.coalesce("_py", F.when(F.col("_pre").rlike("[^\\x00-\\x7F]"), jvm).otherwise(F.col("_pre")))
    return pre.withColumn(out, _post_clean(plain)).drop("_pre", "_py")


# ---------------------------------------------------------------- X9 / X10 tags
def strip_tags_generation(c) -> Column:
    """Remove think/tool_call blocks and stray tags from a generation, then strip."""
    s = F.regexp_replace(_c(c), "(?s)<think>.*?</think>", "")
    s = F.regexp_replace(s, "(?s)<tool_call>.*?</tool_call>", "")
    s = F.regexp_replace(s, "</?(think|tool_call)[^>]*>", "")
    return py_strip(_if_tagged(c, s))


def _if_tagged(c, cleaned: Column) -> Column:
    """Run the regex chain only on texts that can hold a tag (two substring probes)."""
    c = _c(c)
    return F.when(c.contains("think") | c.contains("tool_call"), cleaned).otherwise(c)


def strip_tags_dataset(c) -> Column:
    """Like X9 but each removal also eats the newlines that follow (Q21)."""
    s = F.regexp_replace(_c(c), "(?s)<think>.*?</think>\\n*", "")
    s = F.regexp_replace(s, "(?s)<tool_call>.*?</tool_call>\\n*", "")
    s = F.regexp_replace(s, "</?(think|tool_call)[^>]*>\\n*", "")
    return py_strip(_if_tagged(c, s))


# ---------------------------------------------------------------- misc scalars
def verdict_yes(c) -> Column:
    """End verdict is 'Yes' or 'yes' anywhere in the reply (not 'YES'; Q18)."""
    return _c(c).contains("Yes") | _c(c).contains("yes")


def file_stem(c) -> Column:
    """File name without directory and last extension."""
    name = F.regexp_extract(_c(c), "([^/]*)$", 1)
    return F.regexp_replace(name, "\\.[^.]*$", "")


def iso_z(c) -> Column:
    """``datetime.isoformat() + 'Z'`` — fraction printed only when non-zero."""
    ts = _c(c)
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "SSSSSS")
    return F.when(ts.isNull(), None).otherwise(
        F.concat(base, F.when(frac == "000000", F.lit("")).otherwise(F.concat(F.lit("."), frac)),
                 F.lit("Z")))


def file_stamp(c) -> Column:
    """``%Y%m%dT%H%M%S`` stamp used in transcript file names."""
    return F.date_format(_c(c), "yyyyMMdd'T'HHmmss")


def local_stamp(c) -> Column:
    """``%Y-%m-%d %H:%M:%S`` in the session time zone."""
    return F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss")


def elapsed_hms(seconds) -> Column:
    """Seconds -> HH:MM:SS; Python round() is half-even; hours unbounded."""
    total = F.bround(_c(seconds).cast("double"), 0).cast("long")
    return F.when(total.isNull(), F.lit(None)).otherwise(F.format_string("%02d:%02d:%02d", F.floor(total / 3600).cast("long"),
                           F.floor((total % 3600) / 60).cast("long"), (total % 60).cast("long")))


def window_size_from_model(c) -> Column:
    """first ``_w(\\d+)`` in a model name, else null."""
    return F.expr(f"try_cast(nullif(regexp_extract({_sql(c)}, '_w(\\\\d+)', 1), '') as int)")


def _sql(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("pass a column name")
