"""Chat request / completion JSON checks on Spark's VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (COMPLETION_FINISH, COMPLETION_OBJECT, REQ_BAD_ITEM, REQ_INVALID_JSON,
                         REQ_NO_MESSAGES, REQ_NOT_LIST)
from .text import _c, py_strip


def _falsy(m: Column) -> Column:
    """Python truthiness of a parsed JSON value: None, [], {}, '', 0, false are falsy."""
    t = F.schema_of_variant(m)
    return (m.isNull() | F.is_variant_null(m)
            | (t.startswith("ARRAY") & (F.size(F.try_variant_get(m, "$", "array<variant>")) == 0))
            | ((t == "STRING") & (F.try_variant_get(m, "$", "string") == ""))
            | ((t == "BOOLEAN") & ~F.try_variant_get(m, "$", "boolean"))
            | ((t == "OBJECT<>"))
            | ((t.startswith("BIGINT") | t.startswith("DECIMAL") | t.startswith("DOUBLE")
                | t.startswith("FLOAT") | t.startswith("INT"))
               & (F.try_variant_get(m, "$", "double") == 0)))


def request_check(body) -> Column:
    """struct(error STRING, n_messages INT) for one request body; error null = valid.

    Order of checks: JSON parses; ``messages`` present and truthy; is a list;
    every item is an object with ``role`` and ``content`` (first bad index named).
    """
    v = F.try_parse_json(_c(body))
    m = F.try_variant_get(v, "$.messages", "variant")
    arr = F.try_variant_get(m, "$", "array<variant>")
    ok = F.transform(arr, lambda x: F.schema_of_variant(x).startswith("OBJECT")
                     & F.try_variant_get(x, "$.role", "variant").isNotNull()
                     & F.try_variant_get(x, "$.content", "variant").isNotNull())
    bad = F.array_position(ok, F.lit(False))
    err = (F.when(v.isNull(), F.lit(REQ_INVALID_JSON))
           .when(_falsy(m), F.lit(REQ_NO_MESSAGES))
           .when(~F.schema_of_variant(m).startswith("ARRAY"), F.lit(REQ_NOT_LIST))
           .when(bad > 0, F.concat(F.lit(REQ_BAD_ITEM.split("{i}")[0]), (bad - 1).cast("string"))))
    return F.struct(err.alias("error"), F.when(err.isNull(), F.size(arr)).alias("n_messages"))


def completion_record(rid, created, model, content, prompt_tokens, completion_tokens) -> Column:
    """OpenAI-style chat completion as a JSON string (id supplied, not random)."""
    rec = F.struct(
        _c(rid).alias("id"), F.lit(COMPLETION_OBJECT).alias("object"), _c(created).alias("created"),
        _c(model).alias("model"),
        F.array(F.struct(F.lit(0).alias("index"),
                         F.struct(F.lit("assistant").alias("role"), _c(content).alias("content")).alias("message"),
                         F.lit(COMPLETION_FINISH).alias("finish_reason"))).alias("choices"),
        F.struct(_c(prompt_tokens).alias("prompt_tokens"), _c(completion_tokens).alias("completion_tokens"),
                 (_c(prompt_tokens) + _c(completion_tokens)).alias("total_tokens")).alias("usage"))
    return F.to_json(rec)


def completion_content(response) -> Column:
    """struct(content, error): ``choices[0].message.content`` stripped, or the client's error."""
    v = F.try_parse_json(_c(response))
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    choices = F.try_variant_get(v, "$.choices", "variant")
    carr = F.try_variant_get(choices, "$", "array<variant>")
    first = F.try_element_at(carr, F.lit(1))
    content = F.try_variant_get(first, "$.message.content", "string")
    has_content = F.try_variant_get(first, "$.message.content", "variant").isNotNull()
    err = (F.when(v.isNull(), F.lit("Invalid JSON returned by server"))
           .when(~is_obj | choices.isNull(), F.lit("Unexpected response from server"))
           .when(carr.isNull() | (F.size(carr) == 0), F.lit("No completion choices returned by server"))
           .when(~has_content, F.lit("Invalid completion format from server")))
    return F.struct(F.when(err.isNull(), py_strip(content)).alias("content"), err.alias("error"))
