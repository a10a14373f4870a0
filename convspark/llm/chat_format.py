"""Chat formatting: event-sourced conversations folded into messages, then rendered.

An event is ``(conv_id, seq, kind, msg, role, text)``.  ``msg`` is the message it concerns and
orders the messages of a conversation; ``kind`` is one of

* ``message`` / ``edit``: the message's text is now this text;
* ``delta``: this text is appended to the message (a streamed reply);
* ``regenerate``: the message's text is now this text, and every later message written before
  this event is withdrawn (the dialogue went on from the old reply).

The template is ``### role: text</turn>`` plus a line end per message.  Inside texts and roles
``\\``, ``<``, ``#`` (and ``:`` in roles) are written as ``\\b``, ``\\l``, ``\\h``, ``\\c``, so a raw
``#`` or ``<`` occurs in markers only and the formatted string can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"


def escape(c: Column) -> Column:
    for raw, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for code, raw in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\b", "\\")):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, msg, role, text)`` of an event log.

    Events of one message are sorted by ``seq`` (ties: by kind, then text) and folded; the last
    non-null role wins.  Null texts count as empty, an unknown or null kind as ``delta``.  First
    the deltas of each message are folded (grouped by conversation and message, so a long
    conversation spreads over tasks), then one running maximum per conversation withdraws what a
    regeneration cut off.
    """
    kind = F.coalesce(F.col("kind"), F.lit("delta"))
    ev = F.struct(F.col("seq").alias("seq"), kind.alias("kind"),
                  F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("role"))
    resets = ("message", "edit", "regenerate")
    msgs = (events.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(ev)).alias("ev"))
            .withColumn("from", F.greatest(F.lit(1), F.array_max(F.transform(
                "ev", lambda e, i: F.when(e.kind.isin(*resets), i + 1).otherwise(0))))))
    live = F.expr("slice(ev, `from`, size(ev))")
    msgs = msgs.select(
        "conv_id", "msg",
        F.array_join(F.transform(live, lambda e: e.text), "").alias("text"),
        F.try_element_at(F.filter(F.transform("ev", lambda e: e.role), lambda r: r.isNotNull()), F.lit(-1)).alias("role_"),
        F.element_at(F.expr("ev.seq"), F.col("from").cast("int")).alias("made"),
        F.array_max(F.transform("ev", lambda e: F.when(e.kind == "regenerate", e.seq))).alias("regen"))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    return (msgs.withColumn("cut", F.max("regen").over(before))
            .where(F.col("cut").isNull() | (F.col("made") > F.col("cut")))
            .select("conv_id", "msg", F.col("role_").alias("role"), "text"))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans, n_turns``.

    ``loss_spans`` is an array of ``(start, end)`` code-point offsets into ``formatted`` (end
    exclusive): the escaped text of every ``loss_role`` message, in order, without markers.  Null
    conversation ids form one conversation; a null role renders as an empty one.  The result of
    a conversation is one row, so a conversation has to fit a cell; everything before the last
    grouping is per message.
    """
    return render(fold_events(events), loss_role)


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``format_chats`` on messages that are folded already."""
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit(":"), F.lit("\\c"))
    head = F.concat(F.lit("### "), role, F.lit(": "))
    body = escape(F.coalesce("text", F.lit("")))
    upto = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    m = (messages.select("conv_id", "msg", "role", head.alias("head"), body.alias("body"))
         .withColumn("size", (F.length("head") + F.length("body") + len(END)).cast("long"))
         .withColumn("at", F.coalesce(F.sum("size").over(upto), F.lit(0).cast("long")) + F.length("head"))
         .withColumn("span", F.when(F.col("role") == loss_role,
                                    F.struct(F.col("at").alias("start"),
                                             (F.col("at") + F.length("body")).alias("end")))))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("msg").alias("msg"), F.concat("head", "body", F.lit(END)).alias("piece"),
        F.col("span").alias("span")))).alias("ms"))
    return g.select("conv_id",
                    F.array_join(F.transform("ms", lambda x: x.piece), "").alias("formatted"),
                    F.filter(F.transform("ms", lambda x: x.span), lambda s: s.isNotNull()).alias("loss_spans"),
                    F.size("ms").cast("long").alias("n_turns"))


def read_back(formatted: Column) -> Column:
    """The array of ``(role, text)`` that a formatted string was made of."""
    pieces = F.filter(F.split(formatted, END, -1), lambda p: p != "")
    rest = F.lit(1 << 30)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, F.lit(5), rest), ": ", 1)).alias("role"),
        unescape(F.substring(p, F.locate(": ", p) + 2, rest)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, spans joined with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
