"""Ordered folds over streams with bounded state per key and block.

Rows of a key may arrive in any order and over any number of micro-batches.  Leaves hold the rows of one (key,
block of positions) and sum them up, where asked those of a bucket of keys together: calling an operator costs some
milliseconds per group, so groups of a row or two would spend all time on that; nodes hold the summaries of ``fan`` neighbouring children each, level by
level, and the last ones those of a whole key.  A batch touches only the blocks it has rows for: a key with a
third of all rows spreads over tasks by block, and the state of a block does not grow with its key's history.

Spark allows one such operator to a query, so each level is a streaming query of its own
(``applyInPandasWithState``), fed by the files that the level below commits.  An operator answers what its rows or
summaries settle and passes answers from below through.  An answer is sent again when it changes; its ``rev`` is
the time of the leaves' batch that it rests on, so the row with the highest ``rev`` counts, also
while the levels run side by side.
"""

import json
import zlib
from dataclasses import dataclass
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIRST_BLOCK = -(1 << 40)  # of rows without a position, which come first


def in_order(row: list) -> list:
    """Sort key of a row: column by column, nulls first."""
    return [(x is not None, x) for x in row]


class EndWork:
    """Streaks: the first position where ``threshold`` yes rows in a row end, and how many rows lie after it.

    A block's summary says, for each streak that may enter it, where the end falls (position, rows after it)
    or which streak leaves it; summaries of neighbours join into one of the same form."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def leaf(self, rows: list) -> tuple[dict, dict]:
        by = []
        for streak in range(self.threshold):
            end = None
            for n, (at, yes) in enumerate(rows):
                streak = streak + 1 if yes else 0
                if streak >= self.threshold:
                    end, streak = [at, sum(r[0] > at for r in rows[n + 1:])], 0
                    break
            by.append([end, streak])
        return {}, {"n": len(rows), "by": by}

    def join(self, children: list[dict], whole: bool) -> tuple[dict, dict]:
        by = []
        for streak in range(self.threshold):
            end = None
            for c in children:
                if end:
                    end = [end[0], end[1] + c["n"]]
                else:
                    end, streak = c["by"][streak]
            by.append([end, 0 if end else streak])
        end = by[0][0]
        # an end may also vanish again, when a no between its rows arrives late
        answers = {"end": ["end", end[0], self.threshold, end[1]] if end else [None] * 4} if whole else {}
        return answers, {"n": sum(c["n"] for c in children), "by": by}


class FrameWork:
    """Frames: each asking row with the ``back`` rows before it.  A block's summary is its first and its last
    ``back`` rows; a row is answered where that many rows before it are known, or at the whole key."""

    def __init__(self, back: int):
        self.back = back

    def asks(self, row: list) -> bool:
        raise NotImplementedError

    def name(self, row: list) -> str:
        raise NotImplementedError

    def answer(self, row: list, before: list) -> list:
        raise NotImplementedError

    def leaf(self, rows: list) -> tuple[dict, dict]:
        h = self.back
        answers = {self.name(r): self.answer(r, rows[n - h:n]) for n, r in enumerate(rows) if n >= h and self.asks(r)}
        return answers, {"n": len(rows), "head": rows[:h], "tail": rows[max(0, len(rows) - h):]}

    def join(self, children: list[dict], whole: bool) -> tuple[dict, dict]:
        h, seen, head, tail, answers = self.back, 0, [], [], {}
        for c in children:
            for n, r in enumerate(c["head"]):
                before = (tail + c["head"][:n])[-h:]
                if self.asks(r) and (whole or seen + n >= h):
                    answers[self.name(r)] = self.answer(r, before)
            head = (head + c["head"])[:h]
            tail = c["tail"] if c["n"] >= h else (tail + c["tail"])[-h:]
            seen += c["n"]
        return answers, {"n": seen, "head": head, "tail": tail}


@dataclass
class Fold:
    """``leaves``: the stream of the first level's rows ``key, block, name, body, rev`` (``name`` is null on
    summaries).  ``levels``: each makes the next level's rows from a stream of those below.  ``answers`` takes the
    last level's rows, as a stream or a table."""

    leaves: DataFrame
    levels: list[Callable[[DataFrame], DataFrame]]
    answers: Callable[[DataFrame], DataFrame]


def _changes(key: str | None, block: int, sent: dict, answers: dict, summary, rev: int) -> tuple[list[tuple], dict]:
    """The answers, and the summary, that differ from what was sent, and marks of what has been sent now."""
    rows, now = [], {}
    for name, body in [*answers.items(), *([] if summary is None else [(None, summary)])]:
        if isinstance(body, list) and name not in sent and not any(x is not None for x in body):
            continue  # nothing to take back
        text = json.dumps(body)
        now[name or ""] = mark = zlib.crc32(text.encode())
        if sent.get(name or "") != mark:
            rows.append((key, block, name, text, rev))
    return rows, now


def fold(rows: DataFrame, key: str, row: Column, block: Column, work, out: str, fan: int = 256, levels: int = 0,
         idle: str | None = None, buckets: int | None = None) -> Fold:
    """``key, *out, rev`` for every changed answer of ``work``.

    ``row`` is the row as an object's JSON text, ``block`` its block's number, which never falls along the
    order of rows.  ``levels`` operators of ``fan`` children lie between the leaves and the whole key, which
    then holds a summary per ``fan ** levels`` blocks.  ``idle`` forgets blocks that had no row for so long:
    rows that come for one later start it anew.  ``buckets``: the leaves of so many hash buckets of keys share a
    group per block, for blocks that few rows of a key fall in; the state of a group is then a bucket's rows of
    one block.  A key goes through text there and back.
    """
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("block", T.LongType()),
                           T.StructField("name", T.StringType()), T.StructField("body", T.StringType()),
                           T.StructField("rev", T.LongType())])
    names = schema.names
    timeout = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    mode = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def leaf(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, block = state.getCurrentProcessingTimeMs(), int(group[1])
        keys = {k: v for k, *v in json.loads(state.get[0])} if state.exists else {}
        if timeout:
            keys = {k: v for k, v in keys.items() if now - v[2] < timeout}
        fresh, changed = {}, []
        for pdf in pdfs:
            for k, x in zip(pdf["_key"], pdf["row"]):
                fresh.setdefault(k, []).append(list(json.loads(x).values()))
        for k, more in fresh.items():
            held, sent, _ = keys.get(k, ([], {}, 0))
            held = sorted(held + more, key=in_order)
            rows, sent = _changes(k, block, sent, *work.leaf(held), now)
            changed += rows
            keys[k] = [held, sent, now]
        state.update((json.dumps([[k, *v] for k, v in keys.items()]),))
        if timeout:
            state.setTimeoutDuration(timeout)
        yield pd.DataFrame(changed, columns=names, dtype=object)

    def node(whole: bool):
        def step(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            children, sent = state.get if state.exists else ("{}", "{}")
            children, fresh = json.loads(children), False
            for pdf in pdfs:
                below = pdf["name"].isna()
                for block, body, rev in zip(pdf["block"][below], pdf["body"][below], pdf["rev"][below]):
                    if children.get(str(block), (0,))[0] <= rev:
                        children[str(block)] = (int(rev), body)
                    fresh = True
                if not below.all():
                    yield pdf[~below].assign(block=group[1])[names]
            if fresh:
                order = sorted(children, key=int)
                answers, summary = work.join([json.loads(children[b][1]) for b in order], whole)
                k = None if pd.isna(group[0]) else group[0]
                changed, sent = _changes(k, group[1], json.loads(sent), answers, None if whole else summary,
                                         max(c[0] for c in children.values()))
                state.update((json.dumps(children), json.dumps(sent)))
                yield pd.DataFrame(changed, columns=names, dtype=object)

        def level(below: DataFrame) -> DataFrame:
            up = F.lit(0).cast("long") if whole else F.floor(F.col("block") / fan).cast("long")
            return below.withColumn("above", up).groupBy(key, "above").applyInPandasWithState(
                step, schema, "children string, sent string", "append", GroupStateTimeout.NoTimeout)

        return level

    text_key = F.col(key).cast("string")
    group = text_key if buckets is None else F.pmod(F.xxhash64(key), F.lit(buckets))
    d = rows.select(group.alias("_group"), F.coalesce(block.cast("long"), F.lit(FIRST_BLOCK)).alias("block"),
                    text_key.alias("_key"), row.alias("row"))
    text_schema = T.StructType([T.StructField(key, T.StringType()), *schema.fields[1:]])
    leaves = d.groupBy("_group", "block").applyInPandasWithState(leaf, text_schema, "keys string", "append", mode)
    leaves = leaves.withColumn(key, F.col(key).cast(schema[key].dataType))
    values = F.from_json("body", T.ArrayType(T.StringType()))
    fields = T._parse_datatype_string(out).fields

    def answers(last: DataFrame) -> DataFrame:
        return last.where(F.col("name").isNotNull()).select(
            key, *[F.get(values, i).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)], "rev")

    return Fold(leaves, [node(level == levels) for level in range(levels + 1)], answers)
