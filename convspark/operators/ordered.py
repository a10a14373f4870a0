"""Skew-safe ordered computations inside a key (conversation, process, run).

A plain ``Window.partitionBy(conv_id)`` sends a whole conversation to one
task.  If one key holds a third of all rows that task is the job.  These
helpers count the rows per key first (one narrow aggregate).  A key of at most
``block`` rows stays whole; larger ones are cut into blocks of about equal row
counts, whatever the spacing of their order values, and stitched together:

* ``dense_position``  – 0-based row number inside a key (W9): a local
  ``row_number`` per block plus the row count of all earlier blocks.
* ``running``         – prefix sum / max / min (W5, W6, W8): a local running
  aggregate per block plus the aggregate of all earlier blocks.
* ``lookback``        – the ``w`` rows before each row (W1, W3, W4, A6, J6): the
  last ``w`` rows before a block, by rank and over as many short blocks as it
  takes, are copied into it, so each block is windowed independently.

Blocks end at splitters, quantiles of the key's order values (at most 1,023 a
key), so a dense hour is cut finely and sparse stretches share a block.  Only
the blocks of large keys have a row in the carry tables.  Without a large key
the plan is the usual one-exchange, one-sort window.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_BLOCK = 1 << 16  # rows of one key that one task puts in order
PARTS = 1024  # blocks of one key at most: a key with all rows still spreads over so many tasks
_FINE = 32

_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def _cols(xs: Iterable) -> list:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _null_proof(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with two columns per key, a value and a null flag, that join and partition alike: a
    null key is a key of its own, and the windows' partitioning still serves the joins."""
    names = []
    for n, k in enumerate(keys):
        kind = df.schema[k].dataType
        fill = F.lit("1970-01-01" if kind.typeName() == "date" else "0" if kind.typeName() == "string" else 0).cast(kind)
        df = df.withColumn(f"_k{n}", F.coalesce(F.col(k), fill)).withColumn(f"_n{n}", F.col(k).isNull())
        names += [f"_k{n}", f"_n{n}"]
    return df, names


@dataclass
class Blocks:
    """Rows with the columns that windows partition by; ``hot``: some key has several blocks, numbered by
    ``_blk`` in order, and rows of such keys have ``_hot`` set."""

    df: DataFrame
    by: list[str]
    hot: bool

    def window(self, *order) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*_cols(order))

    def summaries(self, *aggs: Column) -> DataFrame:
        """One row per block of a large key."""
        return self.df.where("_hot").groupBy(*self.by).agg(*aggs)

    def earlier(self) -> WindowSpec:
        """All earlier blocks of a key, over ``summaries``."""
        return (Window.partitionBy(*self.by[:-1]).orderBy("_blk")
                .rowsBetween(Window.unboundedPreceding, -1))

    def whole_key(self) -> WindowSpec:
        return Window.partitionBy(*self.by[:-1])

    def carried(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        """``df``, windowed by block, with its block's row of ``carry`` (nulls for whole keys)."""
        return df.join(carry, self.by, "left")

    def done(self, df: DataFrame) -> DataFrame:
        return df.drop("_blk", "_hot", *self.by) if self.hot else df


def order_blocks(df: DataFrame, keys: Sequence[str], by: Column, block: int = DEFAULT_BLOCK) -> Blocks:
    """Cut the keys of more than ``block`` rows at quantiles of ``by``, a number that never falls along
    the rows' order (nulls first).  Rows of equal ``by`` stay together."""
    keys = list(keys)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > block)
    large = cut_lineage(large)
    if large.isEmpty():
        return Blocks(df, keys, False)
    d, names = _null_proof(df, keys)
    large = _null_proof(large, keys)[0].select(*names, "_rows")
    at = [i / PARTS for i in range(1, PARTS)]
    cuts = (d.select(*names, by.cast("long").alias("_by")).join(large, names)
            .groupBy(*names).agg(F.max("_rows").alias("_rows"), F.percentile_approx("_by", at, 20 * PARTS).alias("_q")))
    wanted = F.least(F.lit(PARTS), F.ceil(F.col("_rows") / block)).cast("int")
    spread = F.transform(F.sequence(F.lit(1), wanted - 1), lambda i: F.element_at("_q", F.floor(i * PARTS / wanted).cast("int")))
    cuts = cuts.select(*names, F.array_distinct(F.when(wanted > 1, spread)).alias("_cuts"))
    # a coarse step and a fine one, so a row meets some 64 splitters of its key
    coarse = F.transform(F.sequence(F.lit(1), F.floor(F.size("_cuts") / _FINE)), lambda i: F.element_at("_cuts", (i * _FINE).cast("int")))
    cuts = cut_lineage(cuts.withColumn("_coarse", F.when(F.size("_cuts") >= _FINE, coarse).otherwise(F.array().cast("array<bigint>"))))
    d = d.withColumn("_by", by.cast("long")).join(cuts, names, "left")
    part = F.size(F.filter("_coarse", lambda s: s <= F.col("_by")))
    fine = F.size(F.filter(F.slice("_cuts", part * _FINE + 1, F.lit(_FINE)), lambda s: s <= F.col("_by")))
    hot = F.col("_cuts").isNotNull()
    d = d.withColumn("_blk", F.when(hot, part * _FINE + fine).otherwise(0)).withColumn("_hot", hot)
    return Blocks(d.drop("_by", "_cuts", "_coarse"), [*names, "_blk"], True)


def dense_position(df: DataFrame, keys: Sequence[str], order: Sequence, by: Column,
                   out: str = "pos", block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``out`` = 0-based position of each row inside ``keys`` by ``order``.

    ``by`` must be a number that never falls along ``order`` (e.g. the turn, or the microseconds of a
    timestamp); keys of more than ``block`` rows are numbered block by block.
    """
    b = order_blocks(df, keys, by, block)
    local = b.df.withColumn(out, (F.row_number().over(b.window(*order)) - 1).cast("long"))
    if not b.hot:
        return local
    # block sizes come from the numbered rows themselves: both branches then share one exchange of the input
    sizes = Blocks(local, b.by, True).summaries((F.max(out) + 1).alias("_n"))
    carry = sizes.select(*b.by, F.sum("_n").over(b.earlier()).alias("_off"))
    return b.done(b.carried(local, carry).withColumn(out, F.col(out) + F.coalesce("_off", F.lit(0))).drop("_off"))


def running(df: DataFrame, keys: Sequence[str], pos: str,
            specs: Sequence[tuple], block: int = DEFAULT_BLOCK) -> DataFrame:
    """Prefix aggregates inside ``keys`` ordered by ``pos``, a number.

    ``specs`` = [(out, op, expr, inclusive)], op in sum|max|min|count.  With
    ``inclusive=False`` the current row is left out (rows strictly before).  An expression of max or min may be
    a struct, so a prefix minimum can carry where it stood.
    """
    b = order_blocks(df, keys, F.col(pos), block)
    w_in = b.window(pos).rowsBetween(Window.unboundedPreceding, 0)
    w_ex = b.window(pos).rowsBetween(Window.unboundedPreceding, -1)
    d = b.df
    zero = {"sum", "count"}
    for out, op, expr, inclusive in specs:
        d = d.withColumn(out, _AGG[op](expr).over(w_in if inclusive else w_ex))
        if b.hot:
            # the block total is the inclusive running value at the block's last row
            d = d.withColumn(f"_{out}_i", F.col(out) if inclusive else _AGG[op](expr).over(w_in))
    if not b.hot:
        for out, op, _, _ in specs:
            d = d.withColumn(out, F.coalesce(out, F.lit(0))) if op in zero else d
        return d
    # derived from the windowed rows, so this branch reuses the same exchange of the input
    totals = Blocks(d, b.by, True).summaries(*[F.max_by(f"_{out}_i", pos).alias(f"_{out}_t") for out, _, _, _ in specs])
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    carry = totals.select(*b.by, *[merge[op](f"_{out}_t").over(b.earlier()).alias(f"_{out}_c") for out, op, _, _ in specs])
    j = b.carried(d, carry)
    for out, op, _, _ in specs:
        both = (F.col(f"_{out}_c"), F.col(out))
        if op in zero:
            val = F.coalesce(both[0], F.lit(0)) + F.coalesce(both[1], F.lit(0))
        else:
            val = (F.greatest if op == "max" else F.least)(*both)
        j = j.withColumn(out, val).drop(f"_{out}_c", f"_{out}_i")
    return b.done(j)


def lookback(df: DataFrame, keys: Sequence[str], pos: str | Sequence[str], w: int, fields: Sequence,
             out: str = "frame", include_current: bool = True,
             block: int = DEFAULT_BLOCK, by: Column | None = None) -> DataFrame:
    """Add ``out`` = ARRAY<STRUCT<fields>> of the ``w`` rows before each row
    (plus the row itself when ``include_current``), in order of ``pos`` (one column or several).

    Frames count rows: positions may have gaps and any spacing.  ``fields`` begin with ``pos``, so the array
    sorts by it.  ``by`` (default: the first of ``pos``) is a number that never falls along the order.
    """
    if w < 0:
        raise ValueError("lookback must not be negative")
    order = [pos] if isinstance(pos, str) else list(pos)
    b = order_blocks(df, keys, F.col(order[0]) if by is None else by, block)
    frame = F.struct(*_cols(fields))
    here = b.window(*order).rowsBetween(-w, 0 if include_current else -1)
    if not b.hot:
        return b.df.withColumn(out, F.array_sort(F.collect_list(frame).over(here)))
    d = b.df.withColumn("_f", frame).withColumn("_halo", F.lit(False))
    if w > 0:
        last = b.window(*[F.col(c).desc() for c in order])
        near = d.where("_hot").withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= w)
        tails = near.groupBy(*b.by).agg(F.array_sort(F.collect_list("_f")).alias("_tail"))
        # every block holds a row, so the last w rows lie in the last w blocks
        before = Window.partitionBy(*b.by[:-1]).orderBy("_blk").rowsBetween(-w, -1)
        rows = F.flatten(F.collect_list("_tail").over(before))
        halos = tails.select(*b.by, F.slice(rows, F.greatest(F.size(rows) - w + 1, F.lit(1)), F.lit(w)).alias("_rows")) \
            .where(F.size("_rows") > 0).select(*b.by, F.explode("_rows").alias("_f"))
        halos = halos.select(*b.by, "_f", *[F.col("_f").getField(c).alias(c) for c in order if c not in b.by],
                             F.lit(True).alias("_halo"))
        d = d.unionByName(halos, allowMissingColumns=True)
    framed = d.withColumn(out, F.array_sort(F.collect_list("_f").over(here)))
    return b.done(framed.where(~F.col("_halo")).drop("_f", "_halo"))
