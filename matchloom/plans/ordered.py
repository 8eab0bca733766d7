"""Ordered (sequence) computations that do not put one key into one task.

A plain ``Window.partitionBy(match, player).orderBy(frame)`` sends every row of
a key to a single task.  Here a key's rows are cut into frame blocks, so a key
holding a third of the data still spreads over the cluster:

* :func:`halo` - look-back / look-ahead bounded by a number of frames: the tail
  of each block is copied into its neighbours, one shuffle, no join;
* :func:`scan` - unbounded look-back (previous row, running sum, running max,
  last non-null): windows inside blocks, plus a window over one summary row per
  block, joined back on the block key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 4096


def _block(order: str, size: int) -> Column:
    return F.floor(F.col(order) / F.lit(float(size))).cast("bigint")


def halo(
    df: DataFrame,
    keys: list[str],
    order: str,
    back: int,
    build: Callable[[DataFrame, list[str]], DataFrame],
    ahead: int = 0,
    block: int = BLOCK,
) -> DataFrame:
    """Run ``build(df, partition_keys)`` per block with ``back``/``ahead`` frames of context.

    ``build`` must add columns only from rows within that distance and keep
    ``_halo``; context rows are removed afterwards.
    """
    if max(back, ahead) >= block:
        block = 2 * max(back, ahead)
    b, pos = _block(order, block), F.pmod(F.col(order), F.lit(block))
    copies = F.filter(
        F.array(
            F.struct(b.alias("b"), F.lit(False).alias("h")),
            F.when(pos >= block - back, F.struct((b + 1).alias("b"), F.lit(True).alias("h"))),
            F.when(pos < ahead, F.struct((b - 1).alias("b"), F.lit(True).alias("h"))),
        ),
        lambda c: c.isNotNull(),
    )
    wide = df.withColumn("_c", F.explode(copies)).select(
        *df.columns, F.col("_c.b").alias("_blk"), F.col("_c.h").alias("_halo")
    )
    out = build(wide, [*keys, "_blk"])
    return out.filter(~F.col("_halo")).drop("_blk", "_halo")


def scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    *,
    lag: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    prior: dict[str, Column] | None = None,
    block: int = BLOCK,
    tie: str | None = None,
) -> DataFrame:
    """Add, over all earlier rows of the key in ``order`` (unique per key with ``tie``):

    ``lag`` previous row's value, ``sums`` / ``maxes`` running value including the
    current row, ``last`` last non-null value including the current row, ``prior`` excluding it.
    """
    lag, sums, maxes, last, prior = lag or {}, sums or {}, maxes or {}, last or {}, prior or {}
    by = [order] + ([tie] if tie else [])
    src = df.withColumn("_blk", _block(order, block))
    for n, c in {**lag, **sums, **maxes, **last, **prior}.items():
        src = src.withColumn(f"_in_{n}", c)
    w = W.partitionBy(*keys, "_blk").orderBy(*by)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    local = src.withColumn("_rn", F.row_number().over(w))
    for n in lag:
        local = local.withColumn(f"_l_{n}", F.lag(f"_in_{n}").over(w))
    for n in sums:
        local = local.withColumn(f"_l_{n}", F.sum(f"_in_{n}").over(run))
    for n in maxes:
        local = local.withColumn(f"_l_{n}", F.max(f"_in_{n}").over(run))
    for n in last:
        local = local.withColumn(f"_l_{n}", F.last(f"_in_{n}", ignorenulls=True).over(run))
    for n in prior:
        earlier = w.rowsBetween(W.unboundedPreceding, -1)
        local = local.withColumn(f"_l_{n}", F.last(f"_in_{n}", ignorenulls=True).over(earlier))
    last = {**last, **prior}

    pos = F.struct(*by)
    aggs = []
    if lag:
        aggs.append(F.max_by(F.struct(*[F.col(f"_in_{n}").alias(n) for n in lag]), pos).alias("_tail"))
    aggs += [F.sum(f"_in_{n}").alias(f"_s_{n}") for n in sums]
    aggs += [F.max(f"_in_{n}").alias(f"_s_{n}") for n in maxes]
    aggs += [
        F.max_by(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), pos)).alias(f"_s_{n}") for n in last
    ]
    per_block = src.groupBy(*keys, "_blk").agg(*aggs)
    wb = W.partitionBy(*keys).orderBy("_blk")
    before = wb.rowsBetween(W.unboundedPreceding, -1)
    carried = [F.lag("_tail").over(wb).alias("_tail")] if lag else []
    carried += [F.sum(f"_s_{n}").over(before).alias(f"_c_{n}") for n in sums]
    carried += [F.max(f"_s_{n}").over(before).alias(f"_c_{n}") for n in maxes]
    carried += [F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in last]
    carry = per_block.select(*keys, "_blk", *carried)

    joined = local.join(carry, [*keys, "_blk"])
    out = [F.col(c) for c in df.columns]
    for n in lag:
        out.append(F.when(F.col("_rn") == 1, F.col(f"_tail.{n}")).otherwise(F.col(f"_l_{n}")).alias(n))
    for n in sums:
        zero = F.coalesce(F.col(f"_c_{n}"), F.lit(0))
        out.append((F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + zero).alias(n))
    for n in maxes:
        out.append(F.greatest(f"_l_{n}", f"_c_{n}").alias(n))
    for n in last:
        out.append(F.coalesce(f"_l_{n}", f"_c_{n}").alias(n))
    return joined.select(*out)


def number_rows(df: DataFrame, keys: list[str], order: str, name: str = "rn", block: int = BLOCK, tie: str | None = None) -> DataFrame:
    """Dense 1-based row number per key."""
    return scan(df, keys, order, sums={name: F.lit(1).cast("bigint")}, block=block, tie=tie)


def segments(
    df: DataFrame,
    keys: list[str],
    order: str,
    cols: list[str],
    starts: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    name: str = "segment",
    block: int = BLOCK,
    row_number: str | None = None,
) -> DataFrame:
    """Number the segments of a key; a row opens one when ``starts(prev, cur)`` holds.

    ``row_number`` names an optional dense row number of the key from the same pass.

    ``prev(c)`` and ``cur(c)`` give a column of the previous and the current row, for the
    ``cols`` listed.  Starts are counted inside blocks; only the first row of a block waits
    for the last row of the block before, which the block summary supplies.
    """
    src = df.withColumn("_blk", _block(order, block)).withColumn("_cur", F.struct(*cols))
    w = W.partitionBy(*keys, "_blk").orderBy(order)
    local = src.withColumn("_prev", F.lag("_cur").over(w))
    inner = F.coalesce(starts(lambda c: F.col(f"_prev.{c}"), lambda c: F.col(f"_cur.{c}")), F.lit(False))
    local = local.withColumn("_st", F.when(F.col("_prev").isNotNull() & inner, 1).otherwise(0).cast("bigint"))
    local = local.withColumn("_rn", F.row_number().over(w))
    local = local.withColumn("_n", F.sum("_st").over(w.rowsBetween(W.unboundedPreceding, 0)))
    per_block = local.groupBy(*keys, "_blk").agg(
        F.min_by("_cur", order).alias("_first"), F.max_by("_cur", order).alias("_last"), F.sum("_st").alias("_inner"),
        F.count(F.lit(1)).alias("_rows"),
    )
    wb = W.partitionBy(*keys).orderBy("_blk")
    chained = per_block.withColumn("_before", F.lag("_last").over(wb))
    opens = F.coalesce(starts(lambda c: F.col(f"_before.{c}"), lambda c: F.col(f"_first.{c}")), F.lit(False))
    chained = chained.withColumn("_open", F.when(F.col("_before").isNull() | opens, 1).otherwise(0).cast("bigint"))
    before = wb.rowsBetween(W.unboundedPreceding, -1)
    base = F.sum(F.col("_open") + F.col("_inner")).over(before)
    carry = chained.select(
        *keys, "_blk", (F.coalesce(base, F.lit(0)) + F.col("_open")).alias("_base"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
    )
    out = [(F.col("_base") + F.col("_n")).alias(name)]
    if row_number:
        out.append((F.col("_rows_before") + F.col("_rn")).alias(row_number))
    return local.join(carry, [*keys, "_blk"]).select(*df.columns, *out)


def islands(df: DataFrame, keys: list[str], order: str, value: Column, name: str = "island", block: int = BLOCK, row_number: str | None = None) -> DataFrame:
    """Number the maximal runs of equal ``value`` per key (null equals null)."""
    d = df.withColumn("_v", value)
    return segments(d, keys, order, ["_v"], lambda p, c: ~c("_v").eqNullSafe(p("_v")), name, block, row_number).drop("_v")
