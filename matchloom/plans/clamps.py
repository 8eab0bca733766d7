"""Running sums held between two bounds after every row, without a loop over rows.

A row turns s into clamp(s + d).  Such maps compose into s -> max(f, min(c, s + a)), so any stretch of rows is
three numbers.  Inside a block, windows join the maps of four neighbouring rows, then of four stretches of four, and so on;
all these windows share one partitioning and one sort.  Each block's last map stands for the block, blocks are
composed in the same way inside groups of blocks, and the groups (one short map in ``block * block`` positions)
are folded in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from matchloom.session import cut_lineage

#: Positions of a block and blocks of a group.
BLOCK = 1024
MAP = ["_add", "_low", "_high"]
#: Neighbouring stretches joined by one window.
WAYS = 4


def _apply(s: Column, a: Column, f: Column, c: Column) -> Column:
    return F.greatest(f, F.least(c, s + a))


def compose(d: DataFrame, part: list[str], order: str, lo: int, hi: int, size: int) -> DataFrame:
    """Replace MAP of each row by the map of all rows of its partition up to it; ``size`` bounds a partition's rows."""
    w = W.partitionBy(*part).orderBy(order)
    rest = [c for c in d.columns if c not in MAP]
    unit = dict(zip(MAP, (0, lo, hi), strict=True))  # before the first row nothing changes
    reach = 1
    while reach < size:
        back = [k * reach for k in range(WAYS - 1, 0, -1)]
        d = d.select(*rest, *MAP, *[F.lag(m, k, v).over(w).alias(f"_{m}{k}") for k in back for m, v in unit.items()])
        a, f, c = (F.col(f"_{m}{back[0]}") for m in MAP)
        for last in [[F.col(f"_{m}{k}") for m in MAP] for k in back[1:]] + [[F.col(m) for m in MAP]]:
            a, f, c = a + last[0], _apply(f, *last), _apply(c, *last)
        d = d.select(*rest, *[v.alias(m) for m, v in zip(MAP, (a, f, c), strict=True)])
        reach *= WAYS
    return d


def block_maps(d: DataFrame, part: list[str], order: str, delta: Column, lo: int, hi: int, block: int = BLOCK) -> DataFrame:
    """Add MAP (the map of the block's rows up to this one) and _end (last row of its block).

    ``part`` names the key and its block of ``block`` positions; ``order`` is unique in it.
    """
    w = W.partitionBy(*part).orderBy(order)
    d = d.select("*", *[v.cast("bigint").alias(m) for m, v in zip(MAP, (delta, F.lit(lo), F.lit(hi)), strict=True)])
    return compose(d.withColumn("_end", F.lead(order).over(w).isNull()), part, order, lo, hi, block)


def replay(maps: DataFrame, keys: list[str], order: str, lo: int, hi: int, start: int, name: str, block: int = BLOCK) -> DataFrame:
    """Value after every row of ``block_maps`` (read twice: give a written table), from ``start`` before the first."""
    b = F.floor(F.col(order) / F.lit(block)).cast("bigint")
    ends = maps.filter("_end").select(*keys, b.alias("_b"), F.floor(b / F.lit(block)).cast("bigint").alias("_g"), *MAP)
    group = [*keys, "_g"]
    w = W.partitionBy(*group).orderBy("_b")
    inner = compose(ends, group, "_b", lo, hi, block).select(
        *group, "_b", F.struct(*MAP).alias("_m"), F.lag(F.struct(*MAP)).over(w).alias("_before"), F.lead("_b").over(w).isNull().alias("_end"))
    earlier = W.partitionBy(*keys).orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    groups = inner.filter("_end").select(*group, F.collect_list("_m").over(earlier).alias("_ms"))
    fold = F.aggregate("_ms", F.lit(start).cast("bigint"), lambda s, m: _apply(s, *[m[x] for x in MAP]))
    heads = inner.join(groups.select(*group, fold.alias("_s")), group)
    before = _apply(F.col("_s"), *[F.col(f"_before.{m}") for m in MAP])
    heads = heads.select(*keys, "_b", F.when(F.col("_before").isNull(), F.col("_s")).otherwise(before).alias("_s"))
    out = maps.withColumn("_b", b).join(heads, [*keys, "_b"])
    return out.withColumn(name, _apply(F.col("_s"), *map(F.col, MAP))).drop(*MAP, "_end", "_b", "_s")


def clamped_sum(df: DataFrame, keys: list[str], order: str, delta: Column, lo: int, hi: int, start: int, name: str, block: int = BLOCK) -> DataFrame:
    """Add the running sum of ``delta`` in ``order`` (unique per key), held in [lo, hi] after every row."""
    d = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    maps = block_maps(d, [*keys, "_blk"], order, delta, lo, hi, block).drop("_blk")
    return replay(cut_lineage(maps), keys, order, lo, hi, start, name, block)
