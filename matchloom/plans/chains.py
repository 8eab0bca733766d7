"""Greedy chains: rows kept one after another, each deciding where the next may come.

Every candidate row says from which position on another may be kept (`free`): a cooldown after it, or the end of what it
starts. The first row of a key is kept, then the first one at or after its `free`, and so on. That is a pointer from each row to
the next kept one, so a key need not be walked by one task:

1. a key's rows are cut into blocks of positions, and each block follows its pointers to the end for every row at once; where
   chains meet they stay together, so a block shrinks to a few steps (rows up to here leave the block with that `free`);
2. one short row per block is chained in order, which tells each block where its chain enters;
3. every block walks its own chain, all in parallel.

Memory is bounded by a block; a key with a row at every position spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchloom.plans.ordered import BLOCK

FIRST = -(1 << 62)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches cut anew so that no group (equal `_g`) is split; holds at most one group beside a batch."""
    left = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([left, t]).combine_chunks() if left is not None else t
        g = t.column("_g").to_numpy()
        cuts = np.flatnonzero(g[1:] != g[:-1])
        at = int(cuts[-1]) + 1 if len(cuts) else 0
        if at:
            yield t.slice(0, at)
        left = t.slice(at)
    if left is not None and left.num_rows:
        yield left


class Pointers:
    """For the rows of some whole groups: their group, its first row and end, and the next row each leads to."""

    def __init__(self, t: pa.Table):
        g, self.order, self.free = (t.column(c).to_numpy() for c in ("_g", "_o", "_free"))
        n = len(g)
        self.first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        self.group = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, n)))
        self.end = np.append(self.first[1:], n)
        self.low = int(self.order.min())
        self.span = int(self.order.max()) - self.low + 2
        self.code = self.group * self.span + (self.order - self.low)
        self.next = np.maximum(self.at(self.group, self.free), np.arange(n) + 1)

    def at(self, group: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The first row of each group at or after a position, or the group's end."""
        return np.searchsorted(self.code, group * self.span + np.clip(position - self.low, 0, self.span - 1))


def chain(df: DataFrame, keys: list[str], order: str, free: str, block: int = BLOCK) -> DataFrame:
    """The kept rows of `df`, which has one row per key and `order` (whole numbers); `free` lies after `order`."""
    rows = df.withColumns({"_o": F.col(order).cast("long"), "_free": F.col(free).cast("long")})
    rows = rows.withColumn("_key", F.struct(*keys, F.floor(F.col("_o") / block).cast("long").alias("_blk")))  # equal also where a key is null
    rows = rows.withColumn("_g", F.xxhash64("_key"))
    names = df.columns
    typed = f"_key {rows.schema['_key'].dataType.simpleString()}"

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            p = Pointers(t)
            leave, ends, nxt = p.free.tolist(), p.end[p.group].tolist(), p.next.tolist()
            for i in range(len(leave) - 1, -1, -1):
                if nxt[i] < ends[i]:
                    leave[i] = leave[nxt[i]]
            leave = np.array(leave)
            last = np.flatnonzero(np.append((leave[1:] != leave[:-1]) | (p.group[1:] != p.group[:-1]), True))
            offsets = pa.array(np.append(np.searchsorted(last, p.first), len(last)), pa.int32())
            steps = [pa.ListArray.from_arrays(offsets, pa.array(x[last])) for x in (p.order, leave)]
            key = t.column("_key").combine_chunks().take(pa.array(p.first))
            yield pa.RecordBatch.from_arrays([key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key, *steps], ["_key", "upto", "leave"])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, FIRST
        for b in batches:
            found = []
            for k, upto, leave in zip(*(b.column(c).to_pylist() for c in ("_k", "upto", "leave")), strict=True):
                if k != key:
                    key, at = k, FIRST
                step = bisect_left(upto, at)
                found.append(at if step < len(upto) else None)
                at = leave[step] if step < len(upto) else at
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(found, pa.int64())], ["_key", "_enter"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            g, enters = t.column("_g").to_numpy(), t.column("_enter").combine_chunks()
            group = np.cumsum(np.append(True, g[1:] != g[:-1])) - 1
            mark = enters.is_valid().to_numpy(zero_copy_only=False)
            entered, at = np.zeros(group[-1] + 1, bool), np.zeros(group[-1] + 1, np.int64)
            entered[group[mark]] = True
            at[group[mark]] = enters.drop_null().to_numpy()
            t = t.filter(pa.array(~mark & entered[group])).combine_chunks()
            if not t.num_rows:
                continue
            p = Pointers(t)
            starts = p.at(np.arange(len(p.first)), at[entered])
            nxt, kept = p.next.tolist(), []
            for i, end in zip(starts.tolist(), p.end.tolist(), strict=True):
                while i < end:
                    kept.append(i)
                    i = nxt[i]
            yield from t.select(names).take(pa.array(kept, pa.int64())).combine_chunks().to_batches()

    short = rows.select("_key", "_g", "_o", "_free").repartition("_key").sortWithinPartitions("_key", "_o").mapInArrow(shrink, f"{typed}, upto array<long>, leave array<long>")
    of_key = [F.col("_key")[c] for c in keys]
    in_order = short.withColumn("_k", F.xxhash64(*of_key)).repartition(*of_key).sortWithinPartitions("_key")
    entries = in_order.mapInArrow(enter, f"{typed}, _enter long").where("_enter IS NOT NULL")
    # Entries travel as rows of their block. After a join on `_key` Spark drops the repartition as redundant and may then read the
    # join's shuffle by mapper (broadcast chosen at run time), which tears blocks apart.
    marked = rows.unionByName(entries.withColumn("_g", F.xxhash64("_key")), allowMissingColumns=True)
    return marked.repartition("_key").sortWithinPartitions("_key", "_o").mapInArrow(walk, df.schema)


def debounce(df: DataFrame, keys: list[str], order: str, cooldown: int, block: int = BLOCK) -> DataFrame:
    """Rows (keys, order) kept when repeats within ``cooldown`` of the last kept row are dropped."""
    one = df.select(*keys, order).distinct().withColumn("_after", F.col(order) + cooldown)
    return chain(one, keys, order, "_after", block).select(*keys, order)
