"""Fixed-size Bloom filters over 64-bit keys, filled by tasks and merged by their words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


class Bloom:
    """Fixed-size filter over 64-bit keys; no false negatives. Two probes, as keys are already mixed."""

    def __init__(self, bits: int):
        self.bits, self.table = bits, np.zeros(bits // 8, np.uint8)

    def add(self, keys: np.ndarray) -> None:
        for at in (keys % np.uint64(self.bits), (keys >> np.uint64(32)) * np.uint64(2654435761) % np.uint64(self.bits)):
            np.bitwise_or.at(self.table, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        for at in (keys % np.uint64(self.bits), (keys >> np.uint64(32)) * np.uint64(2654435761) % np.uint64(self.bits)):
            ok &= (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def gathered(keys: DataFrame, bits: int) -> bytes:
    """Filter of a one-column frame of keys: each task fills its own, only fixed-size filters reach the driver's merge."""

    def fill(batches):
        f = Bloom(bits)
        for b in batches:
            f.add(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        words = f.table.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "word"])

    merged = keys.mapInArrow(fill, "at long, word long").groupBy("at").agg(F.expr("bit_or(word)").alias("word")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[merged.column("at").to_numpy()] = merged.column("word").to_numpy()
    return out.tobytes()


def filter_from(raw: bytes) -> Bloom:
    f = Bloom(8)
    f.bits, f.table = len(raw) * 8, np.frombuffer(raw, np.uint8)
    return f


def sized(n: int, most: int = 1 << 27) -> int:
    """Bits of a filter for n keys: 16 a key, a power of two, at most `most`."""
    return min(most, max(1 << 16, 1 << (16 * n).bit_length()))


def passing(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose `on` may be among the keys, before any shuffle; an exact join settles it. The filter has at most 16 MB.

    It is one broadcast row that holds the filter's words, so that wide rows are tested where they are read and do not pass
    through Python. A join without a key is meant: the other side is that one row.
    """
    bits = sized(keys.count())
    words = pa.array(np.frombuffer(gathered(keys.select(F.xxhash64(on).alias("key")), bits), np.int64))
    one = rows.sparkSession.createDataFrame(pa.table({"_words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)}))
    key, mask = F.xxhash64(on), F.lit(bits - 1)
    # the second place is a product modulo the size, a power of two, of which the low bits are enough (no overflow)
    places = (key.bitwiseAND(mask), (F.shiftrightunsigned(key, 32).bitwiseAND(mask) * F.lit(2654435761)).bitwiseAND(mask))
    kept = rows.crossJoin(F.broadcast(one))
    for at in places:
        word = F.get("_words", F.shiftright(at, 6).cast("int"))
        kept = kept.where(F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return kept.select(*rows.columns)
