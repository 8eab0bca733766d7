"""Interval joins as equi-joins on time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str, bucket: int, how: str = "inner") -> DataFrame:
    """Points within [lo, hi] of a span of the same key.

    Spans are copied to the buckets they touch, a point has one bucket, so no pair outside a
    shared bucket is ever formed.
    """
    b = float(bucket)
    spread = spans.withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col(lo) / b).cast("bigint"), F.floor(F.col(hi) / b).cast("bigint")))
    )
    p = points.withColumn("_b", F.floor(F.col(at) / b).cast("bigint"))
    if how in ("left_semi", "left_anti"):
        p, s = p.alias("p"), spread.alias("s")
        cond = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*keys, "_b"]]
        return p.join(s, [*cond, F.col(f"p.{at}").between(F.col(f"s.{lo}"), F.col(f"s.{hi}"))], how).drop("_b")
    return p.join(spread, [*keys, "_b"]).filter(F.col(at).between(F.col(lo), F.col(hi))).drop("_b")
