"""Chains over blocks against plain loops: any pointers, dense keys, null keys, small batches."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.plans.chains import chain, debounce


def slow_chain(rows):
    out, at = [], {}
    for k, f, free in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if f >= at.get(k, -(1 << 60)):
            out.append((k, f))
            at[k] = free
    return sorted(out, key=str)


def got(df):
    return sorted(((r.k, r.f) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [7, 64, 100_000])
def test_chain_equals_loop(spark, block):
    rng = random.Random(block)
    rows = [(k, f, f + rng.choice([1, 2, 5, 40, 300])) for k in (None, "a", "b", "c") for f in rng.sample(range(-300, 2000), 500)]
    rows += [("one", 5, 6), ("far", -10**12, -10**12 + 1), ("far", 10**12, 10**12 + 9)]
    df = spark.createDataFrame(rows, "k string, f long, free long").repartition(5)
    assert got(chain(df, ["k"], "f", "free", block)) == slow_chain(rows)


def test_columns_stay_and_no_rows_do(spark):
    df = spark.createDataFrame([(1, 2, 3, "x")], "k long, f int, free long, _blk string")
    out = chain(df, ["k"], "f", "free")
    assert out.schema == df.schema and [tuple(r) for r in out.collect()] == [(1, 2, 3, "x")]
    assert chain(df.limit(0), ["k"], "f", "free").count() == 0


def test_key_with_a_row_in_each_frame_is_spread(spark):
    """One key with a million rows: every block of it is its own group, and the result is the plain one."""
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").alias("f"))
    out = debounce(df, ["k"], "f", 75, block=10_000)
    parts = out.select(F.spark_partition_id().alias("p"), "f").groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == -(-1_000_000 // 75)
    assert len(parts) > 1 and max(r["count"] for r in parts) < 0.6 * 1_000_000 / 75
    assert out.where("f % 75 <> 0").isEmpty()


def test_small_arrow_batches(spark):
    rows = [(k, f, f + 3) for k in "ab" for f in range(500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        assert got(chain(spark.createDataFrame(rows, "k string, f long, free long"), ["k"], "f", "free", 40)) == slow_chain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_keys_that_lie_across_all_input_tasks(spark):
    """Rows of each key come from every task of the scan: no block may be walked in pieces."""
    df = spark.range(2_000_000).select((F.col("id") % 2000).alias("k"), F.floor(F.col("id") / 2000).alias("f"))
    out = debounce(df, ["k"], "f", 25)
    assert out.where("f % 25 <> 0").isEmpty() and out.count() == 2000 * 40
