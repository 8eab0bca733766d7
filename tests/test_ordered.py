"""Blocked sequence helpers against plain windows and a plain Python loop."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from matchloom.plans import folds, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for key in ("hot", "b", "c"):
        n = 400 if key == "hot" else 30
        for f in sorted(rnd.sample(range(0, 1200), n)):
            data.append((key, f, rnd.choice([None, 1, 2, 3]), rnd.choice(["x", "y", None])))
    return spark.createDataFrame(data, "k string, f bigint, v bigint, s string").cache()


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(repr, a.select(*cols).collect())) == sorted(map(repr, b.select(*cols).collect()))


@pytest.mark.parametrize("block", [7, 64, 5000])
def test_scan_matches_plain_windows(rows, block):
    got = ordered.scan(
        rows, ["k"], "f", lag={"pv": F.col("v"), "pf": F.col("f")}, sums={"sv": F.coalesce("v", F.lit(0))},
        maxes={"mv": F.col("v")}, last={"lv": F.col("v")}, block=block,
    )
    w = W.partitionBy("k").orderBy("f")
    u = w.rowsBetween(W.unboundedPreceding, 0)
    want = rows.select(
        "*", F.lag("v").over(w).alias("pv"), F.lag("f").over(w).alias("pf"), F.sum(F.coalesce("v", F.lit(0))).over(u).alias("sv"),
        F.max("v").over(u).alias("mv"), F.last("v", ignorenulls=True).over(u).alias("lv"),
    )
    same(got, want)


@pytest.mark.parametrize("block", [40, 5000])
def test_halo_matches_range_window(rows, block):
    def build(d, keys):
        w = W.partitionBy(*keys).orderBy("f").rangeBetween(-20, 5)
        return d.withColumn("n", F.count("v").over(w)).withColumn("m", F.max("v").over(w))

    got = ordered.halo(rows, ["k"], "f", 20, build, ahead=5, block=block)
    w = W.partitionBy("k").orderBy("f").rangeBetween(-20, 5)
    same(got, rows.withColumn("n", F.count("v").over(w)).withColumn("m", F.max("v").over(w)))


def test_islands(rows):
    got = {(r.k, r.f): r.island for r in ordered.islands(rows, ["k"], "f", F.col("s"), block=16).collect()}
    by = {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.f)):
        last, n = by.get(r.k, ((), 0))
        n = n + 1 if last != (r.s,) else n
        by[r.k] = ((r.s,), n)
        assert got[(r.k, r.f)] == n


@pytest.mark.parametrize("cooldown", [1, 5, 30, 170])
def test_debounce_equals_loop(rows, cooldown):
    got = sorted((r.k, r.f) for r in folds.debounce(rows, ["k"], "f", cooldown, block=50).collect())
    want, last = [], {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.f)):
        if r.k not in last or r.f - last[r.k] >= cooldown:
            last[r.k] = r.f
            want.append((r.k, r.f))
    assert got == want
