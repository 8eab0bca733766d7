"""Bounded running sums and cell bitmaps against plain loops."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from matchloom.operators import shape
from matchloom.plans import clamps

LO, HI = -5, 60


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(11)
    data = [("hot", f, rnd.choice([-40, -7, -1, 0, 3, 25])) for f in range(2500)]  # a row in every position
    data += [("gaps", f, rnd.randint(-9, 9)) for f in sorted(rnd.sample(range(9000), 150))]
    data += [("one", 77, -100), ("down", 3, -100), ("down", 4, 200), ("down", 5000, -1)]
    return spark.createDataFrame(data, "k string, f bigint, d bigint")


@pytest.mark.parametrize("block", [3, 16, 1024])
def test_clamped_sum_equals_loop(rows, block):
    got = {(r.k, r.f): r.s for r in clamps.clamped_sum(rows, ["k"], "f", F.col("d"), LO, HI, HI, "s", block).collect()}
    want = {}
    for key, part in groupby(sorted(map(tuple, rows.collect())), key=lambda r: r[0]):
        s = HI
        for _, f, d in part:
            s = want[(key, f)] = min(HI, max(LO, s + d))
    assert got == want


def test_clamped_sum_of_nothing(rows):
    assert clamps.clamped_sum(rows.limit(0), ["k"], "f", F.col("d"), LO, HI, HI, "s").collect() == []


def test_a_hot_key_spreads_over_tasks(spark, rows):
    parts = rows.filter("k = 'hot'").withColumn("_blk", F.floor(F.col("f") / 64).cast("bigint"))
    maps = clamps.block_maps(parts, ["k", "_blk"], "f", F.col("d"), LO, HI, 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert maps.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_open_cells_equal_a_grid_walk(spark):
    rnd = random.Random(4)
    data = [(1, f, team, i, x, y) for f in range(40) for team in ("team_a", "team_b") for i in range(5)
            for x, y in [(rnd.choice([rnd.randint(-300, 4300), 50 * rnd.randint(0, 80)]), rnd.randint(-200, 2200))]]
    data += [(1, 99, "team_a", 0, 3900, 100), (1, 98, "team_b", 0, 2050, 1050), (1, 97, "team_a", 0, 1999, 0)]
    got = {(r.frame_n, r.team): r.open_m2 for r in shape.coverage(
        spark.createDataFrame(data, "match_id bigint, frame_n bigint, team string, player_id bigint, x_cm bigint, y_cm bigint")).collect()}
    want = {}
    for _, f, team, _, x, y in data:
        cells, first = want.setdefault((f, team), set()), 0 if team == "team_a" else 20
        if (x < 2000) if team == "team_a" else (x > 2000):
            cells |= {(gx, gy) for gx in range(first, first + 20) for gy in range(20)
                      if (gx * 100 + 50 - x) ** 2 + (gy * 100 + 50 - y) ** 2 <= 350 ** 2}
    assert got == {k: 400 - len(v) for k, v in want.items()}
    assert got[(99, "team_a")] == 400
