"""Vectors, galleries and track pieces on small rows."""

import random

from pyspark.sql import functions as F

from matchloom.functions.vectors import batch_dot
from matchloom.operators import colours, identity as I


def rand_vectors(spark, players, per):
    rng = random.Random(3)
    rows = [(p * 1000 + i, p, i // 2, 80, [rng.uniform(-1, 1) + (p % 8 == k) * 3.0 for k in range(8)]) for p in players for i in range(per)]
    return spark.createDataFrame(rows, "vec_id long, player_id long, frame_n long, conf_pct int, vec array<double>"), rows


def blended(rows, keep, f=lambda v: v):
    out = {}
    for _, p, _, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        out[p] = f(v) if p not in out else [keep * a + (1 - keep) * b for a, b in zip(out[p], f(v), strict=True)]
    return out


def test_batch_dot_takes_ragged_arrays(spark):
    rows = [([1.0, 2.0], [3.0, 4.0]), ([1.0], [2.0]), ([1.0, 2.0], [1.0]), (None, [1.0]), ([], [])]
    d = spark.createDataFrame(rows, "a array<double>, b array<double>").coalesce(1)
    assert [r[0] for r in d.select(batch_dot("a", "b")).collect()] == [11.0, 2.0, 0.0, 0.0, 0.0]


def test_blend_reads_every_sample(spark):
    vectors, rows = rand_vectors(spark, [1, 2], 150)
    want = blended(rows, 0.99)
    got = {(r.player_id, r.pos): r.value for r in I.vector_ema(vectors, keep=0.99).collect()}
    assert len(got) == 16 and all(abs(got[p, k] - v[k]) < 1e-12 for p, v in want.items() for k in range(8))


def test_histogram_match_reaches_every_player(spark):
    vectors, rows = rand_vectors(spark, range(8, 16), 12)
    want = blended(rows, 0.7, lambda v: [abs(x) for x in v])

    def corr(a, b):
        a, b = ([x - sum(v) / len(v) for x in v] for v in (a, b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    best = {r[0]: max((corr([abs(x) for x in r[4]], g), -p) for p, g in want.items()) for r in rows}
    got = {r.vec_id: (r.player_id, r.score) for r in colours.histogram_match(vectors).collect()}
    assert set(got) == {i for i, (s, _) in best.items() if s >= 0.72}
    assert all(p == -best[i][1] and abs(s - best[i][0]) < 1e-4 for i, (p, s) in got.items())
    assert {p for p, _ in got.values()} == set(range(8, 16))


def test_best_of_team_never_mixes_teams(spark):
    vectors, rows = rand_vectors(spark, [1, 2, 3, 9], 5)
    d = I.best_of_team(vectors.withColumn("team", F.when(F.col("player_id") < 3, "x").otherwise("y")), -2.0)
    assert d.count() == len(rows)
    assert all((r.query_id // 1000 < 3) == (r.player_id < 3) for r in d.collect())


def test_pieces_keep_own_ids_beyond_a_thousand(spark):
    frames = spark.range(1100).select(F.lit(1).cast("long").alias("match_id"), (F.col("id") * 3).alias("frame_n"))
    tracks = frames.crossJoin(spark.range(1, 3).withColumnRenamed("id", "player_id")).select("*", F.lit("a").alias("team"), F.lit(40).alias("h_px"), F.col("frame_n").alias("px"), F.col("frame_n").alias("py"))
    pieces = I.tracklets(tracks, split=1)
    assert pieces.count() == pieces.select("tid").distinct().count() == 2200
