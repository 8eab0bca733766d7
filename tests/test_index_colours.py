"""Inverted-list index against the exact search; team colours of several matches against a plain loop."""

import random

import numpy as np
from pyspark.sql import functions as F

from matchloom.operators import colours
from matchloom.plans import inverted, knn


def vectors(spark, n=1200, dims=16, groups=40):
    rng = random.Random(11)
    heads = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    rows = [(i, i % groups, [h + rng.gauss(0, 0.5) for h in heads[0 if i % 3 == 0 else i % groups]]) for i in range(n)]  # a third around one point
    rows += [(n, 0, [0.0] * dims), (n + 1, 0, None)]
    return spark.createDataFrame(rows, "vec_id long, player_id long, vec array<double>")


def test_index_reaches_its_recall(spark):
    g = vectors(spark)
    q = g.where("vec IS NOT NULL").select(F.col("vec_id").alias("query_id"), "vec")
    index = inverted.build(g, lists=24)
    assert index.rows.count() == 1201 and index.rows.select("list_id").distinct().count() > 12
    probes = inverted.probes_for(index, q, 10, recall=0.95)
    assert 1 <= probes < 24
    exact = knn.top_k(q, g.where("vec IS NOT NULL"), 10)
    found = inverted.search(index, q, 10, probes, rows=100)  # small blocks: the crowded list is cut into several
    assert inverted.recall_of(found, exact) >= 0.9
    assert found.groupBy("query_id").count().where("count > 10").isEmpty()
    every = inverted.search(index, q, 10, len(index.centres), rows=100)
    assert inverted.recall_of(every, exact) == 1.0


def test_nearest_in_wide_blocks_equals_brute_force_and_ties_go_to_the_lower_id():
    """Single-precision products only leave out what cannot count: equal vectors, zero vectors and vectors that are no numbers included."""
    rng = np.random.default_rng(3)
    g = rng.normal(size=(5000, 8)).astype(np.float32)
    g[2000:3500], g[3], g[7] = g[0], 0, np.nan
    gid, q = np.arange(5000) * 2, g[:600]
    u = np.nan_to_num(g.astype(float) / np.maximum(np.sqrt((g.astype(float) ** 2).sum(1, keepdims=True)), 1e-300), nan=np.nan)
    for k in (1, 5, 64):
        r, c, sim = knn.nearest(q, gid[:600], g, gid, k, True)
        for i in (0, 1, 2, 3, 599):
            s = np.einsum("ij,ij->i", np.broadcast_to(u[i], u.shape), u)
            s[i] = s[7] = -np.inf
            want = np.lexsort((gid, -s))[:k]
            assert c[r == i].tolist() == want.tolist() and np.allclose(sim[r == i], s[want])
        assert not (r == 7).any() and not (c == 7).any()


def test_search_merges_one_list_of_hits_of_a_small_gallery(spark, monkeypatch):
    """10,000 vectors are one gallery block: k hits a query to be merged, not k of each 4,096 vectors."""
    g = spark.range(10_000).select(F.col("id").alias("vec_id"), F.lit(1).cast("long").alias("player_id"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("vec"))
    monkeypatch.setattr(knn, "best_of", lambda hits, k: hits)
    assert knn.top_k(g.select(F.col("vec_id").alias("query_id"), "vec"), g, 5).count() == 50_000


def test_index_of_nothing(spark):
    empty = vectors(spark).limit(0)
    index = inverted.build(empty)
    q = empty.select(F.col("vec_id").alias("query_id"), "vec")
    assert inverted.search(index, q, 3, inverted.probes_for(index, q, 3)).count() == 0


def looped(points, k, tol):
    weight = {}
    for p in points:
        weight[p] = weight.get(p, 0) + 1
    dist = lambda p, c: sum((x - y) * (x - y) for x, y in zip(p, c, strict=True))
    low = lambda p: tuple(-v for v in p)
    centres = [max(weight, key=lambda p: (weight[p], low(p)))]
    while len(centres) < k:
        far = {p: n * min(dist(p, c) for c in centres) for p, n in weight.items()}
        p = max(far, key=lambda p: (far[p], low(p)))
        if far[p] == 0:
            break
        centres.append(p)
    nearest = lambda p: min(range(len(centres)), key=lambda i: (dist(p, centres[i]), i))
    while True:
        mine = [[(p, n) for p, n in weight.items() if nearest(p) == i] for i in range(len(centres))]
        new = [tuple(sum(n * p[d] for p, n in m) / sum(n for _, n in m) for d in range(3)) if m else c for m, c in zip(mine, centres, strict=True)]
        moved = max(dist(x, y) for x, y in zip(centres, new, strict=True)) > tol * tol
        centres = new
        if not moved:
            break
    size = [sum(n for p, n in weight.items() if nearest(p) == i) for i in range(len(centres))]
    return sorted((-n, *c) for n, c in zip(size, centres, strict=True))


def test_team_colours_of_each_match_equal_a_loop(spark):
    rng = random.Random(3)
    heads = {1: [(60, 200, 90), (60, 70, 160), (180, 128, 200)], 2: [(90, 100, 100), (200, 60, 60), (30, 30, 220)], 3: [(100, 100, 100)] * 3, 4: [(50, 50, 50)]}
    rows = [(m, *[v + (rng.randrange(-9, 10) if m < 4 else 0) for v in hs[0 if i % 5 < 3 else i % len(hs)]]) for m, hs in heads.items() for i in range(400)]
    df = spark.createDataFrame([*rows, (1, None, 3, 4), (5, None, None, None)], "match_id long, l int, a int, b int")
    got = {}
    for r in colours.team_clusters(df).collect():
        got.setdefault(r.match_id, {})[r.label] = (r.n, r.l, r.a, r.b, r.distinct_centres)
    assert set(got) == {1, 2, 3, 4}
    for m in (1, 2):
        want = looped([tuple(float(v) for v in r[1:]) for r in rows if r[0] == m], 3, 0.5)
        assert got[m] == {name: (-n, *[int(v + 0.5) for v in c], True) for name, (n, *c) in zip(colours.FALLBACK, want, strict=True)}
    spare = {name: (None, *map(int, c), False) for name, c in colours.FALLBACK.items()}
    assert got[3] == got[4] == spare
