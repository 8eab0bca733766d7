"""Recursive and iterative operators against plain loops and hand-made rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from matchloom.operators import candidates as C, events as E, identity as I, machines as X, motion as M, shape as S
from matchloom.plans.knn import assign_greedy, chain_roots, top_k


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_greedy_assignment_equals_sorted_loop(spark):
    rnd = random.Random(3)
    pairs = [(m, a, b, rnd.randrange(10_000) / 1e4) for m in range(3) for a in range(12) for b in range(12) if rnd.random() < 0.5]
    want = []
    for m in range(3):
        used_a, used_b = set(), set()
        for _m, a, b, _s in sorted((p for p in pairs if p[0] == m), key=lambda p: (-p[3], p[1], p[2])):
            if a not in used_a and b not in used_b:
                used_a.add(a), used_b.add(b)
                want.append((m, a, b))
    df = spark.createDataFrame(pairs, "match_id bigint, a bigint, b bigint, score double")
    assert rows(assign_greedy(df), "match_id", "a", "b") == sorted(want)


def test_greedy_assignment_walks_small_matches_and_goes_by_rounds_in_large_ones(spark):
    rnd = random.Random(4)
    pairs = [(m, a, b, rnd.randrange(40) / 40) for m in range(4) for a in range(6 + 3 * m) for b in range(12)]  # many ties
    want = []
    for m in range(4):
        used = set()
        for _m, a, b, _s in sorted((p for p in pairs if p[0] == m), key=lambda p: (-p[3], p[1], p[2])):
            if not {("a", a), ("b", b)} & used:
                used |= {("a", a), ("b", b)}
                want.append((m, a, b))
    df = spark.createDataFrame(pairs, "match_id bigint, a bigint, b bigint, score double")
    for most in (0, 100, 1000):
        assert rows(assign_greedy(df, most=most), "match_id", "a", "b") == sorted(want)


def test_chain_roots(spark):
    e = spark.createDataFrame([(i, i - 1) for i in range(1, 20)] + [(31, 30)], "id bigint, parent bigint")
    assert rows(chain_roots(e), "id", "root") == [(i, 0) for i in range(1, 20)] + [(31, 30)]


def test_top_k_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(60, 5)).astype(np.float32)
    g = spark.createDataFrame([(i, i % 4, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id bigint, player_id bigint, vec array<float>")
    got = rows(top_k(I.as_queries(g), g, 3, rows=7), "query_id", "rank", "vec_id")
    u = vecs.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = [(q, r + 1, int(v)) for q in range(60) for r, v in enumerate(np.argsort(-s[q], kind="stable")[:3])]
    assert got == sorted(want)


def test_stamina_blocks_equal_loop(spark):
    x, data = 0, []
    rnd = random.Random(2)
    for f in range(300):
        x += rnd.choice([0, 0, 8, 15, 25, 30])
        data.append((1, 5, f, x % 4000, 100))
    df = spark.createDataFrame(data, "match_id bigint, player_id bigint, frame_n bigint, x_cm bigint, y_cm bigint")
    got = {r.frame_n: r.stamina for r in M.stamina(df, block=17).collect()}
    s, prev = 1_000_000, None
    for _m, _p, f, xx, _y in data:
        v = 0 if prev is None else abs(xx - prev) / 100 * 25
        v = 0 if v > 30 else v
        s = min(1_000_000, max(100_000, s + (-320 if v >= 5.5 else -40 if v >= 2.5 else -4 if v >= 0.3 else 100)))
        prev = xx
        assert got[f] == s


def test_sprint_open_at_the_end_is_not_emitted(spark):
    data = [(1, 1, f, min(f, 40) * 24 if f < 60 else 960 + (f - 60) * 24, 0) for f in range(100)]
    df = spark.createDataFrame(data, "match_id bigint, player_id bigint, frame_n bigint, x_cm bigint, y_cm bigint")
    got = M.sprints(df).collect()
    assert [(r.start_frame, r.duration_s) for r in got] == [(1, 1.6)]
    assert math.isclose(got[0].distance_m, 39 * 0.24, rel_tol=1e-9)


def test_teleport_needs_confirmation(spark):
    pts = [(0, 0), (10, 0), (500, 0), (20, 0), (600, 0), (610, 0), (620, 0)]
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(pts)], "match_id bigint, frame_n bigint, bpx bigint, bpy bigint")
    assert [r[0] for r in rows(C.teleport_filter(df), "frame_n")] == [0, 1, 3, 5, 6]


def test_kalman_follows_coasts_and_rejects(spark):
    data = [(1, f, None if 20 <= f < 26 else 10.0 + 5 * f + (400 if f == 15 else 0), None if 20 <= f < 26 else 50.0, 0.9) for f in range(40)]
    df = spark.createDataFrame(data, "match_id bigint, frame_n bigint, cx double, cy double, conf double")
    got = {r.frame_n: r for r in C.kalman_track(df).collect()}
    assert got[15].state == "coast" and all(got[f].state == "coast" for f in range(20, 26))
    assert got[39].state == "real" and abs(got[39].x - 205) < 3


def test_shot_machine_goal_save_and_expiry(spark):
    base = {"bpx": 700, "bpy": 360, "speed": 5.0, "dx": 5, "near_id": None, "near_team": None, "near_px": None, "held": "team_a", "in_box": None}

    def frame(m, f, **kw):
        r = {**base, **kw}
        return (m, f, *[r[c] for c in base])

    data = [frame(1, 0, speed=30.0), frame(1, 1, in_box="right"), frame(1, 2, in_box="right"),
            frame(2, 0, speed=30.0), frame(2, 3, near_id=7, near_team="team_b", near_px=1200),
            frame(3, 0, speed=30.0), frame(3, 76), frame(4, 0, speed=30.0, dx=-5)]
    df = spark.createDataFrame(data, "match_id bigint, frame_n bigint, bpx bigint, bpy bigint, speed double, dx bigint, near_id bigint, near_team string, near_px bigint, held string, in_box string")
    assert rows(X.shots(df), "match_id", "end_frame", "outcome") == [(1, 2, "goal"), (2, 3, "save"), (3, 76, "missed")]


FRAMES = "match_id bigint, frame_n bigint, bpx bigint, bpy bigint, speed double, dx bigint, near_id bigint, near_team string, near_px bigint, held string, in_box string"


def random_frames(rnd, matches=4, n=900):
    out = []
    for m in range(matches):
        for f in range(n):
            if rnd.random() < 0.15:
                continue
            near = rnd.random() < 0.3
            out.append((m, f, rnd.randrange(1280), 300, rnd.choice([None, rnd.uniform(0, 30), rnd.uniform(0, 100)]), rnd.randrange(-9, 10), rnd.randrange(14) if near else None,
                        rnd.choice(["team_a", "team_b"]) if near else None, rnd.choice([100, 640, 1200]) if near else None, rnd.choice([None, "team_a", "team_b"]), rnd.choice([None, None, None, "left", "right"])))
    return out


def test_shots_equal_a_walk_through_every_frame(spark):
    data = random_frames(random.Random(5))
    want = []
    for m in range(4):
        frames = [r for r in data if r[0] == m]
        last, shot, free, cooled, end = frames[-1][1], None, -1, -99, None
        for k, (_, f, x, y, v, dx, nid, nteam, npx, held, box) in enumerate(frames):
            if shot and f > shot[1] + 75:
                want.append((*shot, shot[1] + 76, "missed", None))
                free, shot = shot[1] + 77, None
            if shot:
                goal_x, side = (1280, "right") if shot[2] == "team_a" else (0, "left")
                if nteam and nteam != shot[2] and abs(npx - goal_x) < 320:
                    want.append((*shot, f, "save", nid))
                    free, shot = f + 1, None
                elif box == side and frames[k - 1][10] == side and frames[k - 1][1] > shot[1]:
                    want.append((*shot, f, "goal", None))
                    free, shot = f + 1, None
            elif f >= free and f - cooled >= 37.5 and held and v is not None and 18 < v <= 90 and (dx > 0 if held == "team_a" else dx < 0):
                shot, cooled = (m, f, held, nid if nteam == held else None), f
        if shot and shot[1] + 76 <= last:
            want.append((*shot, shot[1] + 76, "missed", None))
    assert len(want) > 40 and len({w[5] for w in want}) == 3
    df = spark.createDataFrame(data, FRAMES)
    assert rows(X.shots(df), "match_id", "frame_n", "team", "shooter_id", "end_frame", "outcome", "keeper_id") == sorted(want, key=lambda w: w[:2])


def test_shots_without_a_goal_box_end_at_the_edge_strip(spark):
    """No box: two checks in the strip are a goal at mid height and a miss elsewhere; too fast rows are no checks."""
    def row(m, f, x, y=360, speed=20.0, box=None, edge=None, near=None):
        return (m, f, x, y, speed, 5, near, near and "team_b", near and 1200, "team_a", box, edge)

    def walk(m, y, fast=20.0):
        return [row(m, 0, 900, y, 30.0), row(m, 1, 1255, y, fast, edge="right"), row(m, 2, 1260, y, edge="right"), row(m, 3, 1262, y, edge="right"), row(m, 200, 600, y, 1.0)]

    data = walk(1, 360) + walk(2, 100) + walk(3, 360, 95.0) + [row(4, 0, 900, speed=30.0), row(4, 1, 1200, speed=99.0, near=7), row(4, 2, 1200, speed=None, near=8), row(4, 3, 1200, near=9), row(4, 200, 600, speed=1.0)]
    df = spark.createDataFrame(data, FRAMES + ", at_edge string")
    assert rows(X.shots(df, edges=True), "match_id", "end_frame", "outcome", "keeper_id") == [(1, 2, "goal", None), (2, 2, "missed", None), (3, 3, "goal", None), (4, 3, "save", 9)]


def test_resolved_shots_equal_their_sql_where_goal_boxes_are_missing(spark, tmp_path):
    import duckdb

    from matchloom import catalog

    src, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("orders",):  # a match without its first frame has no goal boxes
        con.execute(f"COPY (SELECT * FROM '{src}/{t}.parquet' WHERE o_orderkey % 1000 > 0 OR o_orderkey % 3000 = 0) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    got = catalog.queries()["wn_shot_resolve"](spark, str(tmp_path))
    res = con.execute(catalog.oracle_sql()["wn_shot_resolve"])
    names = [d[0] for d in res.description]
    want = sorted(res.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want and len(want) > 50


def test_keeper_shots_equal_a_walk_through_every_frame(spark):
    data = random_frames(random.Random(6))
    want = []
    for m in range(4):
        s, free, frames = None, -1, [r for r in data if r[0] == m]
        for _, f, x, y, v, dx, nid, nteam, npx, held, box in frames:
            if s and f > s[0] + 60:
                want.append((m, s[0], s[0] + 60, s[1], s[2], "unknown"))
                s, free = None, s[0] + 61
            if s:
                peak = max(s[2], v or 0.0)
                out = "goal" if box == s[1] else ("save" if nid is not None else "missed") if (v is not None and v < 0.45 * peak) or dx * s[3] < 0 else "unknown" if f == s[0] + 60 else None
                s = (s[0], s[1], peak, s[3])
                if out:
                    want.append((m, s[0], f, s[1], peak, out))
                    s, free = None, f + 1
            elif f >= free and v is not None and v >= 18 and (dx < 0 and x < 288 or dx > 0 and x > 992):
                s = (f, "left" if dx < 0 else "right", v, dx)
        if s and s[0] + 60 <= frames[-1][1]:
            want.append((m, s[0], s[0] + 60, s[1], s[2], "unknown"))
    assert len(want) > 100
    assert rows(X.keeper_shots(spark.createDataFrame(data, FRAMES)), "match_id", "start_frame", "end_frame", "side", "peak", "outcome") == sorted(want)


def test_flight_completed_and_intercepted(spark):
    def path(m, to_team):
        pts = [(100, 1, "team_a"), (112, None, None), (130, None, None), (150, 2, to_team)]
        return [(m, f, x, 100, pid, team) for f, (x, pid, team) in enumerate(pts)]

    df = spark.createDataFrame(path(1, "team_a") + path(2, "team_b"), "match_id bigint, frame_n bigint, bpx bigint, bpy bigint, holder_id bigint, holder_team string")
    assert rows(X.flights(df), "match_id", "from_id", "to_id", "result") == [(1, 1, 2, "completed"), (2, 1, 2, "intercepted")]


def test_identity_lock_hysteresis(spark):
    data = [(1, 1, 0, 10, 0.60), (1, 1, 50, 20, 0.99), (1, 1, 125, 20, 0.65), (1, 1, 130, 20, 0.90), (1, 1, 300, 30, 0.10)]
    df = spark.createDataFrame(data, "match_id bigint, track_id bigint, frame_n bigint, best_id bigint, conf double")
    assert rows(I.identity_lock(df), "frame_n", "player_id") == [(0, 10), (50, 10), (125, 10), (130, 20)]


def test_diverse_gallery_skips_copies(spark):
    data = [(1, 0, 0, [1.0, 0.0]), (1, 1, 1, [1.0, 0.01]), (1, 2, 2, [0.0, 1.0])]
    df = spark.createDataFrame(data, "player_id bigint, frame_n bigint, vec_id bigint, vec array<float>")
    assert rows(I.diverse_gallery(df), "vec_id") == [(0,), (2,)]


def test_cluster_joins_earliest_seed(spark):
    df = spark.createDataFrame([(1, 1, 1, 0, 0), (1, 1, 2, 200, 0), (1, 1, 3, 400, 0), (1, 1, 4, 410, 0)], "match_id bigint, frame_n bigint, player_id bigint, px bigint, py bigint")
    assert rows(S.cluster_flagged(df), "player_id", "seed_id") == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_trajectory_drops_unreal_jumps(spark):
    pts = [(0, 0, "real"), (10, 0, "real"), (300, 0, "phantom"), (20, 0, "real"), (5, 0, "phantom"), (30, 0, "real")]
    df = spark.createDataFrame([(1, i, x, y, s) for i, (x, y, s) in enumerate(pts)], "event_id bigint, frame_n bigint, bpx bigint, bpy bigint, state string")
    assert [r[0] for r in rows(C.filter_path(df), "frame_n")] == [0, 1, 3, 5]


def test_empty_inputs(spark):
    ev = spark.createDataFrame([], "event_id bigint, match_id bigint, seq bigint, frame_n bigint, event_type string, team string, from_team string, player_id bigint, to_player_id bigint, x_cm bigint, y_cm bigint")
    assert E.team_stats(ev).collect() == [] and E.assists(ev).collect() == [] and E.running_score(ev).collect() == []


def test_zero_denominators_and_nulls(spark):
    from matchloom.functions import geometry as G, text as T
    from matchloom.functions.common import pct

    z = F.lit(0.0)
    r = spark.range(1).select(
        pct(F.lit(1), F.lit(0)).alias("p"), G.angle_at(z, z, z, z, F.lit(1.0), z).alias("a"),
        G.point_segment(F.lit(3.0), F.lit(4.0), z, z, z, z).alias("d"), G.project(z, z, [z] * 9)[0].alias("x"),
        T.verdict(F.lit('{"outcome": "goal"} x')).alias("v"), T.verdict(F.lit("nothing")).alias("n")).first()
    assert (r.p, r.a, r.d, r.x) == (0.0, None, 5.0, None)
    assert (r.v.outcome, r.v.confidence, r.n.outcome) == ("GOAL", 0.0, "?")


def test_running_costs_stamina_from_its_lower_bound_on(spark):
    data = [(1, 5, f, 12 * f, 100) for f in range(300)]  # 12 cm a frame at 25 fps: 3 m/s
    df = spark.createDataFrame(data, "match_id bigint, player_id bigint, frame_n bigint, x_cm bigint, y_cm bigint")
    assert M.stamina(df).where("frame_n = 299").first().stamina == 988_040
