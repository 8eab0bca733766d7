"""Rows on the goal-area line, goals of many matches in one stream, and key points that are not written out."""

import math
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from matchloom import catalog
from matchloom.catalog.registry import BUILDERS
from matchloom.functions.pose import Body
from matchloom.operators import alerts as A, candidates as C, identity as I, machines as X
from matchloom.operators.motion import weighted_velocity
from matchloom.sources.derived import Tables


def test_rows_on_the_area_line_are_inside(spark):
    on = [(4000 - dx, 850 - dy) for dx in range(601) for dy in range(601) if dx * dx + dy * dy == 360_000]
    rows = [(1, i, "team_a", 0, x, y) for i, (x, y) in enumerate(on)]
    tracks = spark.createDataFrame(rows, "match_id long, player_id long, team string, frame_n long, x_cm long, y_cm long")
    assert A.area_violation(tracks).count() == len(on) > 2


def test_goals_of_far_apart_matches_keep_their_frames(spark):
    goals = [(1, 0, 0, "goal"), (2, 2000, 150, "goal"), (3, 2000, 150, "save")]
    t = SimpleNamespace(
        spark=spark,
        match_events=spark.createDataFrame(goals, "event_id long, match_id long, frame_n long, event_type string"),
        ball=spark.range(600).select(F.col("id") % 300).toDF("frame_n").withColumn("match_id", F.explode(F.array(F.lit(0), F.lit(2000)).cast("array<bigint>"))).distinct(),
    )
    got = sorted(tuple(r) for r in BUILDERS["st_goal_wait"](t).select("match_id", "event_id", "frame_n").collect())
    assert got == [(0, 1, f) for f in range(38)] + [(2000, 2, f) for f in range(50, 188)]


def test_key_points_are_not_written_out_and_run_compiled(spark):
    df = catalog.queries()["keypoint_get"](spark, "/root/testdata/sf0.001")
    assert all("/tracks/" in f for f in df.inputFiles()) and df.count() > 0  # no wide table of 51 numbers a row in between
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_weighted_velocity_equals_loop_without_lists(spark):
    frames = [f for f in range(300) if f % 7 and f % 31]
    at = {f: ((f * f) % 97, (f * 13) % 71) for f in frames}
    df = spark.createDataFrame([(1, 2, f, *at[f]) for f in frames], "match_id long, player_id long, frame_n long, px long, py long")
    out = weighted_velocity(df)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.frame_n: (r.vpx, r.vpy) for r in out.collect()}
    v = [0.0, 0.0]
    for i, f in enumerate(frames):
        last = frames[max(0, i - 11):i + 1]
        if i:
            w = [math.exp(-2 + k * 2 / (len(last) - 1)) for k in range(len(last))]
            tb = sum(a * b for a, b in zip(w, last)) / sum(w)
            for c in (0, 1):
                m = sum(a * at[b][c] for a, b in zip(w, last)) / sum(w)
                slope = sum(a * (b - tb) * (at[b][c] - m) for a, b in zip(w, last)) / sum(a * (b - tb) ** 2 for a, b in zip(w, last))
                v[c] = v[c] * 0.6 + slope * 0.4
        assert got[f] == pytest.approx(v, abs=1e-9)


def flying(spark, matches=2000, frames=160):
    """Every match has a ball that flies to the left at each frame and is never seen near a player or in a goal; rows of a match lie across all tasks."""
    d = spark.range(matches * frames).select((F.col("id") % matches).alias("match_id"), F.floor(F.col("id") / matches).alias("frame_n"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("near_id", "long"), ("near_team", "string"), ("near_px", "long"), ("in_box", "string"))]
    return d.select("*", F.lit(100).cast("long").alias("bpx"), F.lit(9).cast("long").alias("bpy"), F.lit(20.0).alias("speed"), F.lit(-40).cast("long").alias("dx"), F.lit("team_b").alias("held"), *none)


def test_shots_of_many_matches_follow_one_another(spark):
    rows = X.shots(flying(spark)).groupBy("frame_n", "end_frame", "outcome").count().collect()
    assert sorted(tuple(r) for r in rows) == [(f, f + 76, "missed", 2000) for f in range(0, 84, 77)]


def test_keeper_shots_of_many_matches_follow_one_another(spark):
    rows = X.keeper_shots(flying(spark)).groupBy("start_frame", "end_frame", "outcome").count().collect()
    assert sorted(tuple(r) for r in rows) == [(f, f + 60, "unknown", 2000) for f in range(0, 100, 61)]


def test_throwing_arm_is_the_higher_seen_one_without_array_functions(spark):
    rows = []
    for left, right, ly, ry in [(30, 30, 50, 40), (30, 30, 40, 50), (30, 30, 40, 40), (29, 30, 10, 90), (30, 29, 90, 10), (29, 29, 1, 2), (30, 30, None, 40), (30, 30, 40, None), (None, 30, 10, 90)]:
        kc, ky = [90] * 17, [100 + i for i in range(17)]
        kc[9], kc[10], ky[9], ky[10] = left, right, ly, ry
        rows.append((len(rows), [10 * i for i in range(17)], ky, kc))
    out = spark.createDataFrame(rows, "id int, kx array<int>, ky array<int>, kc array<int>").select("id", Body().throwing_arm().alias("arm"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" not in plan and "lambda" not in plan
    assert {r.id: r.arm and (r.arm.side, r.arm.wrist_y) for r in out.collect()} == {
        0: (1, 40), 1: (0, 40), 2: (0, 40), 3: (1, 90), 4: (0, 90), 5: None, 6: (0, None), 7: (1, None), 8: (1, 90)}


def moved_columns(spark, df):
    """Names of the columns that any shuffle of the plan moves."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    moved = re.findall(r"^\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[(.*?)\]\n", text, re.M)
    assert moved
    return {c.split("#")[0] for m in moved for c in m.split(", ")}


@pytest.mark.parametrize("name", ["jn_shooter_guess", "jn_hand_flags", "wn_ball_pick", "pose_action"])
def test_queries_on_poses_move_single_points_not_whole_bodies(spark, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not {"kx", "ky", "kc"} & moved_columns(spark, catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_track_pieces_meet_without_their_vectors(spark):
    for name in ("jn_tracklet_score", "jn_lost_match"):
        d = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        assert "ArrowEvalPython" not in d._jdf.queryExecution().optimizedPlan().toString()
    t = Tables(spark, "/root/testdata/sf0.001")
    assert not {"unit", "hist", "vec"} & set(I.lost_pairs(I.with_vectors(I.tracklets(t.tracks, split=1), t.vectors), 90).columns)


def test_hand_flags_take_the_lowest_of_equally_near_players_without_sorting_pairs(spark):
    def body(pid, px, shoulder):
        return (1, 1, pid, px, 100, 40, [0] * 17, [shoulder] * 17, [90] * 17)

    poses = spark.createDataFrame([body(5, 110, 0), body(4, 90, 200), body(6, 500, 90)], "match_id bigint, frame_n bigint, player_id bigint, px bigint, py bigint, h_px bigint, kx array<bigint>, ky array<bigint>, kc array<bigint>")
    cands = spark.createDataFrame([(1, 1, 0, 100, 80), (1, 1, 1, 105, 80), (1, 2, 0, 100, 80)], "match_id bigint, frame_n bigint, cand bigint, cx bigint, cy bigint")
    flags = C.hand_flags(cands, poses)
    assert sorted((r.frame_n, r.cand, r.above) for r in flags.collect()) == [(1, 0, True), (1, 1, False), (2, 0, False)]
    assert "SortAggregate" not in flags._jdf.queryExecution().executedPlan().toString()
