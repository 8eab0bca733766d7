"""Ball candidates, static markers, smoothing, goal windows."""

from pyspark.sql import functions as F

from matchloom.catalog.registry import query, r4
from matchloom.operators import candidates as C, events as E, possession as B
from matchloom.operators.motion import rounded

CK = "match_id, frame_n, cand"


@query("jn_temporal_vote", f"""WITH v AS (SELECT c.match_id, c.frame_n, c.cand, count(DISTINCT p.frame_n) AS votes FROM candidates c LEFT JOIN candidates p ON p.match_id = c.match_id AND p.frame_n BETWEEN c.frame_n - 3 AND c.frame_n - 1
   AND (c.cx-p.cx)*(c.cx-p.cx)+(c.cy-p.cy)*(c.cy-p.cy) < 14400 GROUP BY ALL) SELECT {CK}, votes, {r4('least(votes * 0.18e0, 0.5e0)')} AS bonus FROM v""")
def _(t):
    return rounded(C.temporal_votes(t.candidates), "bonus")


NEARP = "np AS (SELECT c.match_id, c.frame_n, c.cand, c.cx, c.cy, coalesce(bool_or((cx-px)*(cx-px)+(cy-(py-h_px/2e0))*(cy-(py-h_px/2e0)) < 3025), false) AS near FROM candidates c LEFT JOIN tracks t ON t.match_id = c.match_id AND t.frame_n = c.frame_n GROUP BY ALL)"
STATIC = f"""{NEARP}, cw AS (SELECT match_id, cx // 10 AS gx, cy // 10 AS gy, frame_n, count(*) OVER w AS hits, count(*) FILTER (near) OVER w AS wp FROM np WINDOW w AS (PARTITION BY match_id, cx // 10, cy // 10 ORDER BY frame_n RANGE BETWEEN 75 PRECEDING AND CURRENT ROW)),
  mk AS (SELECT match_id, gx, gy, frame_n, max(hits) AS hits FROM cw WHERE hits >= 52 AND (hits >= 67 OR wp * 1e0 / hits < 0.45e0) GROUP BY ALL)"""


@query("wn_static_cells", f"WITH {STATIC} SELECT * FROM mk")
def _(t):
    return C.static_cells(t.candidates, t.tracks)


@query("jn_static_block", f"""WITH {STATIC} SELECT {CK} FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.match_id = c.match_id AND abs(mk.gx - cx // 10) <= 1 AND abs(mk.gy - cy // 10) <= 1 AND c.frame_n BETWEEN mk.frame_n AND mk.frame_n + 1500)""")
def _(t):
    return C.unblocked(t.candidates, C.marker_spans(C.static_cells(t.candidates, t.tracks))).select("match_id", "frame_n", "cand")


_face = " OR ".join(f"(kc[{i}] >= 30 AND (cx-kx[{i}])*(cx-kx[{i}])+(cy-ky[{i}])*(cy-ky[{i}]) < 900)" for i in (1, 2, 3))


@query("flt_candidate_head", f"SELECT {CK} FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM poses p WHERE p.match_id = c.match_id AND p.frame_n = c.frame_n AND ({_face}))")
def _(t):
    return C.off_faces(t.candidates, t.poses).select("match_id", "frame_n", "cand")


FLAGS = f"""hf AS (SELECT c.match_id, c.frame_n, c.cand, coalesce(bool_or((kc[10] >= 30 AND (cx-kx[10])*(cx-kx[10])+(cy-ky[10])*(cy-ky[10]) < 19600) OR (kc[11] >= 30 AND (cx-kx[11])*(cx-kx[11])+(cy-ky[11])*(cy-ky[11]) < 19600)), false) AS in_hand,
   coalesce(bool_or(cx > px - h_px * 0.25e0 AND cx < px + h_px * 0.25e0 AND cy > py - h_px * 0.15e0), false) AS in_shoe,
   coalesce(arg_min(coalesce(cy < least(CASE WHEN kc[6] >= 30 THEN ky[6] END, CASE WHEN kc[7] >= 30 THEN ky[7] END), false), ((cx-px)*(cx-px)*1e0+(cy-(py-h_px/2e0))*(cy-(py-h_px/2e0)), player_id)), false) AS above
   FROM candidates c LEFT JOIN poses p ON p.match_id = c.match_id AND p.frame_n = c.frame_n GROUP BY ALL)"""


@query("jn_hand_flags", f"WITH {FLAGS} SELECT * FROM hf")
def _(t):
    return C.hand_flags(t.candidates, t.poses)


_far = "sqrt((cx-bpx)*(cx-bpx)+(cy-bpy)*(cy-bpy))"


@query("wn_ball_pick", f"""WITH {FLAGS}, s AS (SELECT c.match_id, c.frame_n, c.cand, cx, cy, in_hand, (noise_pct * 1e0) / 100 AS skin, floor((conf_pct / 100e0 + CASE WHEN {_far} > 250 THEN -{_far} / 500e0 ELSE 0e0 END + CASE WHEN in_shoe THEN -1.5e0 ELSE 0e0 END + CASE WHEN in_hand THEN 0.9e0 ELSE 0e0 END
    + CASE WHEN above THEN 0.5e0 ELSE 0e0 END + CASE WHEN noise_pct / 100e0 >= 0.32e0 AND NOT in_hand THEN -0.7e0 ELSE 0e0 END + (colour_pct / 100e0 - 0.5e0) * 0.55e0) * 1e6 + 0.5e0) / 1e6 AS score
    FROM (SELECT *, (colour_pct * 7 + cx) % 100 AS noise_pct FROM candidates) c JOIN hf USING (match_id, frame_n, cand) LEFT JOIN ball b ON b.match_id = c.match_id AND b.frame_n = c.frame_n - 1)
  SELECT match_id, frame_n, arg_max(cand, (score, -cand)) AS cand, arg_max(cx, (score, -cand)) AS cx, arg_max(cy, (score, -cand)) AS cy, {r4('max(score)')} AS score FROM s WHERE (in_hand OR skin < 0.58e0) AND score > 0 GROUP BY ALL""")
def _(t):
    c = t.candidates.withColumn("conf", F.col("conf_pct") / 100.0).withColumn("colour", F.col("colour_pct") / 100.0).withColumn(
        "skin", (F.col("colour_pct") * 7 + F.col("cx")) % 100 / 100.0)
    last = t.ball.select("match_id", (F.col("frame_n") + 1).alias("frame_n"), F.col("bpx").alias("lx"), F.col("bpy").alias("ly"))
    return rounded(C.pick_ball(c, t.poses, last), "score")


_i = "greatest(0e0, least(a.px + a.h_px * 0.25e0, d.px + 5 + d.h_px * 0.25e0) - greatest(a.px - a.h_px * 0.25e0, d.px + 5 - d.h_px * 0.25e0)) * greatest(0e0, least(a.py, d.py + 3) - greatest(a.py - a.h_px, d.py + 3 - d.h_px))"


@query("jn_keypoint_attach", f"""WITH p AS (SELECT a.match_id, a.frame_n, a.player_id AS track_id, d.player_id AS det_id, {_i} AS i, a.h_px * a.h_px * 0.5e0 + d.h_px * d.h_px * 0.5e0 AS s FROM tracks a JOIN tracks d ON d.match_id = a.match_id AND d.frame_n = a.frame_n),
  q AS (SELECT *, floor(i / (s - i) * 1e9 + 0.5e0) / 1e9 AS iou FROM p WHERE i > 0) SELECT match_id, frame_n, track_id, arg_max(det_id, (iou, -det_id)) AS det_id, {r4('max(iou)')} AS iou FROM q WHERE iou > 0 GROUP BY ALL""")
def _(t):
    def box(d, p, ident, dx, dy):
        half = F.col("h_px") * 0.25
        return d.select("match_id", "frame_n", F.col("player_id").alias(ident), (F.col("px") + dx - half).alias(f"{p}x1"), (F.col("py") + dy - F.col("h_px")).cast("double").alias(f"{p}y1"),
                        (F.col("px") + dx + half).alias(f"{p}x2"), (F.col("py") + dy).cast("double").alias(f"{p}y2"))

    return rounded(C.attach_keypoints(box(t.tracks, "t_", "track_id", 0, 0), box(t.tracks, "d_", "det_id", 5, 3)), "iou")


@query("flt_person_conf", "SELECT match_id, frame_n, player_id FROM tracks WHERE conf_pct >= CASE WHEN h_px * h_px / 2e0 < 2400 THEN 20 ELSE 35 END")
def _(t):
    area = F.col("h_px") * F.col("h_px") / 2.0
    return t.tracks.filter(F.col("conf_pct") >= F.when(area < 2400, 20).otherwise(35)).select("match_id", "frame_n", "player_id")


@query("flt_upper_frame", "SELECT match_id, frame_n, player_id FROM tracks WHERE py >= 216")
def _(t):
    return t.tracks.filter(F.col("py") >= 216).select("match_id", "frame_n", "player_id")


@query("flt_goal_box", "SELECT match_id, frame_n, side FROM ball JOIN goal_boxes USING (match_id) WHERE bpx BETWEEN gx1 - 10 AND gx2 + 10 AND bpy BETWEEN gy1 - 10 AND gy2 + 10")
def _(t):
    d = t.ball.join(t.goal_boxes, "match_id")
    return d.filter(F.col("bpx").between(F.col("gx1") - 10, F.col("gx2") + 10) & F.col("bpy").between(F.col("gy1") - 10, F.col("gy2") + 10)).select("match_id", "frame_n", "side")


STILL = """vb AS (SELECT match_id, frame_n, bpx, bpy FROM ball WHERE bpx IS NOT NULL), l AS (SELECT *, row_number() OVER w AS rn, coalesce((bpx-lag(bpx) OVER w)*(bpx-lag(bpx) OVER w)+(bpy-lag(bpy) OVER w)*(bpy-lag(bpy) OVER w) <= 16, false) AS still FROM vb WINDOW w AS (PARTITION BY match_id ORDER BY frame_n)),
  k AS (SELECT *, rn - coalesce(max(CASE WHEN NOT still THEN rn END) OVER (PARTITION BY match_id ORDER BY rn), 0) AS n FROM l), sp AS (SELECT match_id, frame_n, bpx, bpy FROM k WHERE still AND n % 4 = 0)"""


@query("wn_still_kill", f"""WITH {STILL} SELECT {CK} FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.match_id = c.match_id AND c.frame_n BETWEEN sp.frame_n + 1 AND sp.frame_n + 1500 AND (cx-bpx)*(cx-bpx)+(cy-bpy)*(cy-bpy) < 484)""")
def _(t):
    ball = t.ball.filter("bpx is not null").select("match_id", "frame_n", "bpx", "bpy")
    return C.kill_still(t.candidates, C.still_points(ball)).select("match_id", "frame_n", "cand")


@query("wn_teleport")
def _(t):
    return C.teleport_filter(t.ball.filter("bpx is not null").select("match_id", "frame_n", "bpx", "bpy"), jump=60.0, confirm=40.0)


@query("wn_ball_kalman")
def _(t):
    d = t.ball.select("match_id", "frame_n", F.col("bpx").cast("double").alias("cx"), F.col("bpy").cast("double").alias("cy"), (F.col("bconf_pct") / 100.0).alias("conf"))
    return rounded(C.kalman_track(d), "x", "y")


@query("wn_ema_box", f"""WITH RECURSIVE m AS (SELECT match_id, cand, frame_n, cx, w, row_number() OVER o AS rn, coalesce(frame_n - lag(frame_n) OVER o > 1, true) AS fresh FROM candidates WINDOW o AS (PARTITION BY match_id, cand ORDER BY frame_n)),
  e AS (SELECT match_id, cand, frame_n, rn, cx * 1e0 AS x, w * 1e0 AS s FROM m WHERE rn = 1 UNION ALL SELECT m.match_id, m.cand, m.frame_n, m.rn, CASE WHEN fresh THEN m.cx ELSE e.x * 0.65e0 + m.cx * 0.35e0 END, CASE WHEN fresh THEN m.w ELSE e.s * 0.65e0 + m.w * 0.35e0 END FROM e JOIN m ON m.match_id = e.match_id AND m.cand = e.cand AND m.rn = e.rn + 1)
  SELECT match_id, cand, frame_n, {r4('x')} AS s_cx, {r4('s')} AS s_w FROM e""")
def _(t):
    d = t.candidates.select("match_id", "cand", "frame_n", "cx", "w")
    return rounded(C.smooth_boxes(d, ["match_id", "cand"], ["cx", "w"], max_gap=1), "s_cx", "s_w").select("match_id", "cand", "frame_n", "s_cx", "s_w")


def _windows(t):
    return E.goal_windows(t.match_events.filter(E.kind("goal")), t.ball.select("match_id", "frame_n", "bpx", "bpy", "state"))


@query("wn_traj_filter")
def _(t):
    return rounded(C.filter_path(_windows(t).filter("bpx is not null").select("event_id", "frame_n", "bpx", "bpy", "state")), "bpx", "bpy")


@query("wn_shot_frame", """WITH p AS (SELECT event_id, b.frame_n, sqrt((bpx-lag(bpx) OVER w)*(bpx-lag(bpx) OVER w)+(bpy-lag(bpy) OVER w)*(bpy-lag(bpy) OVER w)) / (b.frame_n - lag(b.frame_n) OVER w) AS v, lag(b.frame_n) OVER w AS prev FROM match_events g JOIN ball b ON b.match_id = g.match_id AND b.frame_n BETWEEN g.frame_n - 100 AND g.frame_n
   WHERE event_type = 'goal' WINDOW w AS (PARTITION BY event_id ORDER BY b.frame_n))
  SELECT event_id, arg_max(prev, (v, -frame_n)) FILTER (v IS NOT NULL) AS shot_frame FROM p GROUP BY 1 HAVING count(*) >= 4 AND count(v) > 0""")
def _(t):
    return C.shot_frames(_windows(t))


@query("wn_runup", """SELECT event_id, list(CAST(px AS VARCHAR) || ':' || CAST(py AS VARCHAR) ORDER BY t.frame_n) AS path FROM match_events g JOIN tracks t ON t.match_id = g.match_id AND t.player_id = g.match_id * 14 + g.event_id % 14 AND t.frame_n BETWEEN g.frame_n - 24 AND g.frame_n
  WHERE event_type = 'goal' GROUP BY 1""")
def _(t):
    g = t.match_events.filter(E.kind("goal")).withColumn("shooter_id", F.col("match_id") * 14 + F.col("event_id") % 14)
    return C.run_ups(g, t.tracks)


@query("snk_goal_meta")
def _(t):
    """One nested record per goal: shot frame, shooter, trajectory."""
    w = _windows(t)
    path = w.filter("bpx is not null").groupBy("match_id", "event_id", "goal_frame").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("frame_n", "bpx", "bpy"))), lambda s: F.struct(s["frame_n"].alias("frame"), s["bpx"].alias("x"), s["bpy"].alias("y"))).alias("trajectory"))
    d = path.join(C.shot_frames(w), "event_id", "left").join(t.match_events.select("event_id", "team", F.col("player_id").alias("shooter_id")), "event_id")
    return d.select("match_id", "event_id", F.to_json(F.struct("goal_frame", "shot_frame", "team", "shooter_id", "trajectory")).alias("meta"))
