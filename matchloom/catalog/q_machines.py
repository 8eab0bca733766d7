"""Shots, goals, breaks, flights, keeper machines, techniques, body metrics."""

from pyspark.sql import functions as F

from matchloom.catalog.q_ball import NEAR, PASS, TOUCH
from matchloom.catalog.q_motion import PW, greedy
from matchloom.catalog.q_scalar import kp, sq_ang
from matchloom.catalog.q_shape import LINES, near_holder
from matchloom.catalog.registry import query, r4
from matchloom.operators import machines as X, possession as B, shape as S
from matchloom.operators.motion import rounded
from matchloom.session import cut_lineage

K3 = "match_id, frame_n, player_id"


def touch(t):
    return B.touches(B.holders(t.tracks, t.ball))


def frames(t):
    return cut_lineage(X.ball_frames(t.tracks, t.ball, touch(t), t.goal_boxes))


SPEED2 = f"""pt AS (SELECT *, sum(CASE WHEN raw > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame_n) AS part FROM bs),
  s2 AS (SELECT match_id, frame_n, sqrt((bpx-lag(bpx, 2) OVER w)*(bpx-lag(bpx, 2) OVER w)+(bpy-lag(bpy, 2) OVER w)*(bpy-lag(bpy, 2) OVER w)) / greatest(frame_n - lag(frame_n, 2) OVER w, 1) AS speed FROM pt WINDOW w AS (PARTITION BY match_id, part ORDER BY frame_n))"""
SHOTS = f"""{TOUCH}, {SPEED2}, bx AS (SELECT match_id, {", ".join(f"max({c}) FILTER (side = '{s}') AS {s[0]}_{c}" for s in ("left", "right") for c in ("gx1", "gx2", "gy1", "gy2"))} FROM goal_boxes GROUP BY match_id),
  fr0 AS (SELECT bs.match_id, bs.frame_n, bs.bpx, bs.bpy, s2.speed, bs.bpx - bs.lx AS dx, near.player_id AS near_id, near.team AS near_team, tr.px AS near_px, c.team AS commit,
    CASE WHEN bs.bpx BETWEEN l_gx1 - 12 AND l_gx2 + 12 AND bs.bpy BETWEEN l_gy1 - 12 AND l_gy2 + 12 THEN 'left' WHEN bs.bpx BETWEEN r_gx1 - 12 AND r_gx2 + 12 AND bs.bpy BETWEEN r_gy1 - 12 AND r_gy2 + 12 THEN 'right' END AS in_box
    FROM bs JOIN s2 ON s2.match_id = bs.match_id AND s2.frame_n = bs.frame_n LEFT JOIN near ON near.match_id = bs.match_id AND near.frame_n = bs.frame_n
    LEFT JOIN tracks tr ON tr.match_id = bs.match_id AND tr.frame_n = bs.frame_n AND tr.player_id = near.player_id
    LEFT JOIN touch c ON c.match_id = bs.match_id AND c.frame_n = bs.frame_n AND c.pos = 6 LEFT JOIN bx ON bx.match_id = bs.match_id),
  fr AS (SELECT *, last_value(commit IGNORE NULLS) OVER w AS held, lag(in_box) OVER w AS box0, lag(frame_n) OVER w AS frame0 FROM fr0 WINDOW w AS (PARTITION BY match_id ORDER BY frame_n)),
  la AS (SELECT match_id, frame_n, held AS team, speed, CASE WHEN near_team = held THEN near_id END AS shooter_id, bpx AS x, bpy AS y, CASE WHEN held = 'team_a' THEN 1280 ELSE 0 END AS gx, CASE WHEN held = 'team_a' THEN 'right' ELSE 'left' END AS box
    FROM fr WHERE held IS NOT NULL AND speed > 18 AND speed <= 90 AND CASE WHEN held = 'team_a' THEN dx > 0 ELSE dx < 0 END),
  ev AS (SELECT la.match_id, la.frame_n, min(r.frame_n) FILTER (r.near_team <> la.team AND abs(r.near_px - la.gx) < 320) AS sv, min(r.frame_n) FILTER (r.in_box = la.box AND r.box0 = la.box AND r.frame0 > la.frame_n) AS gl
    FROM la LEFT JOIN fr r ON r.match_id = la.match_id AND r.frame_n BETWEEN la.frame_n + 1 AND la.frame_n + 75 GROUP BY la.match_id, la.frame_n),
  rs AS (SELECT la.match_id, la.frame_n, team, speed, shooter_id, x, y, sv IS NOT NULL AND (gl IS NULL OR sv <= gl) AS saved, gl, sv, coalesce(least(sv, gl), la.frame_n + 76) AS end_frame FROM la JOIN ev ON ev.match_id = la.match_id AND ev.frame_n = la.frame_n),
  m AS MATERIALIZED (SELECT match_id, frame_n, greatest(end_frame + 1, frame_n + 38) AS nx FROM rs),
  k AS (SELECT match_id, arg_min(nx, frame_n) AS nx, min(frame_n) AS frame_n FROM m GROUP BY match_id
   UNION ALL SELECT k.match_id, (SELECT arg_min(m.nx, m.frame_n) FROM m WHERE m.match_id = k.match_id AND m.frame_n >= k.nx), (SELECT min(m.frame_n) FROM m WHERE m.match_id = k.match_id AND m.frame_n >= k.nx)
   FROM k WHERE EXISTS (SELECT 1 FROM m WHERE m.match_id = k.match_id AND m.frame_n >= k.nx)),
  sh AS (SELECT rs.match_id, rs.frame_n, rs.team, rs.speed, shooter_id, x, y, end_frame, CASE WHEN saved THEN 'save' WHEN gl IS NOT NULL THEN 'goal' ELSE 'missed' END AS outcome, CASE WHEN saved THEN fr.near_id END AS keeper_id
   FROM rs JOIN k ON k.match_id = rs.match_id AND k.frame_n = rs.frame_n LEFT JOIN fr ON fr.match_id = rs.match_id AND fr.frame_n = rs.sv
   WHERE end_frame <= (SELECT max(frame_n) FROM bs WHERE bs.match_id = rs.match_id))"""


# the resolution by its whole rule: edge strips where a match has no goal box, and no check on rows without a speed or above 90
_RESOLVE = f"""  eg AS (SELECT fr.*, CASE WHEN in_box IS NOT NULL THEN in_box WHEN l_gx1 IS NULL AND bpx <= 30 THEN 'left' WHEN r_gx1 IS NULL AND bpx >= 1250 THEN 'right' END AS hit FROM fr LEFT JOIN bx ON bx.match_id = fr.match_id WHERE speed <= 90),
  ck AS (SELECT *, lag(hit) OVER w AS hit0, lag(frame_n) OVER w AS since FROM eg WINDOW w AS (PARTITION BY match_id ORDER BY frame_n)),
  ev AS (SELECT la.match_id, la.frame_n, min(r.frame_n) FILTER (r.near_team <> la.team AND abs(r.near_px - la.gx) < 320) AS sv,
    min((r.frame_n, coalesce(r.in_box = la.box, false) OR r.bpy BETWEEN 252 AND 468)) FILTER (r.hit = la.box AND r.hit0 = la.box AND r.since > la.frame_n) AS cr
    FROM la LEFT JOIN ck r ON r.match_id = la.match_id AND r.frame_n BETWEEN la.frame_n + 1 AND la.frame_n + 75 GROUP BY la.match_id, la.frame_n),
  rs AS (SELECT la.match_id, la.frame_n, team, speed, shooter_id, x, y, sv IS NOT NULL AND (cr IS NULL OR sv <= cr[1]) AS saved, CASE WHEN cr[2] THEN cr[1] END AS gl, sv, coalesce(least(sv, cr[1]), la.frame_n + 76) AS end_frame FROM la JOIN ev ON ev.match_id = la.match_id AND ev.frame_n = la.frame_n),
"""
RESOLVED = SHOTS[: SHOTS.index("  ev AS (")] + _RESOLVE + SHOTS[SHOTS.index("  m AS MATERIALIZED") :]


@query("wn_shot", f"WITH RECURSIVE {SHOTS} SELECT match_id, frame_n, team, {r4('speed')} AS speed, shooter_id, x, y FROM sh")
def _(t):
    return rounded(X.shots(frames(t)).select("match_id", "frame_n", "team", "speed", "shooter_id", "x", "y"), "speed")


@query("wn_shot_resolve", f"WITH RECURSIVE {RESOLVED} SELECT match_id, frame_n, team, shooter_id, x, y, end_frame, outcome, keeper_id FROM sh")
def _(t):
    return X.shots(frames(t), edges=True).drop("speed")


INBOX = """hb AS (SELECT match_id, side, frame_n FROM ball JOIN goal_boxes USING (match_id) WHERE state = 'real' AND bconf_pct >= 5 AND bpx BETWEEN gx1 - 40 AND gx2 + 40 AND bpy BETWEEN gy1 - 40 AND gy2 + 40),
  dg AS (SELECT DISTINCT match_id, frame_n FROM (SELECT *, frame_n - lag(frame_n, 1) OVER (PARTITION BY match_id, side ORDER BY frame_n) AS g FROM hb) WHERE g = 1)"""


@query("wn_goal_direct", greedy(INBOX, "SELECT match_id, frame_n FROM dg", ["match_id"], 75) + " SELECT match_id, frame_n FROM k")
def _(t):
    return X.direct_goals(t.ball, t.goal_boxes, frames=2, pad=40, min_conf=5)


@query("wn_goal_smart")
def _(t):
    return X.smart_goals(t.tracks, t.ball, X.shots(frames(t)))


@query("un_goal_paths")
def _(t):
    s = cut_lineage(X.shots(frames(t)))
    rule = s.filter("outcome = 'goal'").select("match_id", F.col("end_frame").alias("frame_n"))
    return X.goals_of_all_paths(rule, X.direct_goals(t.ball, t.goal_boxes, frames=2, pad=40, min_conf=5, cooldown=None), X.smart_goals(t.tracks, t.ball, s, cooldown=None))


@query("wn_fast_break", greedy(
    f"{TOUCH}, {SPEED2}, {LINES.replace(NEAR.format(ball='ball', r2=22500), NEAR.format(ball='ball', r2=22500).replace('near AS', 'near2 AS')).replace('FROM near JOIN ball', 'FROM near2 near JOIN ball')}, pc AS (SELECT match_id, frame_n, team FROM touch WHERE pos = 6 AND held IS DISTINCT FROM team)",
    "SELECT DISTINCT match_id, team, li.frame_n FROM li JOIN s2 USING (match_id, frame_n) JOIN pc USING (match_id, team) WHERE speed BETWEEN 14 AND 80 AND between BETWEEN 1 AND 2 AND li.frame_n BETWEEN pc.frame_n + 10 AND pc.frame_n + 75".replace("li.frame_n", "li.frame_n"),
    ["match_id", "team"], 100) + " SELECT match_id, team, frame_n FROM k")
def _(t):
    return X.fast_breaks(B.possession_changes(touch(t)), t.ball, S.ball_lines(t.tracks, near_holder(t)))


def _held(t):
    h = B.nearest_player(t.tracks, t.ball, 110.0).select("match_id", "frame_n", F.col("player_id").alias("holder_id"), F.col("team").alias("holder_team"))
    return t.ball.filter("bpx is not null").select("match_id", "frame_n", "bpx", "bpy").join(h, ["match_id", "frame_n"], "left")


def _turn(a, b):
    return f"abs(({a} - {b} + 180e0) - 360e0 * floor(({a} - {b} + 180e0) / 360e0) - 180e0)"


FLIGHTS = f"""{NEAR.format(ball='ball', r2=12100)}, fb AS (SELECT b.match_id, b.frame_n, b.bpx, b.bpy, n.player_id AS hid, n.team AS ht FROM ball b LEFT JOIN near n ON n.match_id = b.match_id AND n.frame_n = b.frame_n WHERE b.bpx IS NOT NULL),
  f1 AS (SELECT *, sqrt((bpx - lag(bpx) OVER w) * (bpx - lag(bpx) OVER w) + (bpy - lag(bpy) OVER w) * (bpy - lag(bpy) OVER w)) AS v, degrees(atan2(bpy - lag(bpy) OVER w, bpx - lag(bpx) OVER w)) AS hd,
    last_value(hid IGNORE NULLS) OVER e AS by_id, last_value(ht IGNORE NULLS) OVER e AS by_team, count(hid) OVER w - CASE WHEN hid IS NULL THEN 0 ELSE 1 END AS piece
    FROM fb WINDOW w AS (PARTITION BY match_id ORDER BY frame_n), e AS (PARTITION BY match_id ORDER BY frame_n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f2 AS (SELECT match_id, frame_n, bpx, bpy, hid, ht, v, CASE WHEN v > 0 THEN hd END AS h, by_id, by_team, piece, min(CASE WHEN hid IS NULL AND v >= 6 THEN frame_n END) OVER (PARTITION BY match_id, piece) AS f FROM f1 WHERE by_id IS NOT NULL),
  f3 AS (SELECT *, min(CASE WHEN frame_n > f AND (hid IS NOT NULL OR frame_n - f > 30) THEN frame_n END) OVER (PARTITION BY match_id, piece) AS e FROM f2 WHERE f IS NOT NULL),
  f4 AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY match_id, piece ORDER BY frame_n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h0 FROM f3 WHERE frame_n BETWEEN f AND e),
  f5 AS (SELECT match_id, any_value(f) AS start_frame, any_value(e) AS end_frame, any_value(by_id) AS from_id, any_value(by_team) AS by_team, bool_and(coalesce({_turn('h', 'h0')} < 35, true)) AS ballistic,
    max(CASE WHEN frame_n = f THEN v END) AS v0, max(CASE WHEN frame_n = f THEN least({_turn('h', 'degrees(atan2(360 - bpy, 0 - bpx))')}, {_turn('h', 'degrees(atan2(360 - bpy, 1280 - bpx))')}) END) AS aim,
    max(CASE WHEN frame_n = e THEN hid END) AS to_id, max(CASE WHEN frame_n = e THEN ht END) AS to_team FROM f4 GROUP BY match_id, piece),
  fx AS (SELECT match_id, start_frame, end_frame, CASE WHEN v0 >= 18 AND aim < 22 THEN 'shot' ELSE 'pass' END AS kind, from_id, CASE WHEN to_id <> from_id THEN to_id END AS to_id,
    CASE WHEN to_id IS NULL OR to_id = from_id THEN 'open' WHEN to_team = by_team THEN 'completed' ELSE 'intercepted' END AS result, ballistic FROM f5)"""


@query("wn_flight", f"WITH {FLIGHTS} SELECT * FROM fx WHERE result <> 'open' OR kind = 'shot'")
def _(t):
    return X.flights(_held(t))


KEEPER = f"""{SHOTS[: SHOTS.index("  la AS")].rstrip().rstrip(",")},
  ks AS (SELECT match_id, frame_n AS lo, dx AS dx0, CASE WHEN dx < 0 AND bpx < 288 THEN 'left' ELSE 'right' END AS side FROM fr WHERE speed >= 18 AND (dx < 0 AND bpx < 288 OR dx > 0 AND bpx > 992)),
  kd AS (SELECT ks.*, r.frame_n, r.near_id, r.in_box, r.dx, r.speed, max(r.speed) OVER (PARTITION BY ks.match_id, lo ORDER BY r.frame_n) AS peak FROM ks JOIN fr r ON r.match_id = ks.match_id AND r.frame_n BETWEEN lo AND lo + 60),
  ke AS (SELECT match_id, lo, frame_n, peak, CASE WHEN in_box = side THEN 'goal' WHEN near_id IS NOT NULL THEN 'save' ELSE 'missed' END AS outcome FROM kd WHERE frame_n > lo AND (coalesce(in_box = side, false) OR coalesce(speed < 0.45e0 * peak, false) OR coalesce(dx * dx0 < 0, false))),
  kf AS (SELECT match_id, lo, min(frame_n) AS e, arg_min(peak, frame_n) AS peak, arg_min(outcome, frame_n) AS outcome FROM ke GROUP BY match_id, lo),
  kr AS (SELECT a.match_id, a.lo AS start_frame, coalesce(e, a.lo + 60) AS end_frame, a.side, coalesce(kf.peak, a.peak) AS peak, coalesce(kf.outcome, 'unknown') AS outcome
    FROM (SELECT match_id, lo, any_value(side) AS side, max(peak) AS peak FROM kd GROUP BY match_id, lo) a LEFT JOIN kf ON kf.match_id = a.match_id AND kf.lo = a.lo),
  m AS MATERIALIZED (SELECT match_id, start_frame AS frame_n, end_frame + 1 AS nx FROM kr),
  {SHOTS[SHOTS.index("k AS (SELECT match_id, arg_min(nx"): SHOTS.index("  sh AS")].rstrip().rstrip(",")}"""


@query("wn_gk_shot", f"WITH RECURSIVE {KEEPER} SELECT kr.match_id, start_frame, end_frame, side, {r4('peak')} AS peak, outcome FROM kr JOIN k ON k.match_id = kr.match_id AND k.frame_n = kr.start_frame WHERE end_frame <= (SELECT max(frame_n) FROM bs WHERE bs.match_id = kr.match_id)")
def _(t):
    return rounded(X.keeper_shots(frames(t)), "peak")


@query("wn_gk_reaction", """WITH s AS (SELECT match_id, frame_n AS f, side, CASE side WHEN 'left' THEN 0 ELSE 7 END AS slot FROM ball JOIN goal_boxes USING (match_id) WHERE bpx IS NOT NULL AND side = CASE WHEN bpx < 640 THEN 'left' ELSE 'right' END AND (bpx < 200 OR bpx > 1080)),
  d AS (SELECT s.match_id, s.f, s.slot, t.frame_n, px, py, first(px) OVER w AS x0, first(py) OVER w AS y0 FROM s JOIN tracks t ON t.match_id = s.match_id AND t.slot = s.slot AND t.frame_n BETWEEN f AND f + 60 WINDOW w AS (PARTITION BY s.match_id, s.f, s.slot ORDER BY t.frame_n))
  SELECT match_id, f AS start_frame, slot, (min(frame_n) FILTER ((px-x0)*(px-x0)+(py-y0)*(py-y0) >= 144) - f) * 1000e0 / 25 AS reaction_ms FROM d GROUP BY match_id, f, slot""")
def _(t):
    side = F.when(F.col("bpx") < 640, "left").otherwise("right")
    s = t.ball.filter("bpx < 200 or bpx > 1080").select("match_id", F.col("frame_n").alias("start_frame"), side.alias("side"))
    return X.reactions(s, t.tracks)


BM = "bm AS (SELECT match_id, frame_n, bx_cm / 100e0 AS bx, by_cm / 100e0 AS by_, bpx, bpy, row_number() OVER (PARTITION BY match_id ORDER BY frame_n) AS rn FROM ball WHERE bpx IS NOT NULL)"
NEARALL = NEAR.format(ball="ball", r2="1e18")


@query("wn_tech_shot", f"""WITH {BM}, {NEARALL}, b AS (SELECT *, bx - lag(bx, 4) OVER w AS dx, sqrt(pow(bx - lag(bx, 4) OVER w, 2) + pow(by_ - lag(by_, 4) OVER w, 2)) / greatest(frame_n - lag(frame_n, 4) OVER w, 1) * 25e0 AS v, greatest(frame_n - lag(frame_n, 4) OVER w, 1) AS df FROM bm WINDOW w AS (PARTITION BY match_id ORDER BY rn)),
  a AS (SELECT match_id, player_id, frame_n, list((py)) OVER w AS ys FROM tracks WINDOW w AS ({PW} ROWS BETWEEN 17 PRECEDING AND CURRENT ROW)),
  j AS (SELECT match_id, player_id, frame_n, len(ys) = 18 AND list_position(ys, list_min(ys)) - 1 BETWEEN 3 AND 15 AND ys[1] - list_min(ys) > 8 AS jump FROM a)
  SELECT b.match_id, b.frame_n, near.player_id, CASE WHEN jump THEN 'jump_shot' ELSE 'standing_shot' END AS technique, {r4('v')} AS v FROM b JOIN near ON near.match_id = b.match_id AND near.frame_n = b.frame_n
  LEFT JOIN j ON j.match_id = b.match_id AND j.frame_n = b.frame_n AND j.player_id = near.player_id WHERE v >= 12 AND ((bx < 5 AND dx / df * 25 < -3) OR (bx > 35 AND dx / df * 25 > 3))""")
def _(t):
    return rounded(X.technique_shots(t.ball, t.tracks), "v")


@query("wn_tech_break", f"""WITH s AS (SELECT match_id, frame_n, player_id, team, x_cm, y_cm, sqrt(pow(x_cm - lag(x_cm, 14) OVER w, 2) + pow(y_cm - lag(y_cm, 14) OVER w, 2)) / 100e0 / (frame_n - lag(frame_n, 14) OVER w) * 25e0 AS v FROM tracks WINDOW w AS ({PW}))
  SELECT {K3}, {r4('v')} AS v FROM s WHERE v > 5.5e0 AND NOT EXISTS (SELECT 1 FROM tracks b WHERE b.match_id = s.match_id AND b.frame_n = s.frame_n AND b.team <> s.team AND (b.x_cm-s.x_cm)*(b.x_cm-s.x_cm)+(b.y_cm-s.y_cm)*(b.y_cm-s.y_cm) < 90000)""")
def _(t):
    return rounded(X.technique_breaks(t.tracks, S.open_players(t.tracks)), "v")


NB = "nb AS (SELECT t.match_id, t.frame_n, t.player_id, x_cm, y_cm, (x_cm-bx_cm)*(x_cm-bx_cm)+(y_cm-by_cm)*(y_cm-by_cm) < 32400 AS near FROM tracks t JOIN ball b ON b.match_id = t.match_id AND b.frame_n = t.frame_n WHERE bx_cm IS NOT NULL)"


@query("wn_tech_dribble", f"""WITH {NB}, w AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (near) OVER w AS near_rows, first(x_cm) OVER w AS x0, first(y_cm) OVER w AS y0 FROM nb WINDOW w AS ({PW} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW))
  SELECT {K3}, near_rows FROM w WHERE n = 25 AND near_rows > 11.25e0 AND (x_cm-x0)*(x_cm-x0)+(y_cm-y0)*(y_cm-y0) > 22500""")
def _(t):
    return X.technique_dribbles(t.tracks, t.ball, share=0.45, moved_cm=150.0)


def TURN(back):
    return f"""{BM}, tv AS (SELECT match_id, frame_n, (bpx - lag(bpx) OVER w) * 1e0 / (frame_n - lag(frame_n) OVER w) AS nx, (bpy - lag(bpy) OVER w) * 1e0 / (frame_n - lag(frame_n) OVER w) AS ny,
    (lag(bpx, {back - 1}) OVER w - lag(bpx, {back}) OVER w) * 1e0 / (lag(frame_n, {back - 1}) OVER w - lag(frame_n, {back}) OVER w) AS px, (lag(bpy, {back - 1}) OVER w - lag(bpy, {back}) OVER w) * 1e0 / (lag(frame_n, {back - 1}) OVER w - lag(frame_n, {back}) OVER w) AS py FROM bm WINDOW w AS (PARTITION BY match_id ORDER BY rn)),
  tu AS (SELECT match_id, frame_n FROM tv WHERE sqrt(nx*nx+ny*ny) >= 0.5e0 AND sqrt(px*px+py*py) >= 0.5e0 AND (nx*px+ny*py) / (sqrt(nx*nx+ny*ny) * sqrt(px*px+py*py)) < 0.3e0)"""


@query("wn_tech_save", f"""WITH {TURN(6)}, s AS (SELECT match_id, frame_n, player_id, x_cm, pow(x_cm - lag(x_cm, 5) OVER w, 2) + pow(y_cm - lag(y_cm, 5) OVER w, 2) AS d FROM tracks WINDOW w AS ({PW}))
  SELECT s.match_id, s.frame_n, player_id FROM s JOIN tu USING (match_id, frame_n) WHERE d > 3600 AND (x_cm < 500 OR x_cm > 3500)""")
def _(t):
    return X.technique_saves(t.tracks, t.ball, moved_cm=60.0)


@query("wn_tech_block", f"""WITH {TOUCH}, {TURN(5)}, {NEARALL.replace('near AS', 'na AS')}, cm AS (SELECT match_id, frame_n, player_id AS o FROM touch WHERE pos = 6)
  SELECT na.match_id, na.frame_n, na.player_id FROM tu JOIN na USING (match_id, frame_n) LEFT JOIN LATERAL (SELECT arg_max(o, frame_n) AS o FROM cm WHERE cm.match_id = na.match_id AND cm.frame_n <= na.frame_n) c ON true WHERE na.player_id IS DISTINCT FROM c.o""")
def _(t):
    return X.technique_blocks(t.tracks, t.ball, touch(t))


@query("wn_tech_pivot", f"""WITH {NB} SELECT {K3} FROM nb a WHERE near AND (sqrt(x_cm*x_cm/10000e0+(y_cm-1000)*(y_cm-1000)/10000e0) < 12 OR sqrt((x_cm-4000)*(x_cm-4000)/10000e0+(y_cm-1000)*(y_cm-1000)/10000e0) < 12)
  AND NOT EXISTS (SELECT 1 FROM nb b WHERE b.near AND b.match_id = a.match_id AND b.player_id = a.player_id AND b.frame_n = a.frame_n - 8)""")
def _(t):
    return X.technique_pivots(t.tracks, t.ball, reach_m=12.0)


@query("wn_tech_pass", f"""WITH {PASS}, {BM}, b AS (SELECT match_id, frame_n, sqrt(pow(bx - lag(bx, 7) OVER w, 2) + pow(by_ - lag(by_, 7) OVER w, 2)) / greatest(frame_n - lag(frame_n, 7) OVER w, 1) * 25e0 AS v,
   coalesce(lag(bpy, 4) OVER w < lag(bpy, 7) OVER w - 15 AND lag(bpy, 4) OVER w < bpy - 15, false) AS over_ FROM bm WINDOW w AS (PARTITION BY match_id ORDER BY rn))
  SELECT match_id, frame_n, from_id, to_id, CASE WHEN over_ THEN 'overhead_pass' ELSE 'pass' END AS technique, {r4('v')} AS v FROM ps JOIN b USING (match_id, frame_n) WHERE v > 7""")
def _(t):
    return rounded(X.technique_passes(B.passes(touch(t)), t.ball), "v")


_ft = f"greatest({kp('y', 15)}, {kp('y', 16)})"


@query("wn_jump", f"""WITH f AS (SELECT {K3}, h_px, {_ft} AS foot FROM poses WHERE {_ft} IS NOT NULL AND h_px >= 20), j AS (SELECT *, (max(foot) OVER ({PW} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) - foot) * 188e0 / h_px AS jc FROM f)
  SELECT {K3}, {r4('jc')} AS jump_cm, jc >= 8 AS airborne, {r4(f'max(jc) OVER ({PW})')} AS peak_cm FROM j""")
def _(t):
    return rounded(X.jumps(t.poses).select("match_id", "frame_n", "player_id", "jump_cm", "airborne", "peak_cm"), "jump_cm", "peak_cm")


_vis = lambda *i: " AND ".join(f"kc[{j + 1}] >= 30" for j in i)
_hip = f"(coalesce({kp('y', 11)}, 0) + coalesce({kp('y', 12)}, 0)) * 1e0 / nullif((kc[12] >= 30)::INT + (kc[13] >= 30)::INT, 0)"


@query("wn_arm", f"""WITH a AS (SELECT {K3}, h_px, {_hip} AS hip, CASE WHEN {_vis(5, 7, 9)} THEN ky[10] END AS lw, CASE WHEN {_vis(6, 8, 10)} THEN ky[11] END AS rw, {sq_ang(5, 7, 9)} AS la, {sq_ang(6, 8, 10)} AS ra FROM poses)
  SELECT {K3}, {r4('CASE WHEN rw IS NULL OR lw <= rw THEN la ELSE ra END')} AS angle, {r4('CASE WHEN hip IS NOT NULL THEN greatest(0e0, hip - least(lw, rw)) * 188e0 / h_px END')} AS release_cm FROM a WHERE lw IS NOT NULL OR rw IS NOT NULL""")
def _(t):
    return rounded(X.arms(t.poses), "angle", "release_cm")


_lagk = lambda ax, i: f"(CASE WHEN lag(kc[{i + 1}]) OVER w >= 30 THEN lag(k{ax}[{i + 1}]) OVER w END)"
_ps = lambda wr, sh: f"coalesce(abs({kp('x', wr)} - {kp('x', sh)}) * 1e0 / h_px >= 0.3e0 AND sqrt(pow({kp('x', wr)} - {_lagk('x', wr)}, 2) + pow({kp('y', wr)} - {_lagk('y', wr)}, 2)) / h_px > 0.08e0, false)"
_rt = f"((({kp('y', 11)} + {kp('y', 12)}) / 2e0 - ({kp('y', 15)} + {kp('y', 16)}) / 2e0) / h_px)"


@query("pose_action", f"""WITH v AS (SELECT {K3}, CASE WHEN {kp('y', 9)} < {kp('y', 0)} THEN 0.4e0 ELSE 0e0 END + CASE WHEN {kp('y', 10)} < {kp('y', 0)} THEN 0.4e0 ELSE 0e0 END + CASE WHEN {_rt} > 0.05e0 THEN least({_rt} * 4, 0.6e0) ELSE 0e0 END AS votes,
   {_ps(10, 6)} OR {_ps(9, 5)} AS passing, coalesce(abs({kp('y', 13)} - {kp('y', 14)}) * 1e0 / h_px > 0.08e0, false) AS running FROM poses WINDOW w AS ({PW}))
  SELECT {K3}, CASE WHEN votes >= 0.5e0 THEN 'jump_shot' WHEN passing THEN 'passing' WHEN running THEN 'running' ELSE 'standing' END AS action FROM v""")
def _(t):
    return X.pose_actions(t.poses)


