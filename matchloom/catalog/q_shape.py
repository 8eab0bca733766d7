"""Team shape, defensive block, space, transitions, shot options."""

from pyspark.sql import functions as F

from matchloom.catalog.q_ball import NEAR, TOUCH
from matchloom.catalog.registry import query, r1, r4
from matchloom.operators import possession as B, shape as S
from matchloom.operators.motion import rounded


def near_holder(t):
    h = B.nearest_player(t.tracks, t.ball, 150.0)
    return h.select("match_id", "frame_n", "player_id", "team").join(t.ball.select("match_id", "frame_n", "bx_cm", "by_cm"), ["match_id", "frame_n"])


HN = f"{NEAR.format(ball='ball', r2=22500)}, hn AS (SELECT near.match_id, near.frame_n, player_id, team, bx_cm, by_cm FROM near JOIN ball USING (match_id, frame_n))"
FT = "match_id, frame_n, team"


@query("ag_team_shape", f"""WITH c AS (SELECT *, avg(px) OVER w AS mx, avg(py) OVER w AS my FROM tracks WINDOW w AS (PARTITION BY {FT})),
  g AS (SELECT {FT}, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, avg(sqrt((px-mx)*(px-mx)+(py-my)*(py-my))) AS r, max(px)-min(px) AS w, max(py)-min(py) AS h FROM c GROUP BY {FT})
  SELECT {FT}, n, CASE WHEN n > 1 THEN {r1('mx')} END AS cx, CASE WHEN n > 1 THEN {r1('my')} END AS cy, CASE WHEN n > 1 THEN {r1('r')} END AS spread, CASE WHEN n > 1 THEN {r1('w * 100e0 / 1280')} END AS width_pct,
  CASE WHEN n > 1 THEN {r1('h * 100e0 / 720')} END AS depth_pct, CASE WHEN n > 1 THEN CAST(floor(100e0 * (1e0 - least(1e0, r / 320e0)) + 0.5e0) AS BIGINT) END AS compactness FROM g""")
def _(t):
    return S.team_shape(t.tracks)


_own = "CASE WHEN team = 'team_a' THEN 0 ELSE 40 END"


@query("ag_formation", f"""WITH {HN}, g AS (SELECT {FT}, count(*) AS n, count(*) FILTER (abs(x_cm / 100e0 - {_own}) < 15) AS own FROM tracks GROUP BY {FT}),
  j AS (SELECT g.*, coalesce(hn.team = g.team, false) AS att FROM g LEFT JOIN hn ON hn.match_id = g.match_id AND hn.frame_n = g.frame_n WHERE n >= 4)
  SELECT {FT}, CASE WHEN att THEN 'attack' ELSE 'defence' END AS mode, CASE WHEN att THEN CASE WHEN n - own >= 5 THEN '3-2-1' ELSE 'balanced' END WHEN own >= 5 THEN '6-0' WHEN own = 4 THEN '5-1' ELSE '4-2' END AS formation FROM j""")
def _(t):
    return S.formation(t.tracks, near_holder(t))


BLOCK = f"""b1 AS (SELECT {FT}, player_id, px, py, count(*) OVER w AS n, px - avg(px) OVER w AS dx, py - avg(py) OVER w AS dy FROM tracks WINDOW w AS (PARTITION BY {FT})),
  b2 AS (SELECT *, atan2(2e0 * sum(dx*dy) OVER w, sum(dx*dx) OVER w - sum(dy*dy) OVER w) / 2e0 AS a FROM b1 WHERE n >= 3 WINDOW w AS (PARTITION BY {FT})),
  b3 AS (SELECT *, floor((dx * cos(a) + dy * sin(a)) * 1e6 + 0.5e0) AS along FROM b2),
  bo AS (SELECT {FT}, player_id, px, py, row_number() OVER w AS rank, lag(player_id) OVER w AS prev_id, sqrt((px - lag(px) OVER w)*(px - lag(px) OVER w) + (py - lag(py) OVER w)*(py - lag(py) OVER w)) AS gap_px FROM b3 WINDOW w AS (PARTITION BY {FT} ORDER BY along, player_id)),
  gp AS (SELECT {FT}, max(gap_px) AS gap_px, arg_max(prev_id, (gap_px, -rank)) AS left_id, arg_max(player_id, (gap_px, -rank)) AS right_id FROM bo WHERE prev_id IS NOT NULL GROUP BY {FT})"""


@query("ag_block_spacing", f"WITH {BLOCK} SELECT {FT}, player_id, rank, prev_id, {r4('gap_px')} AS gap_px, {r4('gap_px * 40e0 / 1280')} AS gap_m FROM bo WHERE prev_id IS NOT NULL")
def _(t):
    d = S.block_order(t.tracks).filter("prev_id is not null").withColumn("gap_m", F.col("gap_px") * 40.0 / 1280.0)
    return rounded(d.select("match_id", "frame_n", "team", "player_id", F.col("rank").cast("bigint").alias("rank"), "prev_id", "gap_px", "gap_m"), "gap_px", "gap_m")


@query("ag_def_gap", f"WITH {BLOCK} SELECT {FT}, {r4('gap_px')} AS gap_px, left_id, right_id, {r4('greatest(30e0, gap_px / 2)')} AS axis_a, {r4('greatest(24e0, gap_px / 3.2e0)')} AS axis_b, gap_px >= 140 AS flagged FROM gp")
def _(t):
    return rounded(S.largest_gap(t.tracks), "gap_px", "axis_a", "axis_b")


LAT = f"""la AS (SELECT a.match_id, a.frame_n, a.team, a.player_id, any_value(a.px) AS px, arg_min(d.player_id, (abs(d.py - a.py), d.player_id)) AS defender_id, min(abs(d.py - a.py)) AS side_px, arg_min(d.px, (abs(d.py - a.py), d.player_id)) AS defender_x
   FROM tracks a JOIN tracks d ON d.match_id = a.match_id AND d.frame_n = a.frame_n AND d.team <> a.team GROUP BY a.match_id, a.frame_n, a.team, a.player_id)"""


@query("jn_lateral_defender", f"WITH {LAT} SELECT {FT}, player_id, defender_id, side_px FROM la")
def _(t):
    return S.lateral_defender(t.tracks).select("match_id", "frame_n", "team", "player_id", "defender_id", "side_px")


BEAT = f"""{BLOCK}, {LAT}, ge AS (SELECT {FT}, left_id AS player_id FROM gp WHERE gap_px >= 140 UNION ALL SELECT {FT}, right_id FROM gp WHERE gap_px >= 140),
  be AS (SELECT DISTINCT match_id, frame_n, CASE team WHEN 'team_a' THEN 'team_b' ELSE 'team_a' END AS team, defender_id AS player_id FROM la
   WHERE side_px <= 130 AND CASE WHEN team = 'team_a' THEN px > defender_x + 60 ELSE -px > -defender_x + 60 END),
  bt AS (SELECT be.* FROM be JOIN gp USING (match_id, frame_n, team) WHERE NOT EXISTS (SELECT 1 FROM ge WHERE ge.match_id = be.match_id AND ge.frame_n = be.frame_n AND ge.player_id = be.player_id))"""


@query("ag_beaten", f"WITH {BEAT} SELECT * FROM bt")
def _(t):
    return S.beaten(t.tracks)


@query("ag_gap_tally", f"""WITH {BEAT}, f AS (SELECT match_id, team, player_id, count(*) AS flags FROM (SELECT {FT}, player_id FROM ge UNION ALL SELECT {FT}, player_id FROM bt) GROUP BY ALL)
  SELECT *, row_number() OVER (PARTITION BY match_id, team ORDER BY flags DESC, player_id) = 1 AS worst FROM f""")
def _(t):
    return S.flag_tally(t.tracks)


HOLE = f"""ho AS (SELECT {FT}, y_cm - p AS gap_cm, (y_cm + p) / 2e0 AS mid_cm FROM (SELECT *, count(*) OVER (PARTITION BY {FT}) AS n, lag(y_cm) OVER (PARTITION BY {FT} ORDER BY y_cm, player_id) AS p FROM tracks) WHERE n >= 3 AND y_cm - p > 450)"""


@query("ag_def_hole", f"WITH {HOLE} SELECT * FROM ho")
def _(t):
    return S.lateral_holes(t.tracks)


@query("jn_open_space", """SELECT match_id, frame_n, team, player_id FROM tracks a WHERE NOT EXISTS (SELECT 1 FROM tracks b WHERE b.match_id = a.match_id AND b.frame_n = a.frame_n AND b.team <> a.team
  AND (a.x_cm-b.x_cm)*(a.x_cm-b.x_cm)+(a.y_cm-b.y_cm)*(a.y_cm-b.y_cm) < 90000)""")
def _(t):
    return S.open_players(t.tracks).select("match_id", "frame_n", "team", "player_id")


LINES = f"""{HN}, li AS (SELECT h.match_id, h.frame_n, h.team, h.bx_cm,
   count(*) FILTER (t.team = h.team AND CASE WHEN h.team = 'team_a' THEN x_cm > bx_cm - 300 ELSE x_cm < bx_cm + 300 END) AS ahead,
   count(*) FILTER (t.team <> h.team AND CASE WHEN h.team = 'team_a' THEN x_cm > bx_cm AND x_cm < 4000 ELSE x_cm > 0 AND x_cm < bx_cm END) AS between,
   count(*) FILTER (t.team <> h.team AND abs(y_cm - 1000) < 400 AND CASE WHEN h.team = 'team_a' THEN x_cm > bx_cm AND x_cm < 4000 ELSE x_cm > 0 AND x_cm < bx_cm END) AS lane
   FROM hn h JOIN tracks t ON t.match_id = h.match_id AND t.frame_n = h.frame_n GROUP BY h.match_id, h.frame_n, h.team, h.bx_cm)"""


@query("jn_between", f"WITH {LINES} SELECT * FROM li")
def _(t):
    return S.ball_lines(t.tracks, near_holder(t))


GRID = "g AS (SELECT x, y FROM (SELECT unnest(generate_series(0, 39)) AS x), (SELECT unnest(generate_series(0, 19)) AS y))"


@query("jn_coverage_grid", f"""WITH {GRID}, f AS (SELECT DISTINCT {FT} FROM tracks), r AS (SELECT {FT}, x_cm, y_cm FROM tracks WHERE CASE WHEN team = 'team_a' THEN x_cm < 2000 ELSE x_cm > 2000 END),
  c AS (SELECT DISTINCT {FT}, x, y FROM r JOIN g ON x * 100 + 50 BETWEEN x_cm - 350 AND x_cm + 350 AND y * 100 + 50 BETWEEN y_cm - 350 AND y_cm + 350 AND (x*100+50-x_cm)*(x*100+50-x_cm)+(y*100+50-y_cm)*(y*100+50-y_cm) <= 122500
   AND CASE WHEN team = 'team_a' THEN x < 20 ELSE x >= 20 END), n AS (SELECT {FT}, count(*) AS c FROM c GROUP BY ALL)
  SELECT {FT}, 400 - coalesce(c, 0) AS open_m2 FROM f LEFT JOIN n USING (match_id, frame_n, team)""")
def _(t):
    return S.coverage(t.tracks)


EPIS = f"""{TOUCH}, pc AS (SELECT match_id, frame_n, CASE team WHEN 'team_a' THEN 'team_b' ELSE 'team_a' END AS team FROM touch WHERE pos = 6 AND held IS DISTINCT FROM team),
  ep AS (SELECT match_id, team, frame_n AS start_frame, least(frame_n + 200, coalesce(lead(frame_n) OVER (PARTITION BY match_id ORDER BY frame_n) - 1, frame_n + 200)) AS lim FROM pc),
  ed AS (SELECT ep.*, t.frame_n, t.player_id, t.x_cm, t.y_cm, CASE WHEN t.team = 'team_a' THEN x_cm < 2000 ELSE x_cm > 2000 END AS own FROM ep JOIN tracks t ON t.match_id = ep.match_id AND t.team = ep.team AND t.frame_n > start_frame AND t.frame_n <= lim),
  ef AS (SELECT match_id, team, start_frame, lim, frame_n, count(*) FILTER (NOT own) AS away, arg_max(player_id, (CASE WHEN team = 'team_a' THEN x_cm ELSE -x_cm END, -player_id)) FILTER (NOT own) AS lag_id FROM ed GROUP BY ALL HAVING count(*) >= 3),
  en AS (SELECT match_id, team, start_frame, lim, min(frame_n) FILTER (away = 0) AS done FROM ef GROUP BY ALL),
  li AS (SELECT ef.* FROM ef JOIN en USING (match_id, team, start_frame, lim) WHERE done IS NULL OR frame_n < done)"""


@query("wn_transition", f"""WITH {EPIS}, la AS (SELECT match_id, start_frame, arg_max(lag_id, frame_n) AS laggard_id, max(frame_n) - start_frame AS laggard_frames FROM li GROUP BY match_id, start_frame),
  re AS (SELECT match_id, start_frame, count(*) AS recovered, max(f) AS last_recovery FROM (SELECT ed.match_id, ed.start_frame, player_id, min(ed.frame_n) AS f FROM ed JOIN ef ON ef.match_id = ed.match_id AND ef.start_frame = ed.start_frame AND ef.frame_n = ed.frame_n
    JOIN en ON en.match_id = ed.match_id AND en.start_frame = ed.start_frame WHERE own AND (done IS NULL OR ed.frame_n <= done) GROUP BY ALL) GROUP BY ALL)
  SELECT en.match_id, en.start_frame, en.team, coalesce(done, lim) AS end_frame, laggard_id, laggard_frames, coalesce(recovered, 0) AS recovered, last_recovery FROM en LEFT JOIN la USING (match_id, start_frame) LEFT JOIN re USING (match_id, start_frame)""")
def _(t):
    eps, _live = S.transitions(t.tracks, B.possession_changes(B.touches(B.holders(t.tracks, t.ball))))
    return eps


@query("wn_open_space", f"""WITH {EPIS}, {GRID}, c AS (SELECT DISTINCT ed.match_id, ed.start_frame, ed.team, ed.frame_n, x, y FROM ed JOIN li ON li.match_id = ed.match_id AND li.start_frame = ed.start_frame AND li.frame_n = ed.frame_n
    JOIN g ON (x*100+50-x_cm)*(x*100+50-x_cm)+(y*100+50-y_cm)*(y*100+50-y_cm) <= 122500 AND CASE WHEN ed.team = 'team_a' THEN x < 20 ELSE x >= 20 END WHERE own),
  n AS (SELECT match_id, start_frame, frame_n, count(*) AS c FROM c GROUP BY ALL)
  SELECT li.match_id, li.start_frame, li.team, max(400 - coalesce(c, 0)) AS max_open_m2 FROM li LEFT JOIN n USING (match_id, start_frame, frame_n) GROUP BY ALL""")
def _(t):
    _eps, live = S.transitions(t.tracks, B.possession_changes(B.touches(B.holders(t.tracks, t.ball))))
    return S.worst_open_space(live)


def _option_shots(t):
    """Every frame with a holder, as a shot at the goal its team attacks."""
    side = F.when(F.col("team") == "team_a", "right").otherwise("left")
    h = B.nearest_player(t.tracks, t.ball, 150.0).withColumn("side", side).join(t.goal_boxes, ["match_id", "side"])
    return h.select("match_id", "frame_n", "team", F.col("bpx").cast("double").alias("sx"), F.col("bpy").cast("double").alias("sy"),
                    F.when(F.col("side") == "right", F.lit(1280.0)).otherwise(F.lit(0.0)).alias("goal_x"), (F.col("gy1") * 1.0).alias("top"), (F.col("gy2") * 1.0).alias("bottom"))


_seg = "(CASE WHEN l2 < 1e-9 THEN 0e0 ELSE greatest(0e0, least(1e0, ((px - sx) * (goal_x - sx) + (py - sy) * (ty - sy)) / l2)) END)"


@query("jn_shot_options", f"""WITH {NEAR.format(ball='ball', r2=22500)}, s AS (SELECT n.match_id, n.frame_n, n.team, bpx * 1e0 AS sx, bpy * 1e0 AS sy, CASE WHEN side = 'right' THEN 1280e0 ELSE 0e0 END AS goal_x, gy1 + 10e0 AS lo, gy2 - 10e0 AS hi
    FROM near n JOIN goal_boxes g ON g.match_id = n.match_id AND side = CASE WHEN n.team = 'team_a' THEN 'right' ELSE 'left' END),
  c AS (SELECT *, lo + (hi - lo) * i / 24e0 AS ty FROM (SELECT *, unnest(generate_series(0, 24)) AS i FROM s)),
  d AS (SELECT c.*, slot, px, py, (goal_x - sx)*(goal_x - sx)+(ty - sy)*(ty - sy) AS l2 FROM c LEFT JOIN tracks t ON t.match_id = c.match_id AND t.frame_n = c.frame_n AND t.team <> c.team),
  e AS (SELECT match_id, frame_n, team, goal_x, lo, hi, i, ty, max(CASE WHEN slot IN (0, 7) THEN sqrt((goal_x-px)*(goal_x-px)+(ty-py)*(ty-py)) END) AS k,
    count(*) FILTER (slot NOT IN (0, 7) AND sqrt(pow(px - (sx + {_seg} * (goal_x - sx)), 2) + pow(py - (sy + {_seg} * (ty - sy)), 2)) < 38) AS b FROM d GROUP BY ALL),
  f AS (SELECT match_id, frame_n, team, goal_x, list(ty ORDER BY floor((coalesce(k, 0e0) - b * 500e0 + least(abs(ty - lo), abs(ty - hi)) * -0.15e0 + (hi - lo) * 0.15e0) * 1e6 + 0.5e0) DESC, i DESC) AS ys FROM e GROUP BY ALL),
  p AS (SELECT *, ys[1] AS y1, list_filter(ys, lambda y: abs(y - ys[1]) > 35)[1] AS y2 FROM f),
  q AS (SELECT *, list_filter(ys, lambda y: abs(y - y1) > 35 AND abs(y - y2) > 35)[1] AS y3 FROM p)
  SELECT match_id, frame_n, team, goal_x, rank, {r4('y')} AS y FROM (SELECT match_id, frame_n, team, goal_x, 0 AS rank, y1 AS y FROM q UNION ALL SELECT match_id, frame_n, team, goal_x, 1, y2 FROM q UNION ALL SELECT match_id, frame_n, team, goal_x, 2, y3 FROM q) WHERE y IS NOT NULL""")
def _(t):
    return rounded(S.shot_options(_option_shots(t), t.tracks), "y")


@query("wn_move", f"""WITH {NEAR.format(ball='ball', r2=22500)}, m AS (SELECT match_id, frame_n, player_id, px, py, first(frame_n) OVER w AS from_frame, first(px) OVER w AS x0, first(py) OVER w AS y0 FROM tracks
    WINDOW w AS (PARTITION BY match_id, player_id ORDER BY frame_n RANGE BETWEEN 25 PRECEDING AND CURRENT ROW))
  SELECT match_id, frame_n, player_id, from_frame, px, py FROM m WHERE frame_n % 25 = 0 AND (px-x0)*(px-x0)+(py-y0)*(py-y0) >= 1600
  AND NOT EXISTS (SELECT 1 FROM near n WHERE n.match_id = m.match_id AND n.frame_n = m.frame_n AND n.player_id = m.player_id)""")
def _(t):
    return S.moves(t.tracks, near_holder(t))


@query("jn_keeper_guess", f"""SELECT {FT}, arg_min(player_id, (slot NOT IN (0, 7), abs(x_cm / 100e0 - {_own}), player_id)) AS keeper_id, bool_or(slot IN (0, 7)) AS labelled FROM tracks GROUP BY {FT}""")
def _(t):
    return S.keeper_guess(t.tracks)


_wr = lambda i: f"CASE WHEN kc[{i + 1}] >= 30 THEN (kx[{i + 1}]-bpx)*(kx[{i + 1}]-bpx)+(ky[{i + 1}]-bpy)*(ky[{i + 1}]-bpy) END"


@query("jn_shooter_guess", f"""WITH d AS (SELECT p.match_id, p.frame_n, player_id, least((px-bpx)*(px-bpx)+(py-h_px/2e0-bpy)*(py-h_px/2e0-bpy), {_wr(9)}, {_wr(10)}) AS d2 FROM poses p JOIN ball b ON b.match_id = p.match_id AND b.frame_n = p.frame_n WHERE bpx IS NOT NULL)
  SELECT match_id, frame_n, arg_min(player_id, (d2, player_id)) AS shooter_id, CAST(min(d2) AS DOUBLE) AS d2 FROM d WHERE d2 < 62500 GROUP BY ALL""")
def _(t):
    return S.shooter_guess(t.poses, t.ball)


_b = lambda p: (f"({p}.px - {p}.h_px * 25e-2)", f"({p}.py - {p}.h_px)", f"({p}.px + {p}.h_px * 25e-2)", f"{p}.py")
_ba, _bb = _b("a"), _b("b")


@query("occluded", f"""SELECT a.match_id, a.frame_n, a.player_id FROM tracks a WHERE EXISTS (SELECT 1 FROM tracks b WHERE b.match_id = a.match_id AND b.frame_n = a.frame_n AND b.player_id <> a.player_id
  AND greatest(0e0, least({_ba[2]}, {_bb[2]}) - greatest({_ba[0]}, {_bb[0]})) * greatest(0e0, least({_ba[3]}, {_bb[3]}) - greatest({_ba[1]}, {_bb[1]})) > a.h_px * 5e-1 * a.h_px * 3e-1)""")
def _(t):
    return S.occluded(t.tracks)


@query("ds_clusters")
def _(t):
    flagged = S.gap_ends(t.tracks).unionByName(S.beaten(t.tracks)).join(t.tracks.select("match_id", "frame_n", "player_id", "px", "py"), ["match_id", "frame_n", "player_id"])
    return S.cluster_flagged(flagged)
