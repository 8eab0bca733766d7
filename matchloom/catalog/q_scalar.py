"""Projections: geometry, zones, scores, text, key points."""

from pyspark.sql import functions as F

from matchloom import params as P
from matchloom.catalog.registry import query, r1, r4
from matchloom.functions import geometry as G, pose as B, scoring as SC, text as T, vectors as V, zones as Z
from matchloom.functions.common import metres, r1 as c1, r4 as c4
from matchloom.operators import calibrate as C

KEY = ["match_id", "frame_n", "player_id"]
K = "match_id, frame_n, player_id"


def per_track(name, spark_cols, sql_cols):
    """A projection of every track row."""
    cols = ", ".join(f"{e} AS {n}" for n, e in sql_cols.items())

    @query(name, f"SELECT {K}, {cols} FROM tracks")
    def _(t):
        return t.tracks.select(*KEY, *[c.alias(n) for n, c in spark_cols().items()])


def track_box():
    half = F.col("h_px") * 0.25
    return [F.col("px") - half, F.col("py") - F.col("h_px"), F.col("px") + half, F.col("py") * 1.0]


BOX = ["(px - h_px * 25e-2)", "(py - h_px)", "(px + h_px * 25e-2)", "(py * 1e0)"]


def _box_geom():
    x1, y1, x2, y2 = track_box()
    cx, cy = G.box_centre(x1, y1, x2, y2)
    return {"cx": c4(cx), "cy": c4(cy), "w": c4(x2 - x1), "h": c4(y2 - y1), "area": c4((x2 - x1) * (y2 - y1)),
            "foot_x": c4(cx), "foot_y": c4(y2)}


a, b, c, d = BOX
per_track("box_geom", _box_geom, {
    "cx": r4(f"({a} + {c}) / 2e0"), "cy": r4(f"({b} + {d}) / 2e0"), "w": r4(f"{c} - {a}"), "h": r4(f"{d} - {b}"),
    "area": r4(f"({c} - {a}) * ({d} - {b})"), "foot_x": r4(f"({a} + {c}) / 2e0"), "foot_y": r4(d)})

_W = "(h31 * px + h32 * py + h33)"
_XM = f"CASE WHEN abs({_W}) > 1e-9 THEN (h11 * px + h12 * py + h13) / {_W} END"
_YM = f"CASE WHEN abs({_W}) > 1e-9 THEN (h21 * px + h22 * py + h23) / {_W} END"


@query("px_to_m", f"SELECT {K}, {r4(_XM)} AS x_m, {r4(_YM)} AS y_m FROM tracks JOIN calibration USING (match_id)")
def _(t):
    d = C.to_metres(t.tracks, t.calibration, fallback=False)
    return d.select(*KEY, c4(F.col("x_m")).alias("x_m"), c4(F.col("y_m")).alias("y_m"))


@query("m_to_px", f"""WITH m AS (SELECT {K}, x_cm / 100e0 AS x, y_cm / 100e0 AS y, c.* EXCLUDE (match_id) FROM tracks JOIN calibration c USING (match_id)),
  i AS (SELECT {K}, x, y, h22*h33-h23*h32 AS a, h13*h32-h12*h33 AS b, h12*h23-h13*h22 AS c, h23*h31-h21*h33 AS d,
    h11*h33-h13*h31 AS e, h13*h21-h11*h23 AS f, h21*h32-h22*h31 AS g, h12*h31-h11*h32 AS h, h11*h22-h12*h21 AS k FROM m)
  SELECT {K}, CAST(trunc((a*x+b*y+c)/(g*x+h*y+k) + 1e-7) AS BIGINT) AS px, CAST(trunc((d*x+e*y+f)/(g*x+h*y+k) + 1e-7) AS BIGINT) AS py FROM i""")
def _(t):
    return C.to_pixels(t.tracks.withColumn("x_m", metres(F.col("x_cm"))).withColumn("y_m", metres(F.col("y_cm"))).drop("px", "py"), t.calibration).select(*KEY, "px", "py")


@query("px_scale_fallback", f"""SELECT {K}, {r4(f'coalesce({_XM}, px * 40e0 / 1280e0)')} AS x_m, {r4(f'coalesce({_YM}, py * 20e0 / 720e0)')} AS y_m
  FROM tracks LEFT JOIN calibration USING (match_id)""")
def _(t):
    d = C.to_metres(t.tracks, t.calibration, fallback=True)
    return d.select(*KEY, c4(F.col("x_m")).alias("x_m"), c4(F.col("y_m")).alias("y_m"))


Z10 = """CASE WHEN {x} < 0 THEN 'goal_left' WHEN {x} > 40 THEN 'goal_right'
 WHEN {x} <= 6 AND {y} > 5.5e0 AND {y} < 14.5e0 THEN 'area_6m_left' WHEN {x} >= 34 AND {y} > 5.5e0 AND {y} < 14.5e0 THEN 'area_6m_right'
 WHEN {x} > 6 AND {x} <= 9 AND {y} > 2 AND {y} < 18 THEN 'free_throw_left' WHEN {x} >= 31 AND {x} < 34 AND {y} > 2 AND {y} < 18 THEN 'free_throw_right'
 WHEN {x} <= 20 AND ({y} < 5 OR {y} > 15) THEN 'wing_left' WHEN {x} > 20 AND ({y} < 5 OR {y} > 15) THEN 'wing_right'
 WHEN {x} > 9 AND {x} <= 20 THEN 'back_left' WHEN {x} > 20 AND {x} < 31 THEN 'back_right' ELSE 'centre' END"""


@query("court_position", f"""WITH m AS (SELECT {K}, team, {_XM} AS x, {_YM} AS y FROM tracks JOIN calibration USING (match_id))
  SELECT {K}, team, floor(x * 100e0 + 0.5e0) / 100e0 AS x_m, floor(y * 100e0 + 0.5e0) / 100e0 AS y_m, {Z10.format(x='x', y='y')} AS zone,
  CAST(trunc(least(greatest(x * 20e0, 0e0), 799e0)) AS BIGINT) AS board_x, CAST(trunc(least(greatest(y * 20e0, 0e0), 399e0)) AS BIGINT) AS board_y FROM m""")
def _(t):
    return C.court_position(C.to_metres(t.tracks, t.calibration, fallback=False)).select(
        *KEY, "team", "x_m", "y_m", "zone", "board_x", "board_y")


X, Y = "(x_cm / 100e0)", "(y_cm / 100e0)"
cx, cy = lambda: metres(F.col("x_cm")), lambda: metres(F.col("y_cm"))
per_track("zone10", lambda: {"zone": Z.zone10(cx(), cy())}, {"zone": Z10.format(x=X, y=Y)})
per_track("zone_overlap7", lambda: {f"in_{n}": f for n, f in Z.band_flags(cx(), cy()).items()},
          {f"in_{n}": f"({X} BETWEEN {p} AND {q} AND {Y} BETWEEN 0 AND 20)" for n, (p, q) in P.COURT_BANDS.items()})
_band = lambda v, es: "CASE " + " ".join(f"WHEN {v} < {e} THEN '{n}'" for e, n in zip(es, Z.BAND_NAMES)) + " ELSE '6m_right' END"
per_track("zone_band7", lambda: {"zone_m": Z.zone_band(cx()), "zone_px": Z.zone_band(F.col("px"), Z.BAND_EDGES_PX)},
          {"zone_m": _band(X, (6, 9, 18, 22, 31, 34)), "zone_px": _band("px", (150, 280, 500, 780, 1000, 1130))})
_nx = f"(CASE WHEN team = 'team_a' THEN {X} ELSE 40 - {X} END)"
per_track("zone_shot5", lambda: {"zone": Z.zone_shot5(cx(), cy(), F.col("team"))}, {
    "zone": f"""CASE WHEN {_nx} > 32 AND {Y} < 4.5e0 THEN 'wing_right' WHEN {_nx} > 32 AND {Y} > 15.5e0 THEN 'wing_left'
    WHEN {_nx} >= 32.5e0 AND {_nx} <= 33.5e0 AND {Y} >= 9 AND {Y} <= 11 THEN 'penalty_7m' WHEN {_nx} >= 31 AND {Y} >= 5 AND {Y} <= 15 THEN 'center_6m'
    ELSE 'center_9m' END"""})
_dep = "(CASE WHEN team = 'team_a' THEN 1e0 - px / 1280e0 ELSE px / 1280e0 END)"
per_track("zone_screen", lambda: {"zone": Z.zone_screen(F.col("px"), F.col("py"), F.col("team"))}, {
    "zone": f"""CASE WHEN {_dep} < 18e-2 AND abs(py / 720e0 - 65e-2) > 2e-1 THEN 'Wing' WHEN {_dep} < 18e-2 THEN '6m Centre'
    WHEN {_dep} < 32e-2 THEN '9m Centre' WHEN {_dep} < 5e-1 THEN 'Long Distance' ELSE 'Backcourt' END"""})


@query("zone_custom", f"""WITH z AS (SELECT club_id % 7 AS zone_id, min(club_id * 150) AS x1, min(club_id * 150) + 900 AS x2, min(club_id * 60) AS y1, min(club_id * 60) + 700 AS y2 FROM clubs GROUP BY 1)
  SELECT {K}, zone_id FROM tracks JOIN z ON x_cm BETWEEN x1 AND x2 AND y_cm BETWEEN y1 AND y2""")
def _(t):
    k = F.min("club_id")
    zones = t.clubs.groupBy((F.col("club_id") % 7).alias("zone_id")).agg(
        (k * 150).alias("x1"), (k * 150 + 900).alias("x2"), (k * 60).alias("y1"), (k * 60 + 700).alias("y2"))
    return C.in_rectangles(t.tracks, zones, "x_cm", "y_cm").select(*KEY, "zone_id")


BK = ["match_id", "frame_n"]


def per_ball(name, spark_cols, sql_cols):
    cols = ", ".join(f"{e} AS {n}" for n, e in sql_cols.items())

    @query(name, f"SELECT match_id, frame_n, {cols} FROM ball")
    def _(t):
        return t.ball.select(*BK, *[c.alias(n) for n, c in spark_cols().items()])


BX, BY = "(bx_cm / 100e0)", "(by_cm / 100e0)"
bx, by = lambda: metres(F.col("bx_cm")), lambda: metres(F.col("by_cm"))
per_ball("is_goal_line", lambda: {"goal": Z.is_goal_line(bx(), by()), "goal_tol": Z.is_goal_line(bx(), by(), 0.3)}, {
    "goal": f"{BY} BETWEEN 8.5e0 AND 11.5e0 AND ({BX} <= 0 OR {BX} >= 40)",
    "goal_tol": f"{BY} BETWEEN 8.5e0 AND 11.5e0 AND ({BX} <= 0.3e0 OR {BX} >= 39.7e0)"})
_area = lambda g: f"""(CASE WHEN {Y} < 8.5e0 THEN sqrt(({X}-{g})*({X}-{g})+({Y}-8.5e0)*({Y}-8.5e0)) <= 6 WHEN {Y} > 11.5e0
  THEN sqrt(({X}-{g})*({X}-{g})+({Y}-11.5e0)*({Y}-11.5e0)) <= 6 ELSE abs({X}-{g}) <= 6 END)"""  # noqa: E731
per_track("in_goal_area", lambda: {"left": Z.in_goal_area(cx(), cy(), F.lit(0.0)), "right": Z.in_goal_area(cx(), cy(), F.lit(40.0))},
          {"left": _area(0), "right": _area(40)})
per_track("near_goal_6m", lambda: {"in_circle": Z.near_goal_6m(cx(), cy()), "near": Z.near_goal(cx())}, {
    "in_circle": f"(sqrt({X}*{X}+({Y}-10)*({Y}-10)) < 6.5e0 OR sqrt(({X}-40)*({X}-40)+({Y}-10)*({Y}-10)) < 6.5e0)",
    "near": f"({X} < 5 OR {X} > 35)"})


@query("goal_mouth_cell", f"""WITH g AS (SELECT match_id, frame_n, {BY} AS y, greatest(0e0, least(1e0, (bpy - gy1) * 1e0 / (gy2 - gy1))) AS rel
  FROM ball JOIN goal_boxes USING (match_id) WHERE bpx IS NOT NULL AND side = CASE WHEN bpx < 640 THEN 'left' ELSE 'right' END)
  SELECT match_id, frame_n, (CASE WHEN rel < 33e-2 THEN 'T' WHEN rel < 67e-2 THEN 'M' ELSE 'B' END) ||
  (CASE WHEN y >= 8.5e0 AND y < 9.5e0 THEN 'L' WHEN y >= 10.5e0 AND y < 11.5e0 THEN 'R' ELSE 'C' END) AS cell FROM g""")
def _(t):
    side = F.when(F.col("bpx") < 640, "left").otherwise("right")
    d = t.ball.filter("bpx is not null").withColumn("side", side).join(t.goal_boxes, ["match_id", "side"])
    cell = Z.goal_mouth_cell(by(), F.col("bpy") * 1.0, F.col("gy1") * 1.0, F.col("gy2") * 1.0)
    return d.select(*BK, cell.alias("cell"))


per_track("shot_norm", lambda: dict(zip(("nx", "ny"), C.unit_frame(F.col("px"), F.col("py")))), {
    "nx": r4("least(1e0, greatest(0e0, px / 1280e0))"), "ny": r4("least(1e0, greatest(0e0, py / 720e0))")})


@query("attack_dir", """WITH e AS (SELECT *, (team = 'team_a') <> (seq > 125) AS r FROM match_events WHERE team IN ('team_a', 'team_b'))
  SELECT event_id, team, CASE WHEN r THEN 1 ELSE -1 END AS dir, CASE WHEN r THEN 40e0 ELSE 0e0 END AS goal_x, CASE WHEN r THEN 0e0 ELSE 40e0 END AS own_x FROM e""")
def _(t):
    s = Z.attack_sign(F.col("team"), F.col("period") == 2)
    return C.with_period(t.match_events).select("event_id", "team", s.alias("dir"), Z.attacked_goal_x(s).alias("goal_x"), Z.own_goal_x(s).alias("own_x"))


@query("iou", f"""SELECT match_id, frame_n, cand, {r4('max(i / (w1 + w2 - i))')} AS iou FROM (
  SELECT c.match_id, c.frame_n, cand, player_id, w * h * 16e0 AS w1, ({c} - {a}) * ({d} - {b}) AS w2,
  greatest(0e0, least(cx + w * 2e0, {c}) - greatest(cx - w * 2e0, {a})) * greatest(0e0, least(cy + h * 2e0, {d}) - greatest(cy - h * 2e0, {b})) AS i
  FROM candidates c JOIN tracks t ON t.match_id = c.match_id AND t.frame_n = c.frame_n) GROUP BY ALL""")
def _(t):
    d = t.candidates.join(t.tracks, BK)
    cw, ch = F.col("w") * 2.0, F.col("h") * 2.0
    cand = [F.col("cx") - cw, F.col("cy") - ch, F.col("cx") + cw, F.col("cy") + ch]
    return d.groupBy(*BK, "cand").agg(c4(F.max(G.iou(cand, track_box()))).alias("iou"))


# ---- angles ---------------------------------------------------------------
def per_pose(name, spark_cols, sql_cols, extra=""):
    cols = ", ".join(f"{e} AS {n}" for n, e in sql_cols.items())

    @query(name, f"SELECT {K}, {cols} FROM {extra or 'poses'}")
    def _(t):
        return t.poses.select(*KEY, *[c.alias(n) for n, c in spark_cols().items()])


def kp(axis, i):
    return f"(CASE WHEN kc[{i + 1}] >= 30 THEN k{axis}[{i + 1}] END)"


def sq_ang(p, q, r):
    ax, ay, bx_, by_, cx_, cy_ = (kp(v, i) for i in (p, q, r) for v in "xy")
    u = f"sqrt(({ax}-{bx_})*({ax}-{bx_})+({ay}-{by_})*({ay}-{by_}))"
    v = f"sqrt(({cx_}-{bx_})*({cx_}-{bx_})+({cy_}-{by_})*({cy_}-{by_}))"
    dot = f"(({ax}-{bx_})*({cx_}-{bx_})+({ay}-{by_})*({cy_}-{by_}))"
    return f"CASE WHEN {u}*{v} > 1e-9 THEN degrees(acos(greatest(-1e0, least(1e0, {dot} / ({u}*{v}))))) END"


def b_ang(p, q, r):
    k = B.Body()
    return G.angle_at(k.x(p), k.y(p), k.x(q), k.y(q), k.x(r), k.y(r))


per_pose("joint_angle", lambda: {"left": c4(b_ang(5, 7, 9)), "right": c4(b_ang(6, 8, 10))},
         {"left": r4(sq_ang(5, 7, 9)), "right": r4(sq_ang(6, 8, 10))})


def _sep():
    k = B.Body()
    s = G.line_angle(k.x(5), k.y(5), k.x(6), k.y(6))
    h = G.line_angle(k.x(11), k.y(11), k.x(12), k.y(12))
    return {"torque": c4(G.line_separation(s, h))}


_la = lambda p, q: f"degrees(atan2(({kp('y', q)} - {kp('y', p)}) * 1e0, ({kp('x', q)} - {kp('x', p)}) * 1e0))"
_md = f"(abs({_la(5, 6)} - {_la(11, 12)}) % 180e0)"
per_pose("line_separation", _sep, {"torque": r4(f"least({_md}, 180e0 - {_md})")})
per_pose("keypoint_get", lambda: {"wrist_x": B.Body().x(9), "wrist_y": B.Body().y(9), "nose_y": B.Body(50).y(0)},
         {"wrist_x": kp("x", 9), "wrist_y": kp("y", 9), "nose_y": "CASE WHEN kc[1] >= 50 THEN ky[1] END"})


def _wmean(axis, pts):
    num = " + ".join(f"coalesce({kp(axis, i)} * {w}e0, 0e0)" for i, w in pts)
    den = " + ".join(f"CASE WHEN kc[{i + 1}] >= 30 THEN {w}e0 ELSE 0e0 END" for i, w in pts)
    return f"({num})", f"({den})"


def _com_sql(axis):
    n, dd = _wmean(axis, list(B.SEGMENT_WEIGHTS.items()))
    pn, pd = _wmean(axis, [(i, 1) for i in range(17)])
    return r4(f"CASE WHEN {dd} > 1e-1 THEN {n} / {dd} WHEN {pd} > 0 THEN {pn} / {pd} ELSE 0e0 END")


per_pose("body_com", lambda: dict(zip(("com_x", "com_y"), (c4(v) for v in B.Body().centre_of_mass()))),
         {"com_x": _com_sql("x"), "com_y": _com_sql("y")})
_kc = [(i, 1) for i in (11, 12, 15, 16, 0)]
_kcs = lambda ax: (lambda nd: r4(f"CASE WHEN {nd[1]} > 0 THEN {nd[0]} / {nd[1]} END"))(_wmean(ax, _kc))
per_pose("keeper_com", lambda: dict(zip(("com_x", "com_y"), (c4(v) for v in B.Body().keeper_centre()))),
         {"com_x": _kcs("x"), "com_y": _kcs("y")})


@query("torso_box", f"""WITH k AS (SELECT {K}, px, py, h_px,
   list_filter([CASE WHEN kc[i] > 40 THEN kx[i] END FOR i IN [6, 7, 12, 13]], lambda v: v IS NOT NULL) AS xs,
   list_filter([CASE WHEN kc[i] > 40 THEN ky[i] END FOR i IN [6, 7, 12, 13]], lambda v: v IS NOT NULL) AS ys FROM poses),
  j AS (SELECT *, len(xs) >= 3 AS ok, list_min(xs) AS jx1, list_max(xs) AS jx2, list_min(ys) AS jy1, list_max(ys) AS jy2 FROM k)
  SELECT {K}, CAST(CASE WHEN ok THEN jx1 + trunc((jx2 - jx1) * 1e-1) ELSE trunc({a} + ({c} - {a}) * 3e-1) END AS BIGINT) AS tx1,
  CAST(CASE WHEN ok THEN jx2 - trunc((jx2 - jx1) * 1e-1) ELSE trunc({c} - ({c} - {a}) * 3e-1) END AS BIGINT) AS tx2,
  CAST(CASE WHEN ok THEN greatest(0, jy1 - trunc((jy2 - jy1) * 1e-1)) ELSE trunc({b} + h_px * 18e-2) END AS BIGINT) AS ty1,
  CAST(CASE WHEN ok THEN jy2 ELSE trunc({b} + h_px * 5e-1) END AS BIGINT) AS ty2 FROM j""")
def _(t):
    return t.poses.select(*KEY, *C.torso_box(track_box()))


# ---- ball geometry --------------------------------------------------------
def per_flight(name, spark_cols, sql_cols):
    """Ball against one fixed goal centre and the previous second's position column set."""
    cols = ", ".join(f"{e} AS {n}" for n, e in sql_cols.items())

    @query(name, f"SELECT event_id, {cols} FROM match_events")
    def _(t):
        return t.match_events.select("event_id", *[c.alias(n) for n, c in spark_cols().items()])


EX, EY = lambda: metres(F.col("x_cm")), lambda: metres(F.col("y_cm"))
TX, TY = lambda: (F.col("seq") % 40).cast("double"), lambda: (F.col("value_c") % 20).cast("double")
tx, ty = "(seq % 40 * 1e0)", "(value_c % 20 * 1e0)"
_u = f"sqrt(({tx}-{X})*({tx}-{X})+({ty}-{Y})*({ty}-{Y}))"
_v = f"sqrt((40-{X})*(40-{X})+(10-{Y})*(10-{Y}))"
_cos = f"((({tx}-{X})*(40-{X})+({ty}-{Y})*(10-{Y})) / ({_u}*{_v}))"
per_flight("shot_angle", lambda: {
    "angle": c4(G.shot_angle(EX(), EY(), TX(), TY(), F.lit(40.0), F.lit(10.0))),
    "vertical": F.when((TY() - 10) / 3.0 < -0.25, "upper").when((TY() - 10) / 3.0 > 0.25, "lower").otherwise("middle"),
    "horizontal": F.when(TX() > 20, "right").otherwise("left")}, {
    "angle": r4(f"CASE WHEN {_u}*{_v} > 1e-9 THEN degrees(acos(greatest(-1e0, least(1e0, {_cos})))) ELSE 0e0 END"),
    "vertical": f"CASE WHEN ({ty} - 10) / 3e0 < -25e-2 THEN 'upper' WHEN ({ty} - 10) / 3e0 > 25e-2 THEN 'lower' ELSE 'middle' END",
    "horizontal": f"CASE WHEN {tx} > 20 THEN 'right' ELSE 'left' END"})
_l2 = f"(({tx}-{X})*({tx}-{X})+({ty}-{Y})*({ty}-{Y}))"
_t = f"(CASE WHEN {_l2} < 1e-9 THEN 0e0 ELSE greatest(0e0, least(1e0, ((20-{X})*({tx}-{X})+(10-{Y})*({ty}-{Y})) / {_l2})) END)"
per_flight("point_segment", lambda: {"d": c4(G.point_segment(F.lit(20.0), F.lit(10.0), EX(), EY(), TX(), TY()))},
           {"d": r4(f"sqrt(pow(20-({X}+{_t}*({tx}-{X})),2)+pow(10-({Y}+{_t}*({ty}-{Y})),2))")})
_ux, _uy = f"(CASE WHEN {_u} > 1e-9 THEN ({tx}-{X})/{_u} ELSE 0e0 END)", f"(CASE WHEN {_u} > 1e-9 THEN ({ty}-{Y})/{_u} ELSE 0e0 END)"
per_flight("lane_polygon", lambda: dict(zip(("x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4"), (c4(v) for v in G.lane_polygon(EX(), EY(), TX(), TY())))), {
    "x1": r4(f"{X}-{_uy}*26e0"), "y1": r4(f"{Y}+{_ux}*26e0"), "x2": r4(f"{tx}-{_uy}*52e0"), "y2": r4(f"{ty}+{_ux}*52e0"),
    "x3": r4(f"{tx}+{_uy}*52e0"), "y3": r4(f"{ty}-{_ux}*52e0"), "x4": r4(f"{X}+{_uy}*26e0"), "y4": r4(f"{Y}-{_ux}*26e0")})

# ---- scores ---------------------------------------------------------------
_gr = "CASE WHEN {s} >= 90 THEN 'A+' WHEN {s} >= 80 THEN 'A' WHEN {s} >= 70 THEN 'B+' WHEN {s} >= 60 THEN 'B' WHEN {s} >= 50 THEN 'C' WHEN {s} >= 35 THEN 'D' WHEN {s} > 0 THEN 'F' ELSE '-' END"
per_flight("grade", lambda: {"grade": SC.grade(F.col("value_c") % 101)}, {"grade": _gr.format(s="(value_c % 101)")})
per_flight("stamina_label", lambda: {"label": SC.stamina_label(F.col("value_c") % 101)}, {
    "label": "CASE WHEN value_c % 101 >= 80 THEN 'fresh' WHEN value_c % 101 >= 60 THEN 'good' WHEN value_c % 101 >= 40 THEN 'tired' WHEN value_c % 101 >= 20 THEN 'fatigued' ELSE 'exhausted' END"})


@query("performance", f"""WITH s AS (SELECT player_id, count(*) FILTER (event_type = 'goal') AS g, count(*) FILTER (event_type IN ('goal', 'shot')) AS n,
   count(*) FILTER (event_type = 'fast_break') AS b, count(*) FILTER (event_type = 'save') AS sv, count(*) FILTER (event_type = 'pass') AS a,
   CAST(sum(value_c) AS BIGINT) % 9000 AS m, max(value_c) % 1000 / 100e0 AS v FROM match_events GROUP BY 1),
  p AS (SELECT *, {r1('''least(100e0, least(g * 8e0, 25e0) + CASE WHEN n > 0 THEN g * 1e0 / n * 20e0 ELSE 0e0 END + least(m / 6000e0, 1e0) * 15e0
   + least(v / 9e0, 1e0) * 10e0 + least(b * 5e0, 10e0) + CASE WHEN player_id % 7 = 0 THEN least(sv * 5e0, 20e0) ELSE 0e0 END + least(a * 4e0, 10e0))''')} AS score FROM s)
  SELECT player_id, score, {_gr.format(s='score')} AS grade FROM p""")
def _(t):
    from matchloom.functions.common import count_if

    kind = F.col("event_type")
    s = t.match_events.groupBy("player_id").agg(
        count_if(kind == "goal").alias("g"), count_if(kind.isin("goal", "shot")).alias("n"), count_if(kind == "fast_break").alias("b"),
        count_if(kind == "save").alias("sv"), count_if(kind == "pass").alias("a"),
        (F.sum("value_c") % 9000).alias("m"), (F.max("value_c") % 1000 / 100.0).alias("v"))
    score = SC.performance(F.col("g"), F.col("n"), F.col("m"), F.col("v"), F.col("b"), F.col("sv"), F.col("a"), F.col("player_id") % 7 == 0)
    return s.select("player_id", score.alias("score")).withColumn("grade", SC.grade(F.col("score")))


_norm = " UNION ALL ".join(
    f"SELECT '{r}' AS role, {lo}e0 AS dlo, {hi}e0 AS dhi, {slo}e0 AS slo, {shi}e0 AS shi" for r, ((lo, hi), (slo, shi), _) in P.ROLE_NORMS.items())
_rel = "CASE WHEN {v} > {h} * 1.05e0 THEN 'above' WHEN {v} < {l} * 0.90e0 THEN 'below' ELSE 'in range' END"


@query("norm_compare", f"""WITH n AS ({_norm}), e AS (SELECT event_id, value_c % 800 / 100e0 AS km, value_c % 30 AS sp,
   CASE event_id % 9 WHEN 0 THEN 'GK' WHEN 1 THEN 'CB' WHEN 2 THEN 'LB' WHEN 3 THEN 'RB' WHEN 4 THEN 'LW' WHEN 5 THEN 'RW' WHEN 6 THEN 'PV' ELSE 'XX' END AS role FROM match_events)
  SELECT event_id, e.role, {_rel.format(v='km', l='coalesce(dlo, 4.8e0)', h='coalesce(dhi, 6.5e0)')} AS distance,
  {_rel.format(v='sp', l='coalesce(slo, 12e0)', h='coalesce(shi, 22e0)')} AS sprints FROM e LEFT JOIN n ON n.role = e.role""")
def _(t):
    roles = F.array(*[F.lit(r) for r in P.ROLE_NORMS])
    e = t.match_events.select("event_id", (F.col("value_c") % 800 / 100.0).alias("km"), (F.col("value_c") % 30).alias("sp"),
                              F.coalesce(F.get(roles, (F.col("event_id") % 9).cast("int")), F.lit("XX")).alias("role"))
    return C.against_norms(e, "km", "sp").select("event_id", "role", "distance", "sprints")


@query("severity", """SELECT event_id, CASE WHEN alert_type IN ('passive_violation', 'overload_danger', 'goal_against') THEN 'DANGER'
  WHEN regexp_matches(lower(alert_text), 'substitute immediately|switch now|foul out|red card') THEN 'CRITICAL'
  WHEN regexp_matches(lower(alert_text), 'substitute|immediately| now\\.|switch to|passive|violation|leaving open|exposed') THEN 'WARNING' ELSE 'INFO' END AS severity FROM alert_texts""")
def _(t):
    return t.alert_texts.select("event_id", SC.severity(F.col("alert_text"), F.col("alert_type")).alias("severity"))


# ---- text -----------------------------------------------------------------
per_flight("clock_fmt", lambda: {"clock": T.clock_from_frame(F.col("frame_n"), 25.0), "clock_ms": T.clock(F.col("value_c") / 10.0)}, {
    "clock": "printf('%02d:%02d', CAST(floor(floor(frame_n / 25e0) / 60) AS BIGINT), CAST(floor(frame_n / 25e0) AS BIGINT) % 60)",
    "clock_ms": "printf('%02d:%02d', CAST(floor(floor(value_c / 10e0) / 60) AS BIGINT), CAST(floor(value_c / 10e0) AS BIGINT) % 60)"})


@query("label_fmt", """SELECT player_id, '#' || number || ' ' || player_name AS label, CASE WHEN bal > 0 THEN player_name WHEN number > 50 THEN '#' || number ELSE 'P' || player_id END AS short,
  regexp_extract(replace(player_name, '#', ' '), '(\\S+)$', 1) AS surname FROM players""")
def _(t):
    n, name = F.col("number"), F.col("player_name")
    fallback = F.concat(F.lit("P"), F.col("player_id").cast("string"))
    short = F.when(F.col("bal") > 0, name).otherwise(T.number_name(F.when(n > 50, n), F.lit(None), fallback))
    return t.players.select("player_id", T.number_name(n, name, fallback).alias("label"), short.alias("short"),
                            T.surname(F.replace(name, F.lit("#"), F.lit(" "))).alias("surname"))


per_flight("event_text", lambda: {"line": T.event_text(F.col("team"), F.col("event_type"))},
           {"line": "'[' || upper(replace(team, '_', ' ')) || '] ' || upper(replace(event_type, '_', ' '))"})
per_flight("score_fmt", lambda: {"line": T.score_line(F.col("team"), F.col("seq"), F.col("player_id"), F.col("from_team"))},
           {"line": "team || ' ' || seq || ' - ' || player_id || ' ' || from_team"})
per_flight("ordinal_map", lambda: {"word": T.ordinal(F.col("seq") % 20)}, {
    "word": f"CASE WHEN seq % 20 BETWEEN 1 AND 15 THEN {list(T.ORDINALS)}[seq % 20] ELSE 'no. ' || (seq % 20) END"})
per_flight("opponent", lambda: {"other": C.opponent(F.col("team"))}, {"other": "CASE team WHEN 'team_a' THEN 'team_b' ELSE 'team_a' END"})
per_flight("bgr_hex", lambda: {"hex": T.bgr_hex(F.col("seq") % 256, F.col("player_id") % 256, F.col("value_c") % 256)},
           {"hex": "printf('#%02x%02x%02x', value_c % 256, player_id % 256, seq % 256)"})


@query("actor_number", """SELECT event_id, CAST(nullif(regexp_extract(CASE WHEN user_id % 3 = 0 THEN alias ELSE 'x' END, '#([0-9]+)', 1), '') AS BIGINT) AS n
  FROM (SELECT event_id, user_id, 'player #' || user_id || ' left' AS alias FROM events)""")
def _(t):
    label = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("player #"), F.col("user_id").cast("string"), F.lit(" left"))).otherwise("x")
    return t.events.select("event_id", T.actor_number(label).alias("n"))


@query("jersey_parse", """SELECT match_id, track_id, raw_text, CAST(raw_text AS BIGINT) AS number, conf_pct FROM jersey_reads
  WHERE CASE WHEN regexp_full_match(raw_text, '[0-9]{1,2}') THEN CAST(raw_text AS BIGINT) BETWEEN 1 AND 99 ELSE false END AND conf_pct >= 55""")
def _(t):
    return t.jersey_reads.withColumn("number", T.jersey_number(F.col("raw_text"), F.col("conf_pct") / 100.0)).filter("number is not null").select(
        "match_id", "track_id", "raw_text", "number", "conf_pct")


@query("json_compact", """SELECT event_id, '{"event_type":"' || event_type || '"' || CASE WHEN from_team = 'none' THEN '' ELSE ',"from_team":"' || from_team || '"' END
  || CASE WHEN to_player_id IS NULL THEN '' ELSE ',"to_player_id":' || to_player_id END || '}' AS row FROM match_events""")
def _(t):
    d = t.match_events.withColumn("from_team", F.when(F.col("from_team") != "none", F.col("from_team")).otherwise(""))
    return d.select("event_id", T.compact_json([("event_type", True), ("from_team", True), ("to_player_id", False)]).alias("row"))


@query("json_verdict", """WITH r AS (SELECT conv_id, turn, reply, nullif(regexp_extract(reply, '(\\{.*\\})', 1, 's'), '') AS js FROM model_replies),
  j AS (SELECT *, js IS NOT NULL AND json_valid(js) AND (json_extract_string(js, '$.outcome') IS NOT NULL OR json_extract_string(js, '$.reason') IS NOT NULL) AS ok FROM r)
  SELECT conv_id, turn, CASE WHEN ok THEN upper(coalesce(json_extract_string(js, '$.outcome'), '?')) WHEN upper(reply) LIKE '%GOAL%' THEN 'GOAL'
   WHEN upper(reply) LIKE '%SAVE%' THEN 'SAVE' WHEN upper(reply) LIKE '%MISS%' THEN 'MISS' WHEN upper(reply) LIKE '%PASS%' THEN 'PASS' ELSE '?' END AS outcome,
  CASE WHEN ok THEN coalesce(CAST(json_extract_string(js, '$.confidence') AS DOUBLE), 0e0) WHEN regexp_matches(upper(reply), 'GOAL|SAVE|MISS|PASS') THEN 0.5e0 ELSE 0e0 END AS confidence,
  CASE WHEN ok THEN coalesce(json_extract_string(js, '$.reason'), '') ELSE reply END AS reason FROM j""")
def _(t):
    return t.model_replies.select("conv_id", "turn", T.verdict(F.col("reply")).alias("v")).select("conv_id", "turn", "v.outcome", "v.confidence", "v.reason")


@query("json_insight", """WITH r AS (SELECT conv_id, turn, reply, nullif(regexp_extract(reply, '(\\{.*\\})', 1, 's'), '') AS js FROM model_replies),
  j AS (SELECT *, coalesce(json_valid(js) AND json_extract_string(js, '$.tactical_insight') IS NOT NULL, false) AS ok FROM r)
  SELECT conv_id, turn, CASE WHEN ok THEN trim(json_extract_string(js, '$.internal_reasoning')) END AS reasoning,
  CASE WHEN ok THEN trim(json_extract_string(js, '$.tactical_insight')) ELSE nullif(trim(reply, E' \\n\\t'), '') END AS insight FROM j""")
def _(t):
    return t.model_replies.select("conv_id", "turn", T.insight(F.col("reply")).alias("v")).select("conv_id", "turn", "v.reasoning", "v.insight")


# ---- vectors --------------------------------------------------------------
@query("vec_norm", f"""SELECT vec_id, {r4('list_sum([x*x FOR x IN v])')} AS len2, {r4('v[1]')} AS first FROM (
  SELECT vec_id, [x / (n + 1e-8) FOR x IN d] AS v FROM (SELECT vec_id, d, sqrt(list_sum([x*x FOR x IN d])) AS n FROM (SELECT vec_id, CAST(vec AS DOUBLE[]) AS d FROM vectors)))""")
def _(t):
    d = t.vectors.select("vec_id", V.normalise(F.col("vec")).alias("v"))
    return d.select("vec_id", c4(V.dot(F.col("v"), F.col("v"))).alias("len2"), c4(F.get("v", F.lit(0))).alias("first"))


@query("vec_cosine", f"""SELECT a.vec_id, b.vec_id AS other, {r4('list_cosine_similarity(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[]))')} AS cosine
  FROM vectors a JOIN vectors b ON b.player_id = a.player_id AND b.vec_id = a.vec_id + 10 - a.vec_id % 3""")
def _(t):
    b = t.vectors.select(F.col("vec_id").alias("other"), "player_id", F.col("vec").alias("vec2"))
    d = t.vectors.withColumn("other", F.col("vec_id") + 10 - F.col("vec_id") % 3).join(b, ["player_id", "other"])
    return d.select("vec_id", "other", c4(V.cosine(F.col("vec"), F.col("vec2"))).alias("cosine"))
