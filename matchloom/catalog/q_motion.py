"""Motion, stamina, heat and player reports."""

from pyspark.sql import functions as F

from matchloom import params as P
from matchloom.catalog.registry import query, r1, r4
from matchloom.functions.common import count_if
from matchloom.operators import motion as M

PW = "PARTITION BY match_id, player_id ORDER BY frame_n"


def STEPS(gap=12):
    """CTEs: st = tracks with speed and step_m."""
    return f"""l AS (SELECT *, frame_n - lag(frame_n) OVER w AS g,
    sqrt((x_cm/100e0 - lag(x_cm) OVER w/100e0)*(x_cm/100e0 - lag(x_cm) OVER w/100e0) + (y_cm/100e0 - lag(y_cm) OVER w/100e0)*(y_cm/100e0 - lag(y_cm) OVER w/100e0)) AS dd
    FROM tracks WINDOW w AS ({PW})),
  st AS (SELECT * EXCLUDE (g, dd), CASE WHEN g > 0 AND g <= {gap} AND dd * 25e0 / g <= 30e0 THEN dd * 25e0 / g ELSE 0e0 END AS speed,
    CASE WHEN g > 0 AND g <= {gap} AND dd * 25e0 / g <= 30e0 THEN dd ELSE 0e0 END AS step_m FROM l)"""


@query("wn_speed", f"WITH {STEPS()} SELECT match_id, player_id, frame_n, {r4('speed')} AS speed, speed > 5.5e0 AS sprint FROM st")
def _(t):
    d = M.rounded(M.steps(t.tracks).withColumn("sprint", F.col("speed") > P.SPRINT_MS), "speed")
    return d.select("match_id", "player_id", "frame_n", "speed", "sprint")


@query("wn_avg_speed", f"""WITH {STEPS()} SELECT match_id, player_id, frame_n,
  {r4(f'avg(CASE WHEN speed > 0 THEN speed END) OVER ({PW} ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)')} AS avg_speed FROM st""")
def _(t):
    return M.rounded(M.avg_speed(t.tracks), "avg_speed").select("match_id", "player_id", "frame_n", "avg_speed")


SPRINTS = f"""{STEPS(24)}, f AS (SELECT *, speed >= 5.5e0 AS fast, coalesce(lag(speed >= 5.5e0) OVER ({PW}), false) AS pf FROM st),
  r AS (SELECT *, sum(CASE WHEN fast AND NOT pf THEN 1 ELSE 0 END) OVER ({PW}) AS run FROM f),
  sp AS (SELECT match_id, player_id, run, min(frame_n) FILTER (fast) AS start_frame, (min(frame_n) FILTER (NOT fast) - min(frame_n) FILTER (fast)) / 25e0 AS duration_s,
    coalesce(sum(step_m) FILTER (fast AND pf), 0e0) AS distance_m, max(speed) FILTER (fast) AS peak
  FROM r WHERE run > 0 GROUP BY ALL HAVING duration_s >= 1)"""


@query("wn_sprint", f"WITH {SPRINTS} SELECT match_id, player_id, start_frame, duration_s, {r4('distance_m')} AS distance_m, {r4('peak')} AS peak FROM sp")
def _(t):
    return M.rounded(M.sprints(t.tracks), "distance_m", "peak")


@query("ag_speed_decline", f"""WITH {SPRINTS}, n AS (SELECT *, row_number() OVER (PARTITION BY match_id, player_id ORDER BY start_frame) AS rn,
   count(*) OVER (PARTITION BY match_id, player_id) AS n FROM sp)
  SELECT match_id, player_id, any_value(n) AS n, {r4('max(peak) FILTER (rn > n - 5)')} AS late, {r4('max(peak) FILTER (rn <= 3)')} AS early,
  max(peak) FILTER (rn > n - 5) < max(peak) FILTER (rn <= 3) * 0.8e0 AS declined FROM n WHERE n >= 3 GROUP BY match_id, player_id""")
def _(t):
    return M.rounded(M.speed_decline(M.sprints(t.tracks)), "late", "early")


DELTA = "CASE WHEN speed >= 5.5e0 THEN -320 WHEN speed >= 2.5e0 THEN -40 WHEN speed >= 0.3e0 THEN -4 ELSE 100 END"
STAMINA = f"""WITH RECURSIVE {STEPS(24)}, d AS MATERIALIZED (SELECT match_id, player_id, frame_n, {DELTA} AS d, row_number() OVER ({PW}) AS rn FROM st),
  s AS (SELECT match_id, player_id, frame_n, rn, greatest(100000, least(1000000, 1000000 + d)) AS s FROM d WHERE rn = 1
   UNION ALL SELECT d.match_id, d.player_id, d.frame_n, d.rn, greatest(100000, least(1000000, s.s + d.d))
   FROM s JOIN d ON d.match_id = s.match_id AND d.player_id = s.player_id AND d.rn = s.rn + 1)"""


@query("wn_stamina", f"{STAMINA} SELECT match_id, player_id, frame_n, CAST(s AS BIGINT) AS stamina FROM s")
def _(t):
    return M.stamina(t.tracks)


GREEDY = """WITH RECURSIVE {pre}, m AS MATERIALIZED ({marks}),
  k AS (SELECT {keys}, min(frame_n) AS frame_n FROM m GROUP BY ALL
   UNION ALL SELECT {keys}, (SELECT min(frame_n) FROM m WHERE {same} AND m.frame_n >= k.frame_n + {gap}) AS frame_n FROM k
   WHERE EXISTS (SELECT 1 FROM m WHERE {same} AND m.frame_n >= k.frame_n + {gap}))"""


def greedy(pre, marks, keys, gap):
    same = " AND ".join(f"m.{c} = k.{c}" for c in keys)
    return GREEDY.format(pre=pre, marks=marks, keys=", ".join(keys), same=same, gap=gap)


@query("wn_rest", greedy(
    f"{STEPS(24)}, g AS (SELECT *, sum(CASE WHEN speed >= 2.5e0 THEN 1 ELSE 0 END) OVER ({PW}) AS seg FROM st)",
    """SELECT DISTINCT match_id, player_id, seg, frame_n FROM (SELECT match_id, player_id, seg, frame_n FROM g WHERE speed < 0.3e0
       UNION ALL SELECT match_id, player_id, seg, min(frame_n) FROM g WHERE speed < 2.5e0 GROUP BY ALL)""",
    ["match_id", "player_id", "seg"], 26) + """,
  c AS (SELECT match_id, player_id, seg, count(*) - 1 AS n FROM k GROUP BY ALL)
  SELECT match_id, player_id, CAST(sum(n) AS BIGINT) AS rest_windows FROM c GROUP BY ALL""")
def _(t):
    return M.rest_windows(t.tracks, rest_s=1.0)


@query("wn_sample30", greedy("z AS (SELECT 1)", """SELECT match_id, player_id, frame_n FROM tracks
   UNION SELECT DISTINCT match_id, player_id, CAST(0 AS BIGINT) FROM tracks""", ["match_id", "player_id"], 125)
   + " SELECT match_id, player_id, frame_n, x_cm FROM k JOIN tracks USING (match_id, player_id, frame_n) WHERE frame_n > 0")
def _(t):
    return M.sample_every(t.tracks.select("match_id", "player_id", "frame_n", "x_cm"), 5.0)


@query("wn_throttle", greedy("z AS (SELECT 1)", "SELECT match_id, player_id, frame_n FROM tracks", ["match_id", "player_id"], 25) + " SELECT * FROM k")
def _(t):
    from matchloom.plans.folds import debounce

    return debounce(t.tracks, ["match_id", "player_id"], "frame_n", 25)


@query("ag_motion", f"""WITH {STEPS()} SELECT match_id, player_id, {r4('sum(step_m)')} AS distance_m, {r4('max(speed)')} AS top_speed,
  count(*) FILTER (speed > 5.5e0) AS sprint_frames, count(*) AS frames, {r4('avg(speed) FILTER (speed > 0)')} AS avg_speed FROM st GROUP BY ALL""")
def _(t):
    return M.rounded(M.motion_summary(t.tracks), "distance_m", "top_speed", "avg_speed")


@query("ag_period_motion", f"""WITH {STEPS()} SELECT match_id, player_id, CASE WHEN frame_n < 500 THEN 1 ELSE 2 END AS period, {r4('sum(step_m)')} AS distance_m,
  {r4('max(speed)')} AS top_speed, count(*) FILTER (speed > 5.5e0) AS sprint_frames, count(*) AS frames, {r4('avg(speed) FILTER (speed > 0)')} AS avg_speed
  FROM st GROUP BY match_id, player_id, period""")
def _(t):
    d = t.tracks.withColumn("period", F.when(F.col("frame_n") < 500, 1).otherwise(2))
    return M.rounded(M.motion_summary(d, "period"), "distance_m", "top_speed", "avg_speed")


BANDS = ", ".join(f"count(*) FILTER (x_cm BETWEEN {a * 100} AND {b * 100} AND y_cm BETWEEN 0 AND 2000) AS {n}" for n, (a, b) in P.COURT_BANDS.items())
SHARE = f"""h AS (SELECT match_id, player_id, {BANDS} FROM tracks GROUP BY ALL), u AS (UNPIVOT h ON {', '.join(P.COURT_BANDS)} INTO NAME zone VALUE hits),
  sh AS (SELECT *, {r1('hits * 100e0 / sum(hits) OVER (PARTITION BY match_id, player_id)')} AS share_pct FROM u)"""


@query("ag_zone_pct", f"WITH {SHARE} SELECT match_id, player_id, zone, hits, share_pct FROM sh")
def _(t):
    return M.zone_share(t.tracks)


@query("ag_dominant_zone", f"""WITH {SHARE} SELECT match_id, player_id, arg_max(zone, (hits, zone)) AS zone, max(share_pct) AS share_pct FROM sh GROUP BY ALL""")
def _(t):
    return M.dominant_zone(t.tracks)


ROLE = f"""h AS (SELECT match_id, player_id, {BANDS}, arg_max(y_cm, frame_n) / 100e0 AS y FROM tracks GROUP BY ALL),
  h2 AS (SELECT *, {' + '.join(P.COURT_BANDS)} AS total FROM h), mo AS (SELECT match_id, player_id, sum(step_m) AS dm FROM st GROUP BY ALL),
  ro AS (SELECT match_id, player_id, CASE WHEN total < 50 THEN NULL WHEN own_goal_area * 1e0 / total > 0.4e0 OR (own_half * 1e0 / total > 0.85e0 AND dm < 1500) THEN 'GK'
    WHEN opp_6m * 1e0 / total > 0.25e0 THEN CASE WHEN y < 5 THEN 'RW' WHEN y > 15 THEN 'LW' ELSE 'PV' END
    WHEN opp_9m * 1e0 / total > 0.2e0 OR centre * 1e0 / total > 0.3e0 THEN CASE WHEN y < 7.5e0 THEN 'RB' WHEN y > 12.5e0 THEN 'LB' ELSE 'CB' END
    ELSE 'CB' END AS role FROM h2 JOIN mo USING (match_id, player_id))"""


@query("wn_role", f"WITH {STEPS()}, {ROLE} SELECT * FROM ro")
def _(t):
    return M.roles(t.tracks)


CELLS = "least(greatest((x_cm - x_cm % 50) // 50, 0), 79) AS cell_x, least(greatest((y_cm - y_cm % 50) // 50, 0), 39) AS cell_y"


@query("ag_heat", f"SELECT match_id, player_id, {CELLS}, count(*) AS n FROM tracks GROUP BY ALL")
def _(t):
    return M.heat_cells(t.tracks, "match_id", "player_id")


@query("ag_heat_combined", f"SELECT match_id, {CELLS}, count(*) AS n FROM tracks GROUP BY ALL")
def _(t):
    return M.heat_cells(t.tracks, "match_id")


@query("ag_heat_norm", f"""WITH c AS (SELECT match_id, player_id, {CELLS}, count(*) AS n FROM tracks GROUP BY ALL)
  SELECT *, CAST(floor(n * 255e0 / max(n) OVER (PARTITION BY match_id, player_id)) AS BIGINT) AS level FROM c""")
def _(t):
    return M.heat_normalised(M.heat_cells(t.tracks, "match_id", "player_id"), "match_id", "player_id")


@query("ag_heat_thirds", f"""WITH c AS (SELECT match_id, {CELLS}, count(*) AS n FROM tracks GROUP BY ALL)
  SELECT match_id, floor(coalesce(sum(n) FILTER (cell_x < 26), 0) * 1000e0 / sum(n) + 0.5e0) / 1000e0 AS left,
  floor(coalesce(sum(n) FILTER (cell_x >= 26 AND cell_x < 53), 0) * 1000e0 / sum(n) + 0.5e0) / 1000e0 AS center,
  floor(coalesce(sum(n) FILTER (cell_x >= 53), 0) * 1000e0 / sum(n) + 0.5e0) / 1000e0 AS right FROM c GROUP BY 1""")
def _(t):
    return M.heat_thirds(M.heat_cells(t.tracks, "match_id"), "match_id")


@query("ag_heat_decay", f"""WITH e AS (SELECT match_id, max(frame_n) AS e FROM tracks GROUP BY 1)
  SELECT match_id, px // 16 AS cell_x, CAST(floor(py / 16e0) AS BIGINT) AS cell_y, {r4('sum(pow(0.995e0, e - frame_n))')} AS heat FROM tracks JOIN e USING (match_id) GROUP BY match_id, 2, 3""")
def _(t):
    return M.rounded(M.heat_decay(t.tracks), "heat")


@query("ag_team_rollup", f"""WITH {STEPS()}, p AS (SELECT match_id, player_id, team, sum(step_m) AS d, max(speed) AS v FROM st GROUP BY ALL),
  q AS (SELECT *, (player_id * 37 % 110 - 20) / 100e0 AS f, CASE WHEN player_id % 5 = 0 THEN 10 ELSE -1 END AS i FROM p)
  SELECT match_id, team, count(*) AS players_seen, {r4('sum(d)')} AS distance_m, {r4('max(v)')} AS top_speed,
  {r4('coalesce(avg(f) FILTER (f > 0), 0e0)')} AS fatigue_avg, count(*) FILTER (f > 0.5e0) AS fatigue_high, count(*) FILTER (i >= 0) AS injury_alerts FROM q GROUP BY ALL""")
def _(t):
    p = M.motion_summary(t.tracks, "team")
    p = p.withColumn("fatigue", (F.col("player_id") * 37 % 110 - 20) / 100.0).withColumn(
        "injury_frame", F.when(F.col("player_id") % 5 == 0, 10).otherwise(-1))
    return M.rounded(M.team_rollup(p), "distance_m", "top_speed", "fatigue_avg")


@query("wn_mean_velocity", f"""SELECT match_id, player_id, frame_n,
  {r4('CASE WHEN count(*) OVER w > 1 THEN (px - first(px) OVER w) * 1e0 / (count(*) OVER w - 1) ELSE 0e0 END')} AS vpx,
  {r4('CASE WHEN count(*) OVER w > 1 THEN (py - first(py) OVER w) * 1e0 / (count(*) OVER w - 1) ELSE 0e0 END')} AS vpy
  FROM tracks WINDOW w AS ({PW} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(t):
    return M.rounded(M.mean_velocity(t.tracks), "vpx", "vpy").select("match_id", "player_id", "frame_n", "vpx", "vpy")


@query("wn_wls_velocity", f"""WITH RECURSIVE n AS MATERIALIZED (SELECT match_id, player_id, frame_n, px, py, row_number() OVER ({PW}) AS rn FROM tracks),
  p AS (SELECT a.match_id, a.player_id, a.rn, b.frame_n AS t, b.px AS x, b.py AS y, least(a.rn, 12) AS c, exp(-2e0 + (b.rn - greatest(a.rn - 11, 1)) * 2e0 / (least(a.rn, 12) - 1)) AS w
    FROM n a JOIN n b ON a.match_id = b.match_id AND a.player_id = b.player_id AND b.rn BETWEEN a.rn - 11 AND a.rn WHERE a.rn > 1),
  m AS (SELECT match_id, player_id, rn, sum(w*t)/sum(w) AS tb, sum(w*x)/sum(w) AS xb, sum(w*y)/sum(w) AS yb FROM p GROUP BY ALL),
  v AS MATERIALIZED (SELECT match_id, player_id, rn, sum(w*(t-tb)*(x-xb))/sum(w*(t-tb)*(t-tb)) AS rx, sum(w*(t-tb)*(y-yb))/sum(w*(t-tb)*(t-tb)) AS ry FROM p JOIN m USING (match_id, player_id, rn) GROUP BY ALL),
  e AS (SELECT match_id, player_id, rn, 0e0 AS vx, 0e0 AS vy FROM n WHERE rn = 1 UNION ALL
   SELECT v.match_id, v.player_id, v.rn, e.vx * 0.6e0 + v.rx * 0.4e0, e.vy * 0.6e0 + v.ry * 0.4e0 FROM e JOIN v ON v.match_id = e.match_id AND v.player_id = e.player_id AND v.rn = e.rn + 1)
  SELECT match_id, player_id, frame_n, {r4('vx')} AS vpx, {r4('vy')} AS vpy FROM e JOIN n USING (match_id, player_id, rn)""")
def _(t):
    return M.rounded(M.weighted_velocity(t.tracks), "vpx", "vpy").select("match_id", "player_id", "frame_n", "vpx", "vpy")


@query("wn_predict", f"""WITH RECURSIVE p AS (SELECT match_id, player_id, frame_n, px, py, lead(frame_n) OVER w - frame_n AS gap,
   (px - lag(px) OVER w) * 1e0 / (frame_n - lag(frame_n) OVER w) AS v FROM tracks WINDOW w AS ({PW})),
  q AS (SELECT * FROM p WHERE gap > 1 AND v IS NOT NULL),
  r AS (SELECT match_id, player_id, frame_n, gap, least(gap, 6) AS k, px + v * least(gap, 6) AS x, v FROM q
   UNION ALL SELECT match_id, player_id, frame_n, gap, k + 1, x + v * 0.92e0, v * 0.92e0 FROM r WHERE k < gap)
  SELECT match_id, player_id, frame_n, gap, {r4('x')} AS px FROM r WHERE k = gap""")
def _(t):
    from matchloom.plans.ordered import scan

    d = scan(t.tracks, M.KEYS, "frame_n", lag={"pf": F.col("frame_n"), "ppx": F.col("px"), "pf2": F.col("frame_n")})
    d = d.withColumn("v", (F.col("px") - F.col("ppx")) / (F.col("frame_n") - F.col("pf")))
    d = scan(d.select(*M.KEYS, "frame_n", "px", "v"), M.KEYS, "frame_n", lag={"lf": F.col("frame_n"), "lx": F.col("px"), "lv": F.col("v")})
    gap = F.col("frame_n") - F.col("lf")
    d = d.filter((gap > 1) & F.col("lv").isNotNull())
    return d.select(*M.KEYS, F.col("lf").alias("frame_n"), gap.alias("gap"), M.predict(F.col("lx"), F.col("lv"), gap).alias("px")).transform(
        lambda x: M.rounded(x, "px"))


@query("wn_extrapolate", f"""WITH p AS (SELECT match_id, player_id, frame_n, px, py, lead(frame_n) OVER w AS nf, lag(frame_n) OVER w AS pf,
   (px - lag(px) OVER w) * 1e0 / (frame_n - lag(frame_n) OVER w) AS vx, (py - lag(py) OVER w) * 1e0 / (frame_n - lag(frame_n) OVER w) AS vy FROM tracks WINDOW w AS ({PW})),
  g AS (SELECT *, unnest(generate_series(1, nf - frame_n - 1)) AS k, coalesce(frame_n - pf <= 25 AND abs(vx) <= 35 AND abs(vy) <= 35, false) AS ok FROM p WHERE nf - frame_n BETWEEN 2 AND 12)
  SELECT match_id, player_id, frame_n + k AS frame_n, {r4('CASE WHEN ok THEN px + vx * k ELSE px END')} AS px, {r4('CASE WHEN ok THEN py + vy * k ELSE py END')} AS py FROM g""")
def _(t):
    return M.rounded(M.fill_gaps(t.tracks), "px", "py")


@query("al_fatigue", f"""WITH {STEPS()}, p AS (SELECT match_id, player_id, sum(step_m) AS d, count(*) FILTER (speed > 5.5e0) AS s, avg(speed) FILTER (speed > 0) AS v FROM st GROUP BY ALL),
  q AS (SELECT *, CASE WHEN s > 12 THEN 3 WHEN s > 8 THEN 1 ELSE 0 END + CASE WHEN v < 1.2e0 THEN 3 WHEN v < 1.5e0 THEN 1 ELSE 0 END + CASE WHEN d > 45 THEN 2 ELSE 0 END AS score FROM p)
  SELECT match_id, player_id, score, CASE WHEN score >= 4 THEN 'substitute' ELSE 'tired' END AS advice FROM q WHERE score >= 2""")
def _(t):
    from matchloom.operators import alerts as A

    return A.fatigue(M.motion_summary(t.tracks), sprints=(8, 12), distance=45.0)


_nl = "CASE role " + " ".join(f"WHEN '{r}' THEN [{n[0][0]}e0, {n[0][1]}e0, {n[1][0]}e0, {n[1][1]}e0, {n[2][0]}e0, {n[2][1]}e0]" for r, n in P.ROLE_NORMS.items()) + " ELSE [4.8e0, 6.5e0, 12e0, 22e0, 6.8e0, 8.8e0] END"
_c = lambda *arms: "list_filter([" + ", ".join(f"CASE WHEN {w} THEN '{c}' END" for c, w in arms) + "], lambda x: x IS NOT NULL)"
_cmp = lambda v, i: f"(CASE WHEN {v} > n[{i + 1}] * 1.05e0 THEN 'above' WHEN {v} < n[{i}] * 0.9e0 THEN 'below' ELSE 'in range' END)"


@query("ag_player_report", f"""WITH {STEPS()}, {ROLE}, p AS (SELECT match_id, player_id, sum(step_m) * 2e-2 AS km, max(speed) AS top, count(*) FILTER (speed > 5.5e0) // 10 AS ns, count(*) AS frames FROM st GROUP BY ALL),
  q AS (SELECT p.*, coalesce(role, 'CB') AS role, player_id % 7 AS shots, player_id % 7 % 4 AS goals, player_id % 9 AS saves, player_id % 3 AS assists, player_id % 5 AS breaks,
    player_id * 13 % 101 AS stam, player_id % 6 = 1 AS declined FROM p JOIN ro USING (match_id, player_id)),
  r AS (SELECT *, {_nl} AS n, CASE WHEN shots > 0 THEN goals * 1e0 / shots ELSE 0e0 END AS rate FROM q WHERE frames >= 75),
  s AS (SELECT *, {_cmp('km', 1)} AS dr, {_cmp('ns', 3)} AS sr, {_cmp('top', 5)} AS vr FROM r)
  SELECT match_id, player_id,
  {_c(('work_rate', "dr = 'above'"), ('speed', "vr = 'above'"), ('sprint_volume', "sr = 'above'"), ('conversion', 'rate >= 0.35e0 AND shots >= 3'), ('keeping', 'saves >= 5'), ('playmaking', 'assists >= 2'), ('counter_attack', 'breaks >= 3'), ('stamina', 'stam >= 75'))} AS strengths,
  {_c(('movement', "dr = 'below' AND role <> 'GK'"), ('acceleration', "vr = 'below'"), ('finishing', 'shots > 2 AND rate < 0.2e0'), ('sprint_frequency', "sr = 'below' AND role NOT IN ('GK', 'PV')"))} AS improvements,
  {_c(('stamina_critical', 'stam < 25'), ('stamina_warning', 'stam >= 25 AND stam < 45'), ('speed_decline', 'declined'), ('low_top_speed', "km > 0 AND top < 4 AND role <> 'GK'"))} AS alerts,
  {_c(('increase_movement', "dr = 'below' AND role <> 'GK'"), ('explosive_runs', "sr = 'below' AND role NOT IN ('GK', 'PV')"), ('shot_selection', "shots > 3 AND rate < 0.2e0 AND role <> 'GK'"), ('rest', 'stam < 40'), ('sprint_training', "top < n[5] AND role NOT IN ('GK', 'PV')"), ('keeper_untested', "role = 'GK' AND saves = 0 AND shots = 0"))} AS notes FROM s""")
def _(t):
    p = F.col("player_id")
    m = M.motion_summary(t.tracks).select(
        *M.KEYS, (F.col("distance_m") * 0.02).alias("dist_km"), F.col("top_speed").alias("top_ms"),
        F.floor(F.col("sprint_frames") / 10).alias("sprints"), "frames")
    m = m.join(M.roles(t.tracks), M.KEYS).withColumn("role", F.coalesce("role", F.lit("CB")))
    m = m.select("*", (p % 7).alias("shots"), (p % 7 % 4).alias("goals"), (p % 9).alias("saves"), (p % 3).alias("assists"),
                 (p % 5).alias("breaks"), (p * 13 % 101).alias("stamina"), (p % 6 == 1).alias("declined"))
    return M.player_report(m)
