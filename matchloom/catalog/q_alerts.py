"""Positional alert rules with their cooldowns."""

from pyspark.sql import functions as F

from matchloom.catalog.q_motion import greedy
from matchloom.catalog.q_shape import HOLE, LINES, near_holder
from matchloom.catalog.registry import query
from matchloom.operators import alerts as A, shape as S


def alert(name, pre, marks, keys, gap):
    return query(name, greedy(pre, marks, keys, gap) + f" SELECT {', '.join(keys)}, frame_n FROM k")


def lines(t):
    return S.ball_lines(t.tracks, near_holder(t))


@alert("al_role_drift", "ro AS (SELECT DISTINCT match_id, player_id, CASE slot % 6 WHEN 1 THEN 'RW' WHEN 2 THEN 'LW' ELSE 'CB' END AS role FROM tracks)", "SELECT match_id, player_id, role, frame_n FROM tracks JOIN ro USING (match_id, player_id) WHERE (role = 'RW' AND y_cm > 900) OR (role = 'LW' AND y_cm < 1100)", ["match_id", "player_id", "role"], 375)
def _(t):
    slot = F.col("slot") % 6
    role = F.when(slot == 1, "RW").when(slot == 2, "LW").otherwise("CB")
    return A.role_drift(t.tracks, t.tracks.select("match_id", "player_id", role.alias("role")).distinct())


@alert("al_too_many", "z AS (SELECT 1)", "SELECT match_id, team, frame_n FROM tracks GROUP BY ALL HAVING count(*) > 6", ["match_id", "team"], 100)
def _(t):
    return A.too_many(t.tracks, limit=6)


_six = lambda g: f"(CASE WHEN y_cm < 850 THEN sqrt((x_cm-{g})*(x_cm-{g})+(y_cm-850)*(y_cm-850)) WHEN y_cm > 1150 THEN sqrt((x_cm-{g})*(x_cm-{g})+(y_cm-1150)*(y_cm-1150)) ELSE abs(x_cm-{g}) END <= 600)"


@alert("al_6m", "z AS (SELECT 1)", f"SELECT match_id, player_id, frame_n FROM tracks WHERE CASE WHEN team = 'team_a' THEN {_six(4000)} ELSE {_six(0)} END", ["match_id", "player_id"], 50)
def _(t):
    return A.area_violation(t.tracks)


@alert("al_fast_break", LINES, "SELECT match_id, team, frame_n FROM li WHERE ahead > between + 1", ["match_id", "team"], 75)
def _(t):
    return A.break_chance(lines(t))


@alert("al_numbers", """n AS (SELECT match_id, frame_n, count(*) FILTER (team = 'team_a' AND x_cm > 2000) - count(*) FILTER (team = 'team_b' AND x_cm > 2000) AS da, count(*) FILTER (team = 'team_b' AND x_cm < 2000) - count(*) FILTER (team = 'team_a' AND x_cm < 2000) AS db FROM tracks GROUP BY ALL),
  r AS (SELECT match_id, frame_n, 'team_a' AS team, da AS d FROM n UNION ALL SELECT match_id, frame_n, 'team_b', db FROM n)""",
       "SELECT match_id, team, CASE WHEN d > 0 THEN 'superiority' ELSE 'inferiority' END AS kind, frame_n FROM r WHERE abs(d) >= 2", ["match_id", "team", "kind"], 100)
def _(t):
    return A.numbers(t.tracks)


@alert("al_goal_open", LINES, "SELECT match_id, team, frame_n FROM li WHERE lane = 0 AND abs(CASE WHEN team = 'team_a' THEN 4000 - bx_cm ELSE bx_cm END) < 900", ["match_id", "team"], 50)
def _(t):
    return A.goal_open(lines(t))


@alert("al_hole", f"{LINES}, {HOLE}", "SELECT DISTINCT ho.match_id, ho.team, CAST(floor(mid_cm / 100) AS BIGINT) AS at_m, ho.frame_n FROM ho JOIN li ON li.match_id = ho.match_id AND li.frame_n = ho.frame_n AND li.team <> ho.team", ["match_id", "team", "at_m"], 125)
def _(t):
    return A.holes(S.lateral_holes(t.tracks), lines(t))


_wing = lambda y, d, mine: f"count(*) FILTER (t.team {'=' if mine else '<>'} li.team AND abs(y_cm - {y}) < {d})"


@alert("al_wing_open", f"""{LINES}, w AS (SELECT li.match_id, li.frame_n, {_wing(200, 300, False)} AS dr, {_wing(200, 400, True)} AS ar, {_wing(1800, 300, False)} AS dl, {_wing(1800, 400, True)} AS al
  FROM li JOIN tracks t ON t.match_id = li.match_id AND t.frame_n = li.frame_n GROUP BY ALL)""",
       "SELECT match_id, 'right' AS wing, frame_n FROM w WHERE dr = 0 AND ar > 0 UNION ALL SELECT match_id, 'left', frame_n FROM w WHERE dl = 0 AND al > 0", ["match_id", "wing"], 100)
def _(t):
    return A.wing_open(t.tracks, lines(t))


@alert("al_pivot_free", LINES, f"""SELECT DISTINCT a.match_id, a.team, a.frame_n FROM tracks a JOIN li ON li.match_id = a.match_id AND li.frame_n = a.frame_n AND li.team = a.team
  WHERE CASE WHEN a.team = 'team_a' THEN {_six(4000)} ELSE {_six(0)} END AND NOT EXISTS (SELECT 1 FROM tracks b WHERE b.match_id = a.match_id AND b.frame_n = a.frame_n AND b.team <> a.team
  AND (a.x_cm-b.x_cm)*(a.x_cm-b.x_cm)+(a.y_cm-b.y_cm)*(a.y_cm-b.y_cm) < 22500)""", ["match_id", "team"], 75)
def _(t):
    return A.pivot_free(t.tracks, lines(t))


@query("al_recent", """SELECT event_id, match_id, team, event_type FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY seq DESC) AS r FROM match_events
  WHERE event_type IN ('foul', 'passive_warning', 'fast_break')) WHERE r <= 10""")
def _(t):
    from matchloom.operators.events import kind, newest

    return newest(t.match_events.filter(kind("foul", "passive_warning", "fast_break")), 10).select("event_id", "match_id", "team", "event_type")


@alert("wn_debounce", "z AS (SELECT 1)", "SELECT match_id, team, event_type, frame_n FROM match_events", ["match_id", "team", "event_type"], 150)
def _(t):
    return A.raised(t.match_events, ["match_id", "team", "event_type"], 150)
