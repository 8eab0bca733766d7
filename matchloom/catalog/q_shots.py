"""Shot and league reports."""

from pyspark.sql import functions as F

from matchloom import params as P
from matchloom.catalog.registry import query, r1
from matchloom.operators import league, shots as S

_in = lambda vs: ", ".join(f"'{v}'" for v in vs)
CLEAN = f"""clean AS (SELECT match_id, frame_n, player_id, gk_id, team, number,
  CASE WHEN zone_raw IN ({_in(P.SHOT_ZONES)}) THEN zone_raw ELSE 'Center Back' END AS zone,
  CASE WHEN cell_raw IN ({_in(P.GOAL_CELLS + P.OFF_TARGET)}) THEN cell_raw ELSE 'CH' END AS cell,
  CASE WHEN upper(outcome_raw) IN ({_in(P.OUTCOMES)}) THEN upper(outcome_raw) ELSE 'GOAL' END AS outcome,
  reaction_ms, x_cm, y_cm FROM shots)"""
DISTANCE = "CASE " + " ".join(f"WHEN zone = '{z}' THEN '{d}'" for z, d in P.ZONE_DISTANCE.items()) + " ELSE '9m' END"


def PCT(a, b):
    return f"CASE WHEN {b} > 0 THEN {r1(f'{a} * 100e0 / {b}')} ELSE 0e0 END"


@query("enum_default", f"WITH {CLEAN} SELECT match_id, frame_n, player_id, zone, cell, outcome FROM clean")
def _(t):
    return S.clean_shots(t.shots).select("match_id", "frame_n", "player_id", "zone", "cell", "outcome")


@query("zone_distance", f"WITH {CLEAN} SELECT zone, {DISTANCE} AS distance, count(*) AS n FROM clean GROUP BY ALL")
def _(t):
    s = S.clean_shots(t.shots)
    return s.groupBy("zone", S.zone_distance(F.col("zone")).alias("distance")).agg(F.count(F.lit(1)).alias("n"))


def _grid_sql(actor, hit):
    dims = " UNION ALL ".join(f"SELECT '{z}' AS zone" for z in P.SHOT_ZONES)
    cells = " UNION ALL ".join(f"SELECT '{c}' AS cell" for c in P.GOAL_CELLS)
    off = " UNION ALL ".join(f"SELECT '{c}' AS cell" for c in P.OFF_TARGET)
    return f"""WITH {CLEAN}, a AS (SELECT DISTINCT {actor} FROM clean), z AS ({dims}), c AS ({cells}), o AS ({off})
    SELECT a.{actor}, z.zone, c.cell, count(*) FILTER (clean.outcome = '{hit}') AS hits, count(clean.cell) AS total
    FROM a, z, c LEFT JOIN clean ON clean.{actor} = a.{actor} AND clean.zone = z.zone AND clean.cell = c.cell GROUP BY ALL
    UNION ALL
    SELECT a.{actor}, '*', c.cell, count(*) FILTER (clean.outcome = '{hit}'), count(clean.cell)
    FROM a, (SELECT * FROM c UNION ALL SELECT * FROM o) c
    LEFT JOIN clean ON clean.{actor} = a.{actor} AND clean.cell = c.cell GROUP BY ALL"""


@query("ag_shot_grid", _grid_sql("player_id", "GOAL"))
def _(t):
    return S.dense_grid(S.clean_shots(t.shots), ["player_id"], "GOAL")


@query("ag_save_grid", _grid_sql("gk_id", "SAVE"))
def _(t):
    return S.dense_grid(S.clean_shots(t.shots), ["gk_id"], "SAVE")


@query("ag_shooters", f"""WITH {CLEAN} SELECT player_id, team, count(*) AS shots,
  count(*) FILTER (outcome = 'GOAL') AS goals, arg_min(number, (match_id, frame_n, number)) AS number
  FROM clean GROUP BY ALL""")
def _(t):
    return S.shooters(S.clean_shots(t.shots)).orderBy(F.desc("shots"), "player_id")


@query("ag_keepers", f"""WITH {CLEAN} SELECT gk_id, count(*) AS faced, count(*) FILTER (outcome = 'SAVE') AS saves
  FROM clean GROUP BY ALL""")
def _(t):
    return S.keepers(S.clean_shots(t.shots))


_by = ", ".join(
    f"count(*) FILTER ({DISTANCE} = '{d}') AS shots_{d}, count(*) FILTER ({DISTANCE} = '{d}' AND outcome = 'GOAL') AS goals_{d}"
    for d in ("6m", "7m", "9m")
)
_out = ", ".join(f"count(*) FILTER (outcome = '{o}') AS n_{o.lower()}" for o in P.OUTCOMES)


@query("ag_shot_report", f"""WITH {CLEAN} SELECT player_id, team, count(*) AS shots,
  count(*) FILTER (outcome = 'GOAL') AS goals, {_by}, {_out},
  {PCT("count(*) FILTER (outcome = 'GOAL')", 'count(*)')} AS efficiency FROM clean GROUP BY player_id, team""")
def _(t):
    return S.shot_report(S.clean_shots(t.shots))


@query("ag_save_report", f"""WITH {CLEAN}, c AS ({' UNION ALL '.join(f"SELECT '{c}' AS cell" for c in P.GOAL_CELLS)}),
  k AS (SELECT gk_id, count(*) AS faced, count(*) FILTER (outcome = 'SAVE') AS saves FROM clean GROUP BY 1),
  g AS (SELECT gk_id, cell, count(*) AS n, count(*) FILTER (outcome = 'SAVE') AS s FROM clean GROUP BY ALL)
  SELECT k.gk_id, c.cell, coalesce(s, 0) AS cell_saves, coalesce(n, 0) AS cell_shots,
  {PCT('coalesce(s, 0)', 'coalesce(n, 0)')} AS cell_pct, faced, saves, {PCT('saves', 'faced')} AS save_pct
  FROM k, c LEFT JOIN g ON g.gk_id = k.gk_id AND g.cell = c.cell""")
def _(t):
    return S.save_report(S.clean_shots(t.shots))


@query("ag_shot_team", f"""WITH {CLEAN} SELECT team, NULL AS zone, outcome, CAST(1 AS BIGINT) AS gz, count(*) AS total,
  count(*) FILTER (outcome = 'GOAL') AS goals FROM clean GROUP BY team, outcome
  UNION ALL SELECT team, zone, NULL, CAST(0 AS BIGINT), count(*), count(*) FILTER (outcome = 'GOAL') FROM clean GROUP BY team, zone""")
def _(t):
    return S.team_summary(S.clean_shots(t.shots))


_cells = ", ".join(f"count(*) FILTER (cell = '{c}') AS cell_{c.lower()}" for c in P.GOAL_CELLS)


@query("ag_gk_log", f"""WITH {CLEAN} SELECT gk_id, count(*) AS shots, count(*) FILTER (outcome = 'SAVE') AS saves,
  count(*) FILTER (outcome = 'GOAL') AS conceded, count(*) - count(*) FILTER (outcome = 'SAVE') AS conceded_all,
  {PCT("count(*) FILTER (outcome = 'SAVE')", 'count(*)')} AS save_rate,
  floor(CAST(sum(reaction_ms) AS BIGINT) * 10e0 / count(reaction_ms) + 0.5e0) / 10e0 AS mean_reaction_ms, {_cells}
  FROM clean GROUP BY gk_id""")
def _(t):
    return S.keeper_log(S.clean_shots(t.shots))


@query("wn_gk_rate", f"""WITH {CLEAN}, per AS (SELECT gk_id, match_id, count(*) AS n,
    count(*) FILTER (outcome = 'SAVE') AS s FROM clean GROUP BY ALL),
  c AS (SELECT gk_id, match_id, CAST(sum(n) OVER w AS BIGINT) AS shots_so_far, CAST(sum(s) OVER w AS BIGINT) AS saves_so_far
  FROM per WINDOW w AS (PARTITION BY gk_id ORDER BY match_id))
  SELECT *, {PCT('saves_so_far', 'shots_so_far')} AS save_rate FROM c""")
def _(t):
    return league.running_save_rate(S.clean_shots(t.shots))


@query("jn_upsert_stats", f"""WITH {CLEAN} SELECT player_id, match_id, count(*) AS shots,
  count(*) FILTER (outcome = 'GOAL') AS goals, count(*) FILTER (outcome = 'SAVE') AS saved FROM clean GROUP BY ALL""")
def _(t):
    return league.player_match_stats(S.clean_shots(t.shots))


@query("ag_career", f"""WITH {CLEAN} SELECT player_id, any_value(p.player_name) AS player_name, count(c.player_id) AS shots,
  count(*) FILTER (outcome = 'GOAL') AS goals, count(DISTINCT match_id) AS matches
  FROM players p LEFT JOIN clean c USING (player_id) GROUP BY player_id""")
def _(t):
    return league.career(league.player_match_stats(S.clean_shots(t.shots)), t.players)


@query("src_league", f"""WITH {CLEAN} SELECT competition_name, club_name, count(*) AS shots,
  count(*) FILTER (outcome = 'GOAL') AS goals
  FROM clean JOIN players USING (player_id) JOIN clubs USING (club_id) JOIN competitions USING (competition_id)
  GROUP BY ROLLUP (competition_name, club_name)""")
def _(t):
    return league.rollup(league.player_match_stats(S.clean_shots(t.shots)), t.players, t.clubs, t.competitions)


@query("jn_roster", """SELECT s.match_id, s.frame_n, s.player_id, club_name, p.number,
  coalesce(player_name, '#' || CAST(s.number AS VARCHAR)) AS label
  FROM shots s LEFT JOIN players p ON p.player_id = s.player_id AND p.number = s.number LEFT JOIN clubs USING (club_id)""")
def _(t):
    return league.label_from_roster(t.shots, t.players, t.clubs)


@query("jn_find_number", "SELECT p.number, club_id, min(player_id) AS player_id, count(*) AS candidates FROM players p GROUP BY ALL")
def _(t):
    return league.find_by_number(t.players)


@query("so_roster", "SELECT club_id, number, player_id, player_name FROM players ORDER BY club_id, number, player_id")
def _(t):
    return t.players.select("club_id", "number", "player_id", "player_name").orderBy("club_id", "number", "player_id")


@query("jn_get_or_create", """WITH asked AS (SELECT DISTINCT upper(c_name) AS asked_name, CAST(c_nationkey AS BIGINT) AS club_id FROM customer),
  known AS (SELECT player_id, upper(replace(player_name, 'Supplier', 'Customer')) AS k, club_id FROM players),
  hit AS (SELECT a.asked_name, a.club_id, min(player_id) AS player_id FROM asked a JOIN known ON k = asked_name AND known.club_id = a.club_id GROUP BY ALL)
  SELECT a.asked_name, a.club_id, h.player_id, h.player_id IS NULL AS created FROM asked a LEFT JOIN hit h USING (asked_name, club_id)""")
def _(t):
    asked = t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("bigint").alias("club_id"))
    known = t.players.select("player_id", F.regexp_replace("player_name", "Supplier", "Customer").alias("name"), "club_id")
    return league.get_or_create(asked, known)


@query("jn_compare", f"""WITH {CLEAN}, s AS (SELECT player_id, count(*) AS shots, count(*) FILTER (outcome = 'GOAL') AS goals FROM clean GROUP BY 1)
  SELECT s.*, {PCT('goals', 'shots')} AS performance FROM s WHERE player_id IN (SELECT player_id FROM players WHERE bal > 4000)
  ORDER BY performance DESC, player_id""")
def _(t):
    ids = t.players.filter(F.col("bal") > 4000).select("player_id")
    return league.compare_players(S.shooters(S.clean_shots(t.shots)), ids)


@query("flt_shot_map", """SELECT event_id, event_type, team, x_cm, y_cm FROM match_events
  WHERE event_type IN ('goal', 'shot', 'save', 'fast_break') AND x_cm IS NOT NULL AND y_cm IS NOT NULL""")
def _(t):
    return t.match_events.filter(
        F.col("event_type").isin("goal", "shot", "save", "fast_break") & F.col("x_cm").isNotNull() & F.col("y_cm").isNotNull()
    ).select("event_id", "event_type", "team", "x_cm", "y_cm")
