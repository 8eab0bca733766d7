"""Ball holder, possession, passes and ball quality."""

from pyspark.sql import functions as F

from matchloom.catalog.registry import query, r1, r4
from matchloom.operators import possession as B
from matchloom.operators.motion import rounded

NEAR = """near AS (SELECT b.match_id, b.frame_n, arg_min(player_id, (d2, player_id)) AS player_id, arg_min(team, (d2, player_id)) AS team, min(d2) AS d2, any_value(bpx) AS bpx, any_value(bpy) AS bpy
   FROM (SELECT b.*, t.player_id, t.team, (px - bpx) * (px - bpx) + (py - bpy) * (py - bpy) AS d2 FROM {ball} b JOIN tracks t ON t.match_id = b.match_id AND t.frame_n = b.frame_n WHERE bpx IS NOT NULL) b
   WHERE d2 < {r2} GROUP BY ALL)"""


@query("jn_nearest_ball", f"WITH {NEAR.format(ball='ball', r2=22500)} SELECT match_id, frame_n, player_id, team, d2 FROM near")
def _(t):
    return B.nearest_player(t.tracks, t.ball, 150.0).select("match_id", "frame_n", "player_id", "team", "d2")


VALID = "vb AS (SELECT * FROM ball WHERE bpx IS NOT NULL AND bw_px <= 150 AND bh_px <= 150 AND bw_px * 1e0 / bh_px BETWEEN 0.4e0 AND 2.5e0)"
BSTEP = f"""{VALID}, bl AS (SELECT *, lag(bpx) OVER w AS lx, lag(bpy) OVER w AS ly, lag(frame_n) OVER w AS lf FROM vb WINDOW w AS (PARTITION BY match_id ORDER BY frame_n)),
  bs AS (SELECT *, sqrt((bpx-lx)*(bpx-lx)+(bpy-ly)*(bpy-ly)) AS raw, CASE WHEN sqrt((bpx-lx)*(bpx-lx)+(bpy-ly)*(bpy-ly)) <= 300 THEN sqrt((bpx-lx)*(bpx-lx)+(bpy-ly)*(bpy-ly)) END AS step FROM bl)"""
HOLD = f"{BSTEP}, {NEAR.format(ball='vb', r2=22500)}, hold AS (SELECT near.*, step FROM near JOIN bs USING (match_id, frame_n))"
TOUCH = f"""{HOLD}, h1 AS (SELECT *, CASE WHEN lag(team) OVER w IS DISTINCT FROM team THEN 1 ELSE 0 END AS st FROM hold WINDOW w AS (PARTITION BY match_id ORDER BY frame_n)),
  h2 AS (SELECT *, sum(st) OVER (PARTITION BY match_id ORDER BY frame_n) AS run FROM h1),
  h3 AS (SELECT *, row_number() OVER (PARTITION BY match_id, run ORDER BY frame_n) AS pos, count(*) OVER (PARTITION BY match_id, run) AS n FROM h2),
  ru AS (SELECT match_id, run, any_value(team) AS t, any_value(n) AS n FROM h3 GROUP BY ALL),
  rh AS (SELECT match_id, run, last_value(CASE WHEN n >= 6 THEN t END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM ru),
  touch AS (SELECT h3.*, held FROM h3 JOIN rh USING (match_id, run)), act AS (SELECT * FROM touch WHERE pos >= 6 OR (pos = 1 AND held = team))"""
PASS = f"""{TOUCH}, pl AS (SELECT *, lag(player_id) OVER (PARTITION BY match_id ORDER BY frame_n) AS from_id FROM act),
  ps AS (SELECT match_id, frame_n, team, from_id, player_id AS to_id, step FROM pl WHERE from_id <> player_id AND step > 8)"""


@query("wn_possession", f"WITH {TOUCH} SELECT match_id, frame_n, team, player_id, coalesce(held, 'none') AS from_team FROM touch WHERE pos = 6 AND held IS DISTINCT FROM team")
def _(t):
    return B.possession_changes(B.touches(B.holders(t.tracks, t.ball)))


@query("wn_pass", f"WITH {PASS} SELECT match_id, frame_n, team, from_id, to_id, {r4('step')} AS step FROM ps")
def _(t):
    return rounded(B.passes(B.touches(B.holders(t.tracks, t.ball))), "step")


@query("ag_pass_network", f"WITH {PASS} SELECT match_id, team, from_id, to_id, count(*) AS passes FROM ps GROUP BY ALL")
def _(t):
    return B.pass_network(B.passes(B.touches(B.holders(t.tracks, t.ball))))


CHAIN = f"""{TOUCH}, c1 AS (SELECT *, CASE WHEN lag(team) OVER w IS DISTINCT FROM team THEN 1 ELSE 0 END AS cs, CASE WHEN lag(team) OVER w IS DISTINCT FROM team OR lag(player_id) OVER w IS DISTINCT FROM player_id THEN 1 ELSE 0 END AS ts
    FROM act WINDOW w AS (PARTITION BY match_id ORDER BY frame_n)),
  c2 AS (SELECT *, CAST(sum(cs) OVER (PARTITION BY match_id ORDER BY frame_n) AS BIGINT) AS chain FROM c1),
  c3 AS (SELECT match_id, chain, team, player_id, frame_n, row_number() OVER (PARTITION BY match_id, chain ORDER BY frame_n DESC) AS back FROM c2 WHERE ts = 1),
  ch AS (SELECT match_id, chain, any_value(team) AS team, list(player_id ORDER BY frame_n) AS players FROM c3 WHERE back <= 12 GROUP BY match_id, chain)"""


@query("wn_chain", f"WITH {CHAIN} SELECT match_id, chain, team, players FROM ch")
def _(t):
    return B.chains(B.touches(B.holders(t.tracks, t.ball)))


@query("wn_chain_assist", f"""WITH {CHAIN}, s AS (SELECT *, CASE WHEN chain % 3 = 0 THEN match_id * 14 + 3 ELSE players[len(players)] END AS shooter FROM ch)
  SELECT match_id, chain, shooter, CASE WHEN list_position(players, shooter) > 1 THEN players[list_position(players, shooter) - 1]
   WHEN coalesce(list_position(players, shooter), 0) = 0 AND len(players) >= 2 THEN players[len(players) - 1] END AS assist FROM s""")
def _(t):
    c = B.chains(B.touches(B.holders(t.tracks, t.ball)))
    c = c.withColumn("shooter", F.when(F.col("chain") % 3 == 0, F.col("match_id") * 14 + 3).otherwise(F.element_at("players", -1)))
    return c.select("match_id", "chain", "shooter", B.chain_assist(F.col("players"), F.col("shooter")).alias("assist"))


@query("wn_ball_reset", f"""WITH {BSTEP} SELECT match_id, frame_n, CAST(sum(CASE WHEN raw > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame_n) AS BIGINT) AS part FROM bs""")
def _(t):
    from matchloom.plans.ordered import scan

    d = scan(B.ball_steps(t.ball), ["match_id"], "frame_n", sums={"part": F.col("jump").cast("bigint")})
    return d.select("match_id", "frame_n", "part")


@query("wn_ball_speed", f"""WITH {BSTEP}, p AS (SELECT *, sum(CASE WHEN raw > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame_n) AS part FROM bs),
  q AS (SELECT *, lag(bpx, 2) OVER w AS x2, lag(bpy, 2) OVER w AS y2, lag(frame_n, 2) OVER w AS f2 FROM p WINDOW w AS (PARTITION BY match_id, part ORDER BY frame_n))
  SELECT match_id, frame_n, {r4('sqrt((bpx-x2)*(bpx-x2)+(bpy-y2)*(bpy-y2)) / greatest(frame_n - f2, 1)')} AS speed FROM q""")
def _(t):
    return rounded(B.ball_speed(t.ball), "speed").select("match_id", "frame_n", "speed")


@query("wn_ball_fill", f"""WITH RECURSIVE {BSTEP}, v AS (SELECT match_id, frame_n, bpx, bpy, CASE WHEN step IS NOT NULL THEN (bpx - lx) * 1e0 / (frame_n - lf) END AS vx,
    CASE WHEN step IS NOT NULL THEN (bpy - ly) * 1e0 / (frame_n - lf) END AS vy FROM bs),
  r AS (SELECT match_id, frame_n + 1 AS frame_n, bpx + vx * 0.85e0 AS x, bpy + vy * 0.85e0 AS y, vx * 0.85e0 AS vx, vy * 0.85e0 AS vy FROM v WHERE vx IS NOT NULL
    AND EXISTS (SELECT 1 FROM ball b WHERE b.match_id = v.match_id AND b.frame_n = v.frame_n + 1 AND b.bpx IS NULL)
   UNION ALL SELECT r.match_id, r.frame_n + 1, x + r.vx * 0.85e0, y + r.vy * 0.85e0, r.vx * 0.85e0, r.vy * 0.85e0 FROM r JOIN ball b ON b.match_id = r.match_id AND b.frame_n = r.frame_n + 1 AND b.bpx IS NULL)
  SELECT match_id, frame_n, {r4('x + 1e-7')} AS bpx, {r4('y + 1e-7')} AS bpy FROM r WHERE abs(vx) >= 0.5e0 OR abs(vy) >= 0.5e0""")
def _(t):
    d = B.ball_fill(t.ball)  # powers of 0.85 end in 5: the nudge keeps both engines on one side of a tie
    return rounded(d.withColumn("bpx", F.col("bpx") + 1e-7).withColumn("bpy", F.col("bpy") + 1e-7), "bpx", "bpy")


@query("flt_ball_valid", f"""WITH {BSTEP}, m AS (SELECT *, row_number() OVER w AS rn, coalesce(raw, 1e9) >= 2 AS moved FROM bs WINDOW w AS (PARTITION BY match_id ORDER BY frame_n)),
  k AS (SELECT *, rn - max(CASE WHEN moved THEN rn END) OVER (PARTITION BY match_id ORDER BY frame_n) AS still_for FROM m)
  SELECT match_id, frame_n, bpx, bpy FROM k WHERE NOT still_for > 6""")
def _(t):
    return B.still_rows(t.ball, limit=6).filter("not rejected").select("match_id", "frame_n", "bpx", "bpy")


@query("flt_trust", """WITH n AS (SELECT match_id, frame_n, state, row_number() OVER w AS rn FROM ball WINDOW w AS (PARTITION BY match_id ORDER BY frame_n)),
  s AS (SELECT *, rn - coalesce(max(CASE WHEN state <> 'phantom' THEN rn END) OVER (PARTITION BY match_id ORDER BY rn), 0) AS streak FROM n)
  SELECT match_id, frame_n, state FROM s WHERE streak <= 1""")
def _(t):
    return B.trusted(t.ball, limit=1).select("match_id", "frame_n", "state")


@query("flt_play_frame", """SELECT event_id, match_id, frame_n, event_type FROM match_events e
  WHERE EXISTS (SELECT 1 FROM ball b WHERE b.match_id = e.match_id AND b.frame_n = e.frame_n AND state <> 'lost')""")
def _(t):
    play = t.ball.filter(F.col("state") != "lost").select("match_id", "frame_n")
    return t.match_events.join(play, ["match_id", "frame_n"], "left_semi").select("event_id", "match_id", "frame_n", "event_type")


@query("flt_ball_box", "SELECT match_id, frame_n, cand, w * h AS area FROM candidates WHERE w * h BETWEEN 60 AND 500 AND w * 1e0 / h BETWEEN 1e0 / 1.9e0 AND 1.9e0")
def _(t):
    ratio, area = F.col("w") / F.col("h"), F.col("w") * F.col("h")
    return t.candidates.filter(area.between(60, 500) & ratio.between(1.0 / 1.9, 1.9)).select("match_id", "frame_n", "cand", area.alias("area"))


@query("wn_lost_streak", f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame_n) - row_number() OVER (PARTITION BY match_id, state = 'lost' ORDER BY frame_n) AS g FROM ball),
  s AS (SELECT match_id, count(*) AS n FROM g WHERE state = 'lost' GROUP BY match_id, g) SELECT match_id, count(*) AS streaks, max(n) AS longest, {r4('avg(n)')} AS mean FROM s GROUP BY 1""")
def _(t):
    return rounded(B.streaks(t.ball, "lost").groupBy("match_id").agg(
        F.count(F.lit(1)).alias("streaks"), F.max("frames").alias("longest"), F.avg("frames").alias("mean")), "mean")


_sh = lambda c: r1(f"100e0 * count(*) FILTER ({c}) / count(*)")


@query("ag_ball_states", f"""WITH c AS (SELECT match_id, frame_n, count(*) AS c FROM candidates GROUP BY ALL), d AS (SELECT b.match_id, state, least(coalesce(c, 0), 5) AS c FROM ball b LEFT JOIN c USING (match_id, frame_n))
  SELECT match_id, count(*) AS frames, {_sh("state = 'real'")} AS real_pct, {_sh("state = 'phantom'")} AS phantom_pct, {_sh("state = 'lost'")} AS lost_pct,
  {', '.join(f'count(*) FILTER (c = {k}) AS with_{k}' for k in range(6))}, {_sh('c = 0')} AS none_pct FROM d GROUP BY 1""")
def _(t):
    return B.state_shares(t.ball, t.candidates)


@query("wn_dribble", f"""WITH {HOLD}, a AS (SELECT *, CASE WHEN lag(player_id) OVER w IS DISTINCT FROM player_id THEN 1 ELSE 0 END AS st FROM hold WINDOW w AS (PARTITION BY match_id ORDER BY frame_n)),
  b AS (SELECT *, sum(st) OVER (PARTITION BY match_id ORDER BY frame_n) AS run FROM a), c AS (SELECT *, nullif(sign(bpy - lag(bpy) OVER w), 0) AS s FROM b WINDOW w AS (PARTITION BY match_id, run ORDER BY frame_n)),
  d AS (SELECT *, coalesce(lag(s) OVER w = -s, false) AS flip FROM c WINDOW w AS (PARTITION BY match_id, run ORDER BY frame_n)),
  g AS (SELECT match_id, run, any_value(player_id) AS player_id, min(frame_n) AS start_frame, max(frame_n) AS end_frame, count(*) AS n, count(*) FILTER (flip) AS flips, max(bpy) - min(bpy) AS amp,
    arg_min(bpx, frame_n) AS x1, arg_min(bpy, frame_n) AS y1, arg_max(bpx, frame_n) AS x2, arg_max(bpy, frame_n) AS y2 FROM d GROUP BY match_id, run)
  SELECT match_id, player_id, start_frame, end_frame, n, flips, amp FROM g WHERE n >= 8 AND flips >= 2 AND amp >= 9 AND (x1-x2)*(x1-x2)+(y1-y2)*(y1-y2) >= 1600""")
def _(t):
    return B.dribbles(B.holders(t.tracks, t.ball))
